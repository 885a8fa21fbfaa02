"""Operator 11 against a plain shortest-edit search."""
import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from conftest import SF

from tenurelens.llm import conversations
from tenurelens.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    """Rows (conv_id, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        action = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if action == 0:
            continue
        text = "" if action == 1 else re.sub("[.!?]", "", text) if action == 2 else text
        out += [(conv, turn, "user" if action == 4 else role, text)] * (2 if action == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines): least (cost, audit) over a best-first walk of all
    edits; ``rows`` are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        go = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for role in ("user", "assistant"):
            if role[0] in go:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*lines, f"{role}:")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
        if fault in ("blank", "duplicate"):
            continue
        extra = 5 * (fault == "truncated")
        if role[:1] and role[:1] in go:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
        for new in ("user", "assistant"):
            if new[0] in go:
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))


def brute(rows, ids):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)

    def key(conv, row):
        shown = [" " if conv is None else str(conv), row[2], row[3]]
        return (row[1] is not None, row[1] or 0, hashlib.sha256("".join(f"{len(x)}:{x}" for x in shown).encode()).digest())

    out = []
    for conv in set(ids):
        mine = sorted(groups[conv], key=lambda r: key(conv, r))
        turns = [r[1] for r in mine if r[1] is not None]
        seen, marks = set(), []
        for _, _, role, text in mine:
            core = text.strip(SPACE)
            fault = ("blank" if not core else "duplicate" if (role, text) in seen
                     else "truncated" if core[-1] not in ".!?" else None)
            seen.add((role, text))
            marks.append((role, text, fault))
        count = lambda f: sum(m[2] == f for m in marks)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
        cost, audit, lines = cheapest(marks)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_conversation_repair"](spark, SF)) == brute(damaged(rows), [r[0] for r in rows])


def odd_rows(seed, n):
    """Nulls, ties, repeated rows and a conversation with a third of all rows."""
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?  \n", "cut off", "", " \t", None, "é.", "one\ntwo.", "long " * 50 + "."]
    roles = ["user", "assistant", "system", "User", "", None, "u", "agent"]
    rows = []
    for _ in range(n):
        conv = rnd.choice([None, 1, 1, 1, *range(2, 12), 2**62])
        rows.append((conv, rnd.choice([None, rnd.randrange(-3, 40)]), rnd.choice(roles[:3] * 4 + roles), rnd.choice(texts)))
    return rows + rows[:10]


def test_repair_odd_rows(spark, monkeypatch):
    schema = "conv_id long, turn long, role string, text string, same string, audit string, n long, `a.b` string"
    for seed, block in ((1, 32), (2, 3), (3, 1)):
        monkeypatch.setattr(conversations, "BLOCK", block)
        rows = odd_rows(seed, 150)
        df = spark.createDataFrame([(*r, "s", "a", 1, "d") for r in rows], schema).repartition(5)
        done = conversations.damage(df)
        assert sorted(map(tuple, done.collect()), key=str) == sorted(damaged(rows), key=str)
        assert got(conversations.repair(done, df)) == brute(damaged(rows), [r[0] for r in rows])
        assert got(conversations.repair(df, df)) == brute(
            [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], [r[0] for r in rows])


def test_repair_empty_and_dropped(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(none), none).count() == 0
    ids = spark.createDataFrame([(1,), (None,)], "conv_id long")
    empty = hashlib.sha256().hexdigest()
    assert got(conversations.repair(none, ids)) == [(1, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]


def test_search_equals_the_walk_over_all_edits():
    rnd = random.Random(3)
    names = {None: "x", conversations.SYSTEM: "s", conversations.USER: "u", conversations.ASSISTANT: "a", conversations.GONE: "u"}
    for _ in range(2000):
        marks = [rnd.choice([(r, t, 1) for r in (None, 1, 2, 3) for t in (False, False, True)] + [(conversations.GONE, False, 1)])
                 for _ in range(rnd.randrange(12))]
        rows = [(names[r], "t", "blank" if r == conversations.GONE else "truncated" if t else None) for r, t, _ in marks]
        found = conversations.search(marks, conversations.START, (conversations.START, conversations.ASSISTANT))
        assert list(found.values()) == [cheapest(rows)[:2]]
