"""Repair of conversation structure by depth-first branch and bound.

The rows of a conversation, by turn, become a sequence of roles that must read
``(s?(ua)+)?`` (initials of system, user, assistant) at the least cost of
edits: keep 0, rerole 1, delete 2 (required for blank and repeated rows),
insert an empty turn 5, and 5 more for a truncated row that stays.  Of equally
cheap edits the ASCII-least string of their initials is the answer.

``search`` walks prefixes of edits from an explicit stack.  A node is (rows
used, role written last); per node a table keeps the best (cost, audit) that
reached it, and worse prefixes are dropped.  Suffix lower bounds (cheapest edit
of every row left, plus one for neighbours whose roles cannot follow each
other, each row counted once) cut prefixes that cannot beat the incumbent (cost, audit).
The search ends when no prefix is left, so its incumbent is proved.

One conversation may hold a third of all rows.  Its rows travel as marks of a
few bytes, equal rows of a turn as one mark with a number, sorted by range, so
that a long conversation spreads over many tasks.  They are searched ``BLOCK``
marks at a time, from every role before the block to every role after it, and
the blocks of a conversation are joined in order, again by a table of the best
(cost, audit) per role.  Texts are shuffled once, for the digest of the
repaired conversation, which one task can only compute in order; it streams
them with a constant state.

Cases: null conv_id is a conversation of its own; null turns come first; a null
role or text is one space; rows of one turn come in the order of the SHA-256
digests of role and text (equal rows lie together); a conversation without rows
has zeros, an empty audit and the digest of the empty text; an empty table
gives an empty result.  Columns of other names are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

BLOCK = 32  # marks searched at once: the search is exponential at worst, some milliseconds for so many
_SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
_ROLE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_ENDS = (START, ASSISTANT)
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # what a rerole or an insert writes
_REACH = {START: (START, SYSTEM, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT),
          ASSISTANT: (USER, ASSISTANT)}

# A mark: (role or None, truncated, rows). ``rows`` > 0 with role -1: that many deletions.
GONE = -1


# ---------------------------------------------------------------------------
# the search
# ---------------------------------------------------------------------------
def suffix_bounds(marks: list[tuple[int | None, bool, int]], ends: tuple[int, ...] | None) -> list[list[int]]:
    """``[i][role]``: least cost of the edits of ``marks[i:]`` after ``role``,
    from below; the last place stands for a role that is not known.

    Every row costs its cheapest edit.  Neighbours whose roles cannot follow
    each other cost at least one more: an edit of the later, an insert, or a
    truncated row kept between them.  After such a pair, and after a row
    without a role, the role is taken as not known, so that nothing is counted
    twice.
    """
    unknown = ASSISTANT + 1
    out = [[0] * (unknown + 1) for _ in range(len(marks) + 1)]
    if ends is not None:
        out[-1] = [0 if role in ends or role == unknown else 1 for role in range(unknown + 1)]
    for i in range(len(marks) - 1, -1, -1):
        role, truncated, rows = marks[i]
        after = out[i + 1]
        if role == GONE or truncated:
            out[i] = [x + DELETE * rows for x in after]
        elif role is None:
            out[i] = [after[unknown] + REROLE] * (unknown + 1)
        else:
            out[i] = [after[role] if (last, role) in _LEGAL else after[unknown] + 1 for last in range(unknown)] + [after[role]]
    return out


def search(marks: list[tuple[int | None, bool, int]], entry: int, ends: tuple[int, ...] | None = None):
    """{role after: (cost, audit)} of the cheapest edits from ``entry``.

    With ``ends`` only the best over those roles is sought (one entry).
    """
    bounds, n = suffix_bounds(marks, ends), len(marks)
    targets = len(_REACH[entry]) if ends is None else 1
    best: dict = {}  # target: incumbent (cost, audit, role)
    seen = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]

    def hopeless(i: int, role: int, cost: int, audit: str) -> bool:
        """Whether no end of this prefix can beat an incumbent."""
        return len(best) == targets and all((cost + bounds[i][role], audit) > b[:2] for b in best.values())

    while stack:
        i, role, cost, audit = stack.pop()
        if seen[i, role] < (cost, audit) or hopeless(i, role, cost, audit):
            continue
        if i == n and (ends is None or role in ends):
            target = role if ends is None else None
            if target not in best or (cost, audit) < best[target][:2]:
                best[target] = (cost, audit, role)
        children = [(i, _NEXT[role], cost + INSERT, audit + "I")]
        if i < n:
            mine, truncated, rows = marks[i]
            if mine == GONE:
                children.append((i + 1, role, cost + DELETE * rows, audit + "D" * rows))
            else:
                extra = TRUNCATED if truncated else 0
                children.append((i + 1, role, cost + DELETE, audit + "D"))
                if (role, mine) in _LEGAL:
                    children.append((i + 1, mine, cost + KEEP + extra, audit + "K"))
                children.append((i + 1, _NEXT[role], cost + REROLE + extra, audit + "R"))
        children.sort(key=lambda c: (c[2] + bounds[c[0]][c[1]], c[3]), reverse=True)  # the most promising comes off first
        for child in children:
            if child[:2] not in seen or child[2:] < seen[child[:2]]:
                seen[child[:2]] = child[2:]
                stack.append(child)
    return {role: (cost, audit) for cost, audit, role in best.values()}


class Path:
    """An audit as a chain of blocks, so that long audits share their past."""

    __slots__ = ("before", "cost", "part")

    def __init__(self, cost: int, part: str, before: Path | None):
        self.cost, self.part, self.before = cost, part, before

    def pieces(self, until: Path | None = None) -> str:
        out, at = [], self
        while at is not until:
            out.append(at.part)
            at = at.before
        return "".join(reversed(out))

    def better(self, other: Path | None) -> bool:
        if other is None or self.cost != other.cost:
            return other is None or self.cost < other.cost
        a, b = self, other
        while a is not b:  # chains of equal length: back to where they part
            a, b = a.before, b.before
        return self.pieces(a) < other.pieces(a)


def join_blocks(blocks: Iterable[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) over blocks of (role before, role after, cost, audit)."""
    at: dict[int, Path] = {START: Path(0, "", None)}
    for rows in blocks:
        after: dict[int, Path] = {}
        for entry, end, cost, audit in rows:
            if entry in at:
                path = Path(at[entry].cost + cost, audit, at[entry])
                if path.better(after.get(end)):
                    after[end] = path
        at = after
    best = None
    for end in _ENDS:
        if end in at and at[end].better(best):
            best = at[end]
    return best.cost, best.pieces()


# ---------------------------------------------------------------------------
# damage and marks
# ---------------------------------------------------------------------------
def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage, chosen by
    crc32("conv_id:turn") % 20."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(df["conv_id"].cast("long").alias("conv_id"), df["turn"].cast("long").alias("turn"),
                     df["role"].cast("string").alias("role"), df["text"].cast("string").alias("text"))
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"),
                       F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(20)).alias("action"))
    text = (F.when(F.col("action") == 1, F.lit("")).when(F.col("action") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("action") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("action") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("action != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                            F.explode(times).alias("copy")).drop("copy")


def digest(*values: Column) -> Column:
    """SHA-256 of values, each with its length before it."""
    return F.unhex(F.sha2(F.concat(*[x for v in values for x in (F.length(v).cast("string"), F.lit(":"), v)]), 256))


def normalised(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls as one space) and ``same``, the digest
    of conversation, role and text."""
    shown = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    return (rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"),
                        shown("role").alias("role"), shown("text").alias("text"))
            .withColumn("same", digest(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.col("role"), F.col("text"))))


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, same, initial, blank, truncated, repeats (a row of an
    earlier turn is equal), n (equal rows of this turn): no texts."""
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACES))
    marks = rows.select("conv_id", "turn", "same", F.substring("role", 1, 1).alias("initial"),
                        F.ltrim(trimmed, F.lit(_SPACES)).eqNullSafe("").alias("blank"),
                        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    marks = marks.groupBy("conv_id", "turn", "same").agg(
        F.min("initial").alias("initial"), F.min("blank").alias("blank"), F.min("truncated").alias("truncated"),
        F.count(F.lit(1)).alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))  # null turns come first
    first = marks.groupBy("same").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    return (marks.join(first.select("same", "first"), "same", "left")
            .withColumn("repeats", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(when)).drop("first"))


_STATS = ("blank", "duplicate", "truncated", "illegal", "turns")
_BLOCK = ("conv_id long, part long, block long, entry int, after int, cost long, audit string, blank long, duplicate long, "
          "truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string")


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def searched_blocks(marks: DataFrame) -> DataFrame:
    """The blocks of every conversation with the edits of each (role before,
    role after), in rows of ``_BLOCK``."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int32() if c.endswith(" int") else pa.int64() for c in _BLOCK.split(", ")]

    def solved(rows: list[tuple], part: int, number: int, alone: bool) -> list[tuple]:
        conv_id, steps, turns = rows[0][0], [], []
        blank = duplicate = truncated = illegal = 0
        for _, turn, initial, is_blank, is_cut, repeats, n in rows:
            if turn is not None and turns[-1:] != [turn]:
                turns.append(turn)
            illegal += (n - 1) * (not _legal(initial, initial))
            if is_blank:
                blank += n
                steps.append((GONE, False, n))
                continue
            duplicate += n - (not repeats)
            if not repeats:
                truncated += is_cut
                steps.append((_ROLE.get(initial), is_cut, 1))
            if n - (not repeats):
                steps.append((GONE, False, n - (not repeats)))
        illegal += sum(not _legal(a[2], b[2]) for a, b in zip(rows, rows[1:], strict=False))
        stats = (blank, duplicate, truncated, illegal, len(turns), turns[0] if turns else None, turns[-1] if turns else None,
                 rows[0][2], rows[-1][2])
        entries = ((START, _ENDS),) if alone else tuple((e, None) for e in _REACH)
        return [(conv_id, part, number, entry, end, *found, *stats) for entry, ends in entries
                for end, found in search(steps, entry, ends).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, out = TaskContext.get().partitionId(), 0, [], []
        opened = True  # the block begins the partition or continues its conversation

        def close(ends_here: bool) -> None:
            nonlocal number, held
            out.extend(solved(held, part, number, ends_here and not opened))
            number, held = number + 1, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)],
                                               names=names)
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(batch[i].to_pylist() for i in range(batch.num_columns)), strict=True):
                if held and held[0][0] != row[0]:
                    close(True)
                    opened = False
                elif len(held) >= BLOCK:
                    close(False)
                    opened = True
                held.append(row)
            yield flush()
        if held:
            close(False)  # the conversation may go on in the next partition
        yield flush()

    order = ["conv_id", "turn", "same"]
    return (marks.select(*order, "initial", "blank", "truncated", "repeats", "n").repartitionByRange(*order)
            .sortWithinPartitions(*order).drop("same").mapInArrow(run, _BLOCK))


_AUDIT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def joined_audits(blocks: DataFrame) -> DataFrame:
    """One row per conversation: its figures, cost and audit."""

    def conversation(conv_id, rows: Iterator[tuple]) -> tuple:
        total, low, last_turn, last_initial = dict.fromkeys(_STATS, 0), None, None, None

        def parts():
            nonlocal low, last_turn, last_initial
            for _, block in groupby(rows, key=lambda r: r[1:3]):
                block = list(block)
                *_, blank, duplicate, truncated, illegal, turns, first, last, initial, end = block[0]
                if last_initial is not None and not _legal(last_initial, initial):
                    illegal += 1
                if first is not None:
                    turns -= first == last_turn
                    low, last_turn = first if low is None else low, last
                last_initial = end
                for k, v in zip(_STATS, (blank, duplicate, truncated, illegal, turns), strict=True):
                    total[k] += v
                yield [r[3:7] for r in block]

        cost, audit = join_blocks(parts())
        gaps = 0 if low is None else last_turn - low + 1 - total["turns"]
        return conv_id, gaps, *(total[k] for k in _STATS[:4]), cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch[i].to_pylist() for i in range(batch.num_columns)), strict=True))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(columns)],
                                              names=[c.split()[0] for c in _AUDIT.split(", ")])

        for conv_id, mine in groupby(rows, key=lambda r: r[0]):
            out.append(conversation(conv_id, mine))
            if len(out) >= 1000:
                yield flush()
                out.clear()
        yield flush()

    return (blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "entry", "after")
            .mapInArrow(run, _AUDIT))


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the audit of each conversation carried out
    on its rows, which follow it in order."""
    none = F.lit(None)
    both = audits.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("binary").alias("same"),
                         none.cast("string").alias("role"), F.col("audit").alias("text")).unionByName(
        rows.select("conv_id", F.lit(1).alias("kind"), "turn", "same", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        done: list[tuple] = []

        def write(line: str) -> None:
            state["sha"].update(("\n" + line if state["lines"] else line).encode())
            state["lines"] = True

        def inserts() -> None:
            while state["audit"][state["at"]:state["at"] + 1] == "I":
                state["role"] = _NEXT[state["role"]]
                write("user:" if state["role"] == USER else "assistant:")
                state["at"] += 1

        def close() -> None:
            if state:
                inserts()
                done.append((state["conv_id"], state["sha"].hexdigest()))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())],
                                               names=["conv_id", "repaired_sha256"])
            done.clear()
            return batch

        for batch in batches:
            for conv_id, kind, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    close()
                    state.update(conv_id=conv_id, audit=text, at=0, role=START, lines=False, sha=hashlib.sha256())
                    continue
                inserts()
                edit = state["audit"][state["at"]]
                state["at"] += 1
                if edit == "K":
                    state["role"] = _ROLE[role[:1]]
                    write(f"{role}:{text}")
                elif edit == "R":
                    state["role"] = _NEXT[state["role"]]
                    write(("user:" if state["role"] == USER else "assistant:") + text)
            yield flush()
        close()
        yield flush()

    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "same")
            .select("conv_id", "kind", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string"))


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256 over its ``rows``."""
    rows = normalised(rows)
    audits = cut(joined_audits(searched_blocks(marked(rows))))
    found = (audits.withColumnRenamed("conv_id", "of")
             .join(repaired_digests(rows, audits).withColumnRenamed("conv_id", "whose"), F.col("of").eqNullSafe(F.col("whose"))))
    ids = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
