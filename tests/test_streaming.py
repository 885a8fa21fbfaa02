"""Micro-batch SCD2 sink: whole snapshots, ordered, idempotent replay."""
import uuid

import pytest

from tenurelens.operators import scd2
from tenurelens.session import ensure_checkpoint_dir
from tenurelens.streaming.scd2_stream import MANIFEST, Scd2Sink, announce_snapshot, run_snapshot_stream

COLS = ("emp_key", "v", "valid_from", "valid_to", "is_active")


def _base(spark):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/test_stream_{uuid.uuid4().hex}"


def _snap(spark, rows):
    return spark.createDataFrame(rows, "emp_key long, v string")


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def _stored(spark, base, name, rows, files):
    path = f"{base}/source/{name}"
    _snap(spark, rows).repartition(files).write.parquet(path)
    return path


def _manifest(spark, ts, path, n):
    return spark.createDataFrame([(ts, path, n)], "ts string, path string, n_rows long").selectExpr(
        "CAST(ts AS timestamp_ntz) AS snapshot_ts", "path", "n_rows")


def test_replayed_batch_is_ignored(spark):
    base = _base(spark)
    one, two = [(1, "a"), (2, "b")], [(1, "a"), (2, "B"), (3, "c")]
    sink = Scd2Sink(spark, base + "/state", tracked=("v",))
    first = _manifest(spark, "2000-01-01", _stored(spark, base, "a", one, 2), 2)
    second = _manifest(spark, "2000-02-01", _stored(spark, base, "b", two, 3), 3)
    sink(first, 0)
    sink(second, 1)
    once = _rows(sink.current())
    sink(second, 1)  # replay after a failure between write and progress commit
    assert _rows(sink.current()) == once
    want = scd2.build_history([("2000-01-01", _snap(spark, one)), ("2000-02-01", _snap(spark, two))], ("v",))
    assert once == _rows(want)


def test_snapshots_of_many_files_end_to_end(spark):
    base = _base(spark)
    snaps = [("2000-01-01 00:00:00.25", [(i, "a") for i in range(6)]), ("2000-01-01 00:00:00.75", [(i, "a") for i in range(1, 6)]),
             ("2000-02-01", [(i, "b" if i == 4 else "a") for i in range(1, 7)])]
    for i, (ts, rows) in enumerate(snaps):
        announce_snapshot(spark, base + "/manifest", ts, _stored(spark, base, str(i), rows, 3))
    hist = run_snapshot_stream(spark, base + "/manifest", base + "/state", base + "/ckpt", tracked=("v",))
    want = scd2.build_history([(ts, _snap(spark, rows)) for ts, rows in snaps], ("v",))
    assert _rows(hist) == _rows(want)
    assert {r.emp_key for r in hist.where("NOT is_active").collect()} == {0, 4}


def test_incomplete_snapshots_and_read_errors_raise(spark):
    base = _base(spark)
    path = _stored(spark, base, "a", [(1, "a"), (2, "b")], 2)
    with pytest.raises(ValueError):
        Scd2Sink(spark, base + "/state", tracked=("v",))(_manifest(spark, "2000-01-01", path, 3), 0)
    spark.range(1).write.parquet(base + "/broken/_commits/b=0")
    with pytest.raises(Exception):  # noqa: B017  a commit folder that cannot be read is not "no commit"
        Scd2Sink(spark, base + "/broken").current()
    assert spark.createDataFrame([], MANIFEST).columns == ["snapshot_ts", "path", "n_rows"]


def _bytes(folder):
    import os
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_what_changed_and_compactions_leave_nothing_behind(spark):
    import os
    base = _base(spark)
    n = 4000
    values = {i: f"value {i} " * 5 for i in range(n)}
    sink, snaps, sizes = Scd2Sink(spark, base + "/state", tracked=("v",), compact=4), [], []
    root = base.removeprefix("file:")
    for b in range(10):
        if b:
            for k in range(5):
                values[(b * 37 + k) % n] = f"changed {b}"
            values.pop(100 + b)
            values[n + b] = "new"
        ts = f"2000-01-{b + 1:02d}"
        snaps.append((ts, list(values.items())))
        sink(_manifest(spark, ts, _stored(spark, base, str(b), snaps[-1][1], 2), len(values)), b)
        sizes.append(_bytes(f"{root}/state/opened/b={b}-0") + _bytes(f"{root}/state/closed/b={b}-0"))
    assert max(sizes[1:]) < sizes[0] / 10  # deltas; batches 3 and 7 compact besides
    want = scd2.build_history([(ts, _snap(spark, rows)) for ts, rows in snaps], ("v",))
    assert _rows(sink.current()) == _rows(want)
    assert _rows(sink.active()) == _rows(want.where("is_active"))
    live = sink._last_commit()
    assert len(live["past"]) == 2 and len(live["active"]) == 1 and len(live["opened"]) == 2
    kept = {f"{kind}/{name}" for kind in ("past", "active", "opened", "closed") for name in os.listdir(f"{root}/state/{kind}")}
    assert kept == {*live["past"], *live["active"], *live["opened"], *live["closed"]}
