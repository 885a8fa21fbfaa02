"""Micro-batch SCD2 loads with Structured Streaming.

A snapshot is a folder of any number of files.  When it is complete its writer
announces it with one manifest row (snapshot_ts, path, row count); the stream
reads manifests, so a half-written or many-file snapshot is never taken for a
whole one.  ``foreachBatch`` applies the announced snapshots in time order.

The history is kept in folders that are written once.  A snapshot writes the
versions it opens and the ends of those it closes, so a batch writes as much as
has changed, whatever the length of the history.  Every ``COMPACT`` batches the
open versions are written together and the versions closed since are appended
to the past, which is never written again.  A commit, the last file of a batch,
names the live folders; folders that a compaction replaced are removed one
batch later, when readers have moved on.

A replayed batch id finds its commit and does nothing, so the sink is
idempotent; the stream's checkpoint folder records progress, so a restart
resumes after the last committed batch.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scd2

COMPACT = 8  # batches whose changes are read apart
COMMIT = ("batch_id long, past array<string>, active array<string>, opened array<string>, closed array<string>, "
          "replaced array<string>")
MANIFEST = "snapshot_ts timestamp_ntz, path string, n_rows long"


def announce_snapshot(spark: SparkSession, manifest_dir: str, ts: str, path: str) -> None:
    """Append the manifest row of the complete snapshot in ``path``."""
    row = spark.read.parquet(path).agg(F.lit(ts).cast("timestamp_ntz").alias("snapshot_ts"), F.lit(path).alias("path"),
                                       F.count(F.lit(1)).alias("n_rows"))
    row.coalesce(1).write.mode("append").parquet(manifest_dir)  # one row


class Scd2Sink:
    def __init__(self, spark: SparkSession, state_dir: str, tracked=scd2.TRACKED, compact: int = COMPACT):
        self.spark = spark
        self.state = state_dir.rstrip("/")
        self.tracked = tracked
        self.compact = compact

    def _last_commit(self) -> dict | None:
        """The newest commit, the names of the live folders."""
        try:
            commits = self.spark.read.schema(COMMIT).json(f"{self.state}/_commits").collect()  # one row per batch
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # no commit yet
        if any(c.batch_id is None for c in commits):
            raise ValueError(f"{self.state}/_commits holds a file that is no commit")
        return max(commits, key=lambda c: c.batch_id).asDict() if commits else None

    def _read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.state}/{f}" for f in folders]) if folders else None

    def _versions(self, live: dict) -> DataFrame:
        """The versions that were open at the last compaction or opened since,
        with the ends written since."""
        rows, ends = self._read([*live["active"], *live["opened"]]), self._read(live["closed"])
        if ends is None:
            return rows.withColumns({"valid_to": F.lit(None).cast("timestamp_ntz"), "is_active": F.lit(True)})
        return (rows.join(ends.withColumnRenamed("valid_to", "_end"), [scd2.KEY, "valid_from"], "left")
                .select(*rows.columns, F.col("_end").alias("valid_to"), F.col("_end").isNull().alias("is_active")))

    def _history(self, live: dict) -> DataFrame:
        past, now = self._read(live["past"]), self._versions(live)
        return now if past is None else now.unionByName(past.withColumn("is_active", F.lit(False)))

    def current(self) -> DataFrame | None:
        live = self._last_commit()
        return None if live is None else self._history(live)

    def active(self) -> DataFrame | None:
        """The open versions; the past is not read."""
        live = self._last_commit()
        return None if live is None else self._versions(live).where("is_active")

    def _load(self, live: dict | None, snap: DataFrame, ts: str, name: str) -> dict:
        """Write what the snapshot opens and closes; returns the live folders."""
        t = F.lit(ts).cast("timestamp_ntz")
        if live is None:
            snap.withColumn("valid_from", t).write.mode("overwrite").parquet(f"{self.state}/opened/{name}")
            return {"past": [], "active": [], "opened": [f"opened/{name}"], "closed": [], "replaced": []}
        now = self._versions(live).where("is_active")
        changes = scd2.classify(now.drop(*scd2.VALIDITY), snap, self.tracked)
        opened = snap.join(changes.where("change_type IN ('insert', 'update')"), scd2.KEY).drop("change_type")
        opened.withColumn("valid_from", t).write.mode("overwrite").parquet(f"{self.state}/opened/{name}")
        ended = now.join(changes.where("change_type IN ('delete', 'update')"), scd2.KEY)
        ended.select(scd2.KEY, "valid_from", t.alias("valid_to")).write.mode("overwrite").parquet(f"{self.state}/closed/{name}")
        return {**live, "opened": [*live["opened"], f"opened/{name}"], "closed": [*live["closed"], f"closed/{name}"]}

    def _compacted(self, live: dict, name: str) -> dict:
        """Open versions in one folder, versions closed since in the past."""
        rows = self._versions(live)
        rows.where("NOT is_active").drop("is_active").write.mode("overwrite").parquet(f"{self.state}/past/{name}")
        rows.where("is_active").drop("valid_to", "is_active").write.mode("overwrite").parquet(f"{self.state}/active/{name}")
        return {"past": [*live["past"], f"past/{name}"], "active": [f"active/{name}"], "opened": [], "closed": [],
                "replaced": [*live["active"], *live["opened"], *live["closed"]]}

    def _remove(self, folders: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for f in folders:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.state}/{f}")
            path.getFileSystem(conf).delete(path, True)

    def __call__(self, manifests: DataFrame, batch_id: int) -> None:
        live = self._last_commit()
        if live is not None and batch_id <= live["batch_id"]:
            return  # replay of a committed batch
        announced = manifests.orderBy("snapshot_ts").collect()  # a few rows, one per snapshot
        if not announced:
            return
        replaced = live["replaced"] if live else []
        for i, (ts, path, n_rows) in enumerate(announced):
            snap = self.spark.read.parquet(path)
            if snap.count() != n_rows:
                raise ValueError(f"snapshot {path} does not hold the {n_rows} rows of its manifest")
            live = self._load(live, snap, str(ts), f"b={batch_id}-{i}")
        live["replaced"] = []
        if len(live["opened"]) >= self.compact:
            live = self._compacted(live, f"b={batch_id}")
        fields = [c.split()[0] for c in COMMIT.split(", ")]
        row = tuple({**live, "batch_id": batch_id}[c] for c in fields)
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.state}/_commits/b={batch_id}")
        self._remove(replaced)  # of the compaction before this batch


def run_snapshot_stream(spark: SparkSession, manifest_dir: str, state_dir: str, checkpoint_dir: str,
                        snapshots_per_trigger: int = 1, tracked=scd2.TRACKED) -> DataFrame:
    """Drain the manifest folder (availableNow) and return the history."""
    sink = Scd2Sink(spark, state_dir, tracked)
    stream = spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", snapshots_per_trigger).parquet(manifest_dir)
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink.current()
