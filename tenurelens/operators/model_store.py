"""Fit once, store, load and score.

A model is a folder of Parquet tables: the encoders (levels, target sums,
bounds), Cox coefficients, boosted trees with real thresholds, losses, baseline
curve and one row of metadata, written last, so that a folder without it is no
model.  Every fit gets a folder of its own; nothing is overwritten under a
reader.

``score`` is one plan over any cohort: encode by the stored sums, walk the
stored trees by Arrow batches of rows, read the stored curve at the horizons,
and share the positive Cox terms out to themes.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import HORIZONS_MONTHS, THEMES
from ..session import cut_lineage
from ..sources.sinks import output_dir
from . import boosting, cox, encoding
from .survival import horizon_probabilities, nelson_aalen, theme_of

TABLES = ("levels", "target", "bounds", "cox", "trees", "losses", "curve", "meta")


@dataclass
class Store:
    """The tables of a stored model."""
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def encoders(self) -> encoding.Encoders:
        levels: dict[str, list[str]] = {p: [] for p in encoding.DUMMIES.values()}
        for r in self.table("levels").orderBy("prefix", "place").collect():  # bounded by the one-hot limit
            levels[r.prefix].append(r.level)
        bounds = {r.feature: (r.low, r.high) for r in self.table("bounds").orderBy("place").collect()}
        return encoding.Encoders(levels, self.table("target"), self.table("meta").first()["target_mean"], bounds)


    def importance(self) -> DataFrame:
        """(feature, importance): the mean gain of the splits on each feature
        that the trees use."""
        names = self.table("bounds").select(F.col("feature").alias("name"), F.col("place").cast("int").alias("feature"))
        splits = self.table("trees").select(F.inline(F.arrays_zip("feature", "gain"))).where("gain > 0")
        return splits.join(F.broadcast(names), "feature").groupBy(F.col("name").alias("feature")).agg(F.avg("gain").alias("importance"))


def _columns(features: list[str]) -> list[str]:
    return [f"x_{f.replace('.', '_')}" for f in features]


def fit(cohort: DataFrame, params: boosting.Params | None = None, penalizer: float = 0.1) -> Store:
    """Fit on a cohort and store the model in a new folder."""
    spark = cohort.sparkSession
    cohort = cut_lineage(cohort)
    enc, rows = encoding.fit(cohort)
    rows = cut_lineage(rows)
    features, columns = enc.features, _columns(enc.features)
    coefs, iterations, likelihood = cox.fit(rows, columns, encoding.DURATION, encoding.EVENT, penalizer)
    model = boosting.fit(rows, columns, encoding.DURATION, encoding.EVENT, encoding.KEY, params)

    path = output_dir(spark, f"models/{uuid.uuid4().hex}")
    names = spark.createDataFrame(list(zip(columns, features, range(len(features)), strict=True)), "column string, name string, place int")
    tables = {
        "levels": spark.createDataFrame([(p, i, v) for p, some in enc.levels.items() for i, v in enumerate(some)],
                                        "prefix string, place int, level string"),
        "target": enc.target,
        "bounds": spark.createDataFrame([(f, i, *map(_number, b)) for i, (f, b) in enumerate(enc.bounds.items())],
                                        "feature string, place int, low double, high double"),
        "cox": coefs.join(names, coefs["feature"] == names["column"]).select(
            F.col("name").alias("feature"), "place", "coef", "exp_coef", "se", "z", "p_value"),
        "trees": spark.createDataFrame(
            [(i, t.feature.tolist(), model.threshold(t).tolist(), t.gain.tolist(), t.leaf.tolist()) for i, t in enumerate(model.trees)],
            "tree int, feature array<int>, threshold array<double>, gain array<double>, leaf array<double>"),
        "losses": spark.createDataFrame(model.losses, "round int, loss double, valid_loss double"),
        "curve": nelson_aalen(cohort).select("t", "s0"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    rows.agg(F.count(F.lit(1)).alias("dataset_rows")).select(
        "dataset_rows", F.lit(len(features)).cast("long").alias("features_count"),
        F.lit("boosted Cox and Cox PH").alias("model_type"), F.lit(len(model.trees)).cast("long").alias("trees"),
        F.lit(iterations).cast("long").alias("cox_iterations"), F.lit(likelihood).alias("cox_log_likelihood"),
        F.lit(float(enc.mean)).alias("target_mean"), F.current_timestamp().alias("training_timestamp")).write.parquet(f"{path}/meta")
    return Store(spark, path)


def _number(x) -> float | None:
    return None if x is None else float(x)


# ---------------------------------------------------------------------------
# scoring
# ---------------------------------------------------------------------------
def _trees(store: Store) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, threshold, leaf) of the stored trees in order, as many as rounds."""
    return [(np.array(r.feature), np.array(r.threshold), np.array(r.leaf)) for r in store.table("trees").orderBy("tree").collect()]


def margins(rows: DataFrame, store: Store, features: list[str]) -> DataFrame:
    """Encoded rows with ``margin`` of the stored trees: each batch of rows goes
    down each tree as arrays.  A missing value on a row's way leaves no margin;
    a value that is not a number lies above every threshold."""
    trees = _trees(store)
    if not trees:  # the null model
        return rows.withColumn("margin", F.lit(0.0))

    @F.arrow_udf("double")
    def margin(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns])
        gone = np.stack([np.asarray(c.is_null()) for c in columns])
        total, lost, every = np.zeros(x.shape[1]), np.zeros(x.shape[1], bool), np.arange(x.shape[1])
        missing = gone.any()
        for feature, threshold, leaf in trees:
            node = np.zeros(len(every), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                f = feature[node]
                if missing:
                    lost |= gone[f, every]
                node = 2 * node + 1 + ~(x[f, every] <= threshold[node])
            total += leaf[node - len(feature)]
        return pa.array(total, mask=lost)

    return rows.withColumn("margin", margin(*[F.col(c) for c in _columns(features)]))


def contributions(rows: DataFrame, coefs: dict[str, float]) -> DataFrame:
    """Share (%) of each theme in the positive Cox terms; 20 each if none."""
    parts = {t: F.lit(0.0) for t in THEMES}
    for feature, beta in coefs.items():
        term = F.col(_columns([feature])[0]) * F.lit(beta)
        parts[theme_of(feature)] = parts[theme_of(feature)] + F.greatest(term, F.lit(0.0))
    rows = rows.withColumns({f"part_{t}": p for t, p in parts.items()})
    total = sum((F.col(f"part_{t}") for t in THEMES), F.lit(0.0))
    return rows.withColumns({f"contrib_{t}": F.when(total > 0, F.col(f"part_{t}") / total * 100.0).otherwise(F.lit(20.0)) for t in THEMES})


def score(cohort: DataFrame, store: Store, multiplier: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """emp_key, margin, risk_multiplier, prob_{h}m, general_risk_score and
    contrib_{theme} of every complete row, by the stored model.  ``multiplier``
    (of columns in ``keep``) scales the hazard of each row."""
    enc = store.encoders()
    encoded = encoding.inference(cohort, enc)
    if keep:
        encoded = encoded.join(cohort.select(encoding.KEY, *keep), encoding.KEY)
    rows = margins(encoded, store, enc.features)
    rows = horizon_probabilities(rows, store.table("curve"), extra_multiplier=multiplier)
    rows = contributions(rows, {r.feature: r.coef for r in store.table("cox").collect()})  # one row per feature
    return rows.select(encoding.KEY, *keep, "margin", F.least(F.greatest(F.exp("margin"), F.lit(1e-4)), F.lit(1e4)).alias("risk_multiplier"),
                       *[f"prob_{h}m" for h in HORIZONS_MONTHS], "general_risk_score", *[f"contrib_{t}" for t in THEMES])


def rescored(cohort: DataFrame, store: Store) -> DataFrame:
    """emp_key, margin and 12-month probability on a second way, for checks of
    stored scores: no row walks down a tree, but each node parts the rows that
    reached it in two, down to the leaves.  The curve is read from its nearest
    point here."""
    enc = store.encoders()
    columns, key = _columns(enc.features), encoding.KEY
    trees = _trees(store)
    curve = sorted((r.t, r.s0) for r in store.table("curve").orderBy(F.abs(F.col("t") - HORIZONS_MONTHS[-1]), "t").limit(1).collect())
    s0 = curve[0][1]

    def run(batches):
        for batch in batches:
            x = [batch[c].to_numpy() for c in columns]
            total = np.zeros(len(batch))
            for feature, threshold, leaf in trees:
                reached = {0: np.arange(len(batch))}
                for node in range(len(feature)):
                    rows = reached.pop(node)
                    right = x[feature[node]][rows] > threshold[node]
                    reached[2 * node + 1], reached[2 * node + 2] = rows[~right], rows[right]
                for node, rows in reached.items():
                    total[rows] += leaf[node - len(feature)]
            p = 1.0 - s0 ** np.exp(np.clip(total, -15, 15))
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(total), pa.array(p)], names=[key, "margin", "prob_12m"])

    rows = encoding.inference(cohort, enc).select(key, *columns)
    return rows.mapInArrow(run, f"{key} long, margin double, prob_12m double")


def reconcile(stored: DataFrame, again: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: rows of either side, and how many differ in margin and in the
    12-month probability by more than ``tolerance`` or lack a side."""
    a = stored.select(encoding.KEY, F.col("margin").alias("m"), F.col("prob_12m").alias("p"))
    both = a.join(again.select(encoding.KEY, "margin", "prob_12m"), encoding.KEY, "full")
    off = lambda x, y: F.count_if(~F.coalesce(F.abs(F.col(x) - F.col(y)) <= tolerance, F.lit(False)))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), off("m", "margin").alias("n_margin_differs"),
                    off("p", "prob_12m").alias("n_probability_differs"))
