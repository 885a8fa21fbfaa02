"""The tied-events increment against plain sums, at every size."""
import math

import pytest
from pyspark.sql import functions as F

from tenurelens.operators.survival import tie_smoothed_increment

CASES = [(1, 1), (5, 2), (31, 31), (32, 32), (33, 1), (33, 33), (40, 9), (1000, 999), (1001, 1), (4096, 4096),
         (5000, 4095), (5000, 4096), (5000, 4097), (200_000, 100_000), (3, 0), (300_000, 300_000)]


def test_increment_equals_the_sum(spark):
    rows = spark.createDataFrame(CASES, "n long, d long").select("n", "d", tie_smoothed_increment(F.col("n"), F.col("d"))
                                                                  .alias("h")).collect()
    for r in rows:
        assert r.h == pytest.approx(math.fsum(1 / (r.n - i) for i in range(r.d)), rel=1e-12, abs=1e-15), r
