"""The shared k-means step: rows dealt over all cores, sums equal to a plain version, ties to the lower cluster."""

import numpy as np
from pyspark.sql import functions as F

from loadloom.operators import many_fits as M


def test_small_tables_are_dealt_over_all_cores(spark):
    df = spark.range(2000).coalesce(1).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    table = M.prepared(df, "id", "v")
    assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert table.count() == 2000


def test_fold_equals_plain_sums():
    r = np.random.default_rng(3)
    x = r.integers(-2, 3, (300, 2)).astype(float)  # whole numbers, so that many rows are as near to two centres
    drawn, draws = r.random((300, 2)) < 0.7, np.array([-1, 0, 1, 1])
    centres = r.integers(-2, 3, (3, 2, 4)).astype(float)
    seen = M._seen({"x": x, "drawn": drawn}, draws)
    got = np.zeros((12, 4))
    M._fold(np.c_[np.ones(300), x], (x * x).sum(1)[:, None], seen, np.concatenate([(centres ** 2).sum(1, keepdims=True), -2 * centres], 1), got)
    for i, b in enumerate(draws):
        rows = x if b < 0 else x[drawn[:, b]]
        far = ((rows[:, None] - centres[:, :, i]) ** 2).sum(2)
        own = far.argmin(1)
        part = got[i::4]
        assert part[:, 0].tolist() == np.bincount(own, minlength=3).tolist()
        assert part[:, 1].sum() == far.min(1).sum()
        assert np.array_equal(part[:, 2:], np.stack([rows[own == j].sum(0) for j in range(3)]))
