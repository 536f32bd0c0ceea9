import numpy as np
import pytest
from pyspark.sql import functions as F

from civiflow.operators import isotonic


def brute_curve(scores, labels):
    """Means of the pooled blocks at the distinct scores, by plain pooling."""
    xs = np.unique(scores)
    blocks = [[labels[scores == x].sum(), (scores == x).sum(), 1] for x in xs]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] / blocks[i][1] > blocks[i + 1][0] / blocks[i + 1][1]:
            blocks[i : i + 2] = [[a + b for a, b in zip(blocks[i], blocks[i + 1])]]
            i = max(i - 1, 0)
        else:
            i += 1
    return xs, np.concatenate([[t / w] * n for t, w, n in blocks])


@pytest.mark.parametrize("slices", ["8", "100"])
def test_curve_equals_plain_pooling(spark, slices):
    rng = np.random.default_rng(2)
    s = np.round(rng.random(3000), 3)
    s[:1000] = 0.25
    y = (rng.random(3000) < s**2).astype(int)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        df = spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "score double, y int")
        blocks = isotonic.isotonic_blocks(df.union(spark.createDataFrame([(None, 1), (0.5, None)], df.schema)), "score", "y")
        asked = np.concatenate([rng.random(500), s[:1500], [-1.0, 2.0, 0.25]])
        points = spark.createDataFrame([(i, float(x)) for i, x in enumerate(asked)] + [(9999, None)], "i int, score double")
        got = {r.i: r.p for r in isotonic.with_isotonic(points, blocks, "score", "p").collect()}
        xs, means = brute_curve(s, y)
        assert np.allclose([got[i] for i in range(len(asked))], np.interp(asked, xs, means), atol=1e-12)
        assert got[9999] is None and blocks.count() < 100
        assert isotonic.with_isotonic(points, blocks, "score", "p").count() == len(asked) + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "score double, y int")
    blocks = isotonic.isotonic_blocks(empty, "score", "y")
    assert blocks.count() == 0
    assert isotonic.with_isotonic(empty.withColumn("k", F.lit(1)), blocks, "score", "p").count() == 0
