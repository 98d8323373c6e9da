"""Products of sparse matrices with heavy inner keys."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from xmcforge.operators import sparse as SP


def entries(rnd, n, hot, rows):
    """(row, inner, value) with a third of all entries at inner key 0."""
    return [(rnd.randrange(rows), 0 if rnd.random() < hot else rnd.randrange(1, 40), float(rnd.randint(-3, 3))) for _ in range(n)]


def test_product_with_a_hot_key_on_both_sides(spark):
    rnd = random.Random(1)
    a, b = entries(rnd, 1500, 1 / 3, 300), entries(rnd, 1200, 1 / 3, 250)
    a += [(1, None, 5.0)] + a[:20]
    b += [(2, None, 5.0)] + b[:20]
    want = defaultdict(float)
    by = defaultdict(list)
    for c, k, v in b:
        by[k].append((c, v))
    for r, k, v in a:
        for c, w in by[k] if k is not None else ():
            want[r, c] += v * w
    left = spark.createDataFrame(a, "row long, inner long, value double")
    right = spark.createDataFrame(b, "col long, inner long, value double")
    for block_rows in (4, 16, 4096):
        got = {(r.row, r.col): r.value for r in SP.sparse_matmul(left, right, "row", "inner", "col", block_rows=block_rows).collect()}
        assert got == want, block_rows
    assert SP.sparse_matmul(left.limit(0), right, "row", "inner", "col").count() == 0


def test_blocks_of_a_hot_key_are_bounded(spark):
    a = spark.range(9000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("inner"))
    b = spark.range(6000).select(F.col("id").alias("col"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("inner"))
    left, right = SP.block_rows_of(a, b, "row", "inner", "col", block_rows=128)
    cell = ["inner", "_i", "_j"]
    n = left.groupBy(*cell).agg(F.count(F.lit(1)).alias("x")).join(right.groupBy(*cell).agg(F.count(F.lit(1)).alias("y")), cell)
    hot = n.where("inner = 0").selectExpr("count(*) as cells", "max(x * y) as most", "sum(x * y) as all").first()
    assert hot["all"] == 3000 * 2000 and hot["cells"] == 24 * 16 and hot["most"] < 2 * 128 * 128
    assert n.where("inner <> 0 and (_i <> 0 or _j <> 0)").count() == 0


def test_a_short_side_is_not_cut(spark):
    a = spark.range(5000).select(F.col("id").alias("row"), F.lit(7).alias("inner"))
    b = spark.createDataFrame([(1, 7), (2, 7)], "col long, inner int")
    k = SP.heavy_keys(a, b, "inner", block_rows=64).first()
    assert (k.na, k.nb) == (3, 1)
