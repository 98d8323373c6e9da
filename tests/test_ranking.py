import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from xmcforge.plans.ranking import dist_rank


def test_dist_rank_equals_row_number(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(rng.integers(0, 5)), float(rng.integers(0, 20))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g long, v double")
    got = dist_rank(df, [F.col("v").desc(), "id"], num_partitions=7).toPandas()
    want = df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("v").desc(), "id"))).toPandas()
    m = got.merge(want, on="id")
    assert (m.rank_x == m.rank_y).all() and len(m) == 3000


def test_dist_rank_per_group(spark):
    rng = np.random.default_rng(2)
    # one group holds most rows (skew) and spans several range partitions
    rows = [(int(i), 0 if i % 10 else int(rng.integers(1, 4)), float(rng.integers(0, 50))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g long, v double")
    got = dist_rank(df, ["v", "id"], partition_by=["g"], num_partitions=6).toPandas()
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).toPandas()
    m = got.merge(want, on="id")
    assert (m.rank_x == m.rank_y).all()


def test_dist_rank_plan_has_no_single_partition_window_over_rows(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 13)
    plan = dist_rank(df, ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan.lower() or "Scan ExistingRDD" in plan


def test_null_groups_are_ranked(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "a", 1.0), (3, None, 1.0)], "id long, g string, v double")
    got = {r.id: r["rank"] for r in dist_rank(df, ["v", "id"], partition_by=["g"], num_partitions=3).collect()}
    assert got == {1: 2, 2: 1, 3: 1}
