import numpy as np
from pyspark.sql import functions as F

from xmcforge.operators import assets as AS
from xmcforge.operators import cluster as CL
from xmcforge.operators import sampling as SA


def test_permutation_is_bijection_and_batches(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    p = SA.seeded_permutation(df, "doc_id", 5).toPandas()
    assert sorted(p.pos) == list(range(1000)) and sorted(p.doc_id) == list(range(1000))
    b = SA.assign_batches(SA.seeded_permutation(df, "doc_id", 5), 300).toPandas()
    assert b.groupby("batch_id").size().tolist() == [300, 300, 300, 100]
    p2 = SA.seeded_permutation(df, "doc_id", 6).toPandas()
    assert not (p.sort_values("doc_id").pos.values == p2.sort_values("doc_id").pos.values).all()


def test_weighted_sampling_follows_weights(spark):
    rows = [(d, l) for d in range(4000) for l in (0, 1)]
    xy = spark.createDataFrame(rows, "doc_id long, label_id long")
    w = spark.createDataFrame([(0, 1.0), (1, 3.0)], "label_id long, weight double")
    s = SA.sample_positive(xy, 0, w).toPandas()
    assert len(s) == 4000
    share = (s.label_id == 1).mean()
    assert 0.72 < share < 0.78   # expected 0.75


def test_in_batch_relevance_matches_dense(spark):
    xy = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (3, 1)], "doc_id long, label_id long")
    plan = SA.training_batches(xy, 2, 0)
    pdf = plan.toPandas()
    got = set(map(tuple, SA.in_batch_relevance(plan, xy).toPandas().values.tolist()))
    pos = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 1)}
    want = set()
    for b, g in pdf.groupby("batch_id"):
        for _, a in g.iterrows():
            for _, c in g.iterrows():
                if (a.doc_id, c.label_id) in pos:
                    want.add((b, a.slot, c.slot))
    assert got == want


def test_balanced_clusters_sizes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(203)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    out = CL.balanced_clusters(items, depth=3, seed=1, rounds=2).toPandas()
    sizes = out.groupby("cluster_id").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert sorted(out.item_id) == list(range(203))
    assert CL.tree_depth(203, 32) == 3


def test_image_slots_pad_and_owner_without_assets(spark):
    owners = spark.createDataFrame([(1,), (2,)], "owner_id long")
    assets = spark.createDataFrame([(10, 1), (12, 1), (11, 1), (13, 1)], "asset_id long, owner_id long")
    s = AS.image_slots(owners, assets, 3).toPandas().sort_values(["owner_id", "slot"])
    assert s[s.owner_id == 1].asset_id.tolist() == [10, 11, 12] and s[s.owner_id == 1]["mask"].tolist() == [1, 1, 1]
    assert s[s.owner_id == 2].asset_id.tolist() == [-1, -1, -1] and s[s.owner_id == 2]["mask"].tolist() == [0, 0, 0]


def test_zero_weight_is_never_drawn(spark):
    xy = spark.createDataFrame([(d, l) for d in range(200) for l in (0, 1)], "doc_id long, label_id long")
    w = spark.createDataFrame([(0, 0.0), (1, 2.0)], "label_id long, weight double")
    s = SA.sample_positive(xy, 3, w).toPandas()
    assert len(s) == 200 and (s.label_id == 1).all()


def test_dot_difference_equals_the_native_fold(spark):
    from pyspark.sql import functions as F
    from xmcforge.functions import vectors as V
    rng = np.random.default_rng(9)
    rows = [(i, *([float(x) for x in rng.normal(size=16)] for _ in range(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id long, v array<double>, a array<double>, b array<double>")
    arrow = {r.item_id: r.d for r in V.dot_difference(df, "v", "a", "b", "d", keep=["item_id"]).collect()}
    native = {r.item_id: r.d for r in df.select("item_id", (V.dot("v", "a") - V.dot("v", "b")).alias("d")).collect()}
    assert arrow == native


def test_orders_keep_wide_columns_aligned(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") * 10).alias("payload"))
    p = SA.seeded_permutation(df, "doc_id", 4).toPandas()
    assert (p.payload == p.doc_id * 10).all() and sorted(p.pos) == list(range(300))
    assets = spark.createDataFrame([(i, i // 3, [float(i)]) for i in range(30)], "asset_id long, owner_id long, embedding array<double>")
    s = AS.asset_slot_number(assets).toPandas()
    assert (s.slot == s.asset_id % 3).all() and (s.embedding.map(lambda v: v[0]) == s.asset_id).all()
