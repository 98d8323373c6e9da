"""Caller-supplied splitters and scores."""

import random

import pytest
from pyspark.sql import functions as F

from xmcforge.operators import cluster as CL


def test_keyed_clusters_do_not_depend_on_where_nodes_are_cut(spark):
    rnd = random.Random(2)
    rows = [(i, float(rnd.randrange(5)), float(rnd.randrange(100))) for i in range(203)]
    df = spark.createDataFrame(rows, "item_id long, a double, b double")
    key = lambda level: F.col("ab"[level % 2])
    nodes = {0: [(r[0], r) for r in rows]}
    for level in range(4):
        nxt = {}
        for n, members in nodes.items():
            order = sorted(members, key=lambda m: (-m[1][1 + level % 2], m[0]))
            nxt[2 * n], nxt[2 * n + 1] = order[:len(order) // 2], order[len(order) // 2:]
        nodes = nxt
    want = {i: n for n, members in nodes.items() for i, _ in members}
    for subtree_bytes in (1, 6000, 1 << 30):  # all levels globally, some, none
        got = {r.item_id: r.cluster_id for r in CL.keyed_clusters(df, 4, key, subtree_bytes=subtree_bytes).collect()}
        assert got == want, subtree_bytes


def test_keys_that_are_null_or_nan_are_refused(spark):
    for bad in (None, float("nan")):
        df = spark.createDataFrame([(1, 1.0), (2, bad)], "item_id long, a double")
        with pytest.raises(Exception, match="null or NaN key"):
            CL.keyed_clusters(df, 1, lambda _: F.col("a")).collect()
    assert CL.keyed_clusters(df.limit(0), 2, lambda _: F.col("a")).count() == 0
