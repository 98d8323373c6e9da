import numpy as np
import pytest

from xmcforge.operators import ann as AN
from xmcforge.operators.retrieval import ova_topk


def tables(spark, n=900, nq=120, dim=24, seed=3, groups=30):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    make = lambda m: centers[rng.integers(0, groups, m)] + 0.35 * rng.normal(size=(m, dim))
    lab, q = make(n), make(nq)
    lab[7] = 0.0
    q[5] = 0.0
    labels = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(lab)], "label_id long, embedding array<double>")
    queries = spark.createDataFrame([(1000 + i, [float(x) for x in v]) for i, v in enumerate(q)], "q_id long, embedding array<double>")
    return queries, labels


def rows(df):
    return sorted((r.q_id, r["rank"], r.label_id, round(r.score, 6)) for r in df.collect())


def test_widening_is_exact_and_all_cells_are_exact(spark):
    queries, labels = tables(spark)
    index = AN.build_cells(labels, cell_size=30)
    want = rows(ova_topk(queries, labels, 10))
    assert rows(AN.ann_topk(queries, index, 10, probes=2)) == want
    assert rows(AN.ann_topk(queries, index, 10, probes=10 ** 6, widen=False)) == want
    assert rows(AN.ann_topk(queries, index, 10, probes=3, block_queries=7)) == want  # popular cells in blocks


def test_recall_of_a_few_probes(spark):
    queries, labels = tables(spark)
    index = AN.build_cells(labels, cell_size=30)
    exact = ova_topk(queries, labels, 10)
    some = AN.recall(AN.ann_topk(queries, index, 10, probes=10, widen=False), exact).first().recall
    few = AN.recall(AN.ann_topk(queries, index, 10, probes=2, widen=False), exact).first().recall
    assert some >= 0.9 and few < some <= 1.0


def test_bound_holds_for_every_label(spark):
    queries, labels = tables(spark, 300, 40)
    members, cells = AN.build_cells(labels, cell_size=20)
    c = {r.cell: np.array(r.embedding) for r in cells.collect()}
    q = np.array([r.embedding for r in queries.collect()])
    for r in members.collect():
        x = np.array(r.embedding)
        assert (AN.reach(q, c[r.cell][None, :])[:, 0] >= q @ x - 1e-9).all()


def test_excluded_pairs_and_edges(spark):
    queries, labels = tables(spark, 200, 30)
    index = AN.build_cells(labels, cell_size=25)
    gone = ova_topk(queries, labels, 3).select("q_id", "label_id")
    assert rows(AN.ann_topk(queries, index, 5, probes=1, exclude=gone)) == rows(ova_topk(queries, labels, 5, exclude=gone))
    assert rows(AN.ann_topk(queries, index, 300, probes=1)) == rows(ova_topk(queries, labels, 300))  # fewer labels than k
    assert AN.ann_topk(queries, AN.build_cells(labels.where("false")), 5).count() == 0
    assert AN.ann_topk(queries.where("false"), index, 5).count() == 0
    odd = queries.unionByName(spark.createDataFrame([(None, [1.0] * 24), (5, None)], queries.schema))
    assert rows(AN.ann_topk(odd, index, 5)) == rows(ova_topk(queries, labels, 5))


@pytest.mark.parametrize("rounds", [1, 3])
def test_subtrees_equal_level_wise_splits(spark, rounds):
    from xmcforge.operators import cluster as CL
    _, labels = tables(spark, 300, 9)
    items = labels.withColumnRenamed("label_id", "item_id")
    level = {r.item_id: r.cluster_id for r in CL.balanced_clusters(items, 3, 5, rounds, subtree_bytes=0).collect()}
    tasks = {r.item_id: r.cluster_id for r in CL.balanced_clusters(items, 3, 5, rounds).collect()}
    some = {r.item_id: r.cluster_id for r in CL.balanced_clusters(items, 3, 5, rounds, subtree_bytes=200 * (8 * 24 + 64)).collect()}
    assert level == tasks == some


def test_depth_sixteen_and_a_rule_of_the_caller(spark):
    from collections import Counter
    from xmcforge.operators import cluster as CL
    _, labels = tables(spark, 800, 9)
    items = labels.withColumnRenamed("label_id", "item_id")
    out = CL.balanced_clusters(items, 16, 1).collect()
    assert len({r.cluster_id for r in out}) == 800 and all(0 <= r.cluster_id < 1 << 16 for r in out)

    def by_id(ids, x, rows, seed, level, node, rounds):
        rows = sorted(rows.tolist(), key=lambda r: int(ids[r]))
        return np.array(rows[:len(rows) // 2], int), np.array(rows[len(rows) // 2:], int)

    got = {r.item_id: r.cluster_id for r in CL.balanced_clusters(items, 2, halves=by_id).collect()}
    assert Counter(got.values()) == {0: 200, 1: 200, 2: 200, 3: 200}
    assert [got[i] for i in sorted(got)] == sorted(got.values())


def test_open_bounds_write_no_pairs_of_queries_and_cells(spark):
    """Vectors without clusters: every query must meet every cell, which once was a row with its vector each."""
    import os
    rng = np.random.default_rng(5)
    make = lambda name, n: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 12)))],
                                                 f"{name} long, embedding array<float>")
    queries, labels = make("q_id", 300), make("label_id", 700)
    index = AN.build_cells(labels, cell_size=10)
    kept = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(kept) for f in fs)
    before = size()
    found = AN.ann_topk(queries, index, 5, probes=2)
    got = rows(found)
    assert size() == before and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert got == rows(ova_topk(queries, labels, 5))
    few = AN.ann_topk(queries, index, 5, probes=2, widen=False)
    centers = {r.cell: np.array(r.embedding) for r in index[1].collect()}
    of = {r.label_id: (r.cell, np.array(r.embedding)) for r in index[0].collect()}
    best = {}
    for r in few.collect():
        best.setdefault(r.q_id, []).append((-r.score, r.label_id))
    for r in queries.collect()[:40]:
        v = np.array(r.embedding) / np.linalg.norm(r.embedding)
        cells = sorted(centers, key=lambda c: (-round(float(AN.reach(v[None], centers[c][None])[0, 0]), 6), c))[:2]
        want = sorted((-round(float(v @ x), 6), i) for i, (c, x) in of.items() if c in cells)[:5]
        assert [i for _, i in want] == [i for _, i in sorted(best[r.q_id])]
