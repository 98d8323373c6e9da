import numpy as np

from xmcforge.llm.neighbours import VantageTree, distances, nearest

VEC = "id long, vector array<double>, rank int, score string"


def brute(rows, queries, k):
    def ok(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out = {}
    for i, q, *_ in queries:
        if i is None or not ok(q):
            continue
        near = sorted((float(np.sqrt(np.square(np.array(q) - np.array(v)).sum())), j) for j, v, *_ in rows
                      if j is not None and j != i and ok(v) and len(v) == len(q))
        out[i] = near[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def vectors(n=600, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    x[::3] = x[0]  # a third of the rows are one vector
    return [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]


def test_factor_one_is_exact(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VEC)
    got = answers(nearest(df, df.where("id % 20 = 0"), 10, factor=1.0, shard_rows=150, query_rows=10))
    assert got == brute(rows, [r for r in rows if r[0] % 20 == 0], 10)


def test_recall_of_the_default_factor(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(rng.normal(size=(3000, 16)))]
    df = spark.createDataFrame(rows, VEC)
    got = answers(nearest(df, df.where("id % 50 = 0"), shard_rows=1000))
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 10)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_larger_factors_read_less():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(2000, 3)), rng.normal(size=(20, 3))
    tree = VantageTree(x)
    exact = np.sort(distances(q, x), axis=1)[:, :5]
    best, _ = tree.search(q, np.full(20, -1), np.arange(2000), 5, 1.0)
    assert (best == exact).all()
    loose, _ = tree.search(q, np.full(20, -1), np.arange(2000), 5, 1e9)
    assert (loose >= exact).all() and (loose > exact).any()


def test_edges(spark):
    rows = [(1, [1.0, 2.0], 0, ""), (2, None, 0, ""), (3, [0.0, 0.0], 0, ""), (4, [1.0, None], 0, ""), (5, [float("nan"), 1.0], 0, ""),
            (6, [float("inf"), 1.0], 0, ""), (7, [], 0, ""), (8, [1.0, 2.0, 3.0], 0, ""), (None, [1.0, 1.0], 0, ""),
            (9, [1.0, 2.0], 0, ""), (9, [4.0, 4.0], 0, ""), (10, [1.0, 3.0], 0, ""), (11, [1.0, 1.0], 0, "")]
    df = spark.createDataFrame(rows, VEC)
    got = answers(nearest(df, df.where("id not in (9)")))
    want = {q: n for q, n in brute(rows, [r for r in rows if r[0] != 9], 10).items() if n}
    assert got == want and 8 not in got  # ties go to the smaller id; too few candidates are all returned
    assert nearest(df.where("false"), df).count() == 0 and nearest(df, df.where("false")).count() == 0


def test_distances_beyond_the_range_of_squares(spark):
    import math
    vectors = [[1e200, 0.0], [-1e200, 0.0], [1e-200, 0.0], [3e-200, 4e-200], [1.0, 1.0], [1e308, 1e308], [-1e308, -1e308], [2e200, 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, vector array<double>")

    def measure(a, b):
        return math.dist(a, b)  # scaled, infinite where the distance is no double

    for shard_rows, k in ((4096, 10), (2, 10), (4096, 3)):
        got = {}
        for r in nearest(df, df, k=k, factor=1.0, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for q, v in enumerate(vectors):
            want = sorted(((measure(v, w), i) for i, w in enumerate(vectors) if i != q))[:k]
            assert [i for i, _ in got[q]] == [i for _, i in want], q
            assert all(a == b or abs(a - b) <= 1e-12 * b for (_, a), (b, _) in zip(got[q], want))


def test_a_tree_with_infinite_distances_loses_nothing(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 4)) * 10.0 ** rng.choice([0, 100, 200, 307], size=(300, 1))
    tree = VantageTree(rows, leaf_rows=8)
    with np.errstate(over="ignore"):
        exact = distances(rows[:40], rows)
    best, row = tree.search(rows[:40], np.arange(40), np.arange(300), 299, 1.0)
    for q in range(40):
        order = [i for i in np.lexsort((np.arange(300), exact[q])) if i != q]
        assert row[q].tolist() == order
