import numpy as np
import pytest
from pyspark.sql import functions as F

from xmcforge.operators import retrieval as R


def _vecs(spark, ids, mat, id_col):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, mat)]
    return spark.createDataFrame(rows, f"{id_col} long, embedding array<float>")


def _brute(q, lab, k, exclude=()):
    qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    ln = lab / np.maximum(np.linalg.norm(lab, axis=1, keepdims=True), 1e-300)
    qn[np.linalg.norm(q, axis=1) == 0] = 0
    s = np.round(qn.astype(np.float64) @ ln.astype(np.float64).T, 6)
    out = {}
    for i in range(len(q)):
        cand = [(-s[i, j], j) for j in range(len(lab)) if (i, j) not in exclude]
        out[i] = [j for _, j in sorted(cand)[:k]]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    q = rng.normal(size=(37, 8)).astype(np.float32)
    lab = rng.normal(size=(53, 8)).astype(np.float32)
    lab[10] = lab[3]           # exact tie
    lab[20] = lab[3] * 2       # same direction: tied cosine
    q[5] = 0                   # zero query
    return q, lab


@pytest.mark.parametrize("blocks", [None, (1, 1), (3, 4), (7, 2)])
def test_blocked_topk_matches_brute_force(spark, data, blocks):
    q, lab = data
    got = R.ova_topk(_vecs(spark, range(len(q)), q, "q_id"), _vecs(spark, range(len(lab)), lab, "label_id"), 5,
                     blocks=blocks).toPandas()
    want = _brute(q, lab, 5)
    for i in range(len(q)):
        g = got[got.q_id == i].sort_values("rank").label_id.tolist()
        assert g == want[i], (i, g, want[i])
    assert got.groupby("q_id")["rank"].apply(lambda r: sorted(r) == list(range(1, 6))).all()


def test_filter_before_is_exact_with_uneven_exclusions(spark, data):
    q, lab = data
    ex = {(0, j) for j in range(40)} | {(1, 3), (2, 10)}   # query 0 loses most labels
    exdf = spark.createDataFrame(sorted(ex), "q_id long, label_id long")
    got = R.ova_topk(_vecs(spark, range(len(q)), q, "q_id"), _vecs(spark, range(len(lab)), lab, "label_id"), 5,
                     exclude=exdf, exclude_mode="before", blocks=(2, 3)).toPandas()
    want = _brute(q, lab, 5, ex)
    for i in range(len(q)):
        assert got[got.q_id == i].sort_values("rank").label_id.tolist() == want[i]


def test_filter_after_shrinks_lists(spark, data):
    q, lab = data
    top = _brute(q, lab, 5)
    ex = [(i, top[i][0]) for i in range(len(q))]
    exdf = spark.createDataFrame(ex, "q_id long, label_id long")
    got = R.ova_topk(_vecs(spark, range(len(q)), q, "q_id"), _vecs(spark, range(len(lab)), lab, "label_id"), 5,
                     exclude=exdf, exclude_mode="after").toPandas()
    assert (got.groupby("q_id").size() == 4).all()
    for i in range(len(q)):
        assert got[got.q_id == i].sort_values("rank").label_id.tolist() == top[i][1:]


def test_plan_is_blocked_and_limited(spark, data):
    q, lab = data
    df = R.ova_topk(_vecs(spark, range(len(q)), q, "q_id"), _vecs(spark, range(len(lab)), lab, "label_id"), 5,
                    blocks=(2, 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroupsIn" not in plan
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_similar_labels_excludes_self(spark, data):
    _, lab = data
    df = _vecs(spark, range(len(lab)), lab, "label_id")
    out = R.similar_labels(df, df, topk=3).toPandas()
    assert (out.label_id != out.neighbor_id).all()
    # label 3 has two exact duplicates in direction -> similarity 1 -> mask 1, bucket 1
    row = out[(out.label_id == 3) & (out["rank"] == 1)].iloc[0]
    assert row.neighbor_id in (10, 20) and row["mask"] == 1.0 and row.bucket == 1


def test_nulls_and_repeated_queries(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0])], "q_id long, embedding array<double>")
    lab = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, None), (13, [1.0, 1.0])], "label_id long, embedding array<double>")
    ex = spark.createDataFrame([(1, 10), (2, 11), (1, None)], "q_id long, label_id long")
    got = sorted((r.q_id, r["rank"], r.label_id) for r in R.ova_topk(q, lab, 3, exclude=ex).collect())
    assert got == [(1, 1, 13), (1, 2, 11)]


def test_vectors_of_different_width_are_an_error(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q_id long, embedding array<double>")
    lab = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "label_id long, embedding array<double>")
    with pytest.raises(Exception, match="same width"):
        R.ova_topk(q, lab, 3).collect()


def test_caller_supplied_score(spark, data):
    q, lab = data
    qd, ld = _vecs(spark, range(len(q)), q, "q_id"), _vecs(spark, range(len(lab)), lab, "label_id")
    near = lambda a, b: -np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)
    got = R.ova_topk(qd, ld, 4, normalize=False, score=near, blocks=(2, 3)).toPandas()
    s = np.round(near(q.astype(float), lab.astype(float)), 6)
    for i in range(len(q)):
        assert got[got.q_id == i].sort_values("rank").label_id.tolist() == sorted(range(len(lab)), key=lambda j: (-s[i, j], j))[:4]


def test_every_cell_has_a_task_and_batches_merge(spark, data):
    q, lab = data
    many = np.concatenate([lab] * 30)
    c = R.candidates(_vecs(spark, range(len(q)), q, "q_id"), _vecs(spark, range(len(many)), many, "label_id"), k=7, blocks=(4, 2))
    parts = c.select("q_id", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().collect()
    assert len(parts) == 8
    got = R.rank_within_query(c, 7).toPandas()
    want = _brute(q, many, 7)
    for i in range(len(q)):
        assert got[got.q_id == i].sort_values("rank").label_id.tolist() == want[i]


def _stream(q, batches, k, ex=(), drop=True):
    """The cell's rows (q_id, label_id, excluded) in rank order, and the peak of its memory in MB."""
    import tracemalloc
    import pyarrow as pa
    vec = lambda m: pa.array(list(m), pa.list_(pa.float32()))
    tracemalloc.start()
    cell = R._Cell(k, True, drop, 6, None)
    cell.add(0, pa.RecordBatch.from_arrays([pa.array(np.arange(len(q))), vec(q)], names=["id", "vec"]))
    if len(ex):
        cell.add(1, pa.RecordBatch.from_arrays([pa.array(x) for x in np.array(sorted(ex)).T], names=["id", "other"]))
    at = 0
    for m in batches:
        cell.add(2, pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(m))), vec(m)], names=["id", "vec"]))
        at += len(m)
    out = [r for b in cell.batches() for r in zip(b["q_id"].to_pylist(), b["label_id"].to_pylist(), b["excluded"].to_pylist())]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_a_task_holds_little_beside_its_lists():
    rng = np.random.default_rng(3)
    q, lab = rng.normal(size=(1500, 16)).astype(np.float32), rng.normal(size=(50_000, 16)).astype(np.float32)
    out, peak = _stream(q, np.split(lab, 5), 50)
    assert len(out) == 1500 * 50 and peak < 120
    q = q[:20]
    want = _brute(q, lab, 50)
    assert [(i, j) for i in range(20) for j in want[i]] == [(i, j) for i, j, _ in out if i < 20]


def test_lists_grow_with_k_and_cut_the_blocks():
    wide = R.plan_blocks(12, 600_000, 1_200_000, 64, R.CELL_BYTES, k=500, held=R.held_bytes(500, 64))
    assert wide[0] * R.CELL_BYTES >= 600_000 * (8 * 64 + 28 * 500)


@pytest.mark.parametrize("drop", [True, False])
def test_screened_labels_keep_ties_exclusions_and_odd_values(drop):
    rng = np.random.default_rng(4)
    q = np.round(rng.normal(size=(300, 3))).astype(np.float32)      # few directions: many ties, zero vectors
    lab = np.round(rng.normal(size=(9_000, 3))).astype(np.float32)
    lab[5_000] = [np.nan, 1, 1]
    ex = {(i, j) for i in range(0, 300, 7) for j in rng.integers(0, 9_000, 40).tolist()}
    out, _ = _stream(q, np.split(lab, 3), 5, ex, drop)
    unit = lambda m: R._normalize_rows(m.astype(np.float64))
    s = np.round(unit(q) @ unit(lab).T, 6)
    for i in range(300):
        want = sorted((-s[i, j], j) for j in range(9_000) if not (drop and (i, j) in ex))[:5]
        assert [(j, not drop and (i, j) in ex) for _, j in want] == [(j, f) for a, j, f in out if a == i]


def test_scores_that_reach_their_limit_are_found_in_order():
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(40, 70)).astype(np.float32)
    for limit in (np.full(40, 9.0), np.full(40, 2.5), np.full(40, -9.0), np.where(np.arange(40) == 7, 0.0, 9.0), raw.max(axis=1).astype(float)):
        r, c = R._reaching(raw, limit)
        want = np.nonzero(raw >= limit.astype(np.float32)[:, None])
        assert r.tolist() == want[0].tolist() and c.tolist() == want[1].tolist()


@pytest.mark.parametrize("score", [None, lambda a, b: np.abs(a @ b.T)])
def test_few_labels_are_ranked_before_the_others_are_screened(monkeypatch, score):
    rng = np.random.default_rng(6)
    q, lab = rng.normal(size=(600, 16)), rng.normal(size=(20_000, 16))
    ranked, rank = [], R.block_topk
    monkeypatch.setattr(R, "block_topk", lambda rows, qm, ids, *a: ranked.append(len(rows) * len(ids)) or rank(rows, qm, ids, *a))
    cell = R._Cell(10, False, True, 6, score)
    cell.parts = {0: ([np.arange(600)], [q]), 1: ([], [])}
    assert cell.ready()
    for at, end in ((0, 300), (300, 9_000), (9_000, 20_000)):  # batches of any size
        cell.meet_all(np.arange(at, end), lab[at:end])
    got = {}
    for b in cell.batches():
        for i, j in zip(b["q_id"].to_pylist(), b["label_id"].to_pylist()):
            got.setdefault(i, []).append(j)
    s = np.round(np.abs(q @ lab.T) if score else q @ lab.T, 6)
    assert all(got[i] == np.lexsort((np.arange(20_000), -s[i]))[:10].tolist() for i in range(600))
    assert sum(ranked) <= 600 * 1_024
