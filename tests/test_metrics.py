import math

import numpy as np
import pandas as pd
import pytest

from xmcforge.operators import metrics as M

KS = [1, 2, 3, 5]


def by_definition(pred, truth, queries, ks, weights=None, no_hit="zero"):
    """Every metric straight from its definition: a loop over queries for each cut-off."""
    gain = lambda i: 1.0 / math.log2(i + 1)
    out = {}
    for k in ks:
        sums = dict.fromkeys(["P", "R", "Hit", "nDCG", "MAP", "MRR", "w", "iw", "dw", "idw"], 0.0)
        for q in queries:
            true = set(truth.get(q, ()))
            listed = list(pred.get(q, []))
            hits = [i for i, label in enumerate(listed[:k], start=1) if label in true]
            sums["P"] += len(hits) / k
            sums["R"] += len(hits) / max(len(true), 1)
            sums["Hit"] += bool(hits)
            best = sum(gain(i) for i in range(1, min(len(true), k) + 1))
            if best:
                sums["nDCG"] += sum(map(gain, hits)) / best
            if hits:
                sums["MAP"] += sum((n + 1) / i for n, i in enumerate(hits)) / len(hits)
                sums["MRR"] += 1 / hits[0]
            elif no_hit == "reference" and not any(x in true for x in listed[:max(ks)]):
                sums["MRR"] += 1.0
            if weights is not None:
                ideal = sorted((weights.get(x, 0.0) for x in true), reverse=True)[:k]
                mine = {i: weights.get(listed[i - 1], 0.0) for i in hits}
                sums["w"] += sum(mine.values())
                sums["iw"] += sum(ideal)
                if best:
                    sums["dw"] += sum(w * gain(i) for i, w in mine.items()) / best
                    sums["idw"] += sum(w * gain(i) for i, w in enumerate(ideal, start=1)) / best
        for name in ("P", "R", "Hit", "nDCG", "MAP", "MRR"):
            out.setdefault(name, {})[k] = 100 * sums[name] / len(queries)
        if weights is not None:
            out.setdefault("PSP", {})[k] = 100 * sums["w"] / sums["iw"]
            out.setdefault("PSnDCG", {})[k] = 100 * sums["dw"] / sums["idw"]
    return out


@pytest.fixture(scope="module")
def fixture(spark):
    rng = np.random.default_rng(3)
    queries = list(range(12))
    truth = {q: sorted(rng.choice(30, size=rng.integers(1, 6), replace=False).tolist()) for q in queries[:10]}
    truth[10] = []                      # T = 0
    pred = {}
    for q in queries:
        n = 5 if q % 4 else 2           # short lists
        pred[q] = rng.choice(30, size=n, replace=False).tolist()
    pred[11] = []                       # nothing predicted at all
    pred[3] = [x for x in range(30) if x not in truth[3]][:5]   # no hit
    weights = {l: 1.0 + (l % 7) / 3 for l in range(30)}
    prow = [(q, l, float(10 - i), i + 1) for q, ls in pred.items() for i, l in enumerate(ls)]
    trow = [(q, l) for q, ls in truth.items() for l in ls]
    pdf = spark.createDataFrame(prow, "q_id long, label_id long, score double, rank long")
    tdf = spark.createDataFrame(trow, "q_id long, label_id long")
    qdf = spark.createDataFrame([(q,) for q in queries], "q_id long")
    wdf = spark.createDataFrame(list(weights.items()), "label_id long, weight double")
    return dict(pred=pred, truth=truth, queries=queries, weights=weights, pdf=pdf, tdf=tdf, qdf=qdf, wdf=wdf)


@pytest.mark.parametrize("no_hit", ["zero", "reference"])
def test_report_matches_the_definitions(spark, fixture, no_hit):
    f = fixture
    rep = M.metrics_report(f["pdf"], f["tdf"], f["qdf"], KS, weights=f["wdf"], no_hit=no_hit).toPandas()
    want = by_definition(f["pred"], f["truth"], f["queries"], KS, f["weights"], no_hit)
    for _, r in rep.iterrows():
        assert math.isclose(r.value, want[r.metric][r.k], abs_tol=1e-5), (r.metric, r.k, r.value, want[r.metric][r.k])
    assert set(rep.metric) == set(want)


def test_properties(spark, fixture):
    f = fixture
    rep = M.metrics_report(f["pdf"], f["tdf"], f["qdf"], KS).toPandas()
    assert ((rep.value >= 0) & (rep.value <= 100)).all()
    hit = rep[rep.metric == "Hit"].sort_values("k").value.tolist()
    assert hit == sorted(hit)


def test_reranks_by_score_without_rank(spark, fixture):
    f = fixture
    rep1 = M.metrics_report(f["pdf"], f["tdf"], f["qdf"], KS).toPandas()
    rep2 = M.metrics_report(f["pdf"].drop("rank"), f["tdf"], f["qdf"], KS).toPandas()
    pd.testing.assert_frame_equal(rep1.sort_values(["metric", "k"]).reset_index(drop=True),
                                  rep2.sort_values(["metric", "k"]).reset_index(drop=True))


def test_inverse_propensity_formula(spark):
    xy = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (2, 2)], "doc_id long, label_id long")
    shape = spark.createDataFrame([(4, 3)], "n_rows long, n_labels long")
    labels = spark.createDataFrame([(0,), (1,), (2,)], "label_id long")
    w = dict(M.inverse_propensity(xy, shape, A=0.55, B=1.5, labels=labels).toPandas().values.tolist())
    C = (math.log(4) - 1) * (2.5 ** 0.55)
    for lab, n in ((0, 0), (1, 3), (2, 1)):
        assert math.isclose(w[lab], 1 + C * (n + 1.5) ** -0.55, rel_tol=1e-12)


def test_rows_of_other_queries_do_not_count(spark, fixture):
    f = fixture
    some = spark.createDataFrame([(0,), (1,)], "q_id long")
    rep = M.metrics_report(f["pdf"], f["tdf"], some, KS, weights=f["wdf"]).toPandas()
    want = by_definition(f["pred"], f["truth"], [0, 1], KS, f["weights"])
    assert (rep.value <= 100 + 1e-6).all()
    for _, r in rep.iterrows():
        assert math.isclose(r.value, want[r.metric][r.k], abs_tol=1e-5), (r.metric, r.k)
