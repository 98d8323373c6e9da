"""Losses in batch cells against plain loops over their definition."""

import math
import random

import numpy as np
import pytest

from xmcforge.operators import batch_losses as BL
from xmcforge.operators.sampling import md5_uniform
from xmcforge.sources import files as IO

VEC = "array<double>"


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def loops(docs, raw, fused, rel, draw, k, tau):
    """The terms of one batch: docs/raw/fused map ids to vectors, rel is a set of (doc, label)."""
    def sim(a, b):
        return round(sum(x * y for x, y in zip(unit(a), unit(b))), 6)

    def triplets(anchors, cands, related, key):
        sums, viol = [], []
        for a in sorted(anchors):
            pos = min((c for c in cands if related(a, c)), key=lambda c: (key(a, c), c), default=None)
            neg = sorted((c for c in cands if not related(a, c)), key=lambda c: (-sim(anchors[a], cands[c]), c))[:k]
            entries = []
            if pos is not None:
                p = sim(anchors[a], cands[pos])
                for c in neg:
                    n = sim(anchors[a], cands[c])
                    loss = max(0.0, n - p + min(max(abs(p - n), 0.1), 0.3))
                    entries.append((loss, (n if loss else -50.0) / tau))
            top = max((z for _, z in entries), default=0.0)
            total = sum(math.exp(z - top) for _, z in entries)
            weighted = [x * math.exp(z - top) / total for x, z in entries]
            sums.append(sum(weighted))
            viol.append(sum(x > 0 for x in weighted))
        return sum(sums) / len(sums), sum(viol) / len(viol)

    u, _ = triplets(docs, raw, lambda d, x: (d, x) in rel, lambda d, x: draw[d, x])
    uv, viol = triplets(docs, fused, lambda d, x: (d, x) in rel, lambda d, x: draw[d, x])
    i, _ = triplets(raw, docs, lambda x, d: (d, x) in rel, lambda x, d: draw[x, d])
    lp, ln = [], []
    for d in docs:
        pos = min((x for x in raw if (d, x) in rel), key=lambda x: (draw[d, x], x), default=None)
        if pos is None:
            continue
        lp.append(max(0.0, sim(docs[d], raw[pos]) - sim(docs[d], fused[pos]) + 0.1))
        for x in sorted((x for x in fused if (d, x) not in rel), key=lambda x: (-sim(docs[d], fused[x]), x))[:k]:
            ln.append(max(0.0, sim(docs[d], fused[x]) - sim(docs[d], raw[x]) + 0.1))
    mean = lambda v: sum(v) / sum(x > 0 for x in v) if any(x > 0 for x in v) else 0.0
    return u, uv, i, (mean(lp) + mean(ln)) / 2, viol


@pytest.mark.parametrize("k", [3, 50])
def test_terms_equal_loops(spark, k):
    rnd = random.Random(k)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(6)]
    docs, raw, fused = {d: vec() for d in range(24)}, {x: vec() for x in range(100, 118)}, {x: vec() for x in range(100, 118)}
    fused[100] = raw[100]
    raw[103] = [0.0] * 6
    plan = [(d // 8, d, rnd.choice(sorted(raw))) for d in docs]
    xy = {(d, x) for _, d, x in plan} | {(d, rnd.choice(sorted(raw))) for d in docs for _ in range(2)}
    df = lambda m, c: spark.createDataFrame(list(m.items()) * 2, f"{c} long, embedding {VEC}")  # noqa: E731  repeated rows
    pairs = spark.createDataFrame(sorted(xy) * 2, "doc_id long, label_id long")
    out = BL.batch_losses(spark.createDataFrame(plan, "batch_id long, doc_id long, label_id long"), df(docs, "doc_id"),
                          df(raw, "label_id"), df(fused, "label_id"), pairs, k=k, seed=5).collect()
    both = pairs.union(pairs.selectExpr("label_id", "doc_id")).toDF("a", "b").distinct()
    draw = {(r.a, r.b): -math.log(r.u) for r in both.withColumn("u", md5_uniform("a", "b", IO.F.lit(5))).collect()}
    assert sorted(r.batch_id for r in out) == [0, 1, 2]
    for r in out:
        d = {x: docs[x] for b, x, _ in plan if b == r.batch_id}
        labels = {x for b, _, x in plan if b == r.batch_id}
        want = loops(d, {x: raw[x] for x in labels}, {x: fused[x] for x in labels}, xy, draw, k, 0.1)
        assert np.allclose((r.u, r.uv, r.i, r.r, r.violators_uv), want, atol=1e-9)
        assert (r.n_docs, r.n_labels) == (8, len(labels)) and abs(r.total - (want[0] + want[1] + want[2] + 0.1 * want[3])) < 1e-9


def test_batches_without_vectors_and_without_negatives(spark):
    plan = spark.createDataFrame([(0, 1, 10), (1, 2, 10), (2, 3, 11)], "batch_id long, doc_id long, label_id long")
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], f"doc_id long, embedding {VEC}")
    raw = spark.createDataFrame([(10, [1.0, 1.0]), (11, [1.0, 0.0])], f"label_id long, embedding {VEC}")
    fused = spark.createDataFrame([(10, [1.0, 0.0]), (11, None)], f"label_id long, embedding {VEC}")
    xy = plan.select("doc_id", "label_id")
    out = BL.batch_losses(plan, docs, raw, fused, xy).collect()
    assert [(r.batch_id, r.n_docs, r.n_labels, r.u, r.uv, r.i) for r in out] == [(0, 1, 1, 0.0, 0.0, 0.0)]
    assert BL.batch_losses(plan.limit(0), docs, raw, fused, xy).count() == 0


def test_vectors_are_shuffled_to_cells_once(spark):
    plan = spark.createDataFrame([(0, 1, 10)], "batch_id long, doc_id long, label_id long")
    v = spark.createDataFrame([(1, [1.0])], f"doc_id long, embedding {VEC}")
    lab = spark.createDataFrame([(10, [1.0])], f"label_id long, embedding {VEC}")
    tree = BL.batch_losses(plan, v, lab, lab, plan.select("doc_id", "label_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("FlatMapGroupsInArrow") == 1 and "Cross" not in tree


def test_a_loss_epoch_written_again_replaces_itself(spark):
    path = IO.scratch_path(spark, "losses")
    one = spark.createDataFrame([(0, 1.0), (1, 2.0)], "batch_id long, total double")
    for epoch, scale in ((0, 1.0), (1, 10.0), (0, 3.0)):
        IO.append_losses(one.withColumn("total", one.total * scale), path, epoch)
    got = [(r.step, r.epoch, r.batch_id, r.total) for r in IO.loss_history(spark, path).orderBy("step").collect()]
    assert got == [(0, 0, 0, 3.0), (1, 0, 1, 6.0), (2, 1, 0, 10.0), (3, 1, 1, 20.0)]
