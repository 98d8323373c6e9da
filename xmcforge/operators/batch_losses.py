"""All losses of a training batch in one pass over its vectors (C08-C10 on batch cells).

A batch is one cell: its documents, its distinct sampled labels in the raw and the fused view, and
the relevant pairs among them.  One task holds a cell at a time, makes the two similarity matrices
and takes the four terms from them:

    u   documents against raw labels          uv  documents against fused labels
    i   raw labels against documents          r   raw against fused similarities (margin regulariser)

A cell is bounded by the plan's batch size, whatever the corpus; vectors are shuffled to cells once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmcforge.operators.audit import NEG_SENTINEL
from xmcforge.operators.retrieval import _matrix, _normalize_rows, _vector_type
from xmcforge.operators.sampling import md5_uniform

TERMS = "batch_id long, n_docs long, n_labels long, u double, uv double, i double, r double, violators_uv double"
DOC, RAW, FUSED, PAIR = range(4)


def _hardest(sim, positive, k: int):
    """(columns, present) of each row's ``k`` largest entries that are not positive; ties go to the
    smaller column.  Rows with fewer have absent places."""
    import numpy as np
    k = min(k, sim.shape[1])
    masked = np.where(positive, -np.inf, sim)
    at = np.argsort(-masked, axis=1, kind="stable")[:, :k]
    return at, np.take_along_axis(~positive, at, axis=1)


def _drawn(draw):
    """Each row's positive column: the smallest draw, ties to the smaller column (inf: no pair)."""
    import numpy as np
    at = draw.argmin(axis=1)
    return at, np.isfinite(draw[np.arange(len(draw)), at])


def triplet_rows(sim, positive, draw, k: int, margin_min: float, margin_max: float, tau: float | None):
    """(row sums of the loss, violators per row, rows that have a positive) of a similarity matrix.

    Loss of a row's positive s_p and hard negative s_n: max(0, s_n - s_p + m) with m = |s_p - s_n| kept
    within the margins, weighted by the softmax over the row's negatives at ``tau`` (None: unweighted),
    where negatives without loss stand at -50."""
    import numpy as np
    at, there = _hardest(sim, positive, k)
    pos, has = _drawn(draw)
    s_n = np.take_along_axis(sim, at, axis=1)
    s_p = sim[np.arange(len(sim)), pos][:, None]
    margin = margin_min if margin_min == margin_max else np.clip(np.abs(s_p - s_n), margin_min, margin_max)
    loss = np.where(there & has[:, None], np.maximum(0.0, s_n - s_p + margin), 0.0)
    if tau is not None and loss.shape[1]:
        z = np.where(there, np.where(loss == 0, NEG_SENTINEL, s_n) / tau, -np.inf)
        e = np.where(there, np.exp(z - np.where(there.any(axis=1), z.max(axis=1), 0.0)[:, None]), 0.0)
        loss = loss * e / np.maximum(e.sum(axis=1), np.finfo(float).tiny)[:, None]
    return loss.sum(axis=1), (loss > 0).sum(axis=1), has


def margin_terms(sim_i, sim_f, positive, draw, k: int, margin: float) -> float:
    """Mean of the positive and the negative margin term, each averaged over its entries above 0."""
    import numpy as np
    pos, has = _drawn(draw)
    rows = np.arange(len(sim_i))
    p = np.maximum(0.0, sim_i[rows, pos] - sim_f[rows, pos] + margin)[has]
    at, there = _hardest(sim_f, positive, k)
    there &= has[:, None]
    n = np.maximum(0.0, np.take_along_axis(sim_f, at, axis=1) - np.take_along_axis(sim_i, at, axis=1) + margin)[there]
    return sum(x[x > 0].mean() if (x > 0).any() else 0.0 for x in (p, n)) / 2.0


def batch_losses(plan: DataFrame, doc_vecs: DataFrame, raw: DataFrame, fused: DataFrame, xy: DataFrame, k: int = 10,
                 margin_min: float = 0.1, margin_max: float = 0.3, tau: float | None = 0.1, reg_margin: float = 0.1,
                 reg_weight: float = 0.1, seed: int = 0, digits: int = 6) -> DataFrame:
    """One row per batch of ``plan`` (batch_id, doc_id, label_id): the batch's u, uv, i, r, their sum
    ``total`` = u + uv + i + reg_weight * r, and the mean number of violators of uv.

    ``doc_vecs`` (doc_id, embedding), ``raw`` and ``fused`` (label_id, embedding), ``xy`` (doc_id, label_id).
    Positives are drawn by hash among the anchor's relevant partners in the batch; anchors without one count
    with loss 0.  Documents and labels without a vector (in either view) take no part; a batch left without
    documents or labels has no row.  Similarities are cosines rounded to ``digits``."""
    width = _vector_type(doc_vecs.schema["embedding"], raw.schema["embedding"], fused.schema["embedding"])
    cell = F.col("batch_id").cast("long").alias("batch_id")
    vec = lambda c: F.col(c).cast(width).alias("vec")
    no_draw = [F.lit(None).cast("double").alias("by_doc"), F.lit(None).cast("double").alias("by_label")]

    def vectors(df, kind, id_col, col):
        return df.select(cell, F.lit(kind).alias("kind"), F.col(id_col).cast("long").alias("id"),
                         F.lit(0).cast("long").alias("other"), vec(col), *no_draw)

    docs = plan.select("batch_id", "doc_id").distinct().join(doc_vecs.select("doc_id", "embedding").where("embedding is not null"), "doc_id")
    sampled = plan.select("batch_id", "label_id").distinct()
    views = (raw.select("label_id", F.col("embedding").alias("raw_vec")).where("raw_vec is not null")
             .join(fused.select("label_id", F.col("embedding").alias("fused_vec")).where("fused_vec is not null"), "label_id"))
    labels = sampled.join(views, "label_id")
    draw = lambda a, b: -F.log(md5_uniform(a, b, F.lit(seed)))
    pairs = (plan.select("batch_id", "doc_id").distinct().join(xy.select("doc_id", "label_id").distinct(), "doc_id")
             .join(sampled, ["batch_id", "label_id"])
             .select(cell, F.lit(PAIR).alias("kind"), F.col("doc_id").cast("long").alias("id"),
                     F.col("label_id").cast("long").alias("other"), F.lit(None).cast(width).alias("vec"),
                     draw("doc_id", "label_id").alias("by_doc"), draw("label_id", "doc_id").alias("by_label")))
    rows = (vectors(docs, DOC, "doc_id", "embedding").unionByName(vectors(labels, RAW, "label_id", "raw_vec"))
            .unionByName(vectors(labels, FUSED, "label_id", "fused_vec")).unionByName(pairs))

    def run(t):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("batch_id", pa.int64()), ("n_docs", pa.int64()), ("n_labels", pa.int64())]
                           + [(c, pa.float64()) for c in ("u", "uv", "i", "r", "violators_uv")])
        kind, ids, other = (np.asarray(t.column(c)) for c in ("kind", "id", "other"))

        def view(number):
            at = np.flatnonzero(kind == number)
            at = at[np.unique(ids[at], return_index=True)[1]]
            return ids[at], _normalize_rows(_matrix(t.column("vec").take(pa.array(at)))) if len(at) else None

        (d, dm), (l, rm), (_, fm) = view(DOC), view(RAW), view(FUSED)
        if not len(d) or not len(l):
            return schema.empty_table()
        sim_i, sim_f = (np.round(dm @ m.T, digits) for m in (rm, fm))
        positive = np.zeros(sim_i.shape, bool)
        by_doc, by_label = np.full(sim_i.shape, np.inf), np.full(sim_i.shape[::-1], np.inf)
        at = np.flatnonzero((kind == PAIR) & np.isin(ids, d) & np.isin(other, l))
        x, y = np.searchsorted(d, ids[at]), np.searchsorted(l, other[at])
        positive[x, y] = True
        by_doc[x, y] = np.asarray(t.column("by_doc").take(pa.array(at)))
        by_label[y, x] = np.asarray(t.column("by_label").take(pa.array(at)))
        settings = (k, margin_min, margin_max, tau)
        u, _, _ = triplet_rows(sim_i, positive, by_doc, *settings)
        uv, bad, _ = triplet_rows(sim_f, positive, by_doc, *settings)
        i, _, _ = triplet_rows(sim_i.T, positive.T, by_label, *settings)
        r = margin_terms(sim_i, sim_f, positive, by_doc, k, reg_margin)
        row = [int(t.column("batch_id")[0].as_py()), len(d), len(l), u.mean(), uv.mean(), i.mean(), r, bad.mean()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    out = rows.groupBy("batch_id").applyInArrow(run, TERMS)
    return out.withColumn("total", F.col("u") + F.col("uv") + F.col("i") + F.lit(reg_weight) * F.col("r"))
