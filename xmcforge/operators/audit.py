"""Loss audits over similarity tables.

The reference computes these losses on a batch similarity matrix during fitting:
``in_batch_triplets`` does so over the batches of a training plan (n x batch similarities, one
cell per batch).  The other audits mine negatives from a whole label table with the exact
retrieval.  Positives are excluded before ranking, so a short list is never padded with them,
positives are md5-sampled, and every reduction is a Spark aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xmcforge.functions import vectors as V
from xmcforge.operators.retrieval import cell_topk, ova_topk, rank_within_query
from xmcforge.operators.sampling import in_batch_relevance, sample_positive

NEG_SENTINEL = -50.0


def _norm(df: DataFrame, id_col: str, out_id: str, out_vec: str) -> DataFrame:
    return df.select(F.col(id_col).alias(out_id), V.l2_normalize("embedding").alias(out_vec))


def pair_similarity(pairs: DataFrame, anchors: DataFrame, cands: DataFrame, a_col: str, c_col: str,
                    out: str) -> DataFrame:
    """Rounded cosine of given (anchor, candidate) pairs (native dot on unit vectors)."""
    a = _norm(anchors, "q_id", a_col, "_av")
    c = _norm(cands, "label_id", c_col, "_cv")
    return (pairs.join(a, a_col).join(c, c_col)
                 .withColumn(out, F.round(V.dot("_av", "_cv"), 6)).drop("_av", "_cv"))


def hard_negatives(anchors: DataFrame, cands: DataFrame, positives: DataFrame, k: int,
                   extra_exclude: DataFrame | None = None) -> DataFrame:
    """T03 + P20: the k most similar non-positive candidates per anchor
    (q_id, neg_id, sim_n, rank)."""
    ex = positives.select("q_id", "label_id")
    if extra_exclude is not None:
        ex = ex.unionByName(extra_exclude.select("q_id", "label_id"))
    top = ova_topk(anchors, cands, k, exclude=ex, exclude_mode="before")
    return top.select("q_id", F.col("label_id").alias("neg_id"), F.col("score").alias("sim_n"), "rank")


def triplet_entries(anchors: DataFrame, cands: DataFrame, positives: DataFrame, k: int = 10,
                    margin_min: float = 0.1, margin_max: float = 0.3, apply_softmax: bool = False,
                    tau: float = 0.1, seed: int = 0, fixed_pos: DataFrame | None = None,
                    extra_exclude: DataFrame | None = None, negs: DataFrame | None = None) -> DataFrame:
    """C08 per (anchor, negative): loss = max(0, s_n - s_p + m), m = clamp(|s_p - s_n|, min, max)
    (or the constant when min == max); with ``apply_softmax`` the loss is weighted by the
    softmax over the anchor's negatives at temperature ``tau``, zero-loss negatives at -50.

    ``fixed_pos`` (q_id, pos_id) gives each anchor's positive, as a training plan sampled it;
    without it one is drawn.  Anchors without any positive are skipped.  ``negs`` are the
    ``hard_negatives`` of the same arguments where they were mined before."""
    if fixed_pos is not None:
        pos = fixed_pos.select("q_id", "pos_id")
    else:
        pos = sample_positive(positives.select(F.col("q_id").alias("doc_id"), "label_id"), seed).select(
            F.col("doc_id").alias("q_id"), F.col("label_id").alias("pos_id"))
    pos = pair_similarity(pos, anchors, cands, "q_id", "pos_id", "sim_p")
    if negs is None:
        negs = hard_negatives(anchors, cands, positives, k, extra_exclude)
    return _triplet_loss(negs, pos, margin_min, margin_max, apply_softmax, tau)


def in_batch_triplets(plan: DataFrame, doc_vecs: DataFrame, label_vecs: DataFrame, xy: DataFrame, k: int = 10,
                      margin_min: float = 0.1, margin_max: float = 0.3, apply_softmax: bool = False,
                      tau: float = 0.1, seed: int = 0, own_positive: bool = True) -> DataFrame:
    """C08 over the batches of ``plan`` (doc_id, batch_id, slot, label_id): anchors are a batch's
    documents, candidates its sampled labels, negatives the ``k`` most similar of these that are
    no label of the anchor in ``xy`` (doc_id, label_id).

    The positive is the anchor's own sampled label (the diagonal of the batch matrix), or with
    ``own_positive`` off one of its labels among the batch's, drawn by hash."""
    docs = plan.select("batch_id", F.col("doc_id").alias("q_id")).join(
        doc_vecs.select(F.col("doc_id").alias("q_id"), "embedding"), "q_id")
    labels = plan.select("batch_id", "label_id").distinct().join(label_vecs.select("label_id", "embedding"), "label_id")
    cells = in_batch_relevance(plan, xy)
    slots = plan.select("batch_id", "slot", "doc_id", "label_id")
    relevant = (cells.join(slots.select("batch_id", F.col("slot").alias("row_slot"), F.col("doc_id").alias("q_id")), ["batch_id", "row_slot"])
                .join(slots.select("batch_id", F.col("slot").alias("col_slot"), "label_id"), ["batch_id", "col_slot"])
                .select("batch_id", "q_id", "label_id").distinct())
    if own_positive:
        pos = plan.select(F.col("doc_id").alias("q_id"), F.col("label_id").alias("pos_id"))
    else:
        pos = sample_positive(relevant.select(F.col("q_id").alias("doc_id"), "label_id"), seed).select(
            F.col("doc_id").alias("q_id"), F.col("label_id").alias("pos_id"))
    pos = pair_similarity(pos, doc_vecs.withColumnRenamed("doc_id", "q_id"), label_vecs, "q_id", "pos_id", "sim_p")
    found = cell_topk(docs, labels, relevant, "batch_id", k)
    negs = rank_within_query(found, k).select("q_id", F.col("label_id").alias("neg_id"), F.col("score").alias("sim_n"), "rank")
    return _triplet_loss(negs, pos, margin_min, margin_max, apply_softmax, tau)


def _triplet_loss(negs: DataFrame, pos: DataFrame, margin_min: float, margin_max: float, apply_softmax: bool,
                  tau: float) -> DataFrame:
    e = negs.join(pos, "q_id")
    if margin_min == margin_max:
        margin = F.lit(float(margin_min))
    else:
        margin = F.least(F.greatest(F.abs(F.col("sim_p") - F.col("sim_n")), F.lit(margin_min)), F.lit(margin_max))
    e = e.withColumn("margin", margin).withColumn(
        "loss", F.greatest(F.lit(0.0), F.col("sim_n") - F.col("sim_p") + F.col("margin")))
    if apply_softmax:
        w = Window.partitionBy("q_id")
        s = F.when(F.col("loss") == 0, F.lit(NEG_SENTINEL)).otherwise(F.col("sim_n")) / F.lit(tau)
        e = (e.withColumn("_s", s).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
              .withColumn("loss", F.col("loss") * F.col("_e") / F.sum("_e").over(w)).drop("_s", "_e"))
    return e.select("q_id", "rank", "pos_id", "neg_id", "sim_p", "sim_n", "margin", "loss")


def mask_loss(entries: DataFrame, pad_rank: int | None = None, mask_col: str | None = None) -> DataFrame:
    """The pad column (``rank == pad_rank``) and rows with a false mask get loss 0."""
    loss = F.col("loss")
    if pad_rank is not None:
        loss = F.when(F.col("rank") == pad_rank, F.lit(0.0)).otherwise(loss)
    if mask_col is not None:
        loss = F.when(~F.col(mask_col), F.lit(0.0)).otherwise(loss)
    return entries.withColumn("loss", loss)


def reductions(entries: DataFrame) -> DataFrame:
    """A19 + A18: mean / custom (per-anchor sum, then mean) / sum, and the mean violator count."""
    per_anchor = entries.groupBy("q_id").agg(F.sum("loss").alias("row_sum"),
                                            F.sum((F.col("loss") > 0).cast("double")).alias("viol"),
                                            F.count(F.lit(1)).alias("n"))
    return per_anchor.agg(
        (F.sum("row_sum") / F.sum("n")).alias("mean"),
        F.avg("row_sum").alias("custom"),
        F.sum("row_sum").alias("sum"),
        F.avg("viol").alias("violators"),
        F.count(F.lit(1)).cast("long").alias("n_anchors"))


def margin_regularity(anchors: DataFrame, cands_i: DataFrame, cands_f: DataFrame, positives: DataFrame,
                      k: int = 10, margin: float = 0.1, seed: int = 0,
                      extra_exclude: DataFrame | None = None, negs: DataFrame | None = None) -> DataFrame:
    """Raw view i vs fused view f.  Positive term max(0, s_i - s_f + m) on one sampled
    positive; negative term max(0, s_f - s_i + m) on the k hardest negatives by f; each
    averaged over its entries > 0 (0 if none); the result is their mean.  One row.  ``negs`` are the
    ``hard_negatives`` of the fused view where they were mined before."""
    pos = sample_positive(positives.select(F.col("q_id").alias("doc_id"), "label_id"), seed).select(
        F.col("doc_id").alias("q_id"), F.col("label_id").alias("pos_id"))
    pos = pair_similarity(pos, anchors, cands_i, "q_id", "pos_id", "s_i")
    pos = pair_similarity(pos, anchors, cands_f, "q_id", "pos_id", "s_f")
    lp = pos.select(F.greatest(F.lit(0.0), F.col("s_i") - F.col("s_f") + F.lit(margin)).alias("l"))
    if negs is None:
        negs = hard_negatives(anchors, cands_f, positives, k, extra_exclude)
    negs = negs.select(
        "q_id", "neg_id", F.col("sim_n").alias("s_f"))
    negs = pair_similarity(negs, anchors, cands_i, "q_id", "neg_id", "s_i")
    ln = negs.select(F.greatest(F.lit(0.0), F.col("s_f") - F.col("s_i") + F.lit(margin)).alias("l"))

    both = (lp.select(F.col("l"), F.lit("p").alias("side"))
              .unionByName(ln.select(F.col("l"), F.lit("n").alias("side"))))
    sums = both.groupBy().agg(
        F.coalesce(F.sum(F.when(F.col("side") == "p", F.col("l"))) /
                   F.sum(F.when((F.col("side") == "p") & (F.col("l") > 0), 1.0)), F.lit(0.0)).alias("loss_p"),
        F.coalesce(F.sum(F.when(F.col("side") == "n", F.col("l"))) /
                   F.sum(F.when((F.col("side") == "n") & (F.col("l") > 0), 1.0)), F.lit(0.0)).alias("loss_n"))
    return sums.withColumn("loss", (F.col("loss_p") + F.col("loss_n")) / 2.0)
