"""Retrieval-augmented score fusion.

Candidates are labels and training queries.  A candidate id is ``kind * 2^62 + id`` inside
(ids below 2^62) the retrieval (labels first, like the stacked matrix of the reference) and is split back
into (kind, id) right after it.  The fused score of a label is
    sum_{label hits} p * (1 - lam) + sum_{query hits t} p * lam * X_Y[t, label]
with p the softmax (temperature tau) over the query's candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xmcforge.operators.retrieval import ova_topk
from xmcforge.operators.sparse import sparse_matmul, weighted_identity_union

KIND_OFFSET = 1 << 62
KIND_LABEL, KIND_QUERY = 0, 1


def candidate_union(labels: DataFrame, train_queries: DataFrame) -> DataFrame:
    """(kind, cand_id, embedding) for labels and training queries."""
    lab = labels.select(F.lit("label").alias("kind"), F.col("label_id").alias("cand_id"), "embedding")
    trn = train_queries.select(F.lit("query").alias("kind"), F.col("trn_id").alias("cand_id"), "embedding")
    return lab.unionByName(trn)


def _encode(df: DataFrame, kind_code: int, id_col: str) -> DataFrame:
    return df.select((F.lit(kind_code * KIND_OFFSET) + F.col(id_col)).alias("label_id"), "embedding")


def _decode(df: DataFrame) -> DataFrame:
    return df.select("q_id", F.when(F.col("label_id") >= KIND_OFFSET, "query").otherwise("label").alias("kind"),
                     (F.col("label_id") % F.lit(KIND_OFFSET)).alias("cand_id"), "score", "rank")


def softmax_temperature(df: DataFrame, tau: float, group: str = "q_id", score: str = "score",
                        out: str = "p") -> DataFrame:
    """P10: exp((s - max s) / tau) / sum(...) within each ``group``."""
    w = Window.partitionBy(group)
    e = F.exp((F.col(score) - F.max(score).over(w)) / F.lit(tau))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def retrieve_joint(queries: DataFrame, labels: DataFrame, train_queries: DataFrame, k: int) -> DataFrame:
    cands = _encode(labels, KIND_LABEL, "label_id").unionByName(_encode(train_queries, KIND_QUERY, "trn_id"))
    return _decode(ova_topk(queries, cands, k))


def retrieve_split(queries: DataFrame, labels: DataFrame, train_queries: DataFrame, k_labels: int,
                   k_queries: int) -> DataFrame:
    a = _decode(ova_topk(queries, _encode(labels, KIND_LABEL, "label_id"), k_labels))
    b = _decode(ova_topk(queries, _encode(train_queries, KIND_QUERY, "trn_id"), k_queries))
    return a.unionByName(b)


def fuse(hits: DataFrame, labels: DataFrame, train_xy: DataFrame, tau: float, lam: float) -> DataFrame:
    """Softmax the candidates of each query, then multiply by the stacked value matrix."""
    p = softmax_temperature(hits, tau)
    vm = weighted_identity_union(labels, train_xy, lam)
    left = p.select("q_id", F.struct("kind", "cand_id").alias("inner"), "p")
    right = vm.select(F.struct(F.col("kind"), F.col("row_id").alias("cand_id")).alias("inner"), "label_id", "value")
    return sparse_matmul(left, right, "q_id", "inner", "label_id", a_val="p", b_val="value", out_val="score")


def rai_joint(queries: DataFrame, labels: DataFrame, train_queries: DataFrame, train_xy: DataFrame,
              k: int = 500, tau: float = 0.05, lam: float = 0.1) -> DataFrame:
    """One top-k over labels and training queries together."""
    hits = retrieve_joint(queries, labels, train_queries, k)
    return fuse(hits, labels, train_xy, tau, lam)


def rai_split(queries: DataFrame, labels: DataFrame, train_queries: DataFrame, train_xy: DataFrame,
              k_labels: int = 500, k_queries: int = 50, tau: float = 0.05, lam: float = 0.1) -> DataFrame:
    """Separate top-k per side, then the shared softmax."""
    hits = retrieve_split(queries, labels, train_queries, k_labels, k_queries)
    return fuse(hits, labels, train_xy, tau, lam)


def fixed_width(pred: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every query gets slots 1..k sorted by (score desc, label id); missing -> (-1, 0.0).

    Long form (q_id, slot, label_id, score); ``as_arrays`` builds the array form."""
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), F.col("label_id").asc())
    ranked = pred.withColumn("slot", F.row_number().over(w).cast("long")).where(F.col("slot") <= k)
    grid = queries.select(F.col("q_id").cast("long")).distinct().withColumn(
        "slot", F.explode(F.sequence(F.lit(1), F.lit(k)).cast("array<long>")))
    return (grid.join(ranked.select("q_id", "slot", "label_id", "score"), ["q_id", "slot"], "left")
                .select("q_id", "slot", F.coalesce("label_id", F.lit(-1).cast("long")).alias("label_id"),
                        F.coalesce("score", F.lit(0.0)).alias("score")))


def as_arrays(long_form: DataFrame) -> DataFrame:
    """(q_id, labels array<bigint>, scores array<double>) ordered by slot."""
    agg = long_form.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("slot", "label_id", "score"))).alias("s"))
    return agg.select("q_id", F.col("s.label_id").alias("labels"), F.col("s.score").alias("scores"))
