"""Ranking metrics over long prediction tables.

Definitions (f = relevance flag at rank i, c_k = hits in the top k, T = positives):
P@k = c_k/k, R@k = c_k/max(T,1), Hit@k = 1[c_k>0],
nDCG@k = sum_{i<=k} f_i/log2(i+1) / sum_{i<=min(T,k)} 1/log2(i+1) (0 when T=0),
MAP@k = sum_{i<=k} f_i (c_i/i) / max(c_k,1)  (divides by hits so far),
MRR@k = 1/first-hit-rank if it is <= k else 0; with ``no_hit='reference'`` a query with no
hit in the top K scores 1 at every k.  Each is averaged over *all* queries and scaled by 100.
PSP@k and PSnDCG@k weight flags by inverse propensity and divide the mean by the mean of the
ideal list (true labels by weight): a ratio of means.

The report never builds the dense queries x K grid: every metric is a sum over *hit rows*
(at most K per query) bucketed by rank, so the heavy part is one semi-join and one window
over <= K rows per query; the per-k arithmetic runs on tables of at most K x K rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xmcforge.operators.retrieval import rank_within_query
from xmcforge.session import reliable_checkpoint

METRIC_ORDER = ["P", "R", "Hit", "nDCG", "MAP", "MRR", "PSP", "PSnDCG"]


def ranked(pred: DataFrame, k_max: int) -> DataFrame:
    """(q_id, label_id, rank) with rank <= k_max; re-ranks by score when no rank column."""
    if "rank" in pred.columns:
        return pred.select("q_id", "label_id", F.col("rank").cast("long")).where(F.col("rank") <= k_max)
    return rank_within_query(pred.select("q_id", "label_id", "score"), k_max).select("q_id", "label_id", "rank")


def _ks_col(ks: Sequence[int]):
    return F.explode(F.array(*[F.lit(int(k)).cast("long") for k in sorted(set(ks))]))


def _idcg_expr(n_col: str) -> str:
    """SQL expr: sum_{i<=n} 1/log2(i+1) for a small integer column n (n <= K)."""
    return (f"aggregate(sequence(1, greatest(cast({n_col} as int), 1)), 0D, "
            f"(acc, i) -> acc + case when i <= {n_col} then 1D / log2(i + 1D) else 0D end)")


def eval_flags(pred: DataFrame, truth: DataFrame, queries: DataFrame, k_max: int) -> DataFrame:
    """Dense (q_id, rank, label_id, flag) for ranks 1..K of every query; missing rank -> 0."""
    grid = queries.select(F.col("q_id").cast("long")).distinct().withColumn(
        "rank", F.explode(F.sequence(F.lit(1), F.lit(k_max)).cast("array<long>")))
    rel = truth.select(F.col("q_id").cast("long"), F.col("label_id").cast("long")).distinct().withColumn("rel", F.lit(1))
    return (grid.join(ranked(pred, k_max), ["q_id", "rank"], "left")
                .join(rel, ["q_id", "label_id"], "left")
                .select("q_id", "rank", "label_id", F.coalesce("rel", F.lit(0)).cast("long").alias("flag")))


def cumulative_hits(flags: DataFrame) -> DataFrame:
    """Running hit count per query by rank."""
    w = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return flags.select("q_id", "rank", F.sum("flag").over(w).cast("long").alias("cum_hits"))


def cumulative_dcg(flags: DataFrame) -> DataFrame:
    """Running discounted gain per query by rank."""
    w = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return flags.select("q_id", "rank", F.round(F.sum(F.col("flag") / F.log2(F.col("rank") + 1.0)).over(w), 9)
                        .alias("cum_dcg"))


def first_hit_rank(flags: DataFrame) -> DataFrame:
    """Smallest rank with a hit per query (null when none)."""
    return flags.groupBy("q_id").agg(F.min(F.when(F.col("flag") == 1, F.col("rank"))).cast("long").alias("first_hit"))


def inverse_propensity(train_xy: DataFrame, shape: DataFrame, A: float = 0.55, B: float = 1.5,
                       labels: DataFrame | None = None) -> DataFrame:
    """w_l = 1 + (ln N - 1)(B+1)^A (n_l + B)^-A with N = train rows (shape table).

    ``labels`` (label_id) zero-fills labels that have no training document."""
    freq = train_xy.groupBy(F.col("label_id").cast("long").alias("label_id")).agg(F.sum(F.coalesce(
        F.col("value") if "value" in train_xy.columns else F.lit(1.0), F.lit(1.0))).alias("freq"))
    if labels is not None:
        freq = labels.select(F.col("label_id").cast("long")).distinct().join(freq, "label_id", "left").fillna(0.0, ["freq"])
    n_rows = float(shape.select(F.col("n_rows").cast("double")).first()[0])  # one-row shape table
    c = (math.log(n_rows) - 1.0) * (B + 1.0) ** A
    return freq.select("label_id", (F.lit(1.0) + F.lit(c) * F.pow(F.col("freq") + B, F.lit(-A))).alias("weight"))


def ideal_propensity_topk(truth: DataFrame, weights: DataFrame, k_max: int) -> DataFrame:
    """Per query the true labels ranked by weight (desc, label id asc), top K."""
    t = truth.select(F.col("q_id").cast("long"), F.col("label_id").cast("long")).distinct()
    tw = t.join(weights.select("label_id", "weight"), "label_id", "left").fillna(0.0, ["weight"])
    w = Window.partitionBy("q_id").orderBy(F.col("weight").desc(), F.col("label_id").asc())
    return (tw.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k_max)
              .select("q_id", "rank", "label_id", "weight"))


def metrics_report(pred: DataFrame, truth: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 3, 5, 10),
                   weights: DataFrame | None = None, no_hit: str = "zero", digits: int = 6) -> DataFrame:
    """Long (metric, k, value) table, values in percent rounded to ``digits``."""
    ks = sorted(set(int(k) for k in ks))
    K = max(ks)
    if no_hit not in ("zero", "reference"):
        raise ValueError("no_hit must be 'zero' or 'reference'")
    spark = pred.sparkSession
    q = queries.select(F.col("q_id").cast("long")).distinct()

    # only the asked queries count, whatever else predictions and truth hold
    t = truth.select(F.col("q_id").cast("long"), F.col("label_id").cast("long")).distinct().join(q, "q_id", "left_semi")
    if weights is not None:
        # hits and ideal lists both read the weighted truth: it is made once
        t = reliable_checkpoint(t.join(weights.select("label_id", "weight"), "label_id", "left").fillna(0.0, ["weight"])
                                .select("q_id", "label_id", "weight"))
    else:
        t = t.withColumn("weight", F.lit(0.0))
    # hits need their query's count: one sum over the truth next to one join with it
    tcount = t.groupBy("q_id").agg(F.count(F.lit(1)).alias("T"))
    hits = ranked(pred, K).join(t, ["q_id", "label_id"]).join(tcount, "q_id")
    w = Window.partitionBy("q_id").orderBy("rank")
    hits = (hits.withColumn("j", F.row_number().over(w))
                .withColumn("prec_j", F.col("j") / F.col("rank"))
                .withColumn("ap", F.sum("prec_j").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("j"))
                .withColumn("ap_delta", F.col("ap") - F.coalesce(F.lag("ap").over(w), F.lit(0.0)))
                .withColumn("Tc", F.least(F.col("T"), F.lit(K))))
    # Per (rank, Tc) sums: at most K x K rows.
    by_rank = hits.groupBy("rank", "Tc").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum(1.0 / F.greatest(F.col("T"), F.lit(1))).alias("rsum"),
        F.sum(F.when(F.col("j") == 1, 1.0).otherwise(0.0)).alias("first"),
        F.sum(F.when(F.col("j") == 1, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"),
        F.sum("ap_delta").alias("apd"),
        F.sum("weight").alias("wsum"))
    per_k = (by_rank.withColumn("k", _ks_col(ks)).where(F.col("rank") <= F.col("k"))
             .withColumn("nmin", F.least(F.col("Tc"), F.col("k")))
             .withColumn("disc", 1.0 / F.log2(F.col("rank") + 1.0))
             .withColumn("idcg", F.expr(_idcg_expr("nmin")))
             .groupBy("k").agg(
                 F.sum("cnt").alias("hits"), F.sum("rsum").alias("rsum"), F.sum("first").alias("first"),
                 F.sum("rr").alias("rr"), F.sum("apd").alias("apd"),
                 F.sum(F.col("cnt") * F.col("disc") / F.col("idcg")).alias("ndcg"),
                 F.sum("wsum").alias("wsum"),
                 F.sum(F.col("wsum") * F.col("disc") / F.col("idcg")).alias("wdcg")))
    ks_df = spark.createDataFrame([(k,) for k in ks], "k long")  # the requested cut-offs
    # the query count joins the (len(ks)-row) table as one extra row and is spread by a
    # window over that tiny table, so it costs no separate job
    nq_row = q.agg(F.count(F.lit(1)).cast("double").alias("n_q")).select(F.lit(None).cast("long").alias("k"), "n_q")
    base = (ks_df.join(per_k, "k", "left").fillna(0.0).withColumn("n_q", F.lit(None).cast("double"))
            .unionByName(nq_row, allowMissingColumns=True)
            .withColumn("n_q", F.max("n_q").over(Window.partitionBy(F.lit(0))))
            .where(F.col("k").isNotNull()))
    if no_hit == "reference":
        # queries with a hit anywhere in the top K = first-hit count at the largest k
        # (``base`` has one row per requested k, so this window is over len(ks) rows)
        base = base.withColumn("n_hit", F.max("first").over(Window.partitionBy(F.lit(0))))
        mrr = (F.col("rr") + F.col("n_q") - F.col("n_hit")) / F.col("n_q")
    else:
        mrr = F.col("rr") / F.col("n_q")
    cols = {
        "P": F.col("hits") / (F.col("k") * F.col("n_q")),
        "R": F.col("rsum") / F.col("n_q"),
        "Hit": F.col("first") / F.col("n_q"),
        "nDCG": F.col("ndcg") / F.col("n_q"),
        "MAP": F.col("apd") / F.col("n_q"),
        "MRR": mrr,
    }
    if weights is not None:
        best = Window.partitionBy("q_id").orderBy(F.col("weight").desc(), F.col("label_id").asc())
        ideal = (t.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= K)
                 .join(tcount, "q_id"))
        ideal_by_rank = (ideal.withColumn("Tc", F.least(F.col("T"), F.lit(K)))
                         .groupBy("rank", "Tc").agg(F.sum("weight").alias("iw")))
        ideal_k = (ideal_by_rank.withColumn("k", _ks_col(ks)).where(F.col("rank") <= F.col("k"))
                   .withColumn("nmin", F.least(F.col("Tc"), F.col("k")))
                   .withColumn("disc", 1.0 / F.log2(F.col("rank") + 1.0))
                   .withColumn("idcg", F.expr(_idcg_expr("nmin")))
                   .groupBy("k").agg(F.sum("iw").alias("iwsum"),
                                     F.sum(F.col("iw") * F.col("disc") / F.col("idcg")).alias("iwdcg")))
        base = base.join(ideal_k, "k", "left").fillna(0.0, ["iwsum", "iwdcg"])
        cols["PSP"] = F.when(F.col("iwsum") > 0, F.col("wsum") / F.col("iwsum"))
        cols["PSnDCG"] = F.when(F.col("iwdcg") > 0, F.col("wdcg") / F.col("iwdcg"))
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), (F.lit(100.0) * c).alias("v"))
                                  for name, c in cols.items()]))
    return (base.select(F.col("k").cast("long").alias("k"), stacked.alias("m"))
                .select(F.col("m.metric").alias("metric"), "k", F.round(F.col("m.v"), digits).alias("value")))


def metric_at_k(report: DataFrame, metric: str) -> DataFrame:
    return report.where(F.col("metric") == metric).select("k", F.col("value"))
