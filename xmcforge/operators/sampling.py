"""Seeded orders, batches and positive sampling.

Randomness comes only from md5 of (ids, seed), so every engine and every retry draws the
same numbers: ``u52`` = first 13 hex digits of md5 as an integer in [0, 2^52).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xmcforge.plans.ranking import dist_rank

TWO_POW_52 = float(1 << 52)


def md5_int(*parts: str | Column) -> Column:
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13), 16, 10).cast("long")


def md5_uniform(*parts: str | Column) -> Column:
    """Uniform in (0, 1) from md5 of the parts."""
    return (md5_int(*parts).cast("double") + F.lit(0.5)) / F.lit(TWO_POW_52)


_FIXED_WIDTH = ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp",
                "timestamp_ntz")


def _narrow(df: DataFrame) -> bool:
    """True when every column is fixed-width: cheap to carry through a rank's checkpoint."""
    return all(f.dataType.simpleString() in _FIXED_WIDTH for f in df.schema.fields)


def seeded_permutation(df: DataFrame, id_col: str, seed: int, pos_col: str = "pos") -> DataFrame:
    """A permutation of the unique ``id_col`` ordered by md5(id, seed); 0-based positions.

    Fixed-width columns ride along through the rank (one evaluation of ``df``); wide columns
    (strings, arrays, payloads) are joined back on the id instead."""
    u = md5_int(id_col, F.lit(seed)).alias("_u")
    if _narrow(df):
        return dist_rank(df.select("*", u), ["_u", id_col], rank_col="_r").select(
            *df.columns, (F.col("_r") - 1).alias(pos_col))
    ranked = dist_rank(df.select(id_col, u), ["_u", id_col], rank_col="_r").select(
        id_col, (F.col("_r") - 1).alias(pos_col))
    return df.join(ranked, id_col)


def cluster_batch_order(items: DataFrame, cluster_col: str, id_col: str, seed: int,
                        pos_col: str = "pos") -> DataFrame:
    """Clusters in md5(cluster, seed) order, members together (by unique id), concatenated.
    Fixed-width columns ride through the rank; wide ones join back on the id."""
    u = md5_int(cluster_col, F.lit(seed)).alias("_u")
    if _narrow(items):
        return dist_rank(items.select("*", u), ["_u", cluster_col, id_col], rank_col="_r").select(
            *items.columns, (F.col("_r") - 1).alias(pos_col))
    ranked = dist_rank(items.select(id_col, cluster_col, u), ["_u", cluster_col, id_col], rank_col="_r").select(
        id_col, (F.col("_r") - 1).alias(pos_col))
    return items.join(ranked, id_col)


def assign_batches(ordered: DataFrame, batch_size: int, pos_col: str = "pos") -> DataFrame:
    """Consecutive fixed-size batches over a 0-based position; the last may be short."""
    return (ordered.withColumn("batch_id", F.floor(F.col(pos_col) / F.lit(batch_size)).cast("long"))
                   .withColumn("slot", (F.col(pos_col) % F.lit(batch_size)).cast("long")))


def sample_positive(xy: DataFrame, seed: int, weights: DataFrame | None = None,
                    row_col: str = "doc_id") -> DataFrame:
    """One positive per row, probability proportional to ``weights.weight`` (or uniform).

    Efraimidis-Spirakis: the label with the smallest -ln(u)/w wins, u = md5(row, label, seed).
    A plain ``min_by`` per row: partially aggregated, so a row with millions of labels is
    reduced map-side."""
    x = xy.select(row_col, "label_id")
    if weights is not None:
        x = x.join(weights.select("label_id", "weight"), "label_id", "left").fillna(1.0, ["weight"])
    else:
        x = x.withColumn("weight", F.lit(1.0))
    # a non-positive weight means "never drawn" (infinite key) rather than a division error
    key = F.when(F.col("weight") > 0, -F.log(md5_uniform(row_col, "label_id", F.lit(seed))) / F.col("weight")) \
           .otherwise(F.lit(float("inf")))
    return (x.withColumn("_k", key).groupBy(row_col)
             .agg(F.min_by("label_id", F.struct("_k", "label_id")).alias("label_id")))


def in_batch_relevance(plan: DataFrame, xy: DataFrame) -> DataFrame:
    """Positive cells of each batch's doc x sampled-label matrix, as
    (batch_id, row_slot, col_slot).  Only positives are produced: an equi-join of the
    batch's document labels with its sampled labels on (batch, label)."""
    sampled = plan.select("batch_id", F.col("slot").alias("col_slot"), "label_id")
    doc_labels = plan.select("batch_id", "doc_id", F.col("slot").alias("row_slot")).join(
        xy.select("doc_id", "label_id"), "doc_id")
    return doc_labels.join(sampled, ["batch_id", "label_id"]).select("batch_id", "row_slot", "col_slot")


def training_batches(xy: DataFrame, batch_size: int, seed: int, weights: DataFrame | None = None,
                     clusters: DataFrame | None = None) -> DataFrame:
    """Order (seeded permutation, or cluster order when ``clusters`` (doc_id, cluster_id)
    is given) -> batches -> one sampled positive per document.

    Documents without labels cannot be sampled (the reference cannot train on them) and are
    left out.  Output (doc_id, pos, batch_id, slot, label_id)."""
    # one row per document already: the sampled positive carries straight through the order
    pos = sample_positive(xy, seed, weights)
    if clusters is not None:
        ordered = cluster_batch_order(pos.join(clusters, "doc_id"), "cluster_id", "doc_id", seed)
        ordered = ordered.drop("cluster_id")
    else:
        ordered = seeded_permutation(pos, "doc_id", seed)
    return assign_batches(ordered, batch_size).select("doc_id", "pos", "batch_id", "slot", "label_id")
