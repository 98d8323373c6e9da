"""Sparse label-matrix algebra on long tables (doc_id|row, label_id|col, value).

J07, A01, A06, A07, A20, A21, A22, A23, J09, U02.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmcforge.plans.ranking import dist_rank


# Rows of a side in one block of a heavy inner key; a block makes about the square of it in pairs.
BLOCK_ROWS = 4096
# Parts that the rows of every inner key are cut into when they look up their key's blocks.
LOOKUP_PARTS = 64


def heavy_keys(a: DataFrame, b: DataFrame, inner: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(inner, na, nb) of the inner keys whose rows make more than ``block_rows`` squared pairs: such a
    key's product is a grid of na x nb blocks, none above that many pairs but for uneven hashing."""
    pairs = block_rows * block_rows
    deg = lambda df, out: df.where(F.col(inner).isNotNull()).groupBy(inner).agg(F.count(F.lit(1)).alias(out))
    d = deg(a, "_da").join(deg(b, "_db"), inner).where(F.col("_da").cast("double") * F.col("_db") > pairs)
    # a side that is short against the other is not cut: its block of the other side is longer instead
    blocks = lambda own, other: F.ceil(F.col(own) / F.greatest(F.lit(float(block_rows)), F.lit(float(pairs)) / F.col(other)))
    return d.select(inner, blocks("_da", "_db").cast("int").alias("na"), blocks("_db", "_da").cast("int").alias("nb"))


def _in_blocks(df: DataFrame, heavy: DataFrame, inner: str, own: str, other: str, hashed: list, out: str, copies: str) -> DataFrame:
    """``df`` with its row's block ``out`` and one copy per block of the other side (``copies``).

    Rows look up their key in ``LOOKUP_PARTS`` parts, so the rows of a heavy key do not meet in one task for it."""
    part = F.pmod(F.xxhash64(*hashed), F.lit(LOOKUP_PARTS))
    table = heavy.select(inner, own, other, F.explode(F.sequence(F.lit(0), F.lit(LOOKUP_PARTS - 1)).cast("array<bigint>")).alias("_part"))
    rows = df.withColumn("_part", part).join(table, [inner, "_part"], "left").drop("_part")
    block = F.pmod(F.xxhash64(F.lit(1), *hashed), F.coalesce(own, F.lit(1))).cast("int")
    return (rows.withColumn(out, block)
            .withColumn(copies, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop(own, other))


def block_rows_of(a: DataFrame, b: DataFrame, a_row: str, inner: str, b_col: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with their grid cell (_i, _j) of the inner key; light keys are one cell."""
    heavy = heavy_keys(a, b, inner, block_rows)
    left = _in_blocks(a, heavy, inner, "na", "nb", [F.col(a_row), F.col(inner)], "_i", "_j")
    right = _in_blocks(b, heavy, inner, "nb", "na", [F.col(b_col), F.col(inner)], "_j", "_i")
    return left, right


def sparse_matmul(a: DataFrame, b: DataFrame, a_row: str, inner: str, b_col: str, a_val: str = "value",
                  b_val: str = "value", out_val: str = "value", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """C[row, col] = sum_inner A[row, inner] * B[inner, col].

    Inner keys are classed by their degrees on both sides.  A light key's rows meet in one place of the
    shuffle join; a heavy key's rows are hashed into blocks and each pair of blocks meets in its own
    place, so a key that holds a third of both sides is spread like the rest.  The products are summed
    map-side first.  Entries with a null inner key match nothing; repeated entries add up."""
    left = a.select(F.col(a_row).alias("_row"), F.col(inner).alias("_inner"), F.col(a_val).cast("double").alias("_av"))
    right = b.select(F.col(inner).alias("_inner"), F.col(b_col).alias("_col"), F.col(b_val).cast("double").alias("_bv"))
    left, right = block_rows_of(left, right, "_row", "_inner", "_col", block_rows)
    return (left.join(right, ["_inner", "_i", "_j"]).groupBy("_row", "_col")
                .agg(F.sum(F.col("_av") * F.col("_bv")).alias("_out"))
                .select(F.col("_row").alias(a_row), F.col("_col").alias(b_col), F.col("_out").alias(out_val)))


def label_frequency(xy: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Column sums of X_Y, zero-filled from a label table."""
    freq = xy.groupBy("label_id").agg(F.sum(F.col("value").cast("double")).alias("freq"))
    if labels is None:
        return freq
    return labels.select("label_id").distinct().join(freq, "label_id", "left").fillna(0.0, ["freq"])


def reduce_max_sparse(pred: DataFrame, mapping: DataFrame, new_col: str = "new_id") -> DataFrame:
    """Collapse label space, max score per (q_id, mapped label)."""
    return (pred.join(mapping.select("label_id", new_col), "label_id")
                .groupBy("q_id", new_col).agg(F.max("score").alias("score")))


def reduce_max_dense(pred: DataFrame, mapping: DataFrame, new_col: str = "new_id") -> DataFrame:
    """The dense variant starts from zeros, so each cell is max(0, max score).

    Returned in sparse form: cells without any prediction are the implicit zeros."""
    return (reduce_max_sparse(pred, mapping, new_col)
            .withColumn("score", F.greatest(F.lit(0.0), F.col("score"))))


def max_filter_count(pairs: DataFrame, k: int) -> DataFrame:
    """The largest number of filter pairs of one query, and the over-fetch k + max."""
    per_q = pairs.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))
    return per_q.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_filtered")).withColumn(
        "k_fetch", F.col("max_filtered") + F.lit(k))


def failed_owner_count(owners: DataFrame, asset_map: DataFrame) -> DataFrame:
    """Owners that have no asset at all."""
    missing = owners.select("owner_id").distinct().join(asset_map.select("owner_id"), "owner_id", "left_anti")
    return missing.agg(F.count(F.lit(1)).cast("long").alias("failed_owners"))


def matrix_stats(xy: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Nnz, non-empty rows, used labels, and the label count max_id + 1 (zero-based ids)."""
    stats = xy.agg(F.count(F.lit(1)).cast("long").alias("nnz"),
                   F.countDistinct("doc_id").cast("long").alias("nonempty_rows"),
                   F.countDistinct("label_id").cast("long").alias("used_labels"),
                   (F.max("label_id") + 1).cast("long").alias("n_labels"))
    if rows is not None:  # the shape's row count holds empty rows, too
        stats = stats.crossJoin(rows.agg(F.count(F.lit(1)).cast("long").alias("n_rows")))  # two one-row tables
    return stats


def dense_mapping(xy: DataFrame) -> DataFrame:
    """Dense ids of labels in order of first occurrence in the (doc_id, label_id) order."""
    first = xy.groupBy("label_id").agg(F.min("doc_id").alias("first_doc"))
    ranked = dist_rank(first, ["first_doc", "label_id"], rank_col="r")
    return ranked.select("label_id", (F.col("r") - 1).alias("dense_id"))


def restrict_and_renumber(xy: DataFrame, valid: DataFrame) -> DataFrame:
    """Keep only valid labels (semi join) and renumber them densely by label id."""
    v = valid.select("label_id").distinct()
    renum = dist_rank(v, ["label_id"], rank_col="r").select("label_id", (F.col("r") - 1).alias("new_label_id"))
    return xy.join(v, "label_id", "left_semi").join(renum, "label_id").select(
        "doc_id", "label_id", "new_label_id", "value")


def weighted_identity_union(labels: DataFrame, train_xy: DataFrame, lam: float) -> DataFrame:
    """Rows (kind, row_id, label_id, value): identity over labels x (1-lam) stacked on
    the train matrix x lam.  ``kind`` replaces the row offset of the stacked matrix."""
    ident = labels.select(F.lit("label").alias("kind"), F.col("label_id").alias("row_id"), "label_id",
                          F.lit(1.0 - lam).alias("value"))
    trn = train_xy.select(F.lit("query").alias("kind"), F.col("trn_id").alias("row_id"), "label_id",
                          (F.coalesce(F.col("value") if "value" in train_xy.columns else F.lit(1.0), F.lit(1.0))
                           * F.lit(lam)).alias("value"))
    return ident.unionByName(trn)


def keep_topk_per_row(m: DataFrame, k: int, row: str, col: str, val: str = "value") -> DataFrame:
    """Keep the ``k`` largest entries of every sparse row (ties by column), shorter
    rows unchanged.  ``row_number() <= k`` is limited map-side (WindowGroupLimit)."""
    from pyspark.sql import Window
    w = Window.partitionBy(row).orderBy(F.col(val).desc(), F.col(col).asc())
    return m.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
