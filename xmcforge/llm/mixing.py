"""Mixing sources to target weights.

Sizes are summed per source, targets share the whole size by weight up to a repeat limit, and each
document is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy whose probability is
the fraction of the rate: the copy is drawn when the document's hash lies below its source's
threshold.  The threshold is the place in the source's hash order where the sizes before it make
up the fraction, so the copies' words miss their share by at most half a document.  It is found in
rounds of sums per hash bucket; then every document decides alone, so a source that holds most
rows needs no task of its own and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xmcforge.llm.common import table, written
from xmcforge.llm.registry import query
from xmcforge.plans.ranking import dist_rank

WORD = r"[^\x20\x09-\x0D]+"
# One rate row per source is broadcast up to this many sources; beyond, the join is salted.
BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], repeat_limit: int = 3) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, size).

    Sources in code-point order, null last, take ``weights`` in turn.  Targets share the sum of all
    sizes by weight; none exceeds ``repeat_limit`` times its source, and what such sources leave is
    shared again among the others.  The driver sees a few sums per round."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = dist_rank(per, [F.col("source").asc_nulls_last()], "_turn")
    ranked = ranked.select("source", "source_size", turn[((F.col("_turn") - 1) % len(weights)).cast("int")].alias("_w"),
                           (F.col("source_size") * repeat_limit).cast("double").alias("_cap"))
    ranked = written(ranked, "sources")
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("_cap") < F.col("_w") * F.lit(level)
        now, total, capped, weight = ranked.agg(
            F.count(F.when(above, 1)), F.sum("source_size").cast("double"),
            F.sum(F.when(above, F.col("_cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_w")))).first()
        if now == full or not total or not weight:
            break
        full, level = now, (total - capped) / weight
    return ranked.select("source", "source_size",
                         F.least("_cap", F.col("_w") * F.lit(level or 0.0)).alias("target"))


DRAW_BITS, ROUND_BITS = 52, 12  # bits of a draw, and of a draw that one round of sums settles


def _draw(key: Column, seed: int) -> Column:
    """A whole number below 2^52 from the hash of ``key`` and ``seed``."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("~")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def draw_limits(targets: DataFrame, draws: DataFrame) -> DataFrame:
    """``targets`` (source, source_size, target) with ``base``, the floor of the rate, and ``below``: a
    row of the source is copied once more when its draw is smaller.

    ``draws`` (source, size, draw) is a written table.  A round sums the sizes of each source per
    bucket of draws and keeps the bucket in which the running sum reaches the fraction's share; the
    rows of a bucket shrink 2^12 fold a round, until a bucket is one draw.  The limit is put before
    or after that draw, whichever is nearer."""
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    rates = targets.withColumn("base", F.floor(rate).cast("long"))
    state = rates.select(F.col("source").alias("_s"), (F.col("target") - F.col("base") * F.col("source_size")).alias("need"),
                         F.lit(0).cast("long").alias("low"), F.lit(0.0).alias("before"))
    shift = DRAW_BITS
    while shift > 0:
        width, shift = shift, max(0, shift - ROUND_BITS)
        inside = draws.join(state, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("draw", width) == F.shiftright("low", width)))
        sums = inside.groupBy("_s", F.shiftleft(F.shiftright("draw", shift), shift).alias("at")).agg(
            F.sum("size").cast("double").alias("sum"), F.first("need").alias("need"), F.first("before").alias("start"))
        # at most 2^12 buckets of a source
        order = Window.partitionBy("_s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("start") + F.sum("sum").over(order))
        reached = sums.groupBy("_s").agg(
            F.first("need").alias("need"), F.min(F.when(F.col("upto") >= F.col("need"), F.struct("at", "upto", "sum"))).alias("cut"),
            F.max(F.struct("at", "upto", "sum")).alias("last"))
        cut = F.coalesce("cut", "last")  # sums of whole numbers can stop short of the need by rounding only
        state = written(reached.select("_s", "need", cut["at"].alias("low"), (cut["upto"] - cut["sum"]).alias("before"), cut["sum"].alias("sum")), "limits")
    nearer = F.col("need") - F.col("before") <= F.col("before") + F.col("sum") - F.col("need")
    limits = state.select("_s", F.when(nearer, F.col("low")).otherwise(F.col("low") + 1).alias("below"))
    return (rates.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left")
            .select("source", "source_size", "target", "base", F.coalesce("below", F.lit(0).cast("long")).alias("below")))


def with_copies(df: DataFrame, targets: DataFrame, size: Column, source_col: str = "source", key_col: str = "doc_id",
                seed: int = 10) -> DataFrame:
    """Append ``source_size``, ``target`` and ``copies``: how often the mix takes each row of ``size``.

    The same row gets the same number in every run; rows that repeat a key share one draw."""
    draw = _draw(F.col(f"`{key_col}`"), seed)
    draws = written(df.select(F.col(f"`{source_col}`").alias("source"), size.alias("size"), draw.alias("draw")), "draws")
    limits = written(draw_limits(targets, draws), "rates")
    rates = limits.withColumnRenamed("source", "_source")
    on = df[f"`{source_col}`"].eqNullSafe(F.col("_source"))
    if limits.count() <= BROADCAST_SOURCES:
        joined = df.join(F.broadcast(rates), on)
    else:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(df[f"`{key_col}`"]), F.lit(SALTS)))
        rates = rates.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(rates, on & (F.col("_salt") == F.col("_rsalt"))).drop("_salt", "_rsalt")
    copies = F.col("base") + (draw < F.col("below")).cast("long")
    return joined.drop("_source").withColumn("copies", copies.cast("long")).drop("base", "below")


def mix(df: DataFrame, weights: Sequence[float], text_col: str = "text", source_col: str = "source",
        key_col: str = "doc_id", repeat_limit: int = 3, seed: int = 10) -> DataFrame:
    """The rows of ``df`` as often as the mix takes each (its columns only).

    Null texts have size 0, null sources are one source, an empty table gives an empty table.
    Other columns pass through, also ones called ``copies``, ``target`` or ``source_size``."""
    sizes = df.select(df[f"`{source_col}`"].alias("source"), word_count(df[f"`{text_col}`"]).alias("size"))
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"),
                     df[f"`{source_col}`"].alias("_src"), df[f"`{key_col}`"].alias("_key"))
    size = word_count(F.col(f"_row.`{text_col}`"))
    taken = with_copies(rows, source_targets(sizes, weights, repeat_limit), size, "_src", "_key", seed)
    return taken.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s),
l AS (
  SELECT k, cap / w AS ratio,
         ((sum(source_size::DOUBLE) OVER ()) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM r),
lv AS (SELECT level FROM l WHERE level <= ratio ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT level FROM lv), 0.0)) AS target FROM r),
c AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(coalesce(t.target / nullif(t.source_size, 0), 0.0)) AS base,
         CAST('0x' || substr(md5('10|' || coalesce(CAST(d.doc_id AS VARCHAR), '~')), 1, 13) AS BIGINT) AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, u, sum(size) AS sum, any_value(target - base * source_size) AS need FROM c GROUP BY source, u),
o AS (SELECT *, sum(sum) OVER (PARTITION BY source ORDER BY u) AS upto FROM g),
b AS (
  SELECT source, arg_min(CASE WHEN need - (upto - sum) <= upto - need THEN u ELSE u + 1 END, u) AS below
  FROM o WHERE upto >= need GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target,
       CAST((c.base + CASE WHEN c.u < coalesce(b.below, 0) THEN 1 ELSE 0 END) * c.size AS BIGINT) AS taken
FROM c LEFT JOIN b ON b.source IS NOT DISTINCT FROM c.source
"""


@query("op10_mix_sources", OP10_SQL)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document (weights 5, 2, 1 in turn, at most 3 repeats)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    narrow = written(docs, "sizes")
    targets = source_targets(narrow.select("source", "size"), (5, 2, 1))
    return with_copies(narrow, targets, F.col("size")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
