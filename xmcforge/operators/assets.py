"""Owner/asset data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xmcforge.plans.ranking import dist_rank

URL_PATTERN = r"^https?://"


def valid_url_filter(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Non-empty URL with an http:// or https:// prefix."""
    return df.where(F.col(url_col).isNotNull() & F.col(url_col).rlike(URL_PATTERN))


def left_join_assets(owners: DataFrame, urls: DataFrame) -> DataFrame:
    """Every owner once (distinct first, so URLs are not repeated), with its URLs or null."""
    return owners.select("owner_id").distinct().join(urls, "owner_id", "left")


def urls_per_owner(urls: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Each owner's URLs in ``ord`` order (unique per owner) as a long-form list
    (owner_id, pos, url).

    Positions come from the per-owner distributed rank, so an owner with a huge share of
    all URLs spans many tasks; ``as_lists`` builds arrays when owners are known to be small."""
    # rank the (owner, ord) keys only; the URL strings join back on those unique keys
    r = dist_rank(urls.select("owner_id", ord_col), [ord_col], rank_col="_r", partition_by=["owner_id"])
    return (urls.select("owner_id", ord_col, "url").join(r, ["owner_id", ord_col])
                .select("owner_id", (F.col("_r") - 1).alias("pos"), "url"))


def as_lists(long_urls: DataFrame) -> DataFrame:
    """(owner_id, urls array<string>) from the long form."""
    agg = long_urls.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("s"))
    return agg.select("owner_id", F.col("s.url").alias("urls"))


def asset_slot_number(assets: DataFrame, order_col: str = "asset_id") -> DataFrame:
    """0-based position of each asset inside its owner's list.

    A distributed rank restarted per owner: an owner with millions of assets spans several
    range partitions instead of one task."""
    keys = ["owner_id", order_col]
    r = dist_rank(assets.select(*keys), [order_col], rank_col="_r", partition_by=["owner_id"])
    r = r.withColumn("slot", F.col("_r") - 1).drop("_r")
    extra = [c for c in assets.columns if c not in keys]
    # wide columns (vectors, payloads) join back on the unique asset id instead of riding the rank
    return assets.join(r.drop("owner_id"), order_col) if extra else r


def first_slots(assets: DataFrame, num_slots: int, order_col: str = "asset_id") -> DataFrame:
    """First ``num_slots`` assets per owner (row_number <= N, planned as WindowGroupLimit so
    each map task keeps at most N rows per owner before the shuffle)."""
    w = Window.partitionBy("owner_id").orderBy(F.col(order_col))
    return (assets.withColumn("slot", (F.row_number().over(w) - 1).cast("long"))
                  .where(F.col("slot") < num_slots))


def image_slots(owners: DataFrame, assets: DataFrame, num_slots: int = 3, order_col: str = "asset_id",
                vec_col: str | None = None) -> DataFrame:
    """Slots 0..N-1 for every owner: asset id (-1 if empty), mask, optional vector
    (zero vector when empty).  Long form (owner_id, slot, asset_id, mask[, embedding])."""
    taken = first_slots(assets, num_slots, order_col)
    grid = owners.select("owner_id").distinct().withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(num_slots - 1)).cast("array<long>")))
    cols = ["owner_id", "slot", order_col] + ([vec_col] if vec_col else [])
    out = grid.join(taken.select(*cols), ["owner_id", "slot"], "left")
    res = out.select("owner_id", "slot", F.coalesce(F.col(order_col), F.lit(-1).cast("long")).alias("asset_id"),
                     F.col(order_col).isNotNull().cast("long").alias("mask"),
                     *([vec_col] if vec_col else []))
    return res


def slots_as_arrays(slots: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """(owner_id, slots array<array<double>>, mask array<bigint>) with zero padding."""
    zero = F.array_repeat(F.lit(0.0), dim)
    s = slots.withColumn("v", F.when(F.col("mask") == 1, F.transform(vec_col, lambda x: x.cast("double")))
                         .otherwise(zero))
    agg = s.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("slot", "v", "mask"))).alias("a"))
    return agg.select("owner_id", F.col("a.v").alias("slots"), F.col("a.mask").alias("mask"))


def ingest_assets(ids: DataFrame, urls: DataFrame, num_slots: int = 3) -> DataFrame:
    """Ids -> left join URLs -> valid URLs -> ordered per owner -> first N slots + mask.

    Output long form (owner_id, slot, url, mask) for every owner."""
    joined = left_join_assets(ids, urls)
    valid = valid_url_filter(joined.where(F.col("url").isNotNull()))
    w = Window.partitionBy("owner_id").orderBy("ord")
    taken = valid.withColumn("slot", (F.row_number().over(w) - 1).cast("long")).where(F.col("slot") < num_slots)
    grid = ids.select("owner_id").distinct().withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(num_slots - 1)).cast("array<long>")))
    return (grid.join(taken.select("owner_id", "slot", "url"), ["owner_id", "slot"], "left")
                .select("owner_id", "slot", "url", F.col("url").isNotNull().cast("long").alias("mask")))
