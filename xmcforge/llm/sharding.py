"""Sharding by minimax contiguous partition.

Rows of one group (equal texts) are atomic.  Groups lie in the order of their digest; the smallest
capacity with which a greedy pass over the ordered group sizes needs at most ``n_shards`` shards is
found by bisection, and the cuts are those of that pass.  The ordered sizes stay distributed: a
greedy step is a lookup of "the last group whose running size is at most t", and each bisection
round makes that lookup for many capacities in one job.  A row's shard then follows from its digest
and the few cut digests, with no join.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xmcforge.llm.common import table, written
from xmcforge.llm.registry import query

# Capacities probed per bisection round, and groups per bucket of the ordered sizes.
PROBES = 255
BUCKET_GROUPS = 20_000
MAX_BUCKET_BITS = 16
SLOT_ROWS = 50_000


def _digest_bucket(key: Column, bits: int) -> Column:
    """The first ``bits`` bits of a hexadecimal digest as a number (follows the digest's order)."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")


class _Ordered:
    """Running sizes of the groups in digest order, one bucket's running sums per task."""

    def __init__(self, groups: DataFrame):
        n, self.total, self.largest = groups.agg(
            F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
        bits = min(MAX_BUCKET_BITS, max(1, (n // BUCKET_GROUPS).bit_length() + 4))
        groups = groups.withColumn("bucket", _digest_bucket(F.col("key"), bits))
        sums = {r[0]: r[1] for r in groups.groupBy("bucket").agg(F.sum("size")).collect()}  # at most 2^16 rows
        self.starts, run = [], 0
        for b in range(1 << bits):
            self.starts.append(run)
            run += sums.get(b, 0)
        w = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        start = F.broadcast(groups.sparkSession.createDataFrame(list(enumerate(self.starts)), "bucket int, start long"))
        self.runs = written(groups.join(start, "bucket").select(
            "key", "bucket", (F.col("start") + F.sum("size").over(w)).alias("upto")), "running")

    def last_at_most(self, limits: list[int]) -> list[int]:
        """For each limit, the largest running size that is at most the limit (0 if none)."""
        spark = self.runs.sparkSession
        rows = [(i, bisect_right(self.starts, t) - 1, t, self.starts[bisect_right(self.starts, t) - 1])
                for i, t in enumerate(limits)]
        want = spark.createDataFrame(rows, "i int, bucket int, lim long, base long")
        got = self.runs.join(F.broadcast(want), "bucket").where("upto <= lim").groupBy("i").agg(F.max("upto")).collect()
        best = {r[0]: r[1] for r in got}
        # no group of the bucket fits: the buckets before it end at its start
        return [best.get(i, base) for i, _, _, base in rows]

    def cuts(self, capacities: list[int], n_shards: int) -> list[list[int]]:
        """Greedy cuts (running sizes after each shard) for each capacity."""
        at, out = [0] * len(capacities), [[] for _ in capacities]
        for _ in range(n_shards):
            at = [min(x, self.total) for x in self.last_at_most([a + c for a, c in zip(at, capacities)])]
            for o, a in zip(out, at):
                o.append(a)
        return out

    def key_at(self, upto: int) -> str | None:
        row = self.runs.where((F.col("upto") == upto)).agg(F.max("key")).first()
        return row[0]


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[str | None]]:
    """(smallest feasible capacity, last digest of every shard but the last) of ``groups`` (key, size).

    A cut of None closes a shard before any group.  Keys are hexadecimal digests, sizes positive."""
    ordered = _Ordered(groups)
    low = max(-(-ordered.total // n_shards), ordered.largest, 1)
    high = max(-(-ordered.total // n_shards) + ordered.largest, low)  # always feasible
    while low < high:
        step = max(1, -(-(high - low) // (PROBES + 1)))
        probes = list(range(low, high, step))[:PROBES + 1]
        feasible = [c[-1] >= ordered.total for c in ordered.cuts(probes, n_shards)]
        first = next((i for i, ok in enumerate(feasible) if ok), None)
        if first is None:
            low = probes[-1] + 1
        else:
            high = probes[first]
            low = low if first == 0 else probes[first - 1] + 1
    ends = ordered.cuts([low], n_shards)[0][:-1]
    return low, [ordered.key_at(e) for e in ends]


def shard_rows(rows: DataFrame, n_shards: int) -> DataFrame:
    """Append ``shard`` (0-based) and ``slot`` (gapless from 0 in its shard) to ``rows``, which hold
    ``key`` (hexadecimal digest of the group) and ``size`` (positive) among other columns.

    Rows must come from a written table.  A group of any number of rows is summed map-side for
    the cuts, and its rows are numbered over many tasks: by hashed row blocks, not by group."""
    capacity_keys = minimax_cuts(rows.groupBy("key").agg(F.sum("size").alias("size")), n_shards)[1]
    shard = F.lit(0)
    for k in capacity_keys:
        shard = shard + (F.lit(True) if k is None else F.col("key") > F.lit(k)).cast("int")
    blocks = max(1, rows.count() // SLOT_ROWS) * 8
    placed = written(rows.withColumn("shard", shard.cast("int")).withColumn("_row", F.monotonically_increasing_id())
                     .withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks))), "placed")
    counts = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("shard", "_block").orderBy("key", "_row")
    return (placed.join(before, ["shard", "_block"])
            .withColumn("slot", (F.col("_before") + F.row_number().over(inner) - 1).cast("long"))
            .drop("_block", "_row", "_before"))


def shard_texts(df: DataFrame, n_shards: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row: sizes near equal, equal
    texts together.

    Size is the text's UTF-8 bytes plus 1.  Null texts have no bytes (crc32 0) and, like empty ones,
    form one group each.  Repeated rows are rows of the same group; an empty table gives none.
    Columns other than ``id_col`` and ``text_col`` are not read."""
    text = df[f"`{text_col}`"]
    rows = df.select(df[f"`{id_col}`"].alias(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                     F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
                     F.coalesce(F.md5(text), F.md5(F.lit("\x00null"))).alias("key"))
    out = shard_rows(written(rows, "rows"), n_shards)
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op3_shard")
def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``bytes``."""
    return shard_texts(table(spark, sf_dir, "documents"), 8)
