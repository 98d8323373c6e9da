"""Approximate nearest neighbours with a vantage-point tree per shard.

Rows are dealt into shards of bounded size.  Each shard's task builds a balanced vantage-point tree
and searches it for a block of queries: a subtree is skipped when the triangle inequality bounds its
distances from below by more than the query's k-th best so far, divided by ``factor``.  Factor 1
skips only what cannot hold a neighbour, so the search is exact; larger factors skip more.  The best
k of every shard are merged per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xmcforge.llm.common import table
from xmcforge.llm.registry import query

SHARD_ROWS = 4096
QUERY_ROWS = 2048
LEAF_ROWS = 64
FACTOR = 2.0
# Numbers held by one distance step.
STEP_NUMBERS = 1 << 20


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, at least one not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def lengths(diff):
    """Euclidean lengths along the last axis; where squares leave the range of a double, of the scaled
    numbers (infinite only where a length or a difference itself is)."""
    import numpy as np
    with np.errstate(all="ignore"):
        out = np.sqrt(np.square(diff).sum(axis=-1))
        odd = ~((out > 1e-140) & (out < 1e150))
        if odd.any():
            part = np.abs(diff[odd])
            top = part.max(axis=-1)
            scale = np.where((top > 0) & np.isfinite(top), top, 1.0)
            out[odd] = np.where(np.isfinite(top), scale * np.sqrt(np.square(part / scale[:, None]).sum(axis=-1)), np.inf)
    return out


def distances(queries, rows):
    """Euclidean distances (queries x rows), each summed over the differences in double precision."""
    import numpy as np
    out = np.empty((len(queries), len(rows)))
    step = max(1, STEP_NUMBERS // max(1, rows.size))
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(0, len(queries), step):
            out[i:i + step] = lengths(queries[i:i + step, None, :] - rows[None, :, :])
    return out


class VantageTree:
    """A vantage-point tree over ``rows``: nodes split their rows at the median distance to a vantage
    point and keep each half's smallest and largest distance.  Halves are equal whatever the ties."""

    def __init__(self, rows, leaf_rows: int = LEAF_ROWS):
        import numpy as np
        self.rows, self.leaf_rows = rows, leaf_rows
        self.root = self._grow(np.arange(len(rows)))

    def _grow(self, at):
        import numpy as np
        if len(at) <= self.leaf_rows:
            return (None, at)
        sub = self.rows[at]
        with np.errstate(over="ignore", invalid="ignore"):
            centre = sub.mean(axis=0)
        far = sub[np.argmax(distances(centre[None, :], sub)[0])]  # off-centre points spread distances best
        d = distances(far[None, :], sub)[0]
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        d = d[order]
        return (far, ((d[0], d[half - 1], self._grow(at[order[:half]])), (d[half], d[-1], self._grow(at[order[half:]]))))

    def search(self, queries, own, ids, k: int, factor: float):
        """(distances, row numbers) of each query's k best rows, -1 where there are fewer; rows whose
        id is the query's ``own`` are left out.  Ties go to the smaller id."""
        import numpy as np
        n = len(queries)
        best = np.full((n, k), np.inf)
        row = np.full((n, k), -1)
        first_leaf = np.full(n, -1)

        with np.errstate(over="ignore"):
            squares, row_squares = np.square(queries).sum(axis=1), np.square(self.rows).sum(axis=1)

        def read(q, at):
            # the matrix product rules rows out (none where it overflows); what it leaves is measured exactly
            with np.errstate(over="ignore", invalid="ignore"):
                scale = squares[q][:, None] + row_squares[at][None, :]
                rough = scale - 2.0 * (queries[q] @ self.rows[at].T)
                near = ~(rough > np.square(best[q, -1])[:, None] * (1 + 1e-9) + 1e-9 * scale)
            near &= own[q][:, None] != ids[at][None, :]
            i, j = np.nonzero(near)
            d = np.full(near.shape, np.inf)
            step = max(1, STEP_NUMBERS // queries.shape[1])
            for s in range(0, len(i), step):
                a, b = i[s:s + step], j[s:s + step]
                with np.errstate(over="ignore"):
                    d[a, b] = lengths(queries[q[a]] - self.rows[at[b]])
            alld = np.concatenate([best[q], d], axis=1)
            allr = np.concatenate([row[q], np.where(near, at, -1)], axis=1)
            key = np.where(allr >= 0, ids[allr], np.iinfo(np.int64).max)
            order = np.lexsort((key, alld), axis=1)[:, :k]
            best[q] = np.take_along_axis(alld, order, axis=1)
            row[q] = np.take_along_axis(allr, order, axis=1)

        def below(node, q):
            d = distances(queries[q], node[0][None, :])[:, 0]
            with np.errstate(invalid="ignore"):  # infinite distances give no bound
                return [np.nan_to_num(np.maximum(0.0, np.maximum(lo - d, d - hi)), nan=0.0, posinf=np.inf) for lo, hi, _ in node[1]]

        def descend(node, q):  # to the nearer half each time, for a first k-th distance
            if not len(q):
                return
            if node[0] is None:
                first_leaf[q] = id(node)
                read(q, node[1])
                return
            a, b = below(node, q)
            descend(node[1][0][2], q[a <= b])
            descend(node[1][1][2], q[a > b])

        def walk(node, q):
            if not len(q):
                return
            if node[0] is None:
                q = q[first_leaf[q] != id(node)]
                if len(q):
                    read(q, node[1])
                return
            for bound, (_, _, child) in zip(below(node, q), node[1]):
                walk(child, q[bound * factor <= best[q, -1]])

        descend(self.root, np.arange(n))
        walk(self.root, np.arange(n))
        return best, row


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shard_rows: int = SHARD_ROWS,
            query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows nearest to each query, nearest first.

    Both tables hold (id, vector).  Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, nor do rows with a null id; vectors meet only vectors of their length.
    A row is no candidate of a query with its id.  Rows that repeat an id are candidates each; a
    repeated query is asked once (its smallest vector).  Ties go to the smaller id; fewer candidates
    than ``k`` are all returned.  ``factor`` 1 is exact.  Distances whose squares overflow or vanish
    are measured on scaled vectors; one that is no double itself is infinite and comes last."""
    def clean(df):
        v = F.col("vector").cast("array<double>")
        return df.select(F.col("id").cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))

    rows = clean(rows)
    queries = clean(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    dealt = (rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = (queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))))

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        def matrix(t):
            return np.asarray(t.column("vector").combine_chunks().flatten()).reshape(t.num_rows, -1)
        ids, own = np.asarray(left.column("id")), np.asarray(right.column("id"))
        best, row = VantageTree(matrix(left)).search(matrix(right), own, ids, k, factor)
        q, c = np.nonzero(row >= 0)
        return pa.Table.from_arrays([pa.array(own[q]), pa.array(ids[row[q, c]]), pa.array(best[q, c])], schema=schema)

    size = F.size("vector").alias("dim")
    cell = ["shard", "block", "dim"]
    found = (dealt.select("id", "vector", "shard", "block", size).groupBy(*cell)
             .cogroup(asked.select("id", "vector", "shard", "block", size).groupBy(*cell))
             .applyInArrow(run, "query_id long, vec_id long, score double"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op4_vantage_search")
def op4_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of every embedding whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(rows, rows.where(F.col("id") % 100 == 0))
