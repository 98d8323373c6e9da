"""Balanced hierarchical 2-means.

Level-synchronous: every node of a level is split in the same job, so a level costs a few
shuffles regardless of how many nodes it has.  A split seeds its two centroids with the
members of smallest and largest md5(item, seed, level, node), runs ``rounds`` assignment
rounds (the first uses the seeds, later ones the half means), and cuts each node at its
median of delta = sim(x, c_left) - sim(x, c_right): the first floor(n/2) members by
(delta desc, item id) go left.  Sizes therefore differ by at most one at every level.
The rank inside a node is the distributed rank restarted per node (level 0 is one node
holding everything); only (item, node, delta) are ranked, and the item table with its
vectors is checkpointed once per level.

Only nodes larger than a task's share (``SUBTREE_BYTES``) are split that way.  Below, the items
are shuffled to their node once and each task grows its node's whole subtree with the same
rules in NumPy, so a depth of 16 costs a few jobs and one shuffle, not 16 global sorts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmcforge.functions import vectors as V
from xmcforge.operators.represent import vector_mean
from xmcforge.operators.sampling import md5_int
from xmcforge.plans.ranking import dist_rank
from xmcforge.session import reliable_checkpoint


def root_node(id_col: str = "item_id"):
    """Node 0 for every item, written so the optimizer cannot fold it to a literal: a
    literal key would turn the item/centroid equi-join into a keyless nested-loop join."""
    return F.coalesce(F.col(id_col).cast("long") * F.lit(0), F.lit(0)).cast("long").alias("node")


def _seed_centroids(items: DataFrame, seed: int, level: int) -> DataFrame:
    key = md5_int("item_id", F.lit(seed), F.lit(level), "node")
    k = items.withColumn("_k", F.struct(key.alias("h"), F.col("item_id")))
    return k.groupBy("node").agg(F.min_by("v", "_k").alias("c0"), F.max_by("v", "_k").alias("c1"))


CENTROID_BROADCAST_BYTES = 64 << 20


def median_sides(scored: DataFrame) -> DataFrame:
    """(item_id, side) of ``scored`` (item_id, node, delta): the first floor(n/2) of a node's items by
    (delta desc, item id) have side 0, the others 1.  A node may be as large as the table."""
    sizes = scored.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    ranked = dist_rank(scored, [F.col("delta").desc(), F.col("item_id").asc()], rank_col="_r", partition_by=["node"])
    return (ranked.join(sizes, "node")
                  .select("item_id", F.when(F.col("_r") <= F.floor(F.col("_n") / 2), 0).otherwise(1).cast("long").alias("side")))


def balanced_split(items: DataFrame, seed: int, level: int, rounds: int = 1, dim: int | None = None,
                   n_items: int | None = None) -> DataFrame:
    """Split every node of ``items`` (item_id, node, v unit vector) in two halves.

    Returns (item_id, node, v, side) with side 0 = left.  A level has at most 2^level nodes,
    so the centroid table has a proven size (2^level x 2 x dim doubles): it is broadcast
    under 64 MiB (level 0 is one node: a shuffle join on that key would put every item in
    one task), otherwise joined by node (nodes are then many and equal in size)."""
    cents = _seed_centroids(items, seed, level)
    if dim is None or n_items is None:
        row = items.select(F.max(F.size("v")), F.count(F.lit(1))).first()
        dim, n_items = int(row[0] or 1), int(row[1])
    small = (2 ** level) * 2 * dim * 8 <= CENTROID_BROADCAST_BYTES
    side = None
    for r in range(max(rounds, 1)):
        side_table = F.broadcast(cents) if small else cents
        # only (item, node, delta) go through the rank (and its checkpoint); vectors stay put
        joined = items.join(side_table, "node")
        diff = V.dot_difference(joined, "v", "c0", "c1", "d", keep=["item_id", "node"])
        scored = diff.select("item_id", "node", F.round("d", 9).alias("delta"))
        side = median_sides(scored)
        if r + 1 < rounds:
            halves = vector_mean(items.join(side, "item_id").withColumnRenamed("v", "embedding"),
                                 ["node", "side"], "embedding")
            cents = halves.groupBy("node").agg(
                F.max(F.when(F.col("side") == 0, F.col("embedding"))).alias("c0"),
                F.max(F.when(F.col("side") == 1, F.col("embedding"))).alias("c1"))
    return items.join(side, "item_id").select("item_id", "node", "v", "side")


SUBTREE_BYTES = 256 << 20  # vectors (as double) of a node that one task splits to the end


def seeded_halves(ids, x, rows, seed: int, level: int, node: int, rounds: int):
    """(left rows, right rows) of one node by the rules of ``balanced_split``."""
    import hashlib
    import numpy as np
    if len(rows) < 2:
        return rows[:0], rows
    drawn = sorted((int(hashlib.md5(f"{i}:{seed}:{level}:{node}".encode()).hexdigest()[:13], 16), i, r)
                   for i, r in zip(ids[rows].tolist(), rows.tolist()))
    c0, c1 = x[drawn[0][2]], x[drawn[-1][2]]
    for r in range(max(rounds, 1)):
        if r:
            c0, c1 = x[left].mean(axis=0), x[right].mean(axis=0)
        v = x[rows]
        delta = np.round(np.cumsum(v * c0, axis=1)[:, -1] - np.cumsum(v * c1, axis=1)[:, -1], 9)
        order = rows[np.lexsort((ids[rows], -delta))]
        left, right = order[:len(rows) // 2], order[len(rows) // 2:]
    return left, right


def grow_subtrees(items: DataFrame, level: int, depth: int, seed: int, rounds: int = 1, halves=seeded_halves) -> DataFrame:
    """(item_id, node) at ``depth`` of ``items`` (item_id, node at ``level``, v): each node's subtree
    in one task.  ``halves(ids, x, rows, seed, level, node, rounds)`` cuts a node in two (F03)."""
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        ids = np.asarray(table.column("item_id"))
        vec = table.column("v").combine_chunks()
        x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(ids), -1)
        out = np.empty(len(ids), np.int64)
        todo = [(level, int(key[0].as_py()), np.argsort(ids, kind="stable"))]
        while todo:
            lv, node, rows = todo.pop()
            if lv == depth:
                out[rows] = node
                continue
            left, right = halves(ids, x, rows, seed, lv, node, rounds)
            todo += [(lv + 1, 2 * node, left), (lv + 1, 2 * node + 1, right)]
        return pa.Table.from_arrays([pa.array(ids), pa.array(out)], names=["item_id", "node"])

    return (items.select(F.col("item_id").cast("long").alias("item_id"), "node", "v").groupBy("node")
            .applyInArrow(run, "item_id long, node long"))


def tree_depth(n_items: int, cluster_size: int) -> int:
    """Depth giving clusters of about ``cluster_size`` items: ceil(log2(n / size))."""
    return max(0, int(math.ceil(math.log2(max(n_items, 1) / max(cluster_size, 1)))))


def balanced_clusters(items: DataFrame, depth: int, seed: int = 0, rounds: int = 1, id_col: str = "item_id",
                      vec_col: str = "embedding", subtree_bytes: int = SUBTREE_BYTES, halves=seeded_halves) -> DataFrame:
    """2^depth clusters of equal size (+-1); (item_id, cluster_id).

    Levels are split globally until a node's vectors fit ``subtree_bytes``, then in the node's task.
    ``halves`` replaces the rule there (F03); with a rule of your own, choose ``subtree_bytes`` such
    that no level is split globally."""
    from xmcforge.plans.partitioning import spread_if_small
    row = items.select(F.max(F.size(vec_col)), F.count(F.lit(1))).first()
    dim, n_items = int(row[0] or 1), int(row[1])
    cur = spread_if_small(items.select(id_col, vec_col), key=id_col).select(
        F.col(id_col).alias("item_id"), root_node(id_col), V.l2_normalize(vec_col).alias("v"))
    level = 0
    while level < depth and (n_items >> level) * (8 * dim + 64) > subtree_bytes:
        if level == 0:  # read by several branches (seeds, sizes, scoring, join back): pinned like every later level
            cur = reliable_checkpoint(cur)
        split = balanced_split(cur, seed, level, rounds, dim=dim, n_items=n_items)
        # one reliable checkpoint per level cuts the lineage of the vectors
        cur = reliable_checkpoint(split.select("item_id", (F.col("node") * 2 + F.col("side")).alias("node"), "v"))
        level += 1
    done = grow_subtrees(cur, level, depth, seed, rounds, halves) if level < depth else cur
    return done.select(F.col("item_id").alias(id_col), F.col("node").alias("cluster_id"))


def key_halves(ids, x, rows, seed: int, level: int, node: int, rounds: int):
    """Halves by the node level's key (``x`` holds one column per level), as ``median_sides`` cuts."""
    import numpy as np
    order = rows[np.lexsort((ids[rows], -x[rows, level]))]
    return order[:len(rows) // 2], order[len(rows) // 2:]


def keyed_clusters(items: DataFrame, depth: int, key, id_col: str = "item_id", subtree_bytes: int = SUBTREE_BYTES) -> DataFrame:
    """2^depth clusters of equal size (+-1) by a caller's splitter; (item_id, cluster_id).

    ``key(level)`` is a column over ``items``: each node is cut at its median, larger values left, ties
    to the smaller id.  It works at any size: a node too large for a task is cut by a distributed rank
    of (item, node, key), smaller ones in their task.  Items with a null id or a null or NaN key on any
    level are refused."""
    keys = F.array(*[key(lv).cast("double") for lv in range(depth)])
    cur = items.select(F.col(id_col).cast("long").alias("item_id"), root_node(id_col), keys.alias("v"))
    bad = F.col("item_id").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x))
    cur = cur.withColumn("item_id", F.when(bad, F.raise_error(F.lit("a null id, or a null or NaN key"))).otherwise(F.col("item_id")))
    n_items, level = cur.count(), 0
    while level < depth and (n_items >> level) * (8 * depth + 64) > subtree_bytes:
        cur = reliable_checkpoint(cur)
        side = median_sides(cur.select("item_id", "node", F.col("v")[level].alias("delta")))
        cur = cur.join(side, "item_id").select("item_id", (F.col("node") * 2 + F.col("side")).alias("node"), "v")
        level += 1
    done = grow_subtrees(cur, level, depth, 0, halves=key_halves) if level < depth else cur
    return done.select(F.col("item_id").alias(id_col), F.col("node").alias("cluster_id"))
