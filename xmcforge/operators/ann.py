"""Inverted-file retrieval over balanced clusters.

Labels are dealt into balanced clusters (cells) with a centroid and a radius.  For any vectors,
q.x <= q.c + |q| r holds for every label x of a cell with centroid c and radius r.  A query probes the
``probes`` cells of highest bound; with ``widen`` it then meets every other cell whose bound reaches its
k-th score so far, and the result is the exact top k.

No (query, cell) pair is a row: queries are hashed into blocks, as in exact retrieval, and a block's
task streams the cells' centroids and then the members cell by cell, once for the probes and once more
for the widening.  A task holds its queries, their lists, the cells they chose and all centroids, which
are 1 / ``CELL_SIZE`` of the labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmcforge.functions import vectors as V
from xmcforge.operators.cluster import balanced_clusters, tree_depth
from xmcforge.operators.represent import vector_mean
from xmcforge.operators.retrieval import (CAND_SCHEMA, CELL_BYTES, LABEL_ROWS, TILE_ROWS, _Best, _Cell, _among, _Labels, _matrix,
                                          _streamer, _vector_type, block_topk, held_bytes, plan_blocks, rank_within_query)
from xmcforge.session import reliable_checkpoint

CELL_SIZE = 64
BLOCK_QUERIES = 262_144  # queries that a task holds at most
DENSE = 0.1              # share of a batch's (query, cell) pairs to score from which on all are scored
DIGITS = 6
MARGIN = 2e-6            # scores and bounds are rounded to 6 decimals


def build_cells(labels: DataFrame, cell_size: int = CELL_SIZE, seed: int = 0, rounds: int = 2,
                l_col: str = "label_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The index of ``labels``: members (label_id, cell, embedding of unit length, raw vector) and cells (cell,
    centroid with the radius as one more component).  Labels without a vector are in neither."""
    real = labels.select(F.col(l_col).cast("long").alias("label_id"), F.col(vec_col).alias("embedding")).where(
        "label_id is not null and embedding is not null")
    depth = tree_depth(real.count(), cell_size)
    of = balanced_clusters(real, depth, seed, rounds, id_col="label_id").select("label_id", F.col("cluster_id").alias("cell"))
    members = reliable_checkpoint(real.select("label_id", V.l2_normalize("embedding").alias("embedding"), F.col("embedding").alias("raw"))
                                  .join(of, "label_id"))
    centroids = vector_mean(members, ["cell"])
    far = (members.join(centroids.select("cell", F.col("embedding").alias("_c")), "cell")
           .groupBy("cell").agg(F.max(V.dot("embedding", "embedding") - 2 * V.dot("embedding", "_c") + V.dot("_c", "_c")).alias("_d")))
    cells = centroids.join(far, "cell").select("cell", F.concat("embedding", F.array(F.sqrt(F.greatest("_d", F.lit(0.0))) + 1e-9)).alias("embedding"))
    return members, reliable_checkpoint(cells)


def reach(queries, cells):
    """The highest score that a label of each cell can have: q.c + |q| r."""
    return queries @ cells[:, :-1].T + np.linalg.norm(queries, axis=1)[:, None] * cells[:, -1]


class _Probe(_Cell):
    """A query block that meets only members of the cells it asks for.

    Sides after queries and excluded pairs: 2 centroids, 3 members to be probed, 4 members again, to widen."""

    def __init__(self, k: int, digits: int, probes: int):
        super().__init__(k, True, True, digits, None)
        self.probes, self.cells, self.centers, self.chosen = probes, [], [], None

    def add(self, side: int, batch) -> None:
        if side < 2:
            super().add(side, batch)
        elif not self.ready():
            return
        elif side == 2:
            self.cells.append(np.asarray(batch.column("id")))
            self.centers.append(_matrix(batch.column("center")))
        else:
            ids, cells = np.asarray(batch.column("id")), np.asarray(batch.column("other"))
            vec = self.unit(_matrix(batch.column("vec")))
            if self.chosen is None:
                self.choose()
            for at in range(0, len(ids), LABEL_ROWS):
                part = slice(at, at + LABEL_ROWS)
                (self.probe if side == 3 else self.widen)(ids[part], cells[part], vec[part])

    def choose(self) -> None:
        """Each query's ``probes`` cells of highest bound, as sorted codes cell place * queries + row."""
        cells, centers = np.concatenate(self.cells), np.concatenate(self.centers)
        order = np.argsort(cells)
        self.cells, self.centers = cells[order], centers[order]
        n, step = len(self.ids), len(self.cells)
        if self.probes >= step:
            self.chosen = np.zeros(0, np.int64)
            return
        best = _Best(n, self.probes)
        place = np.arange(step)
        for s in range(0, n, TILE_ROWS):
            rows = np.arange(s, min(s + TILE_ROWS, n))
            for at in range(0, step, LABEL_ROWS):
                found = block_topk(rows, self.vec[rows], place[at:at + LABEL_ROWS], self.centers[at:at + LABEL_ROWS], self.probes, score=reach)
                best.add(*found[:3])
        best.merge()
        self.chosen = np.sort(np.concatenate([lab * n + rows for rows, lab, _ in best.lists]))

    def groups(self, cells: np.ndarray):
        """(cell place, start, end) of the runs of a batch sorted by cell."""
        cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        at = np.r_[0, cuts]
        return zip(np.searchsorted(self.cells, cells[at]).tolist(), at.tolist(), np.r_[cuts, len(cells)].tolist())

    def asked(self, place: int) -> np.ndarray:
        """The queries that chose a cell."""
        n = len(self.ids)
        a, b = np.searchsorted(self.chosen, [place * n, (place + 1) * n])
        return self.chosen[a:b] - place * n

    def meet(self, rows: np.ndarray, labels: _Labels) -> None:
        """Some queries meet the members of one cell."""
        step = max(1, LABEL_ROWS * TILE_ROWS // len(labels.ids))
        gone = labels.excluded(self.ex_row, self.ex_label)
        for s in range(0, len(rows), step):
            some = rows[s:s + step]
            if not self.screen(some, labels, gone):
                self.rank(some, labels)

    def probe(self, ids, cells, vec) -> None:
        if self.probes >= len(self.cells):
            self.meet_all(ids, vec)
            return
        for place, a, b in self.groups(cells):
            rows = self.asked(place)
            if len(rows):
                self.meet(rows, _Labels(ids[a:b], vec[a:b]))

    def widen(self, ids, cells, vec) -> None:
        """Cells not chosen whose bound reaches the k-th score; where these are many, whole tiles are screened."""
        if self.probes >= len(self.cells):
            return
        self.best.merge()
        n, runs = len(self.ids), list(self.groups(cells))
        places = np.array([place for place, _, _ in runs])
        column = np.repeat(places, [b - a for _, a, b in runs])
        every = _Labels(ids, vec)
        gone = every.excluded(self.ex_row, self.ex_label)
        probed = lambda row, c: _among(column[c] * n + row, self.chosen)
        left = [[] for _ in runs]
        for s in range(0, n, TILE_ROWS):
            rows = np.arange(s, min(s + TILE_ROWS, n))
            open_ = ~(reach(self.vec[rows], self.centers[places]) + MARGIN < self.best.least[rows][:, None])
            if open_.mean() >= DENSE and self.screen(slice(s, rows[-1] + 1), every, gone, skip=probed):
                continue
            r, j = np.nonzero(open_)
            fresh = ~_among(places[j] * n + rows[r], self.chosen)
            r, j = r[fresh], j[fresh]
            order = np.argsort(j, kind="stable")
            ends = np.searchsorted(j[order], np.arange(len(runs) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                left[i].append(rows[r[order[ends[i]:ends[i + 1]]]])
        for (_, a, b), rows in zip(runs, left):
            if rows:
                self.meet(np.concatenate(rows), _Labels(ids[a:b], vec[a:b]))


def ann_topk(queries: DataFrame, index: tuple[DataFrame, DataFrame], k: int = 10, probes: int = 8, widen: bool = True,
             exclude: DataFrame | None = None, q_col: str = "q_id", vec_col: str = "embedding", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Top-``k`` labels by cosine: (q_id, label_id, score, rank) from the ``index`` of ``build_cells``.

    Each query probes its ``probes`` best cells; with ``widen`` (exact) every other cell whose bound is
    open, too.  ``exclude`` (q_id, label_id) pairs are never selected.
    Queries without an id or a vector have no neighbours; an empty index gives no rows."""
    members, cells = index
    n_cells = cells.count()
    width = _vector_type(queries.schema[vec_col], members.schema["raw"])
    zero, no_vec, no_center = F.lit(0).cast("long").alias("other"), F.lit(None).cast(width).alias("vec"), F.lit(None).cast("array<double>").alias("center")
    q = queries.select(F.lit(0).alias("side"), F.col(q_col).cast("long").alias("id"), zero, F.col(vec_col).cast(width).alias("vec"), no_center).where(
        "id is not null and vec is not null")
    if exclude is None:
        ex = None
    else:
        ex = exclude.select(F.lit(1).alias("side"), F.col("q_id").cast("long").alias("id"), F.col("label_id").cast("long").alias("other"),
                            no_vec, no_center).where("id is not null and other is not null")
    n_q, dim = (int(x or 0) for x in q.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first())
    n_x = ex.count() if ex is not None else 0
    par = int(queries.sparkSession.sparkContext.defaultParallelism)
    few = min(probes, n_cells)
    # chosen cells are held as lists first, then as codes; all centroids once more by the task
    held = held_bytes(k, dim) + (0.0 if few >= n_cells else 36.0 * few)
    n_qb = plan_blocks(1, n_q, 0, dim, CELL_BYTES, excluded_per_query=n_x / max(n_q, 1), held=held)[0]
    n_qb = max(n_qb, -(-n_q // block_queries), min(par, -(-n_q // TILE_ROWS)), 1)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1)).cast("array<long>")).alias("block")
    own = F.pmod(F.xxhash64("id"), F.lit(n_qb)).alias("block")
    label = lambda side: members.select(blocks, F.lit(side).alias("side"), F.col("label_id").alias("id"), F.col("cell").alias("other"),
                                        F.col("raw").cast(width).alias("vec"), no_center)
    rows = q.select(own, "*").unionByName(label(3)).unionByName(
        cells.select(blocks, F.lit(2).alias("side"), F.col("cell").alias("id"), zero, no_vec, F.col("embedding").alias("center")))
    if ex is not None:
        rows = rows.unionByName(ex.select(own, "*"))
    if widen and few < n_cells:
        rows = rows.unionByName(label(4))
    found = (rows.withColumnRenamed("block", "cell").repartitionById(n_qb, F.col("cell").cast("int")).sortWithinPartitions("cell", "side", "other")
             .mapInArrow(_streamer(k, DIGITS, few, make=_Probe), CAND_SCHEMA).drop("excluded"))
    return rank_within_query(found, k).select("q_id", "label_id", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (hits, wanted, recall): the share of the exact top lists that was found."""
    hits = exact.select("q_id", "label_id").join(found.select("q_id", "label_id", F.lit(1).alias("_hit")), ["q_id", "label_id"], "left")
    return hits.agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("wanted")).withColumn(
        "recall", F.col("hits") / F.greatest(F.col("wanted"), F.lit(1)))
