"""Exact one-vs-all retrieval.

Every query is scored against every label, but pairs never exist as rows.  Queries are hashed into
blocks whose vectors and excluded pairs fit in ``block_bytes``; labels may be hashed into blocks,
too, to give more tasks.  Queries, excluded pairs and labels of each (query block, label block)
cell are dealt to the cell's own task number and sorted, so a task holds one query block and
streams label batches past it, keeping each query's best candidates: a label is ranked only where
it reaches the query's k-th score so far.  A native ``row_number`` window (planned as
``WindowGroupLimit``) merges the lists of the cells.

Scores are cosine/dot in double, rounded to 6 decimals *before* ranking; ties break on
the smaller label id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAND_SCHEMA = T.StructType([
    T.StructField("q_id", T.LongType()),
    T.StructField("label_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("excluded", T.BooleanType()),
])

DEFAULT_BLOCK_BYTES = 128 << 20  # one dense block of vectors (as double) per side
TILE_BYTES = 8 << 20             # one query tile x label block score matrix, ranked in double
TILE_ROWS = 256                  # queries of a tile ...
LABEL_ROWS = 4096                # ... and labels that it meets at once
FIRST_ROWS = 512                 # labels ranked before any k-th score is known
CELL_BYTES = 192 << 20           # what a task holds of one query block: vectors, excluded pairs, lists
_NARROW_NORM = 1e15              # vectors below this length may be screened in single precision
MIN_BLOCK_ROWS = 256             # do not split blocks finer than this to gain parallelism
MAX_TASKS = 20_000               # more cells than this share tasks, one after the other
_EXCLUDED_KEY = np.iinfo(np.int64).max


def _normalize_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(n > 0, m / np.where(n > 0, n, 1.0), 0.0)
    return out


def block_topk(q_ids: np.ndarray, qmat: np.ndarray, l_ids: np.ndarray, lmat: np.ndarray, k: int,
               ex_q: np.ndarray | None = None, ex_l: np.ndarray | None = None, drop_excluded: bool = True,
               digits: int = 6, score=None):
    """Exact per-query top-``k`` of ``qmat @ lmat.T`` by (score desc, label id asc).

    ``(ex_q, ex_l)`` are excluded (query id, label id) pairs of this block: with
    ``drop_excluded`` they can never be selected (exact "filter before"), otherwise they
    compete normally and come back flagged ("filter after").
    ``score(qmat, lmat)`` may replace the dot product by another (queries x labels) matrix.
    Query ids are distinct.  Returns flat arrays (q_id, label_id, score, excluded) grouped by
    query in rank order."""
    order = np.argsort(l_ids, kind="stable")
    l_ids, lmat = l_ids[order], lmat[order]
    nl, nq = len(l_ids), len(q_ids)
    empty = (np.array([], np.int64), np.array([], np.int64), np.array([], np.float64), np.array([], bool))
    if nl == 0 or nq == 0 or k <= 0:
        return empty
    ex_r = ex_c = np.array([], np.int64)
    if ex_q is not None and len(ex_q):
        by_id = np.argsort(q_ids, kind="stable")
        r = by_id[np.minimum(np.searchsorted(q_ids, ex_q, sorter=by_id), nq - 1)]
        c = np.searchsorted(l_ids, ex_l)
        c = np.where(c < nl, c, 0)
        ok = (q_ids[r] == ex_q) & (l_ids[c] == ex_l)
        ex_r, ex_c = r[ok].astype(np.int64), c[ok].astype(np.int64)
    tile = max(1, TILE_BYTES // (8 * nl))
    pos = np.arange(nl, dtype=np.int64)
    scale = 10.0 ** digits
    kk = min(k, nl)
    outs = []
    for s in range(0, nq, tile):
        e = min(s + tile, nq)
        raw = qmat[s:e] @ lmat.T if score is None else np.asarray(score(qmat[s:e], lmat), np.float64)
        scores = np.rint(raw * scale) / scale
        mask = np.zeros(scores.shape, dtype=bool)
        sel = (ex_r >= s) & (ex_r < e)
        mask[ex_r[sel] - s, ex_c[sel]] = True
        bound = float(np.abs(scores).max()) * scale if scores.size else 0.0
        if bound * nl < 4.0e18:
            # exact integer key: smaller = better and unique per row, so a partial sort is exact
            key = -np.rint(scores * scale).astype(np.int64) * nl + pos
            if drop_excluded:
                key[mask] = _EXCLUDED_KEY
            idx = np.argpartition(key, kk - 1, axis=1)[:, :kk] if kk < nl else np.broadcast_to(pos, key.shape).copy()
            idx = np.take_along_axis(idx, np.argsort(np.take_along_axis(key, idx, axis=1), axis=1), axis=1)
        else:  # unbounded scores: full lexicographic sort
            sc = np.where(mask, -np.inf, scores) if drop_excluded else scores
            idx = np.lexsort((np.broadcast_to(pos, sc.shape), -sc), axis=1)[:, :kk]
        rows = np.broadcast_to(np.arange(e - s)[:, None], idx.shape)
        flag = mask[rows, idx]
        keep = ~flag if drop_excluded else np.ones_like(flag)
        outs.append((q_ids[s:e][rows[keep]], l_ids[idx[keep]], scores[rows[keep], idx[keep]], flag[keep]))
    if not outs:
        return empty
    return tuple(np.concatenate([o[i] for o in outs]) for i in range(4))


def _matrix(col) -> np.ndarray:
    """A (rows x dim) float64 matrix from an Arrow list column without per-row Python objects."""
    arr = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    if arr.null_count:
        raise ValueError("a null vector among the embeddings")
    ends = np.asarray(arr.offsets)
    if (np.diff(ends) != ends[1] - ends[0]).any():
        raise ValueError("embeddings in one block must all have the same width")
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


class _Labels:
    """A batch of labels: ids, unit or given vectors, and the excluded pairs (query row, label) that it holds."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray):
        self.ids, self.vec = ids, vec
        self.norm = float(np.sqrt((vec * vec).sum(axis=1).max())) if vec.size else 0.0
        self.narrow = vec.astype(np.float32) if self.norm < _NARROW_NORM else None  # NaN compares as false, too

    def excluded(self, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Sorted codes (query row * labels + place) of the pairs whose label is here, as ``block_topk`` places them."""
        if not len(rows):
            return rows
        order = np.argsort(self.ids, kind="stable")
        place = order[np.minimum(np.searchsorted(self.ids, labels, sorter=order), len(self.ids) - 1)]
        here = self.ids[place] == labels
        return np.sort(rows[here] * len(self.ids) + place[here])


def _among(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``codes`` stand in the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(codes), bool)
    return wanted[np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)] == codes


def _reaching(raw: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores that reach their row's limit, in order.

    Most rows hold none once the lists are good, so each row's maximum is looked at first."""
    limit = limit.astype(raw.dtype)
    hit = np.flatnonzero(raw.max(axis=1) >= limit)
    if 2 * len(hit) >= len(limit):
        hit = np.arange(len(limit))
    else:
        raw, limit = raw[hit], limit[hit]
    r, c = np.divmod(np.flatnonzero(raw >= limit[:, None]), raw.shape[1])  # several times faster than nonzero of a matrix
    return hit[r], c


class _Best:
    """The best ``k`` labels of each of ``n`` query rows, by (score desc, label id).

    What is found waits in ``fresh`` and is merged tile by tile, so the memory beside the lists is
    bounded.  ``least`` is the k-th score of a row, -inf while its list is short."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        none = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float64)
        self.lists = [none] * -(-n // TILE_ROWS)
        self.least = np.full(n, -np.inf)
        self.fresh, self.held = [], 0

    def add(self, rows: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        if len(rows):
            self.fresh.append((rows.astype(np.int32), labels, scores))
            self.held += len(rows)
            if self.held > max(100_000, self.n * self.k // 4):
                self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        new = [np.concatenate([f[i] for f in self.fresh]) for i in range(3)]
        self.fresh, self.held = [], 0
        tile = new[0] // TILE_ROWS
        order = np.argsort(tile, kind="stable")
        new = [x[order] for x in new]
        ends = np.searchsorted(tile[order], np.arange(len(self.lists) + 1))
        for t in np.flatnonzero(np.diff(ends)):
            rows, labels, scores = (np.concatenate([old, x[ends[t]:ends[t + 1]]]) for old, x in zip(self.lists[t], new))
            order = np.lexsort((labels, -scores, rows))
            rows = rows[order]
            start = np.r_[True, rows[1:] != rows[:-1]]
            at = np.arange(len(rows))
            place = at - np.maximum.accumulate(np.where(start, at, 0))
            order, rows, last = order[place < self.k], rows[place < self.k], place[place < self.k] == self.k - 1
            self.lists[t] = rows, labels[order], scores[order]
            kth = scores[order][last]
            self.least[rows[last]] = np.where(np.isnan(kth), -np.inf, kth)


class _Cell:
    """One query block and the best candidates that the labels streamed so far give it."""

    def __init__(self, k: int, normalize: bool, drop_excluded: bool, digits: int, score):
        self.k, self.normalize, self.drop, self.digits, self.score = k, normalize, drop_excluded, digits, score
        self.parts = {0: ([], []), 1: ([], [])}   # side -> ids, and vectors or excluded labels
        self.ids, self.met, self.due, self.room = None, 0, FIRST_ROWS, np.zeros(0, np.float32)

    def add(self, side: int, batch) -> None:
        if side < 2:
            ids, other = self.parts[side]
            ids.append(np.asarray(batch.column("id")))
            other.append(_matrix(batch.column("vec")) if side == 0 else np.asarray(batch.column("other")))
        elif self.ready():
            self.meet_all(np.asarray(batch.column("id")), self.unit(_matrix(batch.column("vec"))))

    def unit(self, mat: np.ndarray) -> np.ndarray:
        return _normalize_rows(mat) if self.normalize else mat

    def ready(self) -> bool:
        """Whether there are queries; the first call closes their block."""
        if self.ids is None and self.parts[0][0]:
            self.ids, first = np.unique(np.concatenate(self.parts[0][0]), return_index=True)
            self.vec = self.unit(np.concatenate(self.parts[0][1])[first])  # a repeated query is asked once
            norms = np.sqrt((self.vec * self.vec).sum(axis=1)) if self.vec.size else np.zeros(len(self.ids))
            self.norms = norms
            self.narrow = self.vec.astype(np.float32) if (norms < _NARROW_NORM).all() else None
            none = np.zeros(0, np.int64)
            ex_q, ex_l = (np.concatenate(x) if x else none for x in self.parts[1])
            row = np.minimum(np.searchsorted(self.ids, ex_q), len(self.ids) - 1)
            asked = self.ids[row] == ex_q
            self.ex_row, self.ex_label = row[asked], ex_l[asked]
            self.parts = {0: ([], []), 1: ([], [])}
            self.best = _Best(len(self.ids), self.k)
        return self.ids is not None

    def meet_all(self, ids: np.ndarray, vec: np.ndarray) -> None:
        """Every query meets a batch of labels.  Only few are ranked to begin with: the pieces double
        until they are whole, and lists are merged each time that twice as many labels were met."""
        end = 0
        while end < len(ids):
            at, end = end, end + min(LABEL_ROWS, max(FIRST_ROWS, self.met))
            labels = _Labels(ids[at:end], vec[at:end])
            self.met += len(labels.ids)
            gone = labels.excluded(self.ex_row, self.ex_label) if self.drop else self.ex_row[:0]
            for s in range(0, len(self.ids), TILE_ROWS):
                rows = slice(s, min(s + TILE_ROWS, len(self.ids)))
                if not self.screen(rows, labels, gone):
                    self.rank(np.arange(rows.start, rows.stop), labels)
            if self.met >= self.due:
                self.best.merge()
                self.due = 2 * self.met

    def screen(self, rows, labels: _Labels, gone: np.ndarray, skip=None) -> bool:
        """Adds the labels that reach their query's k-th score; False (nothing added) where the
        lists are short, values are not finite or too many labels reach it.

        Dot products are screened in single precision with its error bound as slack, and those
        that pass are computed in double.  ``skip(rows, places)`` tells pairs to leave out."""
        least = self.best.least[rows]
        if not len(least) or not len(labels.ids) or least.min() == -np.inf or self.k <= 0:
            return False
        half = 0.51 * 10.0 ** -self.digits
        if self.score is None:
            if self.narrow is None or labels.narrow is None:
                return False
            raw = self.products(self.narrow[rows], labels.narrow)
            slack = (self.vec.shape[1] + 16) * 6e-8 * float(self.norms[rows].max()) * labels.norm
        else:
            raw = np.asarray(self.score(self.vec[rows], labels.vec), np.float64)
            if not np.isfinite(raw).all():
                return False
            slack = 0.0
        limit = least - half - slack - 1e-6 * np.abs(least)
        r, c = _reaching(raw, limit)
        if len(r) > 8 * len(least) * self.k + 4096:
            return False
        row = np.arange(rows.start, rows.stop)[r] if isinstance(rows, slice) else rows[r]
        if len(gone):
            keep = ~_among(row * len(labels.ids) + c, gone)
            r, c, row = r[keep], c[keep], row[keep]
        if skip is not None and len(row):
            keep = ~skip(row, c)
            r, c, row = r[keep], c[keep], row[keep]
        for at in range(0, len(row), 32_768):
            i, j = row[at:at + 32_768], c[at:at + 32_768]
            exact = raw[r[at:at + 32_768], j] if self.score is not None else np.einsum("ij,ij->i", self.vec[i], labels.vec[j])
            exact = np.rint(exact * 10.0 ** self.digits) / 10.0 ** self.digits
            ok = exact >= self.best.least[i]
            self.best.add(i[ok], labels.ids[j[ok]], exact[ok])
        return True

    def products(self, queries: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Dot products in single precision, in memory that the next call takes again."""
        n = len(queries) * len(labels)
        if len(self.room) < n:
            self.room = np.empty(n, np.float32)
        return np.matmul(queries, labels.T, out=self.room[:n].reshape(len(queries), len(labels)))

    def rank(self, rows: np.ndarray, labels: _Labels) -> None:
        """Adds each query's best ``k`` of a batch, in double and for any values."""
        sel = np.isin(self.ex_row, rows) if self.drop else np.zeros(len(self.ex_row), bool)
        out = block_topk(rows, self.vec[rows], labels.ids, labels.vec, self.k, self.ex_row[sel], self.ex_label[sel],
                         True, self.digits, self.score)
        self.best.add(*out[:3])

    def batches(self, step: int = 100_000):
        import pyarrow as pa
        if self.ids is None:
            return
        self.best.merge()
        flagged = not self.drop and len(self.ex_row)
        order = np.argsort(self.ex_row, kind="stable") if flagged else None
        for t, (rows, labels, scores) in enumerate(self.best.lists):
            flag = np.zeros(len(rows), bool)
            if flagged:
                a, b = np.searchsorted(self.ex_row, [t * TILE_ROWS, (t + 1) * TILE_ROWS], sorter=order)
                names, code = np.unique(np.r_[self.ex_label[order[a:b]], labels], return_inverse=True)
                gone = self.ex_row[order[a:b]] * len(names) + code[:b - a]
                pair, first = np.unique(rows.astype(np.int64) * len(names) + code[b - a:], return_index=True)
                flag[first] = np.isin(pair, gone)
            for at in range(0, len(rows), step):
                r, lab, score, fl = (x[at:at + step] for x in (rows, labels, scores, flag))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(self.ids[r], pa.int64()), pa.array(lab, pa.int64()), pa.array(score, pa.float64()), pa.array(fl, pa.bool_())],
                    names=["q_id", "label_id", "score", "excluded"])


def _streamer(*settings, make=_Cell):
    """Arrow function over rows sorted by (cell, side): query rows, excluded pairs, then labels."""
    def run(batches):
        number, cell = None, None
        for batch in batches:
            cells, sides = np.asarray(batch.column("cell")), np.asarray(batch.column("side"))
            if not len(cells):
                continue
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
            for at, end in zip(np.r_[0, cuts], np.r_[cuts, len(cells)]):
                if cells[at] != number:
                    if cell is not None:
                        yield from cell.batches()
                    number, cell = cells[at], make(*settings)
                cell.add(int(sides[at]), batch.slice(int(at), int(end - at)))
        if cell is not None:
            yield from cell.batches()
    return run


def _vector_type(*fields: T.StructField) -> str:
    """What vectors travel as: float where all sides are float (tasks compute in double anyway)."""
    float_ = all(isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType) for f in fields)
    return "array<float>" if float_ else "array<double>"


def plan_blocks(par: int, n_q: int, n_l: int, dim: int, block_bytes: int = DEFAULT_BLOCK_BYTES,
                min_rows: int = MIN_BLOCK_ROWS, k: int = 10, excluded_per_query: float = 0.0,
                held: float = 0.0) -> tuple[int, int]:
    """(query blocks, label blocks).

    A query block's vectors, excluded pairs and ``held`` bytes a query stay under ``block_bytes``; labels are streamed and
    need no bound.  When that gives fewer cells than ``par`` cores, the grid grows along the cheaper
    side: one more label block copies every query vector once more and adds k candidate rows per
    query to the merge; one more query block copies every label vector once more.  Blocks are never
    cut below ``min_rows`` for that."""
    rows = max(1, int(block_bytes // (8 * max(dim, 1) + 16 * excluded_per_query + held)))
    n_qb, n_lb = max(1, math.ceil(n_q / rows)), 1
    if n_qb < par:
        if n_q * (4 * dim + 24 * k) <= n_l * 4 * dim:
            n_lb = max(1, min(math.ceil(par / n_qb), math.ceil(n_l / min_rows)))
        else:
            n_qb = max(n_qb, min(par, math.ceil(n_q / min_rows)))
    return n_qb, n_lb


def held_bytes(k: int, dim: int) -> float:
    """Bytes that a task holds of a query beside its vector: the vector in single precision, its
    list and a quarter of a list not merged yet."""
    return 4.0 * dim + 28.0 * k


def candidates(queries: DataFrame, labels: DataFrame, *, q_col: str = "q_id", l_col: str = "label_id",
               vec_col: str = "embedding", k: int = 10, exclude: DataFrame | None = None,
               drop_excluded: bool = True, normalize: bool = True, digits: int = 6,
               block_bytes: int = CELL_BYTES, blocks: tuple[int, int] | None = None, score=None) -> DataFrame:
    """Per (query block, label block) cell: each query's best ``k`` labels (unranked).

    Excluded pairs travel to the one cell that holds both ids (no replication, no anti-join
    shuffle).  ``blocks`` asks for at least that many blocks; query blocks still respect
    ``block_bytes``.  Rows without an id or a vector have no neighbours and are none."""
    spark = queries.sparkSession

    width = _vector_type(queries.schema[vec_col], labels.schema[vec_col])

    def side(df, number, id_col):
        some = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
        return some.select(F.lit(number).alias("side"), F.col(id_col).cast("long").alias("id"),
                           F.lit(0).cast("long").alias("other"), F.col(vec_col).cast(width).alias("vec"))

    q, lab = side(queries, 0, q_col), side(labels, 2, l_col)
    ex = None
    if exclude is not None:
        ex = exclude.select(F.lit(1).alias("side"), F.col("q_id").cast("long").alias("id"),
                            F.col("label_id").cast("long").alias("other"), F.lit(None).cast(width).alias("vec"))
        ex = ex.where("id is not null and other is not null")
    # one job for all sizes: (queries, excluded pairs, labels, widest vector)
    sized = q.select("side", F.size("vec").alias("d")).unionByName(lab.select("side", F.size("vec").alias("d")))
    if ex is not None:
        sized = sized.unionByName(ex.select("side", F.lit(0).alias("d")))
    n_q, n_x, n_l, dim = (int(x or 0) for x in sized.agg(*[F.sum((F.col("side") == i).cast("long")) for i in range(3)],
                                                          F.max("d")).first())
    par = int(spark.sparkContext.defaultParallelism)
    n_qb, n_lb = plan_blocks(par if blocks is None else 1, n_q, n_l, dim, block_bytes, k=k,
                             excluded_per_query=n_x / max(n_q, 1), held=held_bytes(min(k, n_l), dim))
    if blocks is not None:
        n_qb, n_lb = max(n_qb, blocks[0]), blocks[1]
    qb, lb = (lambda c: F.pmod(F.xxhash64(c), F.lit(n_qb))), (lambda c: F.pmod(F.xxhash64(c), F.lit(n_lb)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    rows = (q.withColumn("qb", qb("id")).withColumn("lb", every(n_lb))
            .unionByName(lab.withColumn("lb", lb("id")).withColumn("qb", every(n_qb))))
    if ex is not None:
        rows = rows.unionByName(ex.withColumn("qb", qb("id")).withColumn("lb", lb("other")))
    # the cell's number is its task's number: every task has its share of cells
    tasks = min(n_qb * n_lb, MAX_TASKS)
    rows = rows.select((F.col("qb") * n_lb + F.col("lb")).alias("cell"), "side", "id", "other", "vec")
    return (rows.repartitionById(tasks, (F.col("cell") % tasks).cast("int")).sortWithinPartitions("cell", "side")
            .mapInArrow(_streamer(k, normalize, drop_excluded, digits, score), CAND_SCHEMA))


def cell_topk(queries: DataFrame, labels: DataFrame, exclude: DataFrame, cell_col: str, k: int,
              normalize: bool = True, digits: int = 6) -> DataFrame:
    """Each query's best ``k`` labels of its own cell (unranked): ``queries`` (cell, q_id, embedding),
    ``labels`` (cell, label_id, embedding), ``exclude`` (cell, q_id, label_id).

    A cell is a bounded group such as a training batch; its queries are held in one task."""
    width = _vector_type(queries.schema["embedding"], labels.schema["embedding"])
    vec = F.col("embedding").cast(width)
    zero, none = F.lit(0).cast("long").alias("other"), F.lit(None).cast(width).alias("vec")
    cell = F.col(cell_col).cast("long").alias("cell")
    rows = (queries.select(cell, F.lit(0).alias("side"), F.col("q_id").cast("long").alias("id"), zero, vec.alias("vec"))
            .unionByName(labels.select(cell, F.lit(2).alias("side"), F.col("label_id").cast("long").alias("id"), zero, vec.alias("vec")))
            .where("vec is not null")
            .unionByName(exclude.select(cell, F.lit(1).alias("side"), F.col("q_id").cast("long").alias("id"),
                                        F.col("label_id").cast("long").alias("other"), none)))
    return (rows.repartition("cell").sortWithinPartitions("cell", "side")
            .mapInArrow(_streamer(k, normalize, True, digits, None), CAND_SCHEMA))


def _window():
    return Window.partitionBy("q_id").orderBy(F.col("score").desc(), F.col("label_id").asc())


def rank_within_query(cand: DataFrame, k: int, rank_col: str = "rank") -> DataFrame:
    """row_number by (score desc, label_id asc) per query, kept to ``k`` (WindowGroupLimit)."""
    return (cand.withColumn(rank_col, F.row_number().over(_window()).cast("long"))
                .where(F.col(rank_col) <= F.lit(k)))


def ova_topk(queries: DataFrame, labels: DataFrame, k: int = 10, *, q_col: str = "q_id",
             l_col: str = "label_id", vec_col: str = "embedding", normalize: bool = True,
             exclude: DataFrame | None = None, exclude_mode: str = "before", digits: int = 6,
             block_bytes: int = CELL_BYTES, blocks: tuple[int, int] | None = None, score=None) -> DataFrame:
    """Top-``k`` labels per query: (q_id, label_id, score, rank).

    ``score(query_matrix, label_matrix)`` replaces the dot product (F02); it runs in the workers
    on NumPy blocks and returns a (queries x labels) matrix, higher is better.

    ``exclude`` (q_id, label_id) pairs are removed either ``before`` ranking (they can never
    be selected, so each list is the exact top-k of the remaining labels) or ``after`` it
    (reference parity: the top-k is taken first, excluded entries are dropped, lists shrink
    and ranks are re-densified with a second window over the same partitioning)."""
    if exclude_mode not in ("before", "after"):
        raise ValueError(f"exclude_mode must be 'before' or 'after', not {exclude_mode!r}")
    drop = exclude is None or exclude_mode == "before"
    cand = candidates(queries, labels, q_col=q_col, l_col=l_col, vec_col=vec_col, k=k, exclude=exclude,
                      drop_excluded=drop, normalize=normalize, digits=digits, block_bytes=block_bytes,
                      blocks=blocks, score=score)
    top = rank_within_query(cand, k)
    if drop:
        return top.drop("excluded")
    kept = top.where(~F.col("excluded")).drop("excluded", "rank")
    return kept.withColumn("rank", F.row_number().over(_window()).cast("long"))


def two_phase_topk(queries: DataFrame, labels: DataFrame, k: int = 10, n_label_blocks: int = 4,
                   **kw) -> DataFrame:
    """T01 with an explicit label-block count: partial top-k per block, then the merge."""
    par = int(queries.sparkSession.sparkContext.defaultParallelism)
    n_qb = max(1, math.ceil(par / n_label_blocks))
    return ova_topk(queries, labels, k, blocks=(n_qb, n_label_blocks), **kw)


def similar_labels(new: DataFrame, orig: DataFrame, topk: int = 10, threshold: float = 0.98,
                   allow_self: bool = False, id_col: str = "label_id", vec_col: str = "embedding") -> DataFrame:
    """Neighbours of each ``new`` label among ``orig`` labels with mask/bucket.

    Self is excluded by id (not by assuming rank 1 is self) unless ``allow_self``.
    Output: (label_id, neighbor_id, sim, rank, mask, bucket).
    """
    from xmcforge.functions.vectors import similarity_bucket, similarity_mask
    q = new.select(F.col(id_col).alias("q_id"), F.col(vec_col).alias("embedding"))
    lab = orig.select(F.col(id_col).alias("label_id"), F.col(vec_col).alias("embedding"))
    if allow_self:
        top = ova_topk(q, lab, topk)
    else:
        selfs = new.select(F.col(id_col).alias("q_id"), F.col(id_col).alias("label_id"))
        top = ova_topk(q, lab, topk, exclude=selfs, exclude_mode="before")
    return top.select(F.col("q_id").alias("label_id"), F.col("label_id").alias("neighbor_id"),
                      F.col("score").alias("sim"), "rank",
                      similarity_mask("score", threshold).alias("mask"),
                      similarity_bucket("score").alias("bucket"))
