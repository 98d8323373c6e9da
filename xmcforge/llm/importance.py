"""Importance resampling towards a target distribution of hashed n-grams.

The rows of a raw table are scored by how much more often their n-grams' hash buckets occur in a
target table (array look-ups, no join); a Gumbel variate seeded by the id turns the k highest scores
into a weighted draw without replacement.  The k-th key is found by quickselect over the scored
table: some random pivot keys, one pass of exact three-way counts, and the range between two pivots
that holds the k-th key goes on.  Only the winners are sorted and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xmcforge.llm.common import SLICE_BYTES, slices, table, words_of, written
from xmcforge.llm.registry import query
from xmcforge.plans.ranking import dist_rank

BUCKETS = 10_000
PIVOTS = 16


def alnum_words(text):
    """(words, offsets per row) of an Arrow string array: A-Z lower-cased, split at every ASCII
    character that is neither a digit nor a letter; other characters belong to words; nulls have none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    text = pc.fill_null(text, "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    # one table look-up a byte; bytes from 0x80 on (all parts of other characters) stay
    to = np.arange(256, dtype=np.uint8)
    to[:128] = [c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128)]
    valid, ends, data = text.buffers()
    plain = to[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return words_of(pa.Array.from_buffers(text.type, len(text), [valid, ends, pa.py_buffer(plain)], offset=text.offset))


def feature_buckets(text, longest: int, buckets: int):
    """(bucket of every feature, offsets per row, words per row): the features of a row are its runs
    of 1 to ``longest`` words joined by a space; the bucket is the crc32 of the run's bytes."""
    import zlib
    import numpy as np
    flat, offsets = alnum_words(text)
    coded = flat.dictionary_encode()
    names = [w.encode() for w in coded.dictionary.to_pylist()]
    code = np.asarray(coded.indices, dtype=np.int64)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = counts[owner] - (np.arange(len(code)) - offsets[:-1][owner])  # words from here to the row's end
    crc = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    rows, found = [owner], [crc[code] % buckets if len(code) else code]
    runs = code
    for size in range(2, longest + 1):  # runs one word longer, each distinct one hashed once
        at = np.flatnonzero(left >= size)
        pairs, runs_of = np.unique(np.stack([runs[at], code[at + size - 1]], axis=1), axis=0, return_inverse=True)
        crc = np.array([zlib.crc32(b" " + names[b], int(crc[a])) for a, b in pairs.tolist()], np.int64)
        runs = np.full(len(code), -1)
        runs[at] = runs_of.reshape(-1)
        rows.append(owner[at])
        found.append(crc[runs[at]] % buckets if len(at) else at)
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable")
    return found[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(counts)))]).astype(np.int64), counts


def bucket_counts(df: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """How many features of all rows fall into each bucket (a list of ``buckets`` numbers)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                total += np.bincount(feature_buckets(part.column("text"), longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = [0] * buckets
    texts = df.select(df[f"`{text_col}`"].alias("text"))
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the raw table."""
    import math
    b, s_all, t_all = float(len(raw)), float(sum(raw)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(raw, target)]


def scored(df: DataFrame, gains: list[int], seed: int, longest: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_features, weight, score): weight is the floored mean gain of a row's features
    (0 without any), score adds a Gumbel variate drawn from sha256 of ``seed:id`` (null for a null id)."""
    def run(batches):
        import hashlib
        import math
        import numpy as np
        import pyarrow as pa
        gain = np.array(gains, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found, offsets, words = feature_buckets(part.column("text"), longest, len(gain))
                total = np.concatenate([[0], np.cumsum(gain[found])])
                n = np.diff(offsets)
                weight = (total[offsets[1:]] - total[offsets[:-1]]) // np.maximum(n, 1)
                score = []
                for i, w in zip(part.column("id").to_pylist(), weight.tolist()):
                    if i is None:
                        score.append(None)
                        continue
                    h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
                    score.append(w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words), pa.array(n), pa.array(weight), pa.array(score, pa.int64())],
                                                 names=["id", "n_words", "n_features", "weight", "score"])

    docs = df.select(df[f"`{id_col}`"].cast("long").alias("id"), df[f"`{text_col}`"].alias("text"))
    return docs.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def _before(score, i) -> Column:
    """Rows that come before the key (score, i): higher scores first, ties to the smaller id."""
    return (F.col("score") > F.lit(score)) | ((F.col("score") == F.lit(score)) & (F.col("id") < F.lit(i)))


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS, seed: int = 0) -> tuple[int, int]:
    """The key (score, id) of the k-th row of ``keys`` (a written table of at least k rows, no nulls)
    by falling score, then id.

    Each round draws ``pivots`` rows by hash from the open range, counts the rows before and at each
    of them exactly, and keeps the range between two neighbours.  A round shrinks the range to
    1 / pivots of its rows on average and takes its own pivots out, so the rounds end with the range."""
    low = high = None  # keys outside the open range, on both sides
    while True:
        inside = keys
        if low is not None:
            inside = inside.where(~_before(*low) & ((F.col("score") != low[0]) | (F.col("id") != low[1])))
        if high is not None:
            inside = inside.where(_before(*high))
        seed += 1
        # distinct keys by the smallest hashes: a top-n, not a sort
        drawn = inside.select("score", "id", F.xxhash64("score", "id", F.lit(seed)).alias("_h")).orderBy("_h").limit(pivots).collect()
        chosen = sorted({(r.score, r.id) for r in drawn}, key=lambda p: (-p[0], p[1]))
        counts = keys.agg(*[F.count(F.when(_before(*p), 1)).alias(f"b{n}") for n, p in enumerate(chosen)],
                          *[F.count(F.when((F.col("score") == p[0]) & (F.col("id") == p[1]), 1)).alias(f"e{n}") for n, p in enumerate(chosen)]).first()
        for n, p in enumerate(chosen):
            if counts[f"b{n}"] >= k:
                high = p
                break
            if counts[f"b{n}"] + counts[f"e{n}"] >= k:
                return p
            low = p


def resample(df: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, longest: int = 1,
             buckets: int = BUCKETS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``df``: the rows of at least
    ``min_words`` words compete, and the floor of ``percent`` % of their number are ranked from 1 by
    falling score, ties to the smaller id; all other ranks are null.

    Null texts have no features (weight 0).  Rows with a null id have no score and do not compete.
    Rows that repeat an id are rows of their own; equal keys are ranked in any order, so a tie at the
    end of the draw between them takes as many as fit.  Empty tables are fine on both sides.  Only
    ``id_col`` and ``text_col`` of ``df`` and ``text_col`` of ``target`` are read, whole texts of all
    rows."""
    gains = bucket_gains(bucket_counts(df, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets))
    rows = written(scored(df, gains, seed, longest, text_col, id_col), "scores")
    eligible = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    keys = rows.where(eligible).select("score", "id")
    k = keys.count() * percent // 100
    final = lambda d, rank: d.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
    none = F.lit(None).cast("long")
    if k == 0:
        return final(rows, none)
    score, i = kth_key(keys, k)
    wins = eligible & (_before(score, i) | ((F.col("score") == score) & (F.col("id") == i)))
    ranked = written(dist_rank(rows.where(wins), [F.col("score").desc(), F.col("id").asc()]), "winners")
    return (final(ranked, F.when(F.col("rank") <= k, F.col("rank")))
            .unionByName(final(rows.where(~F.coalesce(wins, F.lit(False))), none)))


@query("op12_importance")
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's distribution of words."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
