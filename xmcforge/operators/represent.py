"""Vector representations.

Vector means are dense partial sums: each task adds its rows' vectors per key in NumPy, so a key
with a third of all rows leaves a task as one row, and a second pass over rows sorted by key adds
the partial sums.  A row is one vector throughout, never one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmcforge.functions import vectors as V
from xmcforge.plans.ranking import dist_rank


SUM_BYTES = 64 << 20  # partial sums that a task holds before it hands them on


def _dense(col, np, pc):
    """(rows x width) float64 matrix of an Arrow list column without nulls; null components are 0."""
    arr = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    ends = np.asarray(arr.offsets)
    if len(arr) and (np.diff(ends) != ends[1] - ends[0]).any():
        raise ValueError("vectors of one table must all have the same width")
    flat = arr.flatten()
    if flat.null_count:
        flat = pc.fill_null(flat, 0)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(arr), -1)


def _adder(keys: Sequence[str], schema: T.StructType, complete: bool):
    """Arrow function that adds the rows (keys, s, w) of equal keys; with ``complete`` the rows come
    sorted by key, and all keys but the last of a batch are finished."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        slots, types = {}, None
        sums, weights = np.zeros((0, 0)), np.zeros(0)

        def out(names):
            rows = np.array([slots[k] for k in names], np.int64)
            body = sums[rows]
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int64) * body.shape[1])
            vec = pa.ListArray.from_arrays(ends.cast(pa.int32()), pa.array(body.reshape(-1)))
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in names], t) for i, t in enumerate(types)),
                                               vec, pa.array(weights[rows])], names=schema.names)

        def flush(names):
            step = max(1, SUM_BYTES // (8 * max(1, sums.shape[1])) // 4)
            for at in range(0, len(names), step):
                yield out(names[at:at + step])

        for rb in batches:
            if not rb.num_rows:
                continue
            vec = _dense(rb.column("s"), np, pc)
            w = pc.fill_null(rb.column("w"), 0.0).to_numpy(zero_copy_only=False)
            code = np.zeros(rb.num_rows, np.int64)
            for k in keys:
                coded = rb.column(k).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(coded.dictionary) + np.asarray(coded.indices), return_inverse=True)[1].reshape(-1)
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
            code = code.reshape(-1)
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(first)))
            part, part_w = np.add.reduceat(vec[order], starts, axis=0), np.add.reduceat(w[order], starts)
            types = [rb.column(k).type for k in keys]
            names = list(zip(*(rb.column(k).take(pa.array(first)).to_pylist() for k in keys)))
            new = [n for n in names if n not in slots]
            if slots and vec.shape[1] != sums.shape[1]:
                raise ValueError("vectors of one table must all have the same width")
            if new:
                at = len(slots)
                slots.update((n, at + i) for i, n in enumerate(new))
                if at + len(new) > len(sums):
                    room = max(2 * len(sums), at + len(new), 64)
                    grown, grown_w = np.zeros((room, vec.shape[1])), np.zeros(room)
                    if at:
                        grown[:at], grown_w[:at] = sums[:at], weights[:at]
                    sums, weights = grown, grown_w
                sums[at:at + len(new)], weights[at:at + len(new)] = 0.0, 0.0
            rows = np.array([slots[n] for n in names], np.int64)  # each key once
            sums[rows] += part
            weights[rows] += part_w
            if complete:
                last = tuple(rb.column(k)[rb.num_rows - 1].as_py() for k in keys)
                done = [n for n in slots if n != last]
                if len(done) * sums.shape[1] * 8 > SUM_BYTES // 4:
                    yield from flush(done)
                    keep, keep_w = sums[slots[last]].copy(), weights[slots[last]]
                    slots, sums, weights = {last: 0}, np.zeros((64, len(keep))), np.zeros(64)
                    sums[0], weights[0] = keep, keep_w
            elif len(slots) * sums.shape[1] * 8 > SUM_BYTES:
                yield from flush(list(slots))
                slots, sums, weights = {}, np.zeros((0, 0)), np.zeros(0)
        if slots:
            yield from flush(list(slots))
    return run


def vector_sums(df: DataFrame, keys: Sequence[str], vec_col: str = "embedding", weight: str | None = None) -> DataFrame:
    """(keys, s = sum(w * x) as array<double>, w = sum(w)) of each key.

    Rows that are shuffled: one per key and task (a task whose keys' sums exceed ``SUM_BYTES`` hands
    them on and starts again).  Null vectors do not count, null weights and components are 0, null
    keys are a key; vectors must have one width."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    vec = F.col(vec_col)
    rows = df.where(vec.isNotNull()).select(*keys, (F.transform(vec, lambda x: x.cast("double") * w) if weight else vec).alias("s"), w.alias("w"))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("w", T.DoubleType())])
    parts = rows.mapInArrow(_adder(keys, schema, False), schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_adder(keys, schema, True), schema)


def vector_mean(df: DataFrame, keys: Sequence[str], vec_col: str = "embedding", weight: str | None = None,
                eps: float | None = None) -> DataFrame:
    """Mean vector per key: sum(w x) / sum(w) (denominator clamped at ``eps`` when given)."""
    den = F.greatest(F.col("w"), F.lit(eps)) if eps is not None else F.col("w")
    return vector_sums(df, keys, vec_col, weight).select(*keys, F.transform("s", lambda x: x / den).alias("embedding"))


def label_centroids(xy: DataFrame, doc_vecs: DataFrame, labels: DataFrame | None = None, dim: int | None = None,
                    doc_col: str = "doc_id") -> DataFrame:
    """Label centroid = mean embedding of its documents; with ``labels``, labels without
    documents get the zero vector of ``dim`` components (default: the width of the document vectors).
    (label_id, embedding array<double>)"""
    joined = xy.select(doc_col, "label_id").join(doc_vecs.select(doc_col, "embedding"), doc_col)
    cent = vector_mean(joined, ["label_id"])
    if labels is None:
        return cent
    if dim is None:
        some = doc_vecs.where("embedding is not null").select(F.size("embedding").alias("d")).head()
        dim = some.d if some else 0
    zero = F.array_repeat(F.lit(0.0), int(dim))
    return (labels.select("label_id").distinct().join(cent, "label_id", "left")
                  .select("label_id", F.coalesce("embedding", zero).alias("embedding")))


def cluster_centroids(items: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """Mean vector of each cluster's members."""
    return vector_mean(items, [cluster_col])


def masked_mean_pool(tokens: DataFrame, seq_col: str = "seq_id", mask_col: str = "mask",
                     eps: float = 1e-9) -> DataFrame:
    """sum(x * mask) / max(sum(mask), eps) per sequence (an all-zero mask gives zeros)."""
    return vector_mean(tokens, [seq_col], weight=mask_col, eps=eps)


def last_token_pool(tokens: DataFrame, seq_col: str = "seq_id", pos_col: str = "pos",
                    mask_col: str = "mask") -> DataFrame:
    """Vector at the last position with mask 1; with an all-zero mask, the final position.

    ``max_by`` over (mask, pos) gives exactly that order: any mask-1 row beats all mask-0 rows."""
    return tokens.groupBy(seq_col).agg(
        F.max_by("embedding", F.struct(F.col(mask_col), F.col(pos_col))).alias("embedding"))


def multimodal_mean_pool(img_slots: DataFrame, tokens: DataFrame, key: str = "seq_id", eps: float = 1e-9) -> DataFrame:
    """Image slots and text token states pooled together under their masks."""
    a = img_slots.select(F.col("owner_id").alias(key), "embedding", "mask")
    b = tokens.select(key, "embedding", "mask")
    return vector_mean(a.unionByName(b), [key], weight="mask", eps=eps)


def embedding_fallback(raw: DataFrame, enriched: DataFrame, id_col: str = "label_id") -> DataFrame:
    """The enriched vector where one exists for the id, else the raw one (null-safe)."""
    e = enriched.select(id_col, F.col("embedding").alias("_enr"))
    return raw.join(e, id_col, "left").select(
        id_col, F.when(F.col("_enr").isNotNull(), F.col("_enr")).otherwise(F.col("embedding")).alias("embedding"),
        F.col("_enr").isNotNull().alias("enriched"))


def prototype_fusion(sources: DataFrame, id_col: str = "label_id") -> DataFrame:
    """Mean of the available source vectors per id (label vector, cluster vector,
    centroid), then L2 normalised.  A single source gives that source, normalised."""
    mean = vector_mean(sources, [id_col])
    return mean.select(id_col, V.l2_normalize("embedding").alias("embedding"))


def gather(keys: DataFrame, table: DataFrame, key_col: str, broadcast_rows: int | None = None) -> DataFrame:
    """Gather rows of ``table`` by key (left join, null-safe for ids without a row).

    ``broadcast_rows``: broadcast ``table`` only when its counted size is at most this."""
    t = table
    if broadcast_rows is not None and table.count() <= broadcast_rows:
        t = F.broadcast(table)
    return keys.join(t, key_col, "left")


def head_tail_split(freq: DataFrame, clusters: DataFrame, n_head: int) -> DataFrame:
    """The ``n_head`` most frequent labels get ids 0..n_head-1 in ascending frequency
    order (ties by label id); every other label maps to n_head + its cluster id."""
    ranked = dist_rank(freq.select("label_id", "freq"), [F.col("freq").desc(), F.col("label_id").desc()],
                       rank_col="_r")
    head = ranked.where(F.col("_r") <= n_head).select("label_id", (F.lit(n_head) - F.col("_r")).alias("new_id"))
    tail = (ranked.where(F.col("_r") > n_head).select("label_id")
                  .join(clusters.select("label_id", "cluster_id"), "label_id", "left")
                  .select("label_id", (F.lit(n_head) + F.col("cluster_id")).alias("new_id")))
    return head.unionByName(tail).select("label_id", F.col("new_id").cast("long"))


def update_clusters(freq: DataFrame, labels: DataFrame, n_head: int, depth: int, seed: int = 0,
                    rounds: int = 1) -> DataFrame:
    """W07 with C04: (label_id, new_id) where the ``n_head`` most frequent labels keep an id of
    their own and only the other ones are clustered (2^depth balanced clusters), numbered after."""
    from xmcforge.operators.cluster import balanced_clusters
    ranked = dist_rank(freq.select("label_id", "freq"), [F.col("freq").desc(), F.col("label_id").desc()], rank_col="_r")
    tail = labels.select("label_id", "embedding").join(ranked.where(F.col("_r") > n_head).select("label_id"), "label_id")
    clusters = balanced_clusters(tail.withColumnRenamed("label_id", "item_id"), depth=depth, seed=seed, rounds=rounds)
    head = ranked.where(F.col("_r") <= n_head).select("label_id", (F.lit(n_head) - F.col("_r")).cast("long").alias("new_id"))
    return head.unionByName(clusters.select(F.col("item_id").alias("label_id"),
                                            (F.lit(n_head) + F.col("cluster_id")).cast("long").alias("new_id")))


def latest_by_key(obs: DataFrame, key: str = "key", order: Sequence[str] = ("step", "id"),
                  value_cols: Sequence[str] = ("value",)) -> DataFrame:
    """C11: the last observation per key in (step, id) order (``max_by``, order-free, so it is
    also the streaming aggregate)."""
    o = F.struct(*[F.col(c) for c in order])
    return obs.groupBy(key).agg(*[F.max_by(c, o).alias(c) for c in value_cols],
                                *[F.max(o)[c].alias(c) for c in order])


def ema(obs: DataFrame, w: float = 0.95, key: str = "key", order: Sequence[str] = ("step", "id"),
        value_col: str = "value", init: DataFrame | None = None) -> DataFrame:
    """C <- w c + (1 - w) x over each key's observations in ``order``; closed form
    c_n = w^n c_0 + sum_i (1 - w) w^(n - i) x_i.  Ranks per key come from the distributed
    rank, so a key with most of the rows still spreads over many tasks.  ``init`` (key, c0)
    defaults to 0."""
    terms = _ema_weights(obs.select(key, *order, value_col), w, key, order)
    out = terms.groupBy(key).agg(F.sum(F.col("_weight") * F.col(value_col)).alias("s"), F.max("n").alias("n"))
    if init is not None:
        start = init.select(F.col(key).alias("_k"), "c0")
        out = out.join(start, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k").fillna(0.0, ["c0"])
        out = out.withColumn("s", F.col("s") + F.pow(F.lit(w), F.col("n")) * F.col("c0"))
    return out.select(key, F.col("s").alias("ema"), F.col("n").cast("long").alias("n_obs"))


def _ema_weights(obs: DataFrame, w: float, key: str, order: Sequence[str]) -> DataFrame:
    """``obs`` with each row's weight (1 - w) w^(n - i) in its key's mean (a null key is a key)."""
    r = dist_rank(obs, list(order), rank_col="i", partition_by=[key])
    n = r.groupBy(F.col(key).alias("_k")).agg(F.max("i").alias("n"))
    return (r.join(n, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
             .withColumn("_weight", F.lit(1.0 - w) * F.pow(F.lit(w), F.col("n") - F.col("i"))))


def ema_vectors(obs: DataFrame, w: float = 0.95, key: str = "key", order: Sequence[str] = ("step", "id"),
                vec_col: str = "embedding") -> DataFrame:
    """C12 on vectors: (key, embedding) with the running mean of each key's vectors in ``order``
    (unique within a key), from the zero vector.  Only keys and order columns go through the rank."""
    weights = _ema_weights(obs.select(key, *order), w, key, order)
    names = [key, *order]
    weights = weights.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(names)], "_weight")
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_j{i}"))
    weighted = obs.select(*names, vec_col).join(weights, same).select(key, vec_col, "_weight")
    return vector_sums(weighted, [key], vec_col, weight="_weight").select(key, F.col("s").alias("embedding"))


def linear_project(df: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None,
                   vec_col: str = "embedding", out: str = "projected") -> DataFrame:
    """V -> W v (+ b), one matrix product per Arrow batch.  The matrix (out_dim x in_dim,
    sized by the caller, not by the data) travels with the function, not as plan literals.
    Null vectors project to null; other columns pass through."""
    import pyarrow as pa
    w = np.asarray(weights, np.float64)
    b = np.zeros(len(w)) if bias is None else np.asarray(bias, np.float64)
    kept = df.drop(out)
    schema = T.StructType(list(kept.schema.fields) + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    names = kept.columns

    def run(batches):
        for rb in batches:
            vec = rb.column(names.index(vec_col))
            real = vec.drop_null()
            x = real.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            if len(x) != len(real) * w.shape[1]:
                raise ValueError(f"vectors must have {w.shape[1]} components")
            y = x.reshape(len(real), w.shape[1]) @ w.T + b
            sizes = np.where(np.asarray(vec.is_null()), 0, len(w))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            proj = pa.ListArray.from_arrays(ends, pa.array(y.reshape(-1)), mask=vec.is_null())
            yield pa.RecordBatch.from_arrays([*rb.columns, proj], names=[*names, out])

    return kept.mapInArrow(run, schema)


def gram_matrix(df: DataFrame, vec_col: str = "embedding") -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of x x^T, sum of x, rows) over all vectors: each task adds one product per Arrow batch, and
    one row per component carries the sums to their merge, so the driver sees dim + 1 rows."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        total, n = None, 0
        for rb in batches:
            vec = rb.column("s").drop_null()
            if not len(vec):
                continue
            m = _dense(vec, np, pc)
            # the sum of x is one more row of the product: a component that is always 1
            m = np.concatenate([m, np.ones((len(m), 1))], axis=1)
            total = m.T @ m if total is None else total + m.T @ m
            n += len(m)
        if total is not None:
            ends = pa.array((np.arange(len(total) + 1) * len(total)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.ListArray.from_arrays(ends, pa.array(total.reshape(-1)))], names=["i", "s"])

    parts = df.select(F.col(vec_col).alias("s")).mapInArrow(run, "i long, s array<double>")
    rows = {r.i: r.s for r in vector_sums(parts, ["i"], "s").collect()}
    if not rows:
        return np.zeros((0, 0)), np.zeros(0), 0
    full = np.array([rows[i] for i in range(len(rows))])
    return full[:-1, :-1], full[-1, :-1], int(round(full[-1, -1]))


def pca_fit(df: DataFrame, k: int, vec_col: str = "embedding", center: bool = True) -> np.ndarray:
    """The ``k`` principal components (k x dim) by falling variance, of the covariance matrix or, with
    ``center=False``, of the plain second moments.  A component's largest entry (the first of equal
    ones) is positive.  The reference applies components without centring."""
    gram, total, n = gram_matrix(df, vec_col)
    if not n:
        return np.zeros((0, 0))
    cov = gram / n - np.outer(total, total) / n ** 2 if center else gram / n
    values, vectors = np.linalg.eigh(cov)
    comps = vectors[:, np.argsort(-values, kind="stable")[:k]].T
    lead = np.abs(comps).round(9).argmax(axis=1)
    return comps * np.sign(comps[np.arange(len(comps)), lead])[:, None]


# --------------------------------------------------------------------- encoder hook
EncoderFn = Callable[[pd.Series], np.ndarray]
ENCODE_CHARS = 1 << 20  # characters that the default encoder tokenizes at once


def hashed_bag_encoder(dim: int = 64) -> EncoderFn:
    """Default offline encoder: md5-hashed bag of lower-cased tokens, L2 normalised.

    A batch is encoded in slices of about ``ENCODE_CHARS`` characters: tokens are Python strings and take
    many times their text's size."""
    import hashlib
    import re
    tok = re.compile(r"[^\W_]+", re.UNICODE)

    def enc(texts: pd.Series) -> np.ndarray:
        plain = texts.fillna("").to_numpy()
        part = np.cumsum([len(str(t)) for t in plain], dtype=np.int64) // ENCODE_CHARS if len(plain) else np.zeros(0, np.int64)
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(plain)]
        return np.concatenate([np.zeros((0, dim)), *(some(plain[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)])

    def some(texts: np.ndarray) -> np.ndarray:
        # one flat token list per slice; each distinct token is hashed once
        lists = [tok.findall(str(t).lower()) for t in texts]
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        codes, words = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
        bucket = np.array([int(hashlib.md5(w.encode("utf-8")).hexdigest()[:13], 16) % dim for w in words], dtype=np.int64)
        flat = rows * dim + bucket[codes] if len(codes) else np.zeros(0, np.int64)
        out = np.bincount(flat, minlength=len(lists) * dim).astype(np.float64).reshape(len(lists), dim)
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(n > 0, out / np.where(n > 0, n, 1.0), 0.0)
    return enc


def encode_table(df: DataFrame, encoder: EncoderFn, id_col: str = "row_id", text_col: str = "text",
                 dim: int = 64) -> DataFrame:
    """Run a pluggable batch encoder over a table with ``mapInPandas``; output
    (id, embedding array<float>) of fixed width."""
    schema = T.StructType([T.StructField(id_col, T.LongType()),
                           T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = encoder(b[text_col])
            if m.shape[1] != dim:
                raise ValueError(f"encoder returned width {m.shape[1]}, expected {dim}")
            yield pd.DataFrame({id_col: b[id_col].astype("int64").to_numpy(),
                                "embedding": list(m.astype(np.float32))})
    return df.select(F.col(id_col).cast("long"), text_col).mapInPandas(run, schema)


def hashed_bag_native(df: DataFrame, dim: int = 64, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """The default encoder as native expressions (same tokens, same md5 buckets), so it has a
    SQL oracle and skips Python entirely."""
    from xmcforge.functions.text import tokens
    from xmcforge.operators.sampling import md5_int
    from xmcforge.plans.partitioning import spread_if_small
    t = spread_if_small(df.select(id_col, text_col), key=id_col).select(id_col, F.explode(tokens(text_col)).alias("tok"))
    counts = (t.select(id_col, (md5_int("tok") % F.lit(dim)).alias("dim"))
               .groupBy(id_col, "dim").agg(F.count(F.lit(1)).cast("double").alias("c")))
    n = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    return counts.join(n, id_col).select(id_col, "dim", (F.col("c") / F.col("n")).alias("value"))
