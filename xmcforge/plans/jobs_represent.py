"""Representation jobs (SURVEY 2.4 A04/A05, 2.2 P09/P11-P13/P17/P18, 2.3 J08, 2.5 W07,
2.8 C11-C13, 2.10 F01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from xmcforge.operators import assets as AS
from xmcforge.operators import represent as RP
from xmcforge.operators import sparse as SP
from xmcforge.plans import fixtures as fx
from xmcforge.plans.jobs_sampling import FUSED_VIEW_SQL, _mean_sql, fused_labels
from xmcforge.plans.registry import job

DIM = 64
EMA_W = 0.95        # reference EMA weight for centroids (fixed value)
N_HEAD = 500
NUM_IMGS = 3
PROJ_OUT = 4


def proj_matrix(out_dim: int = PROJ_OUT, in_dim: int = DIM) -> list[list[float]]:
    """A deterministic small projection: W[i][j] = (((i + 1) * (j + 1)) % 7 - 3) / 10."""
    return [[(((i + 1) * (j + 1)) % 7 - 3) / 10.0 for j in range(in_dim)] for i in range(out_dim)]


def _long(df, key, vec="embedding", digits=6):
    return df.select(key, F.posexplode(vec).alias("p", "x")).select(
        key, (F.col("p") + 1).cast("long").alias("dim"), F.round(F.col("x").cast("double"), digits).alias("value"))


def _long_sql(src: str, key: str, digits: int = 6) -> str:
    return f"""select {key}, cast(dim as bigint) as dim, round(x::double, {digits}) as value
from (select {key}, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding) as x from ({src}) s)"""


LABEL_CENT_SQL = f"""select l.label_id, coalesce(c.embedding, list_transform(range((select max(len(embedding)) from fx_trnq)), lambda i: 0.0)) as embedding
from fx_label l left join ({_mean_sql("select t.label_id, q.embedding from fx_trn_xy t join fx_trnq q on q.trn_id = t.trn_id", "label_id")}) c
on c.label_id = l.label_id"""


def _label_centroids(t):
    return RP.label_centroids(fx.train_xy(t).select(F.col("trn_id").alias("doc_id"), "label_id"),
                              fx.train_queries(t).select(F.col("trn_id").alias("doc_id"), "embedding"),
                              labels=fx.labels(t))


@job("label_centroids", oracle=_long_sql(LABEL_CENT_SQL, "label_id"))
def label_centroids(t):
    """Mean vector of each label's training queries; zero vector when none."""
    return _long(_label_centroids(t), "label_id")


@job("cluster_centroids", oracle=_long_sql(_mean_sql("select cluster_id, embedding from fx_cluster", "cluster_id"),
                                           "cluster_id"))
def cluster_centroids(t):
    """Mean vector per cluster (the embedding class)."""
    return _long(RP.cluster_centroids(fx.cluster_items(t)), "cluster_id")


MASKED_SQL = f"""select seq_id, list(s / greatest(w, 1e-9) order by dim) as embedding from (
  select seq_id, dim, sum(x * mask) as s, sum(mask * 1.0) as w from (
    select seq_id, mask, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding) as x from fx_seq)
  group by seq_id, dim) group by seq_id"""


@job("masked_mean_pool", oracle=_long_sql(MASKED_SQL, "seq_id"))
def masked_mean_pool(t):
    """Masked mean of token states per sequence (denominator clamped at 1e-9)."""
    return _long(RP.masked_mean_pool(fx.sequences(t)), "seq_id")


@job("last_token_pool", oracle=_long_sql("""select seq_id, embedding from (
  select seq_id, embedding, row_number() over (partition by seq_id order by mask desc, pos desc) as rn from fx_seq) where rn = 1""",
                                         "seq_id"))
def last_token_pool(t):
    """State at the last mask=1 position (final position when the mask is all zero)."""
    return _long(RP.last_token_pool(fx.sequences(t)), "seq_id")


MM_SQL = f"""
with slots as (select owner_id, asset_id, embedding, row_number() over (partition by owner_id order by asset_id) - 1 as slot
               from fx_asset),
u as (select owner_id as seq_id, embedding, 1 as mask from slots where slot < {NUM_IMGS}
      union all select seq_id, embedding, mask from fx_seq)
select seq_id, list(s / greatest(w, 1e-9) order by dim) as embedding from (
  select seq_id, dim, sum(x * mask) as s, sum(mask * 1.0) as w from (
    select seq_id, mask, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding) as x from u)
  group by seq_id, dim) group by seq_id"""


@job("multimodal_mean_pool", oracle=_long_sql(MM_SQL, "seq_id"))
def multimodal_mean_pool(t):
    """First 3 image slots of an owner and its token states pooled under their masks."""
    slots = AS.first_slots(fx.assets(t), NUM_IMGS).select("owner_id", "embedding", F.lit(1).cast("long").alias("mask"))
    return _long(RP.multimodal_mean_pool(slots, fx.sequences(t)), "seq_id")


@job("embedding_fallback", oracle=f"""
with c as ({_mean_sql("select t.label_id, q.embedding from fx_trn_xy t join fx_trnq q on q.trn_id = t.trn_id", "label_id")}),
f as (select l.label_id, coalesce(c.embedding, l.embedding) as embedding, c.label_id is not null as enriched
      from fx_label l left join c on c.label_id = l.label_id)
select label_id, enriched, cast(dim as bigint) as dim, round(x::double, 6) as value
from (select label_id, enriched, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding) as x from f)""")
def embedding_fallback(t):
    """Enriched vector (training-query centroid) when the label has one, else the raw one."""
    enr = RP.label_centroids(fx.train_xy(t).select(F.col("trn_id").alias("doc_id"), "label_id"),
                             fx.train_queries(t).select(F.col("trn_id").alias("doc_id"), "embedding"))
    raw = fx.labels(t).select("label_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fb = RP.embedding_fallback(raw, enr)
    return fb.select("label_id", "enriched", F.posexplode("embedding").alias("p", "x")).select(
        "label_id", "enriched", (F.col("p") + 1).cast("long").alias("dim"), F.round("x", 6).alias("value"))


@job("prototype_fusion", oracle=_long_sql(FUSED_VIEW_SQL, "label_id"))
def prototype_fusion(t):
    """Mean of {raw vector, label centroid, class centroid}, L2 normalised."""
    return _long(fused_labels(t), "label_id")


@job("label_cluster_lookup", oracle=f"""
with c as ({_mean_sql("select cluster_id, embedding from fx_cluster", "cluster_id")})
select label_id, cluster_id, cast(dim as bigint) as dim, round(x::double, 6) as value
from (select m.label_id, m.new_id as cluster_id, unnest(range(1, len(c.embedding) + 1)) as dim, unnest(c.embedding) as x
      from fx_map m join c on c.cluster_id = m.new_id)""")
def label_cluster_lookup(t):
    """Gather each label's cluster centroid by key."""
    cent = RP.cluster_centroids(fx.cluster_items(t))
    keys = fx.label_class_map(t).select("label_id", F.col("new_id").alias("cluster_id"))
    g = RP.gather(keys, cent, "cluster_id")
    return g.select("label_id", "cluster_id", F.posexplode("embedding").alias("p", "x")).select(
        "label_id", "cluster_id", (F.col("p") + 1).cast("long").alias("dim"), F.round("x", 6).alias("value"))


def _brand_clusters(t):
    return t("part").select(F.col("p_partkey").alias("label_id"),
                            F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("cluster_id"))


@job("head_tail_split", oracle=f"""
with f as (select l.label_id, coalesce(x.freq, 0.0) as freq from fx_label_ids l
           left join (select label_id, sum(value) as freq from fx_xy group by label_id) x on x.label_id = l.label_id),
r as (select label_id, row_number() over (order by freq desc, label_id desc) as rk from f)
select r.label_id, case when rk <= {N_HEAD} then {N_HEAD} - rk
       else {N_HEAD} + cast(regexp_extract(p.p_brand, '(\\d+)', 1) as bigint) end as new_id
from r join part p on p.p_partkey = r.label_id""")
def head_tail_split(t):
    """The 500 most frequent parts get ids 0..499 (ascending frequency), the rest 500 + brand."""
    freq = SP.label_frequency(fx.xy(t), fx.label_ids(t))
    return RP.head_tail_split(freq, _brand_clusters(t), N_HEAD)


@job("latest_embedding", oracle="""
select key, value, id from (select key, value, id, row_number() over (partition by key order by step desc, id desc) as rn
from fx_obs) where rn = 1""")
def latest_embedding(t):
    """C11: the latest observation per key in (step, id) order."""
    return RP.latest_by_key(fx.observations(t)).select("key", "value", "id")


EMA_SQL = f"""
select key, round(sum({1 - EMA_W} * pow({EMA_W}, n - i) * value), 6) as ema, max(n) as n_obs from (
  select key, value, row_number() over (partition by key order by step, id) as i, count(*) over (partition by key) as n
  from fx_obs) group by key"""


@job("ema_centroid", oracle=EMA_SQL)
def ema_centroid(t):
    """EMA (w = 0.95) of each key's values in (step, id) order, from zero."""
    e = RP.ema(fx.observations(t), EMA_W)
    return e.select("key", F.round("ema", 6).alias("ema"), "n_obs")


VEC_KEYS = 40   # embeddings stand in for vector observations of this many keys
VEC_OBS = f"select vec_id % {VEC_KEYS} as key, vec_id // {VEC_KEYS} as step, vec_id as id, embedding::double[] as embedding from embeddings"


def _vector_observations(t):
    return t("embeddings").select((F.col("vec_id") % VEC_KEYS).alias("key"), F.expr(f"vec_id div {VEC_KEYS}").alias("step"),
                                  F.col("vec_id").alias("id"), "embedding")


@job("latest_embedding_vectors", oracle=f"""
with o as ({VEC_OBS}), l as (select key, id, embedding, row_number() over (partition by key order by step desc, id desc) as rn from o),
e as (select key, id, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding) as x from l where rn = 1)
select key, id, cast(dim as bigint) as dim, round(x, 6) as value from e""")
def latest_embedding_vectors(t):
    """C11 on vectors: the latest embedding per key in (step, id) order."""
    last = RP.latest_by_key(_vector_observations(t), value_cols=("embedding",))
    return last.select("key", "id", F.posexplode("embedding").alias("p", "x")).select(
        "key", "id", (F.col("p") + 1).cast("long").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("value"))


@job("ema_centroid_vectors", oracle=f"""
with o as ({VEC_OBS}),
r as (select key, embedding, row_number() over (partition by key order by step, id) as i, count(*) over (partition by key) as n from o),
e as (select key, {1 - EMA_W} * pow({EMA_W}, n - i) as w, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding) as x from r)
select key, cast(dim as bigint) as dim, round(sum(w * x), 6) as value from e group by key, dim""")
def ema_centroid_vectors(t):
    """C12 on vectors: the running mean (w = 0.95) of each key's embeddings."""
    return _long(RP.ema_vectors(_vector_observations(t), EMA_W), "key")


def _proj_sql() -> str:
    rows = ", ".join("[" + ", ".join(repr(x) for x in row) + "]::double[]" for row in proj_matrix())
    return f"""select l.label_id, cast(i as bigint) as out_dim,
       round(list_dot_product(([{rows}])[i], l.embedding), 6) as value
from fx_label l, (select unnest(range(1, {PROJ_OUT + 1})) as i) r"""


@job("linear_project", oracle=_proj_sql())
def linear_project(t):
    """Project every label vector with a fixed 4 x 64 matrix (no centring)."""
    p = RP.linear_project(fx.labels(t), proj_matrix())
    return p.select("label_id", F.posexplode("projected").alias("p", "x")).select(
        "label_id", (F.col("p") + 1).cast("long").alias("out_dim"), F.round("x", 6).alias("value"))


@job("pca_covariance", oracle="""
with x as (select label_id, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as v from fx_label),
n as (select count(*) as n from fx_label), m as (select i, sum(v) as s from x group by i)
select cast(a.i as bigint) as i, cast(b.i as bigint) as j, round(sum(a.v * b.v) / any_value(n.n) - any_value(ma.s) * any_value(mb.s) / any_value(n.n) / any_value(n.n), 8) as value
from x a join x b on a.label_id = b.label_id, n, m ma, m mb where ma.i = a.i and mb.i = b.i group by a.i, b.i""")
def pca_covariance(t):
    """P09 fit, the data pass: the covariance matrix that the components come from."""
    gram, total, n = RP.gram_matrix(fx.labels(t))
    cov = gram / n - total[:, None] * total[None, :] / n ** 2
    rows = [(i + 1, j + 1, float(v)) for i, row in enumerate(cov) for j, v in enumerate(row)]  # dim x dim numbers
    return t.spark.createDataFrame(rows, "i long, j long, value double").select("i", "j", F.round("value", 8).alias("value"))


@job("pca_fit")
def pca_fit(t):
    """P09 fit: 4 principal components of the label vectors from their covariance, applied without
    centring like the reference; rows-only (SQL has no eigenvectors; ``pca_covariance`` is checked)."""
    comps = RP.pca_fit(fx.labels(t), 4)
    p = RP.linear_project(fx.labels(t), comps.tolist())
    return p.select("label_id", F.posexplode("projected").alias("p", "x")).select(
        "label_id", (F.col("p") + 1).cast("long").alias("pc"), F.col("x").alias("value"))


ENC_SQL = f"""
with t as (select row_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as tok from fx_doc_text),
c as (select row_id, ('0x' || substr(md5(tok), 1, 13))::bigint % {DIM} as dim, count(*) * 1.0 as c from t group by row_id, dim),
n as (select row_id, sqrt(sum(c * c)) as n from c group by row_id)"""


@job("encode_table", oracle=ENC_SQL + "\nselect c.row_id, c.dim, round(c.c / n.n, 9) as value from c join n on n.row_id = c.row_id")
def encode_table(t):
    """Hashed bag-of-tokens encoder (md5 bucket, L2) over every document, native."""
    e = RP.hashed_bag_native(fx.doc_text(t), DIM)
    return e.select("row_id", "dim", F.round("value", 9).alias("value"))


@job("encode_table_udf", oracle=ENC_SQL + "\nselect c.row_id, c.dim, round(cast(cast(c.c / n.n as float) as double), 5) as value from c join n on n.row_id = c.row_id")
def encode_table_udf(t):
    """the same encoder as a pluggable Python batch function through mapInPandas (float32
    vectors, compared to 5 digits)."""
    e = RP.encode_table(fx.doc_text(t), RP.hashed_bag_encoder(DIM), dim=DIM)
    return (e.select("row_id", F.posexplode("embedding").alias("dim", "x"))
             .where(F.col("x") != 0).select("row_id", F.col("dim").cast("long"), F.round(F.col("x").cast("double"), 5).alias("value")))
