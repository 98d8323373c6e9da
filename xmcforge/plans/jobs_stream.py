"""Streaming jobs over a time-ordered replay of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from xmcforge.plans import fixtures as fx
from xmcforge.plans.jobs_represent import EMA_SQL, EMA_W
from xmcforge.plans.registry import job
from xmcforge.sources.files import scratch_path
from xmcforge.streaming import state as ST

A, B = 0.55, 1.5   # fixed values: dataset-default propensity constants


def _replay(t):
    obs = t("events").select(F.col("user_id").alias("key"), F.col("ts").alias("step"), F.col("event_id").alias("id"),
                             "value", F.col("event_type").alias("label"))
    src = scratch_path(t.spark, "events_replay")
    ST.stage_replay(obs, src)
    return src


def _paths(t, name):
    return scratch_path(t.spark, f"{name}_out"), scratch_path(t.spark, f"{name}_ckpt")


@job("stream_latest", oracle="""
select key, value, id from (select key, value, id, row_number() over (partition by key order by step desc, id desc) as rn
from fx_obs) where rn = 1""")
def stream_latest(t):
    """ST1: latest value per user from a file stream (update log, read back)."""
    out, ck = _paths(t, "latest")
    return ST.stream_latest(t.spark, _replay(t), out, ck).select("key", "value", "id")


@job("stream_latest_vectors", oracle="""
select user_id as key, cast(dim as bigint) as dim, round(x::double, 6) as value from (
  select user_id, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding) as x from (
    select e.user_id, v.embedding, row_number() over (partition by e.user_id order by e.ts desc, e.event_id desc) as rn
    from events e join embeddings v on v.vec_id = e.event_id % (select max(vec_id) + 1 from embeddings)) where rn = 1)""")
def stream_latest_vectors(t):
    """ST1 / C11 on vectors: the embedding bank as a stream, in two runs with a snapshot between them.

    Every event carries an embedding (event number modulo the vectors); the first run's log is
    compacted, the second run's log is read on top of that snapshot."""
    top = t("embeddings").agg(F.max("vec_id").alias("m")).first().m + 1
    events = t("events").select(F.col("user_id").alias("key"), F.col("ts").alias("step"), F.col("event_id").alias("id"),
                                (F.col("event_id") % top).alias("vec_id"))
    obs = events.join(t("embeddings").select("vec_id", "embedding"), "vec_id").drop("vec_id")
    half = events.agg(F.percentile_approx("id", 0.5).alias("m")).first().m or 0
    snapshot = scratch_path(t.spark, "vectors_snapshot")
    schema = obs.schema
    for i, part in enumerate((obs.where(F.col("id") <= half), obs.where(F.col("id") > half))):
        src = scratch_path(t.spark, f"vectors_replay{i}")
        out, ck = _paths(t, f"vectors{i}")
        ST.stage_replay(part, src)
        state = ST.stream_latest(t.spark, src, out, ck, ["embedding"], schema, snapshot if i else None)
        if i == 0:
            state.write.parquet(snapshot)
    return state.select("key", F.posexplode("embedding").alias("p", "x")).select(
        "key", (F.col("p") + 1).cast("long").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("value"))


@job("stream_ema", oracle=f"select key, ema, n_obs, 0::bigint as late from ({EMA_SQL})")
def stream_ema(t):
    """ST2: EMA (w = 0.95) per user with applyInPandasWithState; rows wait an hour of event time."""
    out, ck = _paths(t, "ema")
    res = ST.stream_ema(t.spark, _replay(t), out, ck, EMA_W, delay_s=3600.0)
    return res.select("key", F.round("ema", 6).alias("ema"), "n_obs", "late")


@job("stream_label_frequency", oracle=f"""
select event_type as label, count(*) as freq,
       round(1.0 + (ln((select count(*) from events)::double) - 1.0) * pow({B + 1.0}, {A}) * pow(count(*) + {B}, {-A}), 9) as weight
from events group by event_type""")
def stream_label_frequency(t):
    """ST3: running event-type frequency and its inverse propensity."""
    out, ck = _paths(t, "freq")
    res = ST.stream_label_frequency(t.spark, _replay(t), out, ck, A, B)
    return res.select("label", "freq", F.round("weight", 9).alias("weight"))
