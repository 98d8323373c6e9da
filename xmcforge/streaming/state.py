"""Structured Streaming forms of the reference's running state (ST1-ST3).

* ST1 latest value per key: ``max_by`` over (step, id) is order-free, so late files are
  safe without a watermark.
* ST2 EMA per key (order-dependent): ``applyInPandasWithState`` keeps the mean up to the key's
  watermark (its newest time minus ``delay``) and, in order, the rows after it; rows are applied
  in (step, id) order once the watermark passes them, so files may come in any order within the
  delay.  Rows older than the last applied one are counted as late, apart.
* ST3 running label frequency: streaming count per label; propensity is computed at read.

Sinks are update-mode logs written by ``foreachBatch`` into one partition per batch id
(dynamic partition overwrite, so a retried batch replaces itself); ``latest_state`` reads the
newest row per key.  Nothing is collected on the driver.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

OBS_SCHEMA = T.StructType([
    T.StructField("key", T.LongType()),
    T.StructField("step", T.TimestampNTZType()),
    T.StructField("id", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("label", T.StringType()),
])


def _micros(c: str):
    """Microseconds since the epoch of a timestamp or timestamp_ntz column (UTC session)."""
    return F.unix_micros(F.col(c).cast("timestamp"))


REPLAY_ROWS_PER_FILE = 1_000_000


def stage_replay(obs: DataFrame, path: str, order_col: str = "step", min_files: int = 4,
                 rows_per_file: int = REPLAY_ROWS_PER_FILE) -> None:
    """Write observations as time-ordered files (a replay fixture for the file source, which hands
    files to micro-batches oldest first).

    One range-partitioned write by (time, id), so files hold about equally many rows however times
    are spread, and rows without a time come first.  Then file modification times are set in file
    order; only file names pass through the driver."""
    spark = obs.sparkSession
    n_files = max(min_files, math.ceil(obs.count() / rows_per_file))
    order = [F.col(order_col).asc_nulls_first(), F.col("id").asc_nulls_first()]
    obs.repartitionByRange(n_files, *order).sortWithinPartitions(*order).write.mode("append").parquet(path)
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    now = int(time.time() * 1000)
    for i, f in enumerate(files):
        fs.setTimes(f, now - 1000 * (len(files) - i), -1)


def _log_sink(out_path: str):
    """Idempotent ``foreachBatch`` sink: each micro-batch owns the log partition of its id and
    overwrites only that partition, so a batch re-run after a failure replaces itself instead
    of appending duplicates (exactly-once log contents)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write
              .mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("batch_id").parquet(out_path))
    return write


def _run(stream_df: DataFrame, out_path: str, ckpt: str, mode: str = "update",
         state_partitions: int | None = None) -> None:
    """Drain the stream (availableNow) into the log.  The number of state partitions is fixed
    when a stream first starts (it is recorded in the checkpoint); ``state_partitions``
    (default: the cluster's cores) is applied just for that start and the session value is
    restored right after."""
    spark = stream_df.sparkSession
    n = state_partitions or int(spark.sparkContext.defaultParallelism)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        q = (stream_df.writeStream.outputMode(mode).foreachBatch(_log_sink(out_path))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    q.awaitTermination()


def latest_state(spark: SparkSession, out_path: str, key_cols: Sequence[str]) -> DataFrame:
    """The newest row per key of an update log (a partially aggregated ``max_by``)."""
    log = spark.read.parquet(out_path)
    vals = [c for c in log.columns if c not in (*key_cols, "batch_id")]
    return log.groupBy(*key_cols).agg(*[F.max_by(c, "batch_id").alias(c) for c in vals],
                                      F.max("batch_id").alias("batch_id"))


def compact_log(spark: SparkSession, out_path: str, snapshot_path: str, key_cols: Sequence[str]) -> DataFrame:
    """Fold an update log into a snapshot holding one row per key (with the batch id it came
    from).  A long-running stream keeps appending to a fresh log folder after a compaction,
    and readers union the snapshot with the newer log before ``max_by``."""
    latest_state(spark, out_path, key_cols).write.mode("overwrite").parquet(snapshot_path)
    return spark.read.parquet(snapshot_path)


def read_replay(spark: SparkSession, src: str, schema: T.StructType = OBS_SCHEMA, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)


def stream_latest(spark: SparkSession, src: str, out_path: str, ckpt: str, value_cols: Sequence[str] = ("value",),
                  schema: T.StructType = OBS_SCHEMA, snapshot: str | None = None) -> DataFrame:
    """ST1: latest (``value_cols``, id) per key, of any type, vectors included.

    ``snapshot`` names a folder of ``compact_log``: its rows count as the state before this log, so a
    read costs the keys and what changed since, not the whole history."""
    s = read_replay(spark, src, schema)
    o = F.struct("step", "id")
    agg = s.groupBy("key").agg(*[F.max_by(c, o).alias(c) for c in value_cols], F.max(o)["step"].alias("step"), F.max(o)["id"].alias("id"))
    _run(agg, out_path, ckpt)
    return read_state(spark, out_path, snapshot, ["key"])


def read_state(spark: SparkSession, out_path: str, snapshot: str | None, key_cols: Sequence[str],
               order: Sequence[str] = ("step", "id")) -> DataFrame:
    """The newest row per key, by ``order``, of a snapshot and the log written after it."""
    log = spark.read.parquet(out_path).drop("batch_id")
    if snapshot is not None:
        log = spark.read.parquet(snapshot).select(*log.columns).unionByName(log)
    o = F.struct(*order)
    vals = [c for c in log.columns if c not in (*key_cols, *order)]
    return log.groupBy(*key_cols).agg(*[F.max_by(c, o).alias(c) for c in vals], *[F.max(o)[c].alias(c) for c in order])


EMA_STATE = T.StructType([
    T.StructField("ema", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("last_step", T.LongType()),
    T.StructField("last_id", T.LongType()), T.StructField("late", T.LongType()), T.StructField("steps", T.ArrayType(T.LongType())),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
EMA_OUT = T.StructType([T.StructField("key", T.LongType()), T.StructField("ema", T.DoubleType()), T.StructField("n_obs", T.LongType()),
                        T.StructField("late", T.LongType()), T.StructField("pending", T.LongType())])
NO_TIME = -(1 << 62)  # rows without a time come before all others, as in the batch order


def _fold(ema: float, x: np.ndarray, w: float) -> float:
    """The running mean after the values ``x``."""
    return w ** len(x) * ema + float(((1.0 - w) * w ** np.arange(len(x) - 1, -1, -1, dtype=np.float64) * x).sum())


def _ema_update(w: float, delay_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import warnings  # PySpark's own Arrow serializer triggers a pandas deprecation notice
        warnings.filterwarnings("ignore", category=FutureWarning, module="pyspark.*")
        ema, n, last_step, last_id, late, steps, ids, values = (
            state.get if state.exists else (0.0, 0, None, None, 0, [], [], []))
        steps, ids, values = np.array(steps, np.int64), np.array(ids, np.int64), np.array(values, np.float64)
        for p in pdfs:  # one Arrow batch of the key at a time
            new = [p["step_us"].to_numpy(np.int64), p["id"].to_numpy(np.int64), p["value"].to_numpy(np.float64)]
            if last_step is not None:
                fresh = (new[0] > last_step) | ((new[0] == last_step) & (new[1] > last_id))
                late += int((~fresh).sum())
                new = [c[fresh] for c in new]
            steps, ids, values = np.concatenate([steps, new[0]]), np.concatenate([ids, new[1]]), np.concatenate([values, new[2]])
        order = np.lexsort((ids, steps))
        steps, ids, values = steps[order], ids[order], values[order]
        due = int(np.searchsorted(steps, steps[-1] - delay_us, side="left")) if len(steps) else 0
        if due:
            ema, n = _fold(ema, values[:due], w), n + due
            last_step, last_id = int(steps[due - 1]), int(ids[due - 1])
            steps, ids, values = steps[due:], ids[due:], values[due:]
        state.update((ema, n, last_step, last_id, late, steps.tolist(), ids.tolist(), values.tolist()))
        # what is shown counts the waiting rows, too
        yield pd.DataFrame({"key": pd.array([key[0]], "Int64"), "ema": [_fold(ema, values, w)], "n_obs": [n + len(steps)],
                            "late": [late], "pending": [len(steps)]})
    return fn


def stream_ema(spark: SparkSession, src: str, out_path: str, ckpt: str, w: float = 0.95, delay_s: float = 0.0) -> DataFrame:
    """ST2: (key, ema, n_obs, late, pending) with per-key state.

    A row is applied once the key has seen a row more than ``delay_s`` seconds newer, so files whose
    rows are out of order by less give the batch mean; state per key holds the rows of the last
    ``delay_s`` seconds.  Rows behind the last applied one are counted in ``late`` and change nothing.
    Rows without a time come first; null keys are a key; null values count as 0."""
    s = read_replay(spark, src).select(
        "key", F.coalesce(_micros("step"), F.lit(NO_TIME)).alias("step_us"), F.coalesce("id", F.lit(0).cast("long")).alias("id"),
        F.coalesce("value", F.lit(0.0)).alias("value"))
    out = s.groupBy("key").applyInPandasWithState(_ema_update(w, int(delay_s * 1e6)), EMA_OUT, EMA_STATE, "update",
                                                  GroupStateTimeout.NoTimeout)
    _run(out, out_path, ckpt)
    return latest_state(spark, out_path, ["key"]).drop("batch_id")


def stream_label_frequency(spark: SparkSession, src: str, out_path: str, ckpt: str,
                           A: float = 0.55, B: float = 1.5) -> DataFrame:
    """ST3: running count per label; inverse propensity from the counts at read time."""
    s = read_replay(spark, src)
    counts = s.groupBy("label").agg(F.count(F.lit(1)).alias("freq"))
    _run(counts, out_path, ckpt)
    cur = latest_state(spark, out_path, ["label"]).drop("batch_id")
    n = float(cur.agg(F.sum("freq")).first()[0] or 0)   # one scalar: rows seen so far
    c = (math.log(n) - 1.0) * (B + 1.0) ** A if n > 0 else 0.0
    return cur.select("label", F.col("freq").cast("long"),
                      (F.lit(1.0) + F.lit(c) * F.pow(F.col("freq") + B, F.lit(-A))).alias("weight"))
