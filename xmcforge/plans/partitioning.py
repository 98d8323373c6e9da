"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Inputs estimated below this size may arrive as a single split (one parquet row group, one
# gzip file); spreading them first costs a negligible shuffle and lets CPU-heavy per-row work
# (regex tokenization, hashing) use every core.  Larger inputs keep their file splits.
SPREAD_BELOW_BYTES = 256 << 20


def input_bytes(df: DataFrame, threshold: int = SPREAD_BELOW_BYTES) -> int:
    """Bytes of the files behind ``df``, counted only up to ``threshold`` (no job runs).

    Inputs with more files than cores are already well split and count as large; plans
    without files fall back to Catalyst's estimate."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        try:
            return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        except Exception:
            return threshold
    if len(files) > int(spark.sparkContext.defaultParallelism):
        return threshold
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    total = 0
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f)
        total += int(path.getFileSystem(conf).getFileStatus(path).getLen())
        if total >= threshold:
            break
    return total


def spread_if_small(df: DataFrame, key: str | None = None, threshold: int = SPREAD_BELOW_BYTES) -> DataFrame:
    """Spread ``df`` over ``defaultParallelism`` partitions when its input is small: hashed on
    ``key`` (deterministic, no pre-sort) or round-robin when no key is given."""
    par = int(df.sparkSession.sparkContext.defaultParallelism)
    if input_bytes(df, threshold) < threshold:
        return df.repartition(par, key) if key else df.repartition(par)
    return df
