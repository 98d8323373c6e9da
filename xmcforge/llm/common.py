"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from xmcforge.session import ensure_checkpoint_dir

# Text bytes that one vectorised step of a task holds at once.
SLICE_BYTES = 4 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/xmcforge-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it.

    Cuts lineage (a lost executor re-reads files instead of recomputing) and makes several
    readers see one evaluation.  The shuffle files of this write go when it ends: the table
    replaces them, and a job of many steps holds those of one step only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these tables; nothing may read them afterwards."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def with_fields(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> tuple[DataFrame, T.StructType]:
    """``df`` without columns of the new names, and its schema with the new fields appended."""
    names = {n.lower() for n, _ in fields}
    kept = df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in names])
    return kept, T.StructType(list(kept.schema.fields) + [T.StructField(n, t) for n, t in fields])


def free_name(columns, base: str) -> str:
    """``base``, with underscores added until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def slices(batch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator:
    """Cut an Arrow record batch into row ranges of at most ``max_bytes`` of ``column`` (a longer
    single value stays alone in its range)."""
    import numpy as np
    import pyarrow.compute as pc
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        base = int(ends[start - 1]) if start else 0
        stop = int(np.searchsorted(ends, base + max_bytes, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def words_of(text):
    """Split an Arrow string array at ASCII white space: (flat words, offsets per row).

    Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``; nulls have none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    real = np.asarray(pc.binary_length(flat), dtype=np.int64) > 0
    if not real.all():  # white space at an end leaves an empty piece
        flat = flat.filter(pa.array(real))
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    return flat, offsets


def sums_by(values, offsets):
    """Sums of ``values`` over the ranges of ``offsets`` (empty ranges give 0)."""
    import numpy as np
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def worker_memory(name: str, small: bool = False) -> dict:
    """A dictionary that outlives a task in a reused Python worker (callers bound its size).

    A worker serves one kind of task at a time: asking for a dictionary drops those of other names,
    except ``small`` ones, so that the stages of a pipeline do not add up."""
    import sys
    import types
    home = sys.modules.setdefault("_xmcforge_worker", types.ModuleType("_xmcforge_worker")).__dict__
    if small:
        return home.setdefault("small", {}).setdefault(name, {})
    held = home.setdefault("held", {})
    for other in [k for k in held if k != name]:
        held.pop(other)
    return held.setdefault(name, {})
