"""Re-startable append of asset batches (S11): data first, then one commit file per batch.

A table is a folder with ``data/<batch folder>`` (Parquet) and ``commits/<number>`` (one line of JSON:
the batch's name, folder, first id and row count).  A batch belongs to the table from the moment its
commit file exists; that file is renamed into place in one step and never replaced.  Rows a killed job
left behind have no commit and are never read, and since a batch's ids start where the commits so far
end, a resumed job numbers its assets as an undisturbed one does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmcforge.sources.files import build_asset_table

COMMIT_SCHEMA = "number long, name string, folder string, first_id long, n_rows long"
TABLE_SCHEMA = "asset_id long, owner_id long, ord long, payload string"


class CommitConflict(RuntimeError):
    """Another job committed the same number in the meantime; its batch stands, this one does not."""


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The committed batches in order (one small record each)."""
    files = _listed(spark, f"{path}/commits")
    if not files:
        return []
    rows = spark.read.schema(COMMIT_SCHEMA).json(files).collect()  # one row per batch
    return sorted((r.asDict() for r in rows), key=lambda r: r["number"])


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches."""
    folders = [f"{path}/data/{c['folder']}" for c in commits(spark, path) if c["n_rows"]]
    return spark.read.schema(TABLE_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], TABLE_SCHEMA)


def append_batch(spark: SparkSession, path: str, name: str, blobs: DataFrame) -> bool:
    """Append ``blobs`` (owner_id, ord, bytes) as batch ``name``; False where it is committed already.

    Owners that a committed batch holds are left out; ids go on where the commits end."""
    prepared = prepare_batch(spark, path, name, blobs)
    if prepared is None:
        return False
    commit(spark, path, prepared)
    return True


def prepare_batch(spark: SparkSession, path: str, name: str, blobs: DataFrame) -> dict | None:
    """Write the batch's rows and return the record that ``commit`` makes part of the table."""
    done = commits(spark, path)
    if any(c["name"] == name for c in done):
        return None
    first_id = sum(c["n_rows"] for c in done)
    folder = f"{len(done):09d}-{uuid.uuid4().hex}"
    rows = build_asset_table(blobs, read_assets(spark, path).select("owner_id") if first_id else None, first_id)
    rows = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in TABLE_SCHEMA.split(", ")])
    rows.write.mode("error").parquet(f"{path}/data/{folder}")
    n_rows = spark.read.schema(TABLE_SCHEMA).parquet(f"{path}/data/{folder}").count()
    return {"number": len(done), "name": name, "folder": folder, "first_id": first_id, "n_rows": n_rows}


def append_all(spark: SparkSession, path: str, batches: Iterable[tuple[str, Callable[[], DataFrame]]]) -> list[str]:
    """Append each (name, function that gives the blobs) in turn; the names that were new.  Run again
    after a stop, it goes on with the first batch that has no commit."""
    known = {c["name"] for c in commits(spark, path)}
    return [name for name, blobs in batches if name not in known and append_batch(spark, path, name, blobs())]


# ------------------------------------------------------------------ the shared folder's file system

def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    _, where, fs = _fs(spark, path)
    if not fs.exists(where):
        return []
    return sorted(f.getPath().toString() for f in fs.listStatus(where) if f.getPath().getName().isdigit())


def commit(spark: SparkSession, path: str, record: dict) -> None:
    """Make the batch of ``record`` part of the table; CommitConflict where its number is taken."""
    from py4j.protocol import Py4JJavaError
    jvm, target, fs = _fs(spark, f"{path}/commits/{record['number']:09d}")
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)  # never replaces
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise CommitConflict(f"batch {record['number']} of {path} is committed already") from None
        raise
