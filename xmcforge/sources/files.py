"""Line-oriented and tabular file formats of the reference, read and written by Spark
(S01-S11, S13-S15).

Line identity: the reference identifies a record by its line number.  Spark scans files in
parallel splits, so the line number is rebuilt from the position in the split and the line
counts of the splits before it, in (part number, file name, split start) order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmcforge.functions.text import py_strip
from xmcforge.plans.ranking import PARTITION_BYTES, _estimated_bytes, dist_rank
from xmcforge.session import default_parallelism, ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder (never machine-local)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/xmcforge-io/{uuid.uuid4().hex}/{name}"


# ------------------------------------------------------------------ raw text lines

def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", strip: bool = True,
               line_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """One record per line, blank lines kept; ``row_id`` = 0-based line number.

    The text source hands raw bytes through, so ``decode(binary, encoding)`` applies the
    charset (the reference reads Latin-1); ``strip`` matches Python's ``str.strip``.

    Line numbers need no shuffle of the text: every line belongs to exactly one input split
    (file, split start), is read in file order inside it, and the scan's split layout is fixed
    by the file listing, so ``monotonically_increasing_id`` minus the split's first id is the
    position inside the split.  A light pass counts lines per split; their prefix sums in
    (file, start) order (a table with one row per split) are joined back; the optimizer
    picks that join by the table's size at run time."""
    raw = spark.read.text(path)
    text = F.decode(F.col("value").cast("binary"), encoding)
    if strip:
        text = py_strip(text)
    keyed = raw.select(F.input_file_name().alias("_f"), F.input_file_block_start().alias("_b"),
                       F.monotonically_increasing_id().alias("_m"), text.alias(text_col))
    splits = keyed.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    # part files by their number (part-100000 follows part-99999), others by name
    number = F.nullif(F.regexp_extract("_f", r"part-(\d{1,18})", 1), F.lit("")).cast("long")
    w = Window.orderBy(number.asc_nulls_first(), "_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return (keyed.join(offsets, ["_f", "_b"])
                 .select((F.col("_off") + F.col("_m") - F.col("_m0")).cast("long").alias(line_col), text_col))


def first_line(spark: SparkSession, path: str) -> DataFrame:
    """The one-row (text) first line of ``path`` in the order of ``read_lines``: files are listed, and
    only the first one that has a line is opened.  A large file is read in several splits, in no order
    where the limit is not collected, so the line is taken from the split at its start."""
    import re

    def place(f: str):
        number = re.search(r"part-(\d{1,18})", f)
        return (number is not None, int(number[1]) if number else 0, f)

    for f in sorted(spark.read.text(path).inputFiles(), key=place):
        line = spark.read.text(f).where(F.input_file_block_start() == 0).limit(1).select(py_strip(F.col("value")).alias("text"))
        if line.head() is not None:
            return line
    return spark.createDataFrame([], "text string")


def write_lines(df: DataFrame, path: str, order_col: str, text_col: str = "text", encoding: str = "UTF-8",
                num_files: int | None = None, compression: str | None = None) -> None:
    """One line per record in ``order_col`` order; newlines inside a record become spaces
    (they would shift every later line); empty records stay as blank lines.

    Range-partitioned, so part files are in key order; their number follows the estimated size, but
    is not below the cores.  The text writer emits a string's bytes verbatim, so another charset is
    written by encoding to binary first."""
    n = num_files or max(default_parallelism(df.sparkSession), int(_estimated_bytes(df) // PARTITION_BYTES), 1)
    line = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\r\n]+", " ")
    if encoding.upper().replace("_", "-") not in ("UTF-8", "UTF8"):
        line = F.encode(line, encoding).cast("string")
    body = df.select(order_col, line.alias("value"))
    out = body.repartitionByRange(n, order_col).sortWithinPartitions(order_col).select("value")
    w = out.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.text(path)


# ------------------------------------------------------------------ JSON-lines corpus

CORPUS_SCHEMA = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("target_ind", T.ArrayType(T.LongType())),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CORPUS_SCHEMA) -> DataFrame:
    """JSON lines (gz allowed) with an explicit schema and the line number as row_id.

    A .gz file is one task: a small input is spread before parsing, larger ones keep their splits."""
    from xmcforge.plans.partitioning import spread_if_small
    raw = read_lines(spark, path, encoding="UTF-8", strip=False, line_col="row_id", text_col="_json")
    return spread_if_small(raw, key="row_id").select("row_id", F.from_json("_json", schema).alias("j")).select("row_id", "j.*")


def write_jsonl(df: DataFrame, path: str, order_col: str, compression: str = "gzip") -> None:
    payload = df.select(order_col, F.to_json(F.struct(*[c for c in df.columns if c != order_col])).alias("text"))
    write_lines(payload, path, order_col, "text", compression=compression)


# ------------------------------------------------------------------ sparse matrix text

def write_sparse_matrix(xy: DataFrame, rows: DataFrame, n_labels: int, path: str, row_col: str = "doc_id") -> None:
    """Header ``n_rows n_labels`` then ``col:val`` lists in row order; empty rows kept.

    The header travels as a row with key -1 so it lands first in the first file."""
    cells = xy.select(F.col(row_col).alias("_row"), F.struct("label_id", "value").alias("c"))
    lists = cells.groupBy("_row").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    body = (rows.select(F.col(row_col).alias("_row")).join(lists, "_row", "left")
            .select("_row", F.array_join(F.transform(F.coalesce("cs", F.array()),
                                                     lambda c: F.concat_ws(":", c["label_id"].cast("string"),
                                                                           c["value"].cast("string"))), " ")
                    .alias("text")))
    n_rows = rows.select(F.count(F.lit(1)).alias("n"))
    header = n_rows.select(F.lit(-1).cast("long").alias("_row"),
                           F.concat_ws(" ", F.col("n").cast("string"), F.lit(str(n_labels))).alias("text"))
    write_lines(header.unionByName(body), path, "_row")


def read_sparse_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, label_id, value) long table and the one-row (n_rows, n_labels) header, which is
    read from the first file alone."""
    lines = read_lines(spark, path, encoding="UTF-8", strip=True, line_col="line", text_col="text")
    header = first_line(spark, path).select(
        F.split("text", " ")[0].cast("long").alias("n_rows"), F.split("text", " ")[1].cast("long").alias("n_labels"))
    body = lines.where(F.col("line") > 0).select((F.col("line") - 1).alias("doc_id"),
                                                 F.explode(F.split("text", " ")).alias("cell"))
    body = body.where(F.col("cell") != "").select(
        "doc_id", F.split("cell", ":")[0].cast("long").alias("label_id"),
        F.split("cell", ":")[1].cast("double").alias("value"))
    return body, header


# ------------------------------------------------------------------ small delimited files

def write_pairs(df: DataFrame, path: str, a: str = "q_id", b: str = "label_id") -> None:
    df.select(a, b).write.mode("overwrite").option("sep", " ").csv(path)


def read_filter_pairs(spark: SparkSession, path: str | None) -> DataFrame:
    """Two integer columns separated by a space; no file = no filter (empty table)."""
    schema = "q_id long, label_id long"
    if not path:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).option("sep", " ").csv(path)
    except Exception as e:  # missing folder means "no filter"
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id->title``; the id is the trimmed text before the first ``->``."""
    lines = read_lines(spark, path, encoding="UTF-8", strip=False)
    return lines.select("row_id", F.trim(F.split("text", "->", 2)[0]).alias("id"))


def read_id_url(spark: SparkSession, path: str) -> DataFrame:
    """Tab separated (id, url)."""
    return spark.read.schema("id string, url string").option("sep", "\t").csv(path)


# ------------------------------------------------------------------ parquet tables

def write_embeddings(df: DataFrame, path: str, split_col: str = "split") -> None:
    """Parquet {split, id, embedding array<float>} partitioned by split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_embeddings(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Read back; ``only`` becomes a partition filter (pruned at planning)."""
    df = spark.read.parquet(path)
    if only:
        df = df.where(F.col("split").isin(list(only)))
    return df


def split_row_counts(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


# ------------------------------------------------------------------ asset blobs

def build_asset_table(blobs: DataFrame, done_owners: DataFrame | None = None, start_id: int = 0) -> DataFrame:
    """(asset_id, owner_id, ord, payload base64) with a running asset index.

    ``blobs`` = (owner_id, ord, bytes) with unique (owner_id, ord).  Resume: owners already present in ``done_owners``
    are skipped (anti join) and numbering continues at ``start_id``."""
    todo = blobs
    if done_owners is not None:
        todo = todo.join(done_owners.select("owner_id").distinct(), "owner_id", "left_anti")
    # rank the (owner, ord) keys only; the payload joins back once instead of riding through
    # the range shuffle and the rank's checkpoint
    ids = dist_rank(todo.select("owner_id", "ord"), ["owner_id", "ord"], rank_col="_r")
    return todo.join(ids, ["owner_id", "ord"]).select(
        (F.col("_r") - 1 + F.lit(start_id)).alias("asset_id"), "owner_id", "ord",
        F.regexp_replace(F.base64("bytes"), r"[\r\n]", "").alias("payload"))


def decode_payload(assets: DataFrame) -> DataFrame:
    return assets.withColumn("bytes", F.unbase64("payload"))


# ------------------------------------------------------------------ metric history

def append_metrics(report: DataFrame, path: str, epoch: int) -> None:
    """Append (epoch, metric, k, value) rows."""
    report.select(F.lit(epoch).cast("long").alias("epoch"), "metric", "k", "value").write.mode("append").parquet(path)


def metrics_wide(spark: SparkSession, path: str, metric: str = "P", ks=None) -> DataFrame:
    """Wide history (epoch, '<metric>@<k>' ...), like the reference CSV.  Passing ``ks`` fixes
    the pivot columns up front (no extra job to discover them)."""
    hist = spark.read.parquet(path).where(F.col("metric") == metric)
    cols = [f"{metric}@{k}" for k in ks] if ks else None
    return (hist.withColumn("col", F.concat(F.lit(f"{metric}@"), F.col("k").cast("string")))
                .groupBy("epoch").pivot("col", cols).agg(F.first("value")))


def append_losses(losses: DataFrame, path: str, epoch: int) -> None:
    """One row per batch of ``epoch`` in the loss history; an epoch written again replaces itself."""
    (losses.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").partitionBy("epoch")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def loss_history(spark: SparkSession, path: str) -> DataFrame:
    """The batches' losses in training order: ``step`` counts (epoch, batch_id) from 0."""
    hist = spark.read.parquet(path).withColumn("epoch", F.col("epoch").cast("long"))
    return dist_rank(hist, ["epoch", "batch_id"], rank_col="step").withColumn("step", F.col("step") - 1)
