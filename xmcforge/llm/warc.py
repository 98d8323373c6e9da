"""WARC archives compressed with Zstandard and a dictionary.

An archive starts with a skippable frame that holds the dictionary; then every record is one frame.
The writer streams records into archives of bounded size below a shared folder; the reader takes
whole archives from Spark's binary reader, loads the dictionary from the leading skippable frame,
decodes one frame per record and validates headers, lengths and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmcforge.llm.common import scratch_path, slices, table
from xmcforge.llm.registry import query

# Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
ZSTD_DICTIONARY_MAGIC = 0xEC30A437
VERSION = b"WARC/1.1"

ARCHIVE_BYTES = 16 << 20  # payload bytes after which an archive is closed
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20  # of an archive's own payloads, for its dictionary
MIN_REVISIT_BYTES = 1000
CRLF = b"\r\n"

RECORD = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("record_offset", T.LongType()),
    T.StructField("page_id", T.LongType()), T.StructField("target_uri", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType())])


def record_bytes(page_id, uri, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit carries no block.  Line breaks in ``uri`` are percent-encoded."""
    name = lambda i: b"<urn:x-page:%s>" % (b"null" if i is None else b"%d" % i)
    uri = (uri or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + name(page_id),
            b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + uri.encode(),
            b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % size]
    if revisit:
        head += [b"WARC-Refers-To: " + name(refers_to),
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: application/octet-stream", b"Content-Length: %d" % len(block)]
    return CRLF.join(head) + CRLF * 2 + block + CRLF * 2


def parse_record(data: bytes) -> dict:
    """Validate one record and return its fields; raises ValueError on any fault."""
    import hashlib
    head, sep, rest = data.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not sep or lines[0] != VERSION:
        raise ValueError("not a WARC/1.1 record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        name = key.decode("ascii").lower()
        if not colon or not key or name in fields:
            raise ValueError(f"bad or repeated header {line[:60]!r}")
        fields[name] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "x-payload-length", "content-length"):
        if name not in fields:
            raise ValueError(f"missing header {name}")
    length = int(fields["content-length"])
    if length < 0 or len(rest) != length + 4 or rest[length:] != CRLF * 2:
        raise ValueError("Content-Length does not match the record")
    algorithm, _, digest = fields["warc-payload-digest"].partition(":")
    if algorithm != "sha1" or len(digest) != 40 or digest.strip("0123456789abcdef"):
        raise ValueError("bad payload digest")
    kind, size, block = fields["warc-type"], int(fields["x-payload-length"]), rest[:length]

    def page(text: str):
        if not (text.startswith("<urn:x-page:") and text.endswith(">")):
            raise ValueError(f"bad record id {text[:60]!r}")
        return None if text[12:-1] == "null" else int(text[12:-1])

    if kind == "response":
        if size != length or hashlib.sha1(block).hexdigest() != digest or "warc-refers-to" in fields:
            raise ValueError("payload does not match its headers")
        refers = None
    elif kind == "revisit":
        if length or "warc-refers-to" not in fields:
            raise ValueError("bad revisit record")
        refers, block = page(fields["warc-refers-to"]), None
    else:
        raise ValueError(f"unknown record type {kind!r}")
    uri = fields.get("warc-target-uri", "").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": page(fields["warc-record-id"]), "target_uri": uri, "record_type": kind, "refers_to": refers,
            "payload_bytes": size, "payload_digest": digest, "payload": block}


def train_dictionary(payloads: list[bytes]):
    """A dictionary from a bounded sample of an archive's payloads; None where it is too small."""
    import zstandard as zs
    sample, left = [], SAMPLE_BYTES
    for p in payloads:
        if left <= 0:
            break
        if len(p) >= 64:
            sample.append(p[:64 << 10])
            left -= len(sample[-1])
    if len(sample) < 16:
        return None
    try:
        return zs.train_dictionary(DICTIONARY_BYTES, sample)
    except zs.ZstdError:
        return None


def archive_bytes(records: list[bytes], dictionary) -> bytes:
    import struct
    import zstandard as zs
    out = []
    if dictionary is not None:
        raw = dictionary.as_bytes()
        out.append(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
    c = zs.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return b"".join(out + [c.compress(r) for r in records])


def iter_frames(data):
    """(offset, record bytes) of every frame of one archive; raises ValueError on a broken one."""
    import struct
    import zstandard as zs
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8:8 + size]
        if len(raw) != size:
            raise ValueError("truncated dictionary frame")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the format allows a compressed dictionary
            raw = zs.ZstdDecompressor().decompressobj().decompress(raw)
        if raw[:4] != struct.pack("<I", ZSTD_DICTIONARY_MAGIC):
            raise ValueError("the leading frame holds no dictionary")
        dictionary, at = zs.ZstdCompressionDict(raw), 8 + size
    decompressor = zs.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(data)
    while at < len(data):
        d = decompressor.decompressobj()
        parts, start = [], at
        try:
            while not d.eof:
                if at >= len(data):
                    raise ValueError("truncated record frame")
                chunk = view[at:at + (1 << 16)]
                parts.append(d.decompress(chunk))
                at += len(chunk)
        except zs.ZstdError as e:
            raise ValueError(f"broken record frame: {e}") from e
        at -= len(d.unused_data)
        yield start, b"".join(parts)


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to) of ``pages`` (page_id, url, html).

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is the
    response.  Null html is an empty payload; rows with a null page_id are always responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"),
                        F.sha1(payload).alias("digest"))
    # one row per repeated payload, summed map-side; a hot payload's rows are split by AQE below
    repeated = (rows.where(F.col("size") >= min_bytes).groupBy("digest")
                .agg(F.max("page_id").alias("_last"), F.count("page_id").alias("_n")).where("_n > 1").drop("_n"))
    refers = F.when((F.col("page_id") != F.col("_last")), F.col("_last"))
    return rows.join(repeated, "digest", "left").withColumn("refers_to", refers).drop("_last")


def write_archives(records: DataFrame, folder: str, archive_bytes_limit: int = ARCHIVE_BYTES) -> list[str]:
    """Write every row of ``plan_records`` into archives below ``folder``, a URI that all executors
    reach; returns the folder of the finished archives.

    A task writes its archives under names of its partition through a temporary name, so a retried
    task replaces them; the rows of a partition are sorted, so it writes the same ones."""
    def run(batches):
        import uuid
        import pyarrow as pa
        from pyspark import TaskContext
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        done, held, held_bytes = 0, [], 0

        def close():
            nonlocal done, held, held_bytes
            if not held:
                return None
            dictionary = train_dictionary([p for p, r in held])
            data = archive_bytes([r for p, r in held], dictionary)
            name = f"{root}/part-{part:06d}-{done:06d}.warc.zst"
            temporary = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(data)
            store.move(temporary, name)
            done, n, held, held_bytes = done + 1, len(held), [], 0
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for s in slices(batch, "payload"):
                for r in s.to_pylist():
                    held.append((r["payload"], record_bytes(r["page_id"], r["url"], r["payload"], r["size"],
                                                            r["digest"], r["refers_to"])))
                    held_bytes += len(held[-1][1])
                    if held_bytes >= archive_bytes_limit:
                        yield close()
        if (last := close()) is not None:
            yield last

    manifest = records.sortWithinPartitions("page_id", "digest").mapInArrow(run, "archive string, records long")
    return manifest.agg(F.coalesce(F.sum("records"), F.lit(0)), F.count("archive")).first()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records (``RECORD``) of all archives in ``folder``, one frame each, fully validated.

    A broken archive or record fails the job with its place.  One task holds one archive."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
             .select("path", "content"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, held = [], 0
                data = content.as_py()
                for at, record in iter_frames(data):
                    try:
                        row = parse_record(record)
                    except ValueError as e:
                        raise ValueError(f"{path} at byte {at}: {e}") from e
                    rows.append({"archive": path, "record_offset": at, **row})
                    held += len(record)
                    if held >= (4 << 20):
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(RECORD)
    return files.mapInArrow(run, RECORD)


OP8_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last, count(page_id) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN m.n > 1 AND p.page_id <> m.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.n > 1 AND p.page_id <> m.last THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest
"""


@query("op8_warc", OP8_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, read the archives back and report each record."""
    folder = scratch_path(spark, "warc")
    expected, archives = write_archives(plan_records(table(spark, sf_dir, "pages")), folder)
    if not archives:
        return spark.createDataFrame([], RECORD).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
