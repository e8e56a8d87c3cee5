"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page, and every sorted partition writes its own
files, starting a new one when the compressed size reaches the limit.  All
headers are made from the record alone (ids from the page and payload, a
fixed date, recomputed digests), so a task that runs again writes the same
bytes.  A file is written under a name of its attempt, then renamed; only
files of the manifest table, which Spark commits as a whole, are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.llm.common import saved, scratch
from lakeledger.llm.registry import register, table

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
_MASK = (1 << 64) - 1


def digest32(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None, digest: str) -> str:
    """A UUID (version 8) that holds the page id and part of the digest."""
    word = (page_id or 0) & _MASK
    tag = zlib.crc32(digest.encode()) if page_id is not None else zlib.crc32(b"none" + digest.encode())
    value = (word >> 16) << 80 | 8 << 76 | (tag & 0xFFF) << 64 | 2 << 62 | (word & 0xFFFF) << 46 | (tag << 14) & ((1 << 46) - 1)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(urn: str) -> int:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    word = (value >> 80) << 16 | (value >> 46) & 0xFFFF
    return word - (1 << 64) if word >> 63 else word


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_bytes(page_id: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool) -> bytes:
    """One record: a response, or a revisit that names its response's page."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_urn(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_urn(original, digest)}", f"WARC-Refers-To-Date: {DATE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _store(folder: str):
    """The file system and path of a shared folder, from inside a task."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``payload, digest, original``: the page that a revisit refers to.

    Of equal payloads of at least ``min_bytes`` the largest page_id is the
    response; rows that repeat it are responses too.  A NULL page_id is never
    the largest; payloads of NULL ids only are all responses.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload"))
    first = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("low"), F.count("*").alias("m"))
    first = saved(first.where("m > 1").select("digest", F.col("n").alias("size"), "low"), "warc-copies")
    # Payloads that occur once need no partner; the join is on the rest.
    joined = rows.join(first.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("n") == F.col("size")), "left")
    other = F.col("low").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("low"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("low")).alias("original"), other.alias("revisit"))


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, min_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder`` and return the manifest.

    Every row is one record; NULL html is an empty payload, a NULL url or
    page_id leaves its header out.  Other columns are ignored.  The manifest
    has ``file, records, bytes`` and is saved as ``folder``'s committed list.
    No pages: no files.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (mark_revisits(pages, min_bytes).repartitionByRange(parts, "page_id", "url")
             .sortWithinPartitions("page_id", "url").withColumn("part", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        done, out, size, records, part = [], [], 0, 0, None

        def close() -> None:
            nonlocal out, size, records
            name = f"part-{part:06d}-{len(done):05d}.warc.gz"
            hidden = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden, compression=None) as f:
                for x in out:
                    f.write(x)
            store.move(hidden, f"{root}/{name}")
            done.append((name, records, size))
            out, size, records = [], 0, 0

        for b in batches:
            for page_id, url, payload, original, revisit, at in zip(*(c.to_pylist() for c in b.columns)):
                part = at
                data = _gzip(record_bytes(page_id, url, payload, original, revisit))
                out.append(data)
                size, records = size + len(data), records + 1
                if size >= roll_bytes:
                    close()
        if records:
            close()
        cols = list(zip(*done)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["file", "records", "bytes"])

    manifest = order.mapInArrow(run, "file string, records long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files in the manifest, digests checked.

    Returns ``page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, payload`` (NULL for revisits).  A block or payload that does
    not match its digest, or a file whose size is not the manifest's, fails.
    """
    manifest = spark.read.schema("file string, records long, bytes long").parquet(f"{folder}/manifest")
    files = manifest.repartition("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            for name, records, size in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(f"{root}/{name}") as f:
                    data = f.read()
                if len(data) != size:
                    raise ValueError(f"{name}: {len(data)} bytes, the manifest has {size}")
                rows, seen = [], 0
                while data:
                    z = zlib.decompressobj(31)
                    fields, block = parse_record(z.decompress(data))
                    data, seen = z.unused_data, seen + 1
                    rows.append(_row(fields, block))
                    if len(rows) == 256 or not data:
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
                        rows = []
                if seen != records:
                    raise ValueError(f"{name}: {seen} records, the manifest has {records}")

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError("a block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError("a payload does not match its digest")
    page = fields.get("X-Page-ID")
    refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return (None if page is None else int(page), fields.get("WARC-Target-URI"), kind, size, digest, refers, payload if kind == "response" else None)


ORACLE_OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
d AS (SELECT page_id, n, x, list_reduce(list_prepend('', list_transform(string_split(x, ''), lambda c: lpad(bin(CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), 4, '0'))), lambda a, c: a || c) AS bits FROM h),
e AS (SELECT page_id, n, x, list_reduce(list_prepend('', list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT)
    + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT) AS BIGINT), 1))), lambda a, c: a || c) AS digest FROM d),
f AS (SELECT *, max(page_id) OVER (PARTITION BY x, n) AS top FROM e)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM f
"""


@register("op8_warc_round_trip", ORACLE_OP8)
def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files into the shared folder and read back."""
    folder = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
