"""Packing documents into fixed-length sequences along a space-filling curve.

Each document's tokens are counted into hashed buckets, the normalised
vector is projected to a few dimensions by a fixed random matrix, and the
place of that point on a Hilbert curve is the document's key.  Documents are
range-sorted by the key and laid end to end, so a sequence holds documents
that lie near each other on the curve.  Documents are cut where a sequence
is full; only the end of the whole corpus can leave a remainder, and that is
split into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeledger.llm.bpe import codec_of
from lakeledger.llm.common import saved, share, shared
from lakeledger.llm.registry import register, table

BUCKETS = 256
DIMENSIONS = 4
BITS = 15


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n, dims) below 2**bits.

    Gray-code and rotation steps per bit plane, on all points at once.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curve_keys(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids lie end to end."""
    rng = np.random.RandomState(11)
    project = rng.standard_normal((BUCKETS, DIMENSIONS))
    bucket = ((np.arange(1 << 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64) % BUCKETS
    n = len(offsets) - 1
    if not n:
        return np.empty(0, np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc * BUCKETS + bucket[ids % len(bucket)], minlength=n * BUCKETS).reshape(n, BUCKETS)
    norm = np.sqrt((counts.astype(float) ** 2).sum(1, keepdims=True))
    point = 0.5 + 0.5 * np.tanh((counts / np.maximum(norm, 1)) @ project)
    return hilbert_key((point * ((1 << BITS) - 1)).astype(np.int64))


def tail_bounds(total: int, length: int) -> list[int]:
    """Where the sequences after the last full one begin; lengths are powers of two."""
    at = total - total % length
    out = []
    for bit in reversed(range(length.bit_length())):
        if (total - at) >> bit & 1:
            out.append(at)
            at += 1 << bit
    return out


def pack(docs: DataFrame, length: int = 4096, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents, placed in sequences of ``length`` tokens.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Returns
    one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``, and ``ids`` (little-endian unsigned 16-bit ids, or
    32-bit beyond 65,536 ids).  A NULL or empty text is a document of one
    token, ``end_id``.  Repeated rows and rows with equal or NULL ``doc_id``
    are documents of their own.  No documents: no rows.

    Only ``(row, key, size)`` is range-sorted; the ids are shuffled once.
    """
    spark = docs.sparkSession
    codec = codec_of(vocabulary)
    kind = np.dtype("<u2" if codec.size <= 1 << 16 else "<u4")
    handle = share(spark, codec)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(handle)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                flat, ends = codec.encode(part.column(2).to_pylist())
                n = part.num_rows
                ids = np.insert(flat, ends[1:], end_id)
                ends = ends + np.arange(n + 1)
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(curve_keys(ids, ends)), pa.array(np.diff(ends)), data],
                                                 names=["row", "doc_id", "key", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = saved(rows.mapInArrow(tokens, "row long, doc_id long, key long, n long, ids binary"), "pack-ids")

    def run_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            n = b.column(1).to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends - n), b.column(1), b.column(2)], names=["row", "local", "n", "part"])
            at = int(ends[-1]) if len(ends) else at

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (coded.select("row", "n", "key", "doc_id").repartitionByRange(parts, "key", "doc_id", "row")
             .sortWithinPartitions("key", "doc_id", "row").select("row", "n", F.spark_partition_id().alias("part")))
    order = saved(order.mapInArrow(run_up, "row long, local long, n long, part int"), "pack-order")
    # One row per range partition: the tokens before it.
    sums = order.groupBy("part").agg(F.sum("n").alias("tokens"))
    before = sums.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    full = total - total % length
    tail = np.array(tail_bounds(total, length), np.int64)
    placed = order.join(before, "part").select("row", (F.col("before") + F.col("local")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out: list[tuple] = []
                for doc_id, raw, at in zip(*(c.to_pylist() for c in part.columns)):
                    n, start = len(raw) // kind.itemsize, 0
                    while start < n:
                        here = at + start
                        if here < full:
                            seq, offset = divmod(here, length)
                            end = (seq + 1) * length
                        else:
                            i = int(np.searchsorted(tail, here, "right")) - 1
                            seq, offset = full // length + i, here - int(tail[i])
                            end = int(tail[i + 1]) if i + 1 < len(tail) else total
                        size = min(n - start, end - here)
                        ids = raw[start * kind.itemsize:(start + size) * kind.itemsize]
                        crc = zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes())
                        out.append((doc_id, start, size, crc, n, seq, offset, ids))
                        start += size
                types = [pa.int64()] * 7 + [pa.binary()]
                cols = list(zip(*out)) if out else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    joined = coded.select("row", "doc_id", "ids").join(placed, "row").select("doc_id", "ids", "at")
    return joined.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


@register("op7_pack_sequences")
def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
