"""Near-duplicate classes of documents by SimHash and pivot distance tables.

A document's fingerprint has a bit set if more than half of its word
shingles' XXH64 hashes have it (repeats count).  Fingerprints link at
``radius`` or fewer differing bits; the result is the connected components.

Equal fingerprints are one row from the start, so copies cost one aggregate.
Each distinct fingerprint x gets a table of Hamming distances to reference
fingerprints, the pivots.  For any pivot p, ``|d(x, p) - d(y, p)| <= d(x, y)``,
so a pair whose largest coordinate difference passes the radius is no link.

The pivots are of two kinds:

* The zero fingerprint and, for each block of neighbouring bits, the one that
  is set in this block only.  The difference of the distances to the two tells
  the ones inside the block.  A link changes at most ``radius`` blocks, so
  with the blocks in G groups some G - radius groups keep their coordinates
  exactly.  Rows with equal coordinates in one such choice of groups make a
  cell; every linked pair shares a cell.
* Spread pivots with bits of their own.  Inside a cell, pairs are discarded by
  the largest coordinate difference over them; survivors are verified.

A cell sends back one spanning link per row at most, never its pairs.  Cells
of more than CELL rows are not compared: their rows go through a second
table with pivots of single bits, whose cells hold ``2**(4 * radius)``
fingerprints at most, whatever the data.  Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.llm.common import components, saved
from lakeledger.llm.registry import register, table

#: Bits of a block of the coarse table, and groups beyond the radius that its blocks are dealt to.
BLOCK_BITS, SPARE_GROUPS = 4, 4
#: Groups of the fine table; each has 64 / FINE_GROUPS single-bit pivots.
FINE_GROUPS = 16
#: Rows of a coarse cell that are compared in place.
CELL = 1024
#: Spread pivots of the comparison inside a cell.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(12)], np.uint64)
#: Rows read before complete cells are compared; pairs kept before they are folded into labels.
ROWS, PAIRS = 1 << 17, 1 << 21
#: Shingles counted at a time.
SHINGLES = 1 << 14


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of a text as an unsigned int.

    ASCII letters are lower-cased; words are runs without ASCII white space.
    Fewer words than a shingle has: the whole sequence is the one shingle.
    No words, or no text: zero.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    width = min(words, len(found))
    total, ones = len(found) - width + 1, np.zeros(64, np.int64)
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    for lo in range(0, total, SHINGLES):
        n = min(SHINGLES, total - lo)
        parts = zip(*(found[lo + i:lo + i + n] for i in range(width)))
        h = np.fromiter(map(digest, map(b" ".join, parts)), np.uint64, n)
        ones += np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row ``(id, fp)`` per row of ``docs``, fp as a signed long."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.select("id", F.lit(0).cast("long").alias("fp")).schema

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(sign, out)


def _deal(items: int, groups: int) -> list[range]:
    """``items`` in ``groups`` runs of nearly equal length."""
    cut = [items * g // groups for g in range(groups + 1)]
    return [range(cut[g], cut[g + 1]) for g in range(groups)]


def coarse_keys(fp: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """One cell key per choice of groups that keep their coordinates, from the distances to block pivots."""
    to_zero = np.bitwise_count(fp).astype(np.int64)
    pivots = [np.uint64(((1 << BLOCK_BITS) - 1) << lo) for lo in range(0, 64, BLOCK_BITS)]
    ones = [(to_zero - np.bitwise_count(fp ^ p) + BLOCK_BITS) // 2 for p in pivots]
    groups = _deal(len(pivots), radius + SPARE_GROUPS)
    for dropped in combinations(range(len(groups)), radius):
        key = np.zeros(len(fp), np.int64)
        for b in (b for g, blocks in enumerate(groups) if g not in dropped for b in blocks):
            key = key * (BLOCK_BITS + 1) + ones[b]
        yield key


def fine_keys(fp: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """As ``coarse_keys`` with a pivot for each single bit: a kept group's coordinates are its bits."""
    groups = _deal(64, FINE_GROUPS)
    for dropped in combinations(range(FINE_GROUPS), radius):
        kept = sum(1 << b for g, bits in enumerate(groups) if g not in dropped for b in bits)
        yield (fp & np.uint64(kept)).view(np.int64)


def cells(prints: DataFrame, keys: Callable[[np.ndarray, int], Iterator[np.ndarray]], radius: int) -> DataFrame:
    """``(c, k, fp)``: each fingerprint of ``prints(fp)`` in its cell of every choice c."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for c, key in enumerate(keys(fp.view(np.uint64), radius)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), c, np.int32)), pa.array(key), batch.column(0)], names=["c", "k", "fp"])

    return prints.select("fp").mapInArrow(place, "c int, k long, fp long")


def _fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining rows a and b: the smallest row of each component."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def link_cells(fp: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows in the same cell (``cell``: sorted cell numbers)."""
    n = len(fp)
    # Distances to the pivots, less the one to a row's own: one byte each.
    near = np.bitwise_count(fp[None, :] ^ PIVOTS[:, None]).astype(np.int8)
    end = np.searchsorted(cell, cell, side="right")
    label, pairs, held = np.arange(n), [], 0
    rows = np.flatnonzero(end > np.arange(n) + 1)
    step = 1
    while len(rows):
        for lo in range(0, len(rows), ROWS):
            a = rows[lo:lo + ROWS]
            b = a + step
            for d in near:
                close = np.abs(d[a] - d[b]) <= radius
                a, b = a[close], b[close]
            linked = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            pairs.append((a[linked], b[linked]))
            held += int(linked.sum())
        if held > PAIRS:
            label, pairs, held = _fold(label, *map(np.concatenate, zip(*pairs))), [], 0
        step += 1
        rows = rows[end[rows] > rows + step]
    if pairs:
        label = _fold(label, *map(np.concatenate, zip(*pairs)))
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def cell_links(placed: DataFrame, radius: int) -> DataFrame:
    """Links ``(a, b)`` that span each cell's components; cells are compared whole, a few at a time."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(c, k, fp):
            new = np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])]
            a, b = link_cells(fp.view(np.uint64), np.cumsum(new), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list = []
        for batch in batches:
            held.append([col.to_numpy(zero_copy_only=False) for col in batch.columns])
            if sum(len(h[0]) for h in held) < ROWS:
                continue
            c, k, fp = map(np.concatenate, zip(*held))
            last = int(np.flatnonzero((c != c[-1]) | (k != k[-1]))[-1]) + 1 if (c[0], k[0]) != (c[-1], k[-1]) else 0
            if last:
                yield links(c[:last], k[:last], fp[:last])
            held = [[c[last:], k[last:], fp[last:]]]
        if held:
            yield links(*map(np.concatenate, zip(*held)))

    return placed.repartition("c", "k").sortWithinPartitions("c", "k").mapInArrow(compare, "a long, b long")


def print_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links that span the components of the distinct fingerprints ``prints(fp)``."""
    placed = cells(prints, coarse_keys, radius)
    hot = saved(placed.groupBy("c", "k").count().where(F.col("count") > CELL).select("c", "k"), "simhash-hot")
    links = cell_links(placed.join(hot, ["c", "k"], "left_anti").select("c", "k", "fp"), radius)
    dense = saved(placed.join(hot, ["c", "k"], "left_semi").select("fp").distinct(), "simhash-dense")
    return links.unionByName(cell_links(cells(dense, fine_keys, radius), radius)).distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint and near-duplicate class of every row of ``docs``.

    Returns ``(id_col, fingerprint, component_id)``: 16 lowercase hex digits
    and the smallest id of the class.  NULL and empty texts have fingerprint
    zero and link like any other.  Repeated rows each have a row; an id with
    several texts has a row for each.  NULL ids never name a class that holds
    another id; a class of NULL ids only has a NULL component.  Other columns
    of ``docs`` are not read.  An empty table gives an empty result.
    ``radius`` may be 1 to 3.
    """
    if not 1 <= radius <= 3:
        raise ValueError("radius must be 1 to 3")
    signed = saved(fingerprints(docs, id_col, text_col, words), "simhash-signed")
    prints = saved(signed.groupBy("fp").agg(F.min("id").alias("low")), "simhash-prints")
    comp = components(print_links(prints.select("fp"), radius), "simhash-components").withColumnRenamed("node", "fp")
    joined = saved(prints.join(comp, "fp"), "simhash-joined")
    low = joined.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = (joined.join(low, "comp").select("fp", "component_id")
             .unionByName(prints.join(comp, "fp", "left_anti").select("fp", F.col("low").alias("component_id"))))
    return signed.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op11_simhash_classes")
def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), words=3, radius=2)
