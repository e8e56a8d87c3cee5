"""Periodic runs of words: stretches that repeat a short sequence over and over.

A run is a maximal stretch of smallest period q and at least four periods
(six words at least).  Runs are found from longest common extensions:

* **Extensions.**  Only suffixes at positions of a difference cover (modulo
  13) are sorted, by their first 13 words and then by doubling.  Any two
  positions i, j have a shift t < 13 that brings both into the cover, so an
  extension compares t words at most and then reads a range minimum from a
  sparse table over the sorted samples' common prefixes.  The same on the
  reversed words gives extensions to the left.
* **Harmonic grid.**  A run of period q and length L has i, i + q inside for
  L - q neighbouring i, so a grid of step ``max(6, 4 q) - q`` meets it.  All
  q together ask n ln n / 3 questions about.  A question whose first words
  differ is done at once, and samples are sorted only for texts of which some
  comparison gets as far as a sample.

Many texts are handled in one set of arrays; each text's words are numbers of
its own and texts are kept apart by separators that equal nothing, so no
extension leaves its text.  Work is n log n for any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.llm.registry import register, table

#: A perfect difference set: every residue is a difference of two members.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Words handled in one set of arrays (a longer text makes its own set); grid points looked at together.
WORDS, POINTS = 1 << 17, 1 << 20

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
#: _SHIFT[i, j]: smallest t with i + t and j + t both in the cover.
_SHIFT = np.array([[next(t for t in range(MODULUS) if _IN_COVER[(i + t) % MODULUS] and _IN_COVER[(j + t) % MODULUS])
                    for j in range(MODULUS)] for i in range(MODULUS)])


def _apart(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array, unique separators around each; and where each text starts."""
    lens = np.array([len(t) for t in texts], np.int64)
    starts = MODULUS + np.r_[0, np.cumsum(lens + 1)[:-1]] if len(texts) else np.empty(0, np.int64)
    out = -1 - np.arange(2 * MODULUS + int((lens + 1).sum()), dtype=np.int64)
    for s, t in zip(starts, texts):
        out[s:s + len(t)] = t
    return out, starts


def _synchronise(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words from i and j up to their first common sample, and whether it is reached."""
    shift = _SHIFT[i % MODULUS, j % MODULUS]
    same, at = np.zeros(len(i), np.int64), np.arange(len(i))
    for t in range(MODULUS):
        at = at[shift[at] > t]
        at = at[words[i[at] + t] == words[j[at] + t]]
        if not len(at):
            break
        same[at] += 1
    return same, same == shift


def _refine(rank: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of ``at`` split by ``key`` in place; returns those still tied."""
    order = np.lexsort((key, rank[at]))
    at, r, k = at[order], rank[at][order], key[order]
    idx = np.arange(len(at))
    old = np.r_[True, r[1:] != r[:-1]]
    new = old | np.r_[True, k[1:] != k[:-1]]
    first = np.maximum.accumulate(np.where(new, idx, 0))
    rank[at] = r + first - np.maximum.accumulate(np.where(old, idx, 0))
    size = np.diff(np.r_[np.flatnonzero(new), len(at)])
    return at[np.repeat(size > 1, size)]


class CommonExtension:
    """Longest common extensions to the right over ``words`` (which ends in MODULUS unique separators)."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.samples = np.flatnonzero(_IN_COVER[np.arange(len(words)) % MODULUS])
        self.samples = self.samples[self.samples <= len(words) - MODULUS]
        m = len(self.samples)
        self.index = np.full(len(words), -1, np.int32)
        self.index[self.samples] = np.arange(m, dtype=np.int32)
        rank, tied = np.zeros(m, np.int64), np.arange(m)
        for t in range(MODULUS):
            tied = _refine(rank, words[self.samples[tied] + t], tied)
        levels, reach = [rank.astype(np.int32)], MODULUS
        while len(tied):
            after = self.samples[tied] + reach
            key = np.where(after < len(words), self.index[np.minimum(after, len(words) - 1)], -1)
            tied = _refine(rank, np.where(key >= 0, levels[-1][key], -1 - after), tied)
            levels.append(rank.astype(np.int32))
            reach *= 2
        self.rank = levels[-1]
        self._minima(self._neighbours(levels))

    def _neighbours(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix length of each sample and the next one in order."""
        by_rank = np.empty(len(self.rank), np.int64)
        by_rank[self.rank] = self.samples
        a, b = by_rank[:-1].copy(), by_rank[1:].copy()
        out, end = np.zeros(len(a), np.int64), len(self.words)
        for level in range(len(levels) - 1, -1, -1):
            ia, ib = self.index[np.minimum(a, end - 1)], self.index[np.minimum(b, end - 1)]
            far = np.where((ia >= 0) & (ib >= 0) & (levels[level][ia] == levels[level][ib]), MODULUS << level, 0)
            out, a, b = out + far, a + far, b + far
        at = np.arange(len(a))
        for _ in range(MODULUS):
            at = at[self.words[np.minimum(a[at], end - 1)] == self.words[np.minimum(b[at], end - 1)]]
            if not len(at):
                break
            out[at], a[at], b[at] = out[at] + 1, a[at] + 1, b[at] + 1
        return out

    def _minima(self, lcp: np.ndarray) -> None:
        self.table, width = [lcp.astype(np.int32)], 1
        while 2 * width <= len(lcp):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the sampled positions i and j (i <> j)."""
        a, b = self.rank[self.index[i]], self.rank[self.index[j]]
        lo, hi = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for lv in np.unique(level):
            at = level == lv
            t = self.table[lv]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << int(lv))])
        return out

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same, reached = _synchronise(self.words, i, j)
        same[reached] += self.between(i[reached] + same[reached], j[reached] + same[reached])
        return same


def _grid(lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grid points (text, position, period) of all texts and periods, POINTS at a time or one period's."""
    per_text = np.where(lens >= 6, lens // 4, 0)
    text = np.repeat(np.arange(len(lens)), per_text)
    period = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + 1
    step = np.maximum(6, 4 * period) - period
    count = -((period - lens[text]) // step)
    total = np.cumsum(count)
    lo = 0
    while lo < len(text):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + POINTS, side="right")))
        c = count[lo:hi]
        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(text[lo:hi], c), nth * np.repeat(step[lo:hi], c), np.repeat(period[lo:hi], c)
        lo = hi


def runs_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the texts (arrays of word numbers): text, start, length, period, sorted by text, start, period."""
    lens = np.array([len(t) for t in texts], np.int64)
    words, starts = _apart(texts)
    found, asked = [], []
    for text, i, q in _grid(lens):
        at = starts[text] + i
        hit = words[at] == words[at + q]
        text, at, q = text[hit], at[hit], q[hit]
        if not len(at):
            continue
        right, r_open = _synchronise(words, at, at + q)
        left, l_open = _synchronise(words[::-1], len(words) - at, len(words) - at - q)
        open_ = r_open | l_open
        asked.append((text[open_], at[open_] - starts[text[open_]], q[open_]))
        found.append([x[~open_] for x in (text, at - starts[text] - left, left + right, q)])
    if asked:
        text, i, q = map(np.concatenate, zip(*asked))
        if len(text):
            found.append(_extended(texts, text, i, q))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    text, start, equal, q = map(np.concatenate, zip(*found))
    keep = equal >= np.maximum(6, 4 * q) - q
    text, start, length, q = text[keep], start[keep], (equal + q)[keep], q[keep]
    # A multiple of the period has the same stretch: the smallest stays.
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    if len(text):
        first = np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
        text, start, length, q = text[first], start[first], length[first], q[first]
    order = np.lexsort((q, start, text))
    return text[order], start[order], length[order], q[order]


def _extended(texts: list[np.ndarray], text: np.ndarray, i: np.ndarray, q: np.ndarray) -> tuple:
    """Stretches around the grid points: samples are sorted for the texts asked about only."""
    which = np.unique(text)
    words, starts = _apart([texts[t] for t in which])
    at = starts[np.searchsorted(which, text)] + i
    right = CommonExtension(words).extend(at, at + q)
    left = CommonExtension(np.ascontiguousarray(words[::-1])).extend(len(words) - at, len(words) - at - q)
    return text, i - left, left + right, q


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """Words joined by one space, without those of a run after its first period."""
    if not len(start):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    keep = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[k] for k in keep])


def with_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """``docs`` with its periodic runs and its text without the repetitions.

    ``runs_col``: array of (start, length, period) in words numbered from 0,
    by start, then period; empty if there are none.  ``collapsed_col``: the
    words joined by one space, each run cut to its first period; never NULL.
    Words are runs without ASCII white space, compared as they stand.  NULL
    and empty texts have no words.  Every row is handled by itself, so
    repeated rows and NULL ids change nothing; an empty table stays empty.
    All columns stay; the two new names must be free.
    """
    clash = {runs_col, collapsed_col} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    run_type = "array<struct<start:bigint,length:bigint,period:bigint>>"
    out = docs.withColumns({runs_col: F.lit(None).cast(run_type), collapsed_col: F.lit(None).cast("string")}).schema
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(t.as_py() or b"").split() for t in batch.column(at).cast(pa.binary())]
            lo = 0
            while lo < len(split):
                hi, size = lo, 0
                while hi < len(split) and (hi == lo or size + len(split[hi]) <= WORDS):
                    size += len(split[hi])
                    hi += 1
                yield _with_runs(batch.slice(lo, hi - lo), split[lo:hi], names)
                lo = hi

    names = out.names
    return docs.mapInArrow(add, out)


def _with_runs(batch: pa.RecordBatch, split: list[list[bytes]], names: list[str]) -> pa.RecordBatch:
    known = _Numbers()
    text, start, length, period = runs_of([np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in split])
    cut = np.searchsorted(text, np.arange(len(split) + 1))
    kept = [_collapse(w, start[a:b], length[a:b], period[a:b]) for w, a, b in zip(split, cut, cut[1:])]
    runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([*batch.columns, runs, pa.array(kept, pa.binary()).cast(pa.string())], names=names)


def planted(doc_id: Column, text: Column) -> Column:
    """The text that the query looks at: where crc32(doc_id) is divisible by ten, a tail of it becomes periodic.

    Of such a text's n words, word i >= a becomes word a + (i - a) mod p.  A
    NULL id plants nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.nullif(F.size(words), F.lit(0))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise(text)


@register("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as s, -r.period as p)))")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return with_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
