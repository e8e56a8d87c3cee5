"""Phrase collocations of each language by the stripes pattern.

A *stripe* is a prefix of one or two words with an associative counter of the
words that follow it (the empty word: the piece ends).  Tasks count in stripes
of their own, which are then merged elementwise.  Everything asked for is read
off merged stripes: the extensions of a prefix are the counter's entries, a
word's count is the total of its stripe, and what subsumes a phrase is the
largest entry of the stripe that it is the prefix of, and the largest entry
that ends with it.

A stripe of a frequent word grows with the vocabulary, so stripes are cut into
SEGMENTS by the next word's hash; a segment is the unit that is shuffled and
merged, and merging streams over sorted rows.  A task sends one row per
prefix and segment, however often a phrase occurs in its texts.  A segment
that still holds more than MERGE different words is not kept in one task: its
sums so far are sent on, entry by entry, and added up by their full key.

Stripes of two words are counted in a second pass over the texts, only where
both of their word pairs may be frequent: a bitmap of 2**BITMAP_BITS cells
(16 MB at any scale) marks the frequent pairs.  It has no false negatives; a
false positive costs a row, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeledger.llm.common import saved
from lakeledger.llm.registry import register, table

#: Segments of a stripe.
SEGMENTS = 8
#: log2 of the cells that mark frequent word pairs.
BITMAP_BITS = 27
#: Tokens counted at a time, entries and words that a task holds before it sends its stripes.
TOKENS, ENTRIES, WORDS = 1 << 18, 1 << 21, 1 << 20
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: Entries merged at a time; a segment with more distinct next words is added up entry by entry.
MERGE = 1 << 19

_SHIFT, _BREAK = 21, 0
_MASK = (1 << _SHIFT) - 1
#: Ends of pieces become line feeds, tabs become spaces.
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")

_STRIPE = "lang string, prefix string, seg int, next array<string>, n array<bigint>"
_MERGED = "lang string, prefix string, seg int, total bigint, next array<string>, n array<bigint>, open boolean"


class _Words(dict):
    """Numbers of a language's words; all languages share one sequence of numbers."""

    def __init__(self, lang: str, task: "_Stripes"):
        super().__init__({b"\n": _BREAK})
        self.lang, self.task = lang, task
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)

    def __missing__(self, word: bytes) -> int:
        task = self.task
        self[word] = number = len(task.words)
        task.words.append(word)
        task.langs.append(self.lang)
        task.hashes[number] = xxhash.xxh64_intdigest(word, self.seed)
        return number


class _Stripes:
    """A task's stripes: prefixes of ``order`` words packed with the next word into one number."""

    def __init__(self, order: int, frequent: np.ndarray | None):
        self.order, self.frequent = order, frequent
        self.hashes = np.zeros(1 << _SHIFT, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.words, self.langs, self.by_lang = [b""], [""], {}
        self.waiting, self.size, self.parts, self.entries = [], 0, [], 0

    def add(self, lang: str, tokens: list[bytes]) -> None:
        known = self.by_lang.get(lang)
        if known is None:
            known = self.by_lang[lang] = _Words(lang, self)
        self.waiting.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)
        if self.size >= TOKENS:
            self.count()

    def full(self) -> bool:
        return len(self.words) > WORDS or self.entries > ENTRIES

    def count(self) -> None:
        """Waiting tokens into packed entries; entries are added up when they double."""
        if not self.size:
            return
        ids = np.concatenate(self.waiting)
        self.waiting, self.size = [], 0
        m = max(0, len(ids) - self.order)
        at = [ids[j:j + m] for j in range(self.order + 1)]
        ok = at[0] != _BREAK
        for nxt in at[1:self.order] if self.order == 1 else at[1:]:
            ok &= nxt != _BREAK
        if self.frequent is not None:
            for a, b in zip(at, at[1:]):
                cell = (self.hashes[a] ^ (self.hashes[b] << np.uint64(1))) >> np.uint64(64 - BITMAP_BITS)
                ok &= (self.frequent[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
        key = at[0][ok]
        for nxt in at[1:]:
            key = key << _SHIFT | nxt[ok]
        self.parts.append(np.unique(key, return_counts=True))
        self.entries += len(self.parts[-1][0])
        if self.entries > ENTRIES:
            key, n = map(np.concatenate, zip(*self.parts))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.parts = [(key[first], np.add.reduceat(n, first))]
            # Full only once adding up no longer halves the entries.
            self.entries = len(first) if len(first) > ENTRIES // 2 else 0

    def send(self) -> Iterator[pa.RecordBatch]:
        """The stripes so far, as rows; the memory starts anew."""
        self.count()
        if self.parts and sum(len(k) for k, _ in self.parts):
            key, n = map(np.concatenate, zip(*self.parts))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            words = pa.array(self.words, pa.binary()).cast(pa.string())
            langs = pa.array(self.langs, pa.string())
            prefix, nxt = key >> _SHIFT, key & _MASK
            seg = np.where(nxt == _BREAK, 0, self.hashes[nxt] % np.uint64(SEGMENTS)).astype(np.int64)
            order = np.argsort(prefix * SEGMENTS + seg, kind="stable")
            prefix, nxt, seg, n = prefix[order], nxt[order], seg[order], n[order]
            first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (seg[1:] != seg[:-1])])
            for lo in range(0, len(first), 1 << 16):
                rows = first[lo:lo + (1 << 16)]
                end = int(first[lo + len(rows)]) if lo + len(rows) < len(first) else len(key)
                p, s = prefix[rows], slice(int(rows[0]), end)
                name = words.take(pa.array(p & _MASK))
                if self.order == 2:
                    name = pc.binary_join_element_wise(words.take(pa.array(p >> _SHIFT)), name, " ")
                offsets = pa.array(np.r_[rows - rows[0], end - rows[0]], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(p & _MASK)), name, pa.array(seg[rows], pa.int32()),
                     pa.ListArray.from_arrays(offsets, words.take(pa.array(nxt[s]))), pa.ListArray.from_arrays(offsets, pa.array(n[s]))],
                    names=["lang", "prefix", "seg", "next", "n"])
        self.clear()


def stripes(docs: DataFrame, order: int, frequent: Callable[[], np.ndarray] | None = None) -> DataFrame:
    """Stripes of ``docs(lang, text)`` as counted by each task; ``lang`` and the words hold no NULL."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Stripes(order, frequent() if frequent else None)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                tokens = text.as_py().lower().translate(_PIECES).replace(b"\n", b" \n ").split(b" ")
                tokens = [b"\n", *filter(None, tokens), b"\n"]
                # A slice repeats the last words of the one before, so every phrase ends in one slice.
                for lo in range(0, len(tokens), TOKENS):
                    task.add(lang.as_py(), tokens[max(0, lo - order):lo + TOKENS])
                    if len(tokens) > TOKENS:
                        task.count()
                    if task.full():
                        yield from task.send()
        yield from task.send()

    return docs.select("lang", "text").mapInArrow(count, _STRIPE)


def merged(found: DataFrame, least: int, name: str) -> DataFrame:
    """Stripes merged elementwise: rows per segment with their total and their entries of ``least`` or more."""
    def same(t: pa.Table) -> np.ndarray:
        """Whether a row has the key of the row before."""
        out = np.ones(max(0, t.num_rows - 1), bool)
        for name in ("lang", "prefix", "seg"):
            col = t.column(name).combine_chunks()
            out &= pc.equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        return out

    def add(t: pa.Table, least: int) -> pa.Table:
        new = np.r_[True, ~same(t)]
        first = np.flatnonzero(new)
        lists = t.column("next").combine_chunks()
        counts = t.column("n").combine_chunks()
        row = np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists).to_numpy())
        sums = pa.table({"row": row, "next": lists.flatten(), "n": counts.flatten()}).group_by(["row", "next"], use_threads=False).aggregate([("n", "sum")])
        row, n = sums.column("row").to_numpy(), sums.column("n_sum").to_numpy()
        total = np.zeros(len(first), np.int64)
        np.add.at(total, row, n)
        keep = np.flatnonzero(n >= least)
        keep = keep[np.argsort(row[keep], kind="stable")]
        offsets = pa.array(np.searchsorted(row[keep], np.arange(len(first) + 1)), pa.int32())
        nxt = sums.column("next").combine_chunks().take(pa.array(keep))
        keys = t.select(["lang", "prefix", "seg"]).take(pa.array(first)).combine_chunks()
        return (keys.append_column("total", pa.array(total)).append_column("next", pa.ListArray.from_arrays(offsets, nxt))
                .append_column("n", pa.ListArray.from_arrays(offsets, pa.array(n[keep]))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(t: pa.Table, least: int, open_: bool) -> Iterator[pa.RecordBatch]:
            t = add(t, least)
            yield from t.append_column("open", pa.array(np.full(t.num_rows, open_))).to_batches()

        # wide: the segment coming last has been sent in part already.
        held, size, wide = [], 0, False
        for batch in batches:
            size += pc.sum(pc.list_value_length(batch.column("next"))).as_py() or 0
            held.append(batch)
            if size < MERGE:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            ends = np.flatnonzero(~same(t)) + 1
            if len(ends):
                done = int(ends[0]) if wide else 0
                yield from rows(t.slice(0, done), 0, True) if wide else ()
                yield from rows(t.slice(done, int(ends[-1]) - done), least, False) if ends[-1] > done else ()
                t, wide = t.slice(int(ends[-1])), False
            t = add(t, 0)
            size = pc.sum(pc.list_value_length(t.column("next"))).as_py()
            held = t.select(["lang", "prefix", "seg", "next", "n"]).to_batches()
            if 2 * size > MERGE:
                yield from rows(pa.Table.from_batches(held), 0, True)
                held, size, wide = held[0:0], 0, True
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            ends = np.flatnonzero(~same(t)) + 1
            done = (int(ends[0]) if len(ends) else t.num_rows) if wide else 0
            yield from rows(t.slice(0, done), 0, True) if done else ()
            yield from rows(t.slice(done), least, False) if done < t.num_rows else ()

    sorted_ = found.repartition("lang", "prefix", "seg").sortWithinPartitions("lang", "prefix", "seg")
    out = saved(sorted_.mapInArrow(merge, _MERGED), name)
    part = (out.where("open").select("lang", "prefix", "seg", F.explode(F.arrays_zip("next", "n")).alias("e"))
            .groupBy("lang", "prefix", "seg", F.col("e.next").alias("next")).agg(F.sum("e.n").alias("n")))
    none = F.filter(F.array("next"), lambda x: F.lit(False))
    enough = F.col("n") >= least
    return out.where("not open").drop("open").unionByName(part.select(
        "lang", "prefix", "seg", F.col("n").alias("total"), F.when(enough, F.array("next")).otherwise(none).alias("next"),
        F.when(enough, F.array("n")).otherwise(F.array().cast("array<bigint>")).alias("n")))


def _entries(stripes_: DataFrame) -> DataFrame:
    """``(lang, prefix, next, a)``: the extensions held by the stripes, without ends of pieces."""
    both = stripes_.select("lang", "prefix", F.explode(F.arrays_zip("next", "n")).alias("e"))
    return both.select("lang", "prefix", F.col("e.next").alias("next"), F.col("e.n").alias("a")).where("next <> ''")


def pair_bitmap(pairs: DataFrame) -> Callable[[], np.ndarray]:
    """Cells of the frequent pairs ``(lang, prefix, next)``, broadcast; called in a task it gives the bitmap."""
    cell = F.shiftrightunsigned(F.xxhash64("lang", "prefix").bitwiseXOR(F.shiftleft(F.xxhash64("lang", "next"), 1)), 64 - BITMAP_BITS)
    # Positions in a bucket are 1 to 32768 for values 1 to 32768.
    value = cell + 1
    blocks = (pairs.groupBy(F.call_function("bitmap_bucket_number", value).alias("bucket"))
              .agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", value)).alias("bits")))
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for bucket, bits in blocks.collect():
        bitmap[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bits, np.uint8)
    handle = pairs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    return lambda: np.frombuffer(handle.value, np.uint8)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, subsume_percent: int = 50, top: int = 2000) -> DataFrame:
    """The strongest phrases of two and three words of each language.

    Texts are lower-cased in A-Z and split at ``.,;:!?`` and line ends into
    pieces, those at spaces and tabs into words.  Candidates occur ``least``
    times or more inside pieces, overlaps included.  Score: the least over all
    cuts into first part and rest of ``floor(1000000 a a / (l r))``, ties to
    the earlier cut.  A pair inside a candidate of three words with
    ``subsume_percent`` of its count or more is left out.  Returns
    ``(lang, rank, phrase, a, l, r, n, score)``, the first ``top`` of each
    language; n counts the language's words.

    NULL texts are empty, a NULL language is ``und``; ties rank by phrase.
    Repeated rows count each.  Other columns are not read.  An empty table, or
    one without candidates, gives no row.
    """
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    first = merged(stripes(src, 1), least, "stripes-one")
    every = first.groupBy("lang", "prefix").agg(F.sum("total").alias("f"))
    words = saved(every.where(F.col("f") >= least), "stripes-words")
    totals = first.groupBy("lang").agg(F.sum("total").alias("n"))
    pairs = saved(_entries(first), "stripes-pairs")
    second = merged(stripes(src, 2, pair_bitmap(pairs)), least, "stripes-two")
    triples = saved(_entries(second).select("lang", "prefix", "next", "a", F.substring_index("prefix", " ", 1).alias("w1"),
                                            F.concat_ws(" ", F.substring_index("prefix", " ", -1), "next").alias("rest")), "stripes-triples")
    phrase = F.concat_ws(" ", "prefix", "next").alias("phrase")

    def count(name: str, key: str) -> DataFrame:
        return words.select("lang", F.col("prefix").alias(key), F.col("f").alias(name))

    def of_pair(name: str, key: str) -> DataFrame:
        return pairs.select("lang", phrase.alias(key), F.col("a").alias(name))

    over = (triples.select("lang", F.col("prefix").alias("phrase"), "a").unionByName(triples.select("lang", F.col("rest").alias("phrase"), "a"))
            .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (pairs.select("lang", "prefix", "next", "a", phrase).join(over, ["lang", "phrase"], "left")
            .where(F.coalesce(100 * F.col("longer") < subsume_percent * F.col("a"), F.lit(True))))

    def exact(left: str, right: str):
        return F.expr(f"cast(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0)) as decimal(38,0)) "
                      f"div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")

    two = (kept.join(count("l", "prefix"), ["lang", "prefix"]).join(count("r", "next"), ["lang", "next"])
           .select("lang", "phrase", "a", "l", "r", exact("l", "r").alias("score")))
    three = (triples.select("lang", phrase, "a", "prefix", "next", "w1", "rest")
             .join(count("l1", "w1"), ["lang", "w1"]).join(of_pair("r1", "rest"), ["lang", "rest"])
             .join(of_pair("l2", "prefix"), ["lang", "prefix"]).join(count("r2", "next"), ["lang", "next"])
             .withColumns({"s1": exact("l1", "r1"), "s2": exact("l2", "r2")})
             .select("lang", "phrase", "a", *(F.when(F.col("s1") <= F.col("s2"), F.col(x + "1")).otherwise(F.col(x + "2")).alias(y)
                                              for x, y in (("l", "l"), ("r", "r"), ("s", "score")))))
    # The first ranks of each part of a language before those of the language: no task sees all its phrases.
    by = [F.desc("score"), F.desc("a"), F.col("phrase")]
    scored = two.unionByName(three).withColumn("part", F.pmod(F.hash("phrase"), F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= top)
    return scored.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_OP12 = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 10),
cuts AS (SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp
         FROM c, (VALUES (1), (2)) cs(cut) WHERE cut < k),
s AS (SELECT cuts.*, fl.a AS l, fr.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (fl.a::HUGEINT * fr.a))::BIGINT AS score
      FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = lp JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
      UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2 WHERE coalesce(100 * longer < 50 * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, ranked.r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""


@register("op12_stripes_collocations", ORACLE_OP12)
def stripes_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
