"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array.  Each round
forms the keys of adjacent pairs, finds their merge ranks by binary search
over the sorted pair keys, takes the lowest rank of every word and merges
its occurrences, all as array operations over all words at once.  Words that
are done leave the array.  Results are kept per whitespace-free chunk of
text, so a chunk seen before costs one dictionary lookup.

Tables come from a ``tokenizers`` JSON file whose steps are the ones this
module implements; anything else is refused when the file is loaded.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger.llm.common import share, shared
from lakeledger.llm.registry import register, table

#: Chunks kept per Python worker; beyond this the memory is emptied and filled anew.
CACHE_CHUNKS = 700_000
#: Unicode white space.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Python's extra separators that are no Unicode white space.
_ODD_SPACES = "\x1c\x1d\x1e\x1f"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def codec_of(path: str | None = None) -> Codec:
    """The codec of a vocabulary file.  Broadcast it: its size is the file's."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return Codec(f.read(), letter_classes(), late_lower())


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


@functools.cache
def letter_classes() -> tuple[str, str]:
    """Character ranges of letters and of numbers as the vocabulary's library knows them.

    Unicode tables differ by version, so the library is asked once, on the
    driver, for its classes.
    """
    from tokenizers import Regex, pre_tokenizers
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    out = []
    for kind in "LN":
        runs = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True).pre_tokenize_str(every)
        out.append("".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r, _ in runs))
    return out[0], out[1]


@functools.cache
def late_lower() -> dict[str, str]:
    """Lower-case forms that the vocabulary's library knows and this Python doesn't yet."""
    from tokenizers import normalizers
    lower, out = normalizers.Lowercase(), {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.category(c) == "Cn" and (small := lower.normalize_str(c)) != c:
            out[c] = small
    return out


class _Numbers(dict):
    """Gives every new chunk the next number and notes it."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class Codec:
    """Encoder and decoder over one vocabulary file (its JSON text)."""

    def __init__(self, vocabulary: str, classes: tuple[str, str], lower: dict[str, str]):
        spec = json.loads(vocabulary)
        model = spec["model"]
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
        if (model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout")
                or steps != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") is not None
                or [s.get("type") for s in split] != ["Split", "ByteLevel"]):
            raise ValueError("this vocabulary needs steps that are not implemented")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pattern = split[0]["pattern"]["Regex"]
        for name, ranges in zip((r"\p{L}", r"\p{N}"), classes):
            pattern = pattern.replace(f"[{name}]", f"[{ranges}]").replace(name, ranges)
        self.lower = lower
        self.late = re.compile("[" + "".join(self.lower) + "]") if self.lower else None
        self.words = re.compile(pattern.replace(r"\s", SPACES) + r"|\n")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max([*vocab.values(), *added.values()]) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.full(self.size, -1, np.int64)
        rank[made] = np.arange(len(made))
        # Every token has one merge that makes it, ranked after the merges of
        # its parts: all occurrences of the lowest pair may then merge at once.
        if len(set(made.tolist())) != len(made) or (np.maximum(rank[left], rank[right]) >= np.arange(len(made))).any():
            raise ValueError("this vocabulary's merges are not in making order")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made
        names = [b""] * self.size
        for t, i in [*vocab.items(), *added.items()]:
            names[i] = t.encode()
        self.names = np.array(names, dtype=object)
        self.forget()

    # -- encoding --------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """Maximal runs without white space; no token crosses white space."""
        if any(c in text for c in _ODD_SPACES):
            return re.findall(f"[^{SPACES}]+", text)
        return text.split()

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not known yet, all in one flat array."""
        text = "\n".join(chunks)
        if self.special and self.special.search(text):
            split = self.special.split(text)
            parts = [w for i, t in enumerate(split) for w in ([t] if i % 2 else self.split(t))]
        else:
            parts = self.split(text)
        index = dict.fromkeys(parts)
        index.pop("\n", None)  # a single chunk has no line end
        index = dict(zip(index, range(len(index))))
        words = list(index)
        index["\n"] = -1
        flat, start = self.merge(["" if w in self.added else w for w in words])
        if not self.added.keys().isdisjoint(index):
            got = [np.array([self.added[w]]) if w in self.added else flat[start[i]:start[i + 1]] for i, w in enumerate(words)]
            flat, start = np.concatenate(got), np.concatenate([[0], np.cumsum([len(g) for g in got])])
        which = np.fromiter(map(index.__getitem__, parts), np.int64, len(parts))
        word = which >= 0
        ids, ends = gather(flat, start, which[word])
        # The words before each chunk's end mark.
        ends = np.concatenate([[0], ends])[np.append(np.cumsum(word)[~word], word.sum())]
        need = self.start[self.count] + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(need, 1 << 16), np.int32)])
        self.flat[self.start[self.count]:need] = ids
        if self.count + len(chunks) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(len(chunks), 1 << 16), np.int64)])
        self.start[self.count + 1:self.count + 1 + len(chunks)] = self.start[self.count] + ends
        self.count += len(chunks)

    def split(self, text: str) -> list[str]:
        """Words and line ends of the normalised text, in order."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            # Rare: a plain search for each is far cheaper than the pattern.
            if any(c in text for c in self.lower):
                text = self.late.sub(lambda m: self.lower[m[0]], text)
        return self.words.findall(text.lower())

    def forget(self) -> None:
        self.known = _Numbers()
        self.count = 0
        self.flat = np.empty(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the start of each word in it."""
        raw = [w.encode() for w in words]
        size = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)[size > 0] - 1
        sym = self.inner[data]
        sym[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), size)
        rank = self.ranks(sym, word, np.arange(len(sym)))
        done_sym, done_word = [], []
        none = len(self.made)
        while len(sym):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            low = np.repeat(low, np.diff(np.append(first, len(sym))))
            keep = low < none
            if not keep.all():
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
            pos = np.flatnonzero(keep & (rank == low))
            # In a run of touching hits (a pair of equal symbols) every second
            # one overlaps the one before it.
            begin = np.flatnonzero(np.diff(pos, prepend=-2) != 1)
            within = np.arange(len(pos)) - np.repeat(begin, np.diff(np.append(begin, len(pos))))
            pos = pos[within % 2 == 0]
            sym[pos] = self.made[rank[pos]]
            keep[pos + 1] = False
            shift = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            pos = shift[pos]
            near = np.concatenate([pos, pos[pos > 0] - 1])
            rank[near] = self.ranks(sym, word, near)
        if done_sym:
            sym, word = np.concatenate(done_sym), np.concatenate(done_word)
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        count = np.bincount(word, minlength=len(words)) if len(words) else np.empty(0, np.int64)
        return sym, np.concatenate([[0], np.cumsum(count)]).astype(np.int64)

    def ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Merge rank of the pair that starts at each position; none: one past the last."""
        out = np.full(len(at), len(self.made), np.int64)
        inside = np.flatnonzero(at < len(sym) - 1)
        i = at[inside]
        same = word[i] == word[i + 1]
        inside, i = inside[same], i[same]
        key = sym[i] * self.size + sym[i + 1]
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[slot] == key
        out[inside[hit]] = self.rank[slot[hit]]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the offset of each (NULL: empty)."""
        out, size = [np.empty(0, np.int32)], [0]
        for lo in range(0, len(texts), 256):
            if self.count > CACHE_CHUNKS:
                self.forget()
            which = []
            for t in texts[lo:lo + 256]:
                chunks = self.chunks(t) if t else []
                which.append(np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks)))
            if self.known.new:
                self.learn(self.known.new)
                self.known.new = []
            for at in range(0, len(which), 16):
                some = which[at:at + 16]
                ids, ends = gather(self.flat, self.start, np.concatenate(some))
                out.append(ids)
                ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, some)])]
                size.extend(np.diff(ends).tolist())
        return np.concatenate(out), np.cumsum(size)

    # -- decoding --------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by one space (the file names no decoder)."""
        return b" ".join(self.names[ids])


def gather(flat: np.ndarray, start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat[start[w]:start[w + 1]]`` for each w of ``which``, end to end, and where each ends."""
    size = start[which + 1] - start[which]
    ends = np.cumsum(size)
    if not len(which):
        return flat[:0], ends
    return flat[np.arange(ends[-1]) + np.repeat(start[which] - (ends - size), size)], ends


def encode(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Add ``out``: the token ids of the whole ``text``, an ``array<int>``.

    ``vocabulary`` is the path of a ``tokenizers`` JSON file on the driver.

    NULL and empty texts give an empty array.  All other columns stay.  A
    column named ``out`` is replaced.  Rows are independent, so copies, ties
    and repeated rows need no care.
    """
    spec = share(df.sparkSession, codec_of(vocabulary))
    base = df.drop(out) if out != text else df
    schema = T.StructType([f for f in base.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(spec)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                flat, ends = codec.encode(part.column(part.schema.get_field_index(text)).to_pylist())
                cols = [c for n, c in zip(part.schema.names, part.columns) if n != out]
                names = [n for n in part.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], names=[*names, out])

    return base.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Add ``out``: the text of the token ids in ``ids`` (NULL: empty)."""
    spec = share(df.sparkSession, codec_of(vocabulary))
    base = df.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(spec)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                col = part.column(part.schema.get_field_index(ids)).fill_null([])
                offs, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
                texts = [codec.decode(flat[x:y]) for x, y in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, out])

    return base.mapInArrow(run, schema)


@register("op3_bpe_codec")
def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of both.

    The decode step consumes the ids that the encode step made.  A document
    without text has 0 tokens and the digests of the empty string.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs).drop("text"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
