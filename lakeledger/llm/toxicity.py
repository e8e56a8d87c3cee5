"""Toxicity scores from a lexicon matched by Levenshtein automata.

The lexicon is learned from labelled training rows: stems (a word's beginning
that only toxic texts use) and whole words.  Its trie is intersected with the
Levenshtein automaton of the lexicon: a state is a set of (trie node, edits)
pairs, built when first met and kept, so a word is read letter by letter and
most words leave the automaton after a few letters.  Misspelled words and
stems match within one edit from five letters on, words within two from nine
letters on; shorter entries match exactly.

Every match is weighed by its context window: a match in quotation marks or
beside a word of reporting counts as quotation, any other as abuse.  The sums
of both are the features of a logistic score fitted on the training rows.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger.llm.common import discard, saved, share, shared
from lakeledger.llm.registry import register, table

#: Labelled training rows used at most, those with the smallest hash of doc_id.
TRAIN_ROWS = 12_000
#: Longest beginning of a word that can be a stem.
STEM = 8
#: Words on either side that can mark a match as quotation.
WINDOW = 3
#: Words whose match a worker remembers, bytes of automaton states that it keeps (about), and terms that a task counts before it sends them.
CACHE_WORDS, STATE_BYTES, TERMS = 200_000, 64 << 20, 60_000

# ---- fixed values -----------------------------------------------------------
REPORTING = frozenset("called calls said says wrote quoted quote quotes quoting word term insult slur termed "
                      "appelé mot terme insulte wort begriff beleidigung genannt palabra término insulto llamado".split())
QUOTES = "\"'“”„‟‘’‚«»‹›「」"
# -----------------------------------------------------------------------------
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def plain_word(word: str) -> str:
    """Lower case, without marks at either end."""
    word = word.lower()
    return word if word.isalnum() else _EDGE.sub("", word)


class Lexicon:
    """Trie of weighted entries and the automaton that reads words against it."""

    def __init__(self, entries: dict[str, float]):
        """Entries ending in ``*`` are stems, others whole words."""
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, tuple[float, int]] = {}
        self.stem: dict[int, tuple[float, int]] = {}
        for entry, weight in entries.items():
            at = 0
            name = entry.rstrip("*")
            for c in name:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                at = nxt
            kind = self.stem if entry.endswith("*") else self.word
            kind[at] = (weight, 0 if len(name) < 5 else 1 if len(name) < 9 else 2)
        self.edits = max((k for _, k in (*self.word.values(), *self.stem.values())), default=0)
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[dict[int, int], float, float]] = []
        self.number: dict[bytes, int] = {}
        self.steps: list[dict[str, int]] = []
        self.known: dict[str, tuple[float, float]] = {}
        self.held = 0
        self.start = self._state({0: 0}, 0.0, 0.0)

    def _state(self, nodes: dict[int, int], stem: float, near: float) -> int:
        """Number of a state: least edits per node, closed under missing letters, and the best stems met, exact and misspelled."""
        todo = list(nodes.items())
        while todo:
            node, edits = todo.pop()
            if edits < self.edits and nodes.get(node) == edits:
                for nxt in self.children[node].values():
                    if nodes.get(nxt, self.edits + 1) > edits + 1:
                        nodes[nxt] = edits + 1
                        todo.append((nxt, edits + 1))
        for node, edits in nodes.items():
            if node in self.stem:
                weight, most = self.stem[node]
                if edits == 0:
                    stem = max(stem, weight)
                elif edits <= most:
                    near = max(near, weight)
        key = array("Q", sorted(4 * n + e for n, e in nodes.items())).tobytes() + array("d", (stem, near)).tobytes()
        if key not in self.number:
            # A state's dictionaries and its key take so much, by measurement.
            self.held += 600 + 40 * len(nodes)
            self.number[key] = len(self.states)
            self.states.append((nodes, stem, near))
            self.steps.append({})
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        nodes, stem, near = self.states[state]
        out: dict[int, int] = {}
        for node, edits in nodes.items():
            nxt = self.children[node].get(c)
            if nxt is not None and out.get(nxt, self.edits + 1) > edits:
                out[nxt] = edits
            if edits < self.edits:
                for other in [node, *self.children[node].values()]:
                    if out.get(other, self.edits + 1) > edits + 1:
                        out[other] = edits + 1
        got = self._state(out, stem, near) if out or stem or near else -1
        self.steps[state][c] = got
        return got

    def read(self, word: str) -> tuple[float, float]:
        """Weights of the word's exact and of its misspelled match (0: none)."""
        state = self.start
        steps = self.steps
        for c in word:
            nxt = steps[state].get(c)
            if nxt is None:
                nxt = self._step(state, c)
            if nxt < 0:
                return 0.0, 0.0
            state = nxt
        nodes, exact, near = self.states[state]
        for node, edits in nodes.items():
            if node in self.word:
                weight, most = self.word[node]
                if edits == 0:
                    exact = max(exact, weight)
                elif edits <= most:
                    near = max(near, weight)
        return exact, (0.0 if exact else near)

    def features(self, text: str | None) -> list[float]:
        """Sums of exact abuse, misspelled abuse and quotation, saturating."""
        if self.held > STATE_BYTES:
            self.forget()
        elif len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, hits = self.known, []
        words = (text or "").split()
        for i, w in enumerate(words):
            got = known.get(w)
            if got is None:
                known[w] = got = self.read(plain_word(w))
            if got != (0.0, 0.0):
                hits.append((i, got))
        sums = [0.0, 0.0, 0.0]
        for i, (exact, near) in hits:
            if self.quoted(words, i):
                sums[2] += max(exact, near)
            else:
                sums[0] += exact
                sums[1] += near
        return [math.log1p(x) for x in sums]

    @staticmethod
    def quoted(words: list[str], i: int) -> bool:
        """Whether the window shows quotation: marks around it or a word of reporting."""
        before, after = words[max(0, i - WINDOW):i], words[i + 1:i + 1 + WINDOW]
        opens = words[i][0] in QUOTES or any(w[0] in QUOTES and w[-1] not in QUOTES for w in before)
        closes = words[i].rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES and w[0] not in QUOTES for w in after)
        near = [plain_word(w) for w in before + after]
        return (opens and closes) or any(w in REPORTING for w in near)


def learn_entries(train: DataFrame) -> dict[str, float]:
    """Lexicon from ``train(text, toxic)``: entries with their weights.

    Each document counts once for a beginning or a word, and near copies of
    one document (equal smallest shingle hash) count once together.  An entry
    must be so concentrated on toxic documents that chance cannot explain it
    among as many candidates.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], set[int]] = {}

        def send() -> pa.RecordBatch:
            part = list(seen.items())
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([t for (t, _), _ in part], pa.string()), pa.array([x for (_, x), _ in part], pa.int32()),
                 pa.array([list(k) for _, k in part], pa.list_(pa.int64()))], names=["term", "toxic", "keys"])

        for b in batches:
            for text, toxic in zip(*(c.to_pylist() for c in b.columns)):
                words = [w for w in map(plain_word, (text or "").split()) if w]
                key = min((hash_of(" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))), default=0) if words else 0
                terms = set()
                for w in set(words):
                    terms.update(w[:k] for k in range(3, min(len(w), STEM) + 1))
                    terms.add(w + "$")
                for t in terms:
                    seen.setdefault((t, toxic), set()).add(key)
                if len(seen) > TERMS:
                    yield send()
        yield send()

    cells = train.mapInArrow(count, "term string, toxic int, keys array<long>")
    # Rare terms cannot qualify; they go before anything is gathered.
    per = (cells.groupBy("term", "toxic").agg(F.size(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("m"))
           .groupBy("term").agg(F.sum(F.expr("if(toxic = 1, m, 0)")).alias("bad"), F.sum(F.expr("if(toxic = 0, m, 0)")).alias("good")))
    total = train.groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in total}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return {}
    # -log of the chance that a term of m documents is all toxic, against the
    # number of terms that could be (about the square root of the vocabulary).
    share_ = bad / (bad + good)
    least = max(3, math.ceil(math.log(1e3) / -math.log(share_)))
    terms = per.where(F.col("bad") >= least).where(
        F.col("good") * bad <= F.when(F.length("term") < 6, 0.02).otherwise(0.06) * F.col("bad") * good)
    found = {r["term"]: (r["bad"], r["good"]) for r in terms.collect()}
    return prune(found, bad, good)


def hash_of(text: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(text) >> 1


def prune(found: dict[str, tuple[int, int]], bad: int, good: int) -> dict[str, float]:
    """The longest beginnings that keep their support, and whole words where a stem always ends."""
    longer: dict[str, list[str]] = {}
    for t in found:
        # A long word follows the longest beginning that is counted.
        longer.setdefault(t[:-1] if len(t) <= STEM + 1 else t[:STEM], []).append(t)
    out: dict[str, float] = {}
    for t in found:
        if t.endswith("$"):
            continue
        if t[:-1] in found and t[:-1][-1:] != "$":
            continue
        while True:
            nxt = [x for x in longer.get(t, []) if found[x][0] >= 0.9 * found[t][0]]
            if not nxt:
                break
            t = max(nxt, key=lambda x: (found[x][0], x))
            if t.endswith("$"):
                break
        b, g = found[t]
        out[t[:-1] if t.endswith("$") else t + "*"] = math.log((b + 0.5) / (bad + 1) / ((g + 0.5) / (good + 1)))
    # Words longer than a stem that no kept beginning covers.
    stems = tuple(e[:-1] for e in out if e.endswith("*"))
    for t, (b, g) in found.items():
        if t.endswith("$") and t[:-1] not in out and not (stems and t.startswith(stems)):
            out[t[:-1]] = math.log((b + 0.5) / (bad + 1) / ((g + 0.5) / (good + 1)))
    return dict(sorted(out.items()))


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression (intercept last) by Newton steps.

    The prior makes matches count towards toxicity and quotation half as much,
    so features that the sample never shows keep a sensible weight.
    """
    a = np.column_stack([x, np.ones(len(x))])
    prior = np.array([2.0, 1.2, 0.3, -2.5])
    ridge = np.array([0.3, 0.3, 0.3, 0.01])
    w = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * (w - prior)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Add ``held_out, score, predicted`` to every row of ``docs``.

    ``labels`` has ``doc_id`` and ``toxic``.  Only rows whose crc32 of the
    doc_id as text is not divisible by 5 are learned from, at most
    ``train_rows`` of them; a NULL label or doc_id teaches nothing, of several
    labels of one doc_id the larger counts, of several texts the smallest.
    What the lexicon learns is bounded by these rows alone.  The score reads the text
    alone.  NULL and empty texts get the score of a text without any match.
    Without labelled toxic and clean rows the lexicon is empty and every score
    is the prior's.  All rows and other columns stay; columns of the three
    names are replaced.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    known = (labels.where("doc_id is not null and toxic is not null").where(fold != 0)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .join(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    # At most train_rows small rows come to the driver and go back as a table.
    ids = spark.createDataFrame([tuple(r) for r in known.select("doc_id", "toxic").collect()], "doc_id long, toxic int")
    train = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    train = saved(train.select("text", "toxic"), "toxicity-train")
    entries = learn_entries(train)
    handle = share(spark, Lexicon(entries))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared(handle)
        for b in batches:
            x = np.array([lexicon.features(t) for t in b.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, i]) for i in range(3)], b.column(1)], names=["a", "b", "c", "toxic"])

    rows = [tuple(r) for r in train.mapInArrow(measure, "a double, b double, c double, toxic int").collect()]
    data = np.array(rows, float).reshape(-1, 4)
    w = fit_weights(data[:, :3], data[:, 3])
    discard(train)

    base = docs.drop("held_out", "score", "predicted")
    names = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared(handle)
        at = names.index("text")
        for b in batches:
            x = np.array([lexicon.features(t) for t in b.column(at).to_pylist()]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(x @ w[:3] + w[3], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*names, "score"])

    out = base.mapInArrow(run, schema)
    return (out.withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


@register("op10_toxicity_scores")
def op10_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
