"""N-gram Jaccard self-join of documents by grouped prefixes.

A document is the set of its distinct word shingles.  All shingles have one
global order, rare ones first: the order's key is a shingle's count in a
hashed count table over the whole corpus, then its hash.  Two sets whose
Jaccard similarity reaches the threshold share a shingle among the first
``n - ceil(t * n) + 1`` of each (the prefix).

Documents with the same prefix and size form one group, so the prefix index
holds one posting per group.  Candidate pairs of groups pass a size filter
and a bound from the shared part of their prefixes; survivors are expanded
to members (one per distinct set) and verified on the whole texts.

The result is connected components, so links inside a component need not be
listed one by one.  Groups are first gathered into families: each joins the
posting leader that it shares most of its prefix with; families that meet in a
posting of many documents become one.  The sets of a family
are compared in blocks of bounded size by one matrix product a block.  Every
block also holds one and the same set, the family's hub, so blocks that link to
it share a label without a further pass.  Blocks then meet only the sets that are not yet
in their family's main component, and send back links between labels.
Candidate pairs across families stay pairs of classes (one group's sets in one
component); they come from postings of few documents only, so a set meets a
bounded number of others in each.  Small ones are verified set by set, larger
ones in blocks by the same matrix product, each block answering for its two
components.  No link
between components is lost, and a family of thousands of near copies costs a
few rows per copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeledger.llm.common import bucketed, components, discard, saved
from lakeledger.llm.registry import register, table

#: log2 of the cells of the shingle count table (one byte each when broadcast).
ORDER_BITS = 24
BLOCK = 1 << 16
#: Words kept by a task's word-hash memory before it is emptied.
WORD_CACHE = 1 << 18
#: Sets in a block of a family or class, about.
FAMILY_BLOCK = 256
#: Documents of a posting whose families are still compared pair by pair; with more they become one family.
FEW_DOCUMENTS = 32
#: Member pairs of a pair of classes that are verified one by one; classes with more meet in blocks.
SINGLE_PAIRS = 16


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, words: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    ASCII letters are lower-cased, words are runs without ASCII white space
    (what ``bytes.lower`` and ``bytes.split`` do).  Fewer words than a
    shingle has: the whole sequence is the one shingle.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = (total + h[i:len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        total ^= total >> np.uint64(32)
    return np.unique(_mix(total))


def _sets(batch: pa.RecordBatch, at: int, words: int, known: dict) -> list[np.ndarray]:
    return [shingle_set(t, words, known) for t in batch.column(at).cast(pa.binary()).to_pylist()]


def shingle_order(docs: DataFrame, words: int) -> bytes:
    """One byte per cell of the count table: the logarithm of its count.

    Every shingle of every document is counted.  A task adds up its own
    table and sends it in compressed blocks; blocks are summed in two steps,
    so a step's groups stay small however many tasks there are.  What comes
    to the driver is the finished table, 2**ORDER_BITS bytes at any scale.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, known, any_ = np.zeros(1 << ORDER_BITS, np.uint32), _WordHash(), False
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                for h in _sets(b.slice(lo, 512), 0, words, known):
                    cells[(h >> np.uint64(64 - ORDER_BITS)).astype(np.int64)] += 1
                    any_ = True
        if any_:
            salt = xxhash.xxh3_64_intdigest(cells[:4096].tobytes()) % 32
            for lo in range(0, len(cells), BLOCK * 16):
                blocks = range(lo // BLOCK, lo // BLOCK + 16)
                data = [pa.compress(cells[i * BLOCK:(i + 1) * BLOCK].tobytes(), codec="zstd", asbytes=True) for i in blocks]
                yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([salt] * 16, pa.int32()), pa.array(data, pa.binary())], names=["block", "salt", "data"])

    def unpack(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, BLOCK * 4, codec="zstd", asbytes=True), np.uint32)

    def total(t: pa.Table) -> np.ndarray:
        cells = np.zeros(BLOCK, np.uint64)
        for x in t.column("data").to_pylist():
            cells += unpack(x)
        return np.minimum(cells, (1 << 32) - 1).astype(np.uint32)

    def packed(t: pa.Table, cells: np.ndarray) -> pa.Table:
        return pa.table({"block": t.column("block")[:1], "data": pa.array([pa.compress(cells.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        return packed(t, total(t))

    def levels(t: pa.Table) -> pa.Table:
        return packed(t, np.minimum(255, 8 * np.log2(1 + total(t).astype(float))).astype(np.uint8))

    parts = docs.select("text").mapInArrow(count, "block int, salt int, data binary")
    once = parts.groupBy("block", "salt").applyInArrow(add, "block int, data binary")
    level = np.zeros(1 << ORDER_BITS, np.uint8)
    for r in once.groupBy("block").applyInArrow(levels, "block int, data binary").collect():
        level[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(pa.decompress(bytes(r["data"]), BLOCK, codec="zstd", asbytes=True), np.uint8)
    return level.tobytes()


def prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document: ``doc_id, text, n, sig, g, prefix``.

    ``sig`` is a 128-bit digest of the set, ``g`` one of prefix and size,
    ``prefix`` the ordered keys of the prefix.
    """
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, known = np.frombuffer(order.value, np.uint8), _WordHash()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                n, sig, group, prefix = [], [], [], []
                for h in _sets(part, 1, words, known):
                    size = len(h)
                    take = size - (percent * size + 99) // 100 + 1 if size else 0
                    key = (level[(h >> np.uint64(64 - ORDER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(55)) | (h >> np.uint64(9))
                    key = np.sort(np.partition(key, take - 1)[:take] if take else key)
                    n.append(size)
                    sig.append(hashlib.md5(h.tobytes()).digest())
                    group.append(hashlib.md5(size.to_bytes(8, "little") + key.tobytes()).digest())
                    prefix.append(key.astype(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(group, pa.binary()), keys],
                    names=["doc_id", "text", "n", "sig", "g", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, text string, n long, sig binary, g binary, prefix array<long>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``(comp, comp2)`` of the ``pairs(a, b, comp, comp2)`` that reach the threshold.

    The texts of the pairs' sets are picked from the buckets first, so that
    no other text is shuffled for the two joins.
    """
    pairs = saved(pairs, "jaccard-pairs")
    asked = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    texts = saved(texts.join(asked, "sig"), "jaccard-pair-texts")
    a = texts.select(F.col("sig").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("sig").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keep = []
                for x, y in zip(_sets(part, 2, words, known), _sets(part, 3, words, known)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.filter(pa.array(keep)).select([0, 1])

    joined = pairs.join(a, "a").join(b, "b").select("comp", "comp2", "ta", "tb")
    return joined.mapInArrow(run, "a binary, b binary")


def similar_sizes(a: str, b: str, percent: int):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def link_components(docs: DataFrame, words: int = 5, percent: int = 80, details: bool = False) -> DataFrame:
    """Near-duplicate class of every document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored.  Two
    documents link when ``100 * |intersection| >= percent * |union|`` of
    their shingle sets.  Returns one row per row of ``docs``: ``doc_id,
    n_shingles, component_id``, the last being the smallest ``doc_id``
    reachable by links.  Documents without words have an empty set, link
    with nothing and are their own component.  Rows with equal or NULL
    ``doc_id`` are documents of their own; a component of NULL ids only has
    NULL as its id.  No documents: no rows.

    With ``details`` two more columns tell rows and classes apart where ids
    repeat or are NULL: ``text_hash`` (64-bit, of the row's text) and
    ``component_key`` (a digest of the class; NULL without words).
    """
    coded = saved(prefixes(docs, words, percent), "jaccard-prefixes")
    sets = coded.where("n > 0")
    members = saved(sets.groupBy("sig").agg(F.min("doc_id").alias("low_id"), F.min("g").alias("g"), F.min("n").alias("n")), "jaccard-sets")
    # One posting per group and prefix key; keys of one group only are dropped.
    groups = sets.groupBy("g").agg(F.min("n").alias("n"), F.min("prefix").alias("prefix"), F.count("*").alias("docs"))
    posts = groups.select("g", "n", "docs", F.posexplode("prefix").alias("pos", "key"))
    # Counted in a window: the postings, the largest table of the job, are shuffled once and not saved.
    of_key = Window.partitionBy("key")
    posts = posts.withColumn("m", F.count("*").over(of_key)).withColumn("busy", F.sum("docs").over(of_key) > FEW_DOCUMENTS)
    posts = saved(posts.where("m > 1").select("key", "g", "n", "pos", "busy"), "jaccard-shared")
    # Sets that can meet another one: their group shares a key or has several sets.
    several = members.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
    active = members.join(posts.select("g").unionByName(several).distinct(), "g")
    active = saved(active, "jaccard-active")
    texts = bucketed(sets.groupBy("sig").agg(F.min("text").alias("text")).join(active.select("sig"), "sig"), "jaccard-texts", "sig")

    family = _gathered(_families(posts, active, percent), posts)
    near = _inside(family, texts, words, percent).select(F.col("a").alias("sig"), F.col("b").alias("comp"))
    labels = saved(family.join(near, "sig", "left").select("sig", "g", "n", "fam", F.coalesce("comp", "sig").alias("comp")), "jaccard-labels")
    rest = _rest(labels, texts, words, percent)
    far = _across(_crossing(posts, labels, percent), labels, texts, words, percent)
    merged = components(rest.unionByName(far), "jaccard-components").select(F.col("node").alias("comp"), F.col("comp").alias("whole"))

    named = members.join(labels.select("sig", "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    named = named.join(merged, "comp", "left").select("sig", "low_id", F.coalesce("whole", "comp").alias("comp"))
    low = named.groupBy("comp").agg(F.min("low_id").alias("component_id"))
    named = saved(named.join(low, "comp").select("sig", "component_id", F.col("comp").alias("component_key")), "jaccard-named")
    more = [F.xxhash64("text").alias("text_hash")] if details else []
    full = coded.where("n > 0").select("doc_id", "n", "sig", *more).join(named, "sig")
    empty = coded.where("n = 0").select("doc_id", "n", *more, F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component_key"))
    out = ["doc_id", F.col("n").alias("n_shingles"), "component_id", *(["text_hash", "component_key"] if details else [])]
    return full.select(out).unionByName(empty.select(out))


def _families(posts: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """``sig, g, n, fam``: groups joined to the leader they share most keys with.

    A posting's leader is its group with the smallest hash, so one member
    tends to lead all postings of a family.  A third of the prefix must be
    shared; families only decide who is compared in blocks.
    """
    lead = posts.groupBy("key").agg(F.min(F.struct(F.xxhash64("g").alias("h"), F.col("g").alias("b"), F.col("n").alias("nb"))).alias("lead"))
    lead = saved(lead.select("key", "lead.b", "lead.nb"), "jaccard-leads")
    met = (posts.join(lead, "key").where("g <> b").where(similar_sizes("n", "nb", percent))
           .groupBy("g", "b").agg(F.count("*").alias("m"), F.first("n").alias("n"))
           .where(F.col("m") * 300 >= F.col("n") * (100 - percent)))
    best = met.groupBy("g").agg(F.max(F.struct("m", "b")).alias("best")).select(F.col("g").alias("a"), F.col("best.b").alias("b"))
    root = _roots(best).select(F.col("a").alias("g"), F.col("b").alias("fam"))
    joined = active.join(root, "g", "left").select("sig", "g", "n", F.coalesce("fam", "g").alias("fam"))
    family = saved(joined, "jaccard-family")
    discard(lead)
    return family


def _gathered(family: DataFrame, posts: DataFrame) -> DataFrame:
    """``family`` with families that meet in a busy posting as one, and each group's number of busy postings (``met``).

    Near copies of one text that follow different leaders would otherwise be
    listed as pairs, each with all of the other families.  One row per family
    and posting decides which become one.
    """
    busy = saved(posts.where("busy").select("key", "g").join(family.select("g", "fam").distinct(), "g"), "jaccard-busy")
    low = busy.groupBy("key").agg(F.min("fam").alias("low"))
    edges = busy.select("key", "fam").distinct().join(low, "key").where("fam <> low").select(F.col("fam").alias("a"), F.col("low").alias("b"))
    whole = components(edges, "jaccard-gathered").select(F.col("node").alias("fam"), F.col("comp").alias("whole"))
    met = busy.groupBy("g").agg(F.count("*").alias("met"))
    found = family.join(whole, "fam", "left").join(met, "g", "left").select("sig", "g", "n", F.coalesce("whole", "fam").alias("fam"), F.coalesce("met", F.lit(0)).alias("met"))
    found = saved(found, "jaccard-gathered-family")
    discard(busy, family)
    return found


def _roots(parent: DataFrame) -> DataFrame:
    """``(a, b)`` with ``b`` the root of ``a`` in the forest ``parent(a, b)``.

    A leader's hash is below its follower's, so there are no cycles.  Each
    round doubles the distance that is followed, until every parent is a root.
    """
    cur = saved(parent, "jaccard-leaders")
    while True:
        up = cur.select(F.col("a").alias("b"), F.col("b").alias("c"))
        was, cur = cur, saved(cur.select("a", "b").join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "jaccard-leaders")
        discard(was)
        if cur.where("moved").isEmpty():
            return cur.select("a", "b")


def _sized(family: DataFrame) -> DataFrame:
    """Adds ``blocks`` and ``blk`` to the sets of families of several sets."""
    size = family.groupBy("fam").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / FAMILY_BLOCK).cast("int")
    return (family.join(size, "fam").withColumn("blocks", blocks)
            .withColumn("blk", F.pmod(F.hash("sig"), "blocks")).drop("m"))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the left with the right sets.

    Shingles of one side only are left out; the others become columns of two
    0/1 matrices, multiplied a bounded number of columns at a time.
    """
    total = np.zeros((len(left), len(right)), np.float32)
    every = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right)]
    shared = np.intersect1d(np.unique(every[0]), np.unique(every[1]), assume_unique=True)
    place = []
    for sets, flat in zip((left, right), every):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        col = np.searchsorted(shared, flat)
        hit = col < len(shared)
        hit[hit] = shared[col[hit]] == flat[hit]
        order = np.argsort(col[hit], kind="stable")
        place.append((row[hit][order], col[hit][order]))
    for lo in range(0, len(shared), 4096):
        grid = []
        for sets, (row, col) in zip((left, right), place):
            x, y = np.searchsorted(col, [lo, lo + 4096])
            g = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
            g[row[x:y], col[x:y] - lo] = 1
            grid.append(g)
        total += grid[0] @ grid[1].T
    return total


def _forest(left: list, right: list, words: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Spanning links between the labels of rows ``(label, text)`` of two lists."""
    known = _WordHash()
    sets = [[shingle_set(t, words, known) for _, t in side] for side in (left, right)]
    size = [np.array([len(x) for x in side], np.int64) for side in sets]
    both = np.rint(_overlaps(*sets)).astype(np.int64)
    link = 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in np.argwhere(link).tolist():
        x, y = root(left[i][0]), root(right[j][0])
        parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _link_batch(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})


def _inside(family: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``(set, label)`` links inside each block of a family, one per linked set.

    Every block also holds the family's hub, which is then the label of all
    that reach it, whatever their block: the set with the most busy postings,
    as it has the fewest shingles of its own (the smallest sig on ties).
    """
    sized = _sized(family)
    hub = (sized.groupBy("fam").agg(F.min(F.struct(-F.col("met"), F.col("sig"))).alias("hub"), F.first("blocks").alias("blocks"))
           .where("blocks > 1").select("fam", "hub.sig", "blocks"))
    known = saved(hub.select("sig").join(texts, "sig"), "jaccard-hubs")
    hub = hub.select("sig", "fam", F.explode(F.sequence(F.lit(0), F.expr("blocks - 1"))).alias("blk")).join(known, "sig")
    rows = sized.select("sig", "fam", "blk", F.lit(False).alias("hub")).join(texts, "sig").unionByName(hub.withColumn("hub", F.lit(True)))

    def run(t: pa.Table) -> pa.Table:
        hub = {s for s, h in zip(t.column("sig").to_pylist(), t.column("hub").to_pylist()) if h}
        # An empty label is below all others, so the hub's links carry it.
        rows = [(b"" if s in hub else s, x) for s, x in dict(zip(t.column("sig").to_pylist(), t.column("text").cast(pa.binary()).to_pylist())).items()]
        links = _forest(rows, rows, words, percent)
        return _link_batch([(a, b or min(hub)) for a, b in links])

    return rows.groupBy("fam", "blk").applyInArrow(run, "a binary, b binary")


def _rest(labels: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between labels: sets outside their family's main component with all blocks."""
    sized = _sized(labels).where("blocks > 1")
    counts = sized.groupBy("fam", "comp").agg(F.count("*").alias("m"))
    main = counts.groupBy("fam").agg(F.max(F.struct("m", "comp")).alias("main"), F.sum("m").alias("all"))
    main = main.select("fam", F.col("main.comp").alias("main"), F.ceil((F.col("all") - F.col("main.m")) / FAMILY_BLOCK).cast("int").alias("chunks")).where("chunks > 0")
    sized = sized.join(main, "fam").join(texts, "sig")
    some = (sized.where("comp <> main").withColumn("chunk", F.pmod(F.hash("sig", F.lit(1)), "chunks"))
            .withColumn("blk", F.explode(F.sequence(F.lit(0), F.expr("blocks - 1")))))
    every = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr("chunks - 1"))))
    cols = ["fam", "blk", "chunk", "comp", "text"]
    rows = some.select(*cols, F.lit(True).alias("some")).unionByName(every.select(*cols, F.lit(False).alias("some")))

    def run(t: pa.Table) -> pa.Table:
        left, right = [], []
        for some, comp, text in zip(*(t.column(c).to_pylist() for c in ("some", "comp")), t.column("text").cast(pa.binary()).to_pylist()):
            (left if some else right).append((comp, text))
        return _link_batch(_forest(left, right, words, percent))

    return rows.groupBy("fam", "blk", "chunk").applyInArrow(run, "a binary, b binary")


def _crossing(posts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs ``(g, comp, g2, comp2)`` of classes in different families and components.

    Pairs of (group, component) classes that share postings, cut by size and
    by the bound that the shared prefix keys leave.  A key's rank among its group's postings bounds the keys shared before it:
    those that no other group has are no postings.
    """
    ranked = posts.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("pos")).cast("long"))
    marked = ranked.join(labels.select("g", "fam", "comp").distinct(), "g")
    open_ = marked.groupBy("key").agg(F.min("fam").alias("f0"), F.max("fam").alias("f1")).where("f0 <> f1").select("key")
    marked = saved(marked.join(open_, "key").select("key", "g", "n", "pos", "rank", "fam", "comp"), "jaccard-open")
    # The smaller set of a pair (g on ties) needs the first keys only.
    first = F.expr(f"n - ceil(2 * {percent} * n / (100.0 + {percent})) + 1")
    other = marked.where(F.col("pos") < first).select("key", *[F.col(c).alias(c + "2") for c in ("g", "n", "pos", "rank", "fam", "comp")])
    need = F.expr(f"cast(ceil({percent} * (n + n2) / (100.0 + {percent})) as long)")
    met = (marked.join(other, "key").where("fam <> fam2 and comp <> comp2 and (n2 < n or (n2 = n and g2 < g))")
           .where(similar_sizes("n", "n2", percent))
           .where(F.expr("least(rank, rank2) + least(n - pos - 1, n2 - pos2 - 1)") >= need)
           .groupBy("g", "comp", "g2", "comp2").agg(
               F.count("*").alias("m"), F.first("n").alias("n"), F.first("n2").alias("n2"),
               F.max("pos").alias("pos"), F.max("pos2").alias("pos2")))
    # Shared keys after the last one met lie behind both positions.
    met = met.where(F.col("m") + F.least(F.expr("n - pos - 1"), F.expr("n2 - pos2 - 1")) >= need)
    return met.select("g", "comp", "g2", "comp2")


def _across(met: DataFrame, labels: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``(comp, comp2)`` between the classes of the candidate pairs ``met``.

    A pair of classes of m and m2 sets costs m * ceil(m2 / FAMILY_BLOCK) +
    m2 * ceil(m / FAMILY_BLOCK) rows, never m * m2.
    """
    sizes = labels.groupBy("g", "comp").agg(F.count("*").alias("m"))
    other = sizes.select(F.col("g").alias("g2"), F.col("comp").alias("comp2"), F.col("m").alias("m2"))
    met = saved(met.join(sizes, ["g", "comp"]).join(other, ["g2", "comp2"]).withColumn("pair", F.xxhash64("g", "comp", "g2", "comp2")), "jaccard-met")
    left = labels.select("g", "comp", F.col("sig").alias("a"))
    right = labels.select(F.col("g").alias("g2"), F.col("comp").alias("comp2"), F.col("sig").alias("b"))
    few = met.where(F.col("m") * F.col("m2") <= SINGLE_PAIRS).select("g", "comp", "g2", "comp2")
    single = verified(few.join(left, ["g", "comp"]).join(right, ["g2", "comp2"]).select("a", "b", "comp", "comp2"), texts, words, percent)

    many = met.where(F.col("m") * F.col("m2") > SINGLE_PAIRS)
    blocks, blocks2 = (F.ceil(F.col(m) / FAMILY_BLOCK).cast("int") for m in ("m", "m2"))

    def side(members: DataFrame, keys: list[str], sig: str, comp: str, own: tuple, met_: tuple, first: bool) -> DataFrame:
        """Members with their block among ``own`` blocks, once for each block they meet."""
        rows = many.join(members, keys).select(
            "pair", F.col(comp).alias("comp"), F.col(sig).alias("sig"), F.pmod(F.hash(sig), own[1]).alias(own[0]),
            F.explode(F.sequence(F.lit(0), met_[1] - 1)).alias(met_[0]))
        return rows.withColumn("first", F.lit(first))

    i, j = ("i", blocks), ("j", blocks2)
    rows = side(left, ["g", "comp"], "a", "comp", i, j, True).unionByName(side(right, ["g2", "comp2"], "b", "comp2", j, i, False))

    def run(t: pa.Table) -> pa.Table:
        both = ([], [])
        for first, comp, text in zip(*(t.column(c).to_pylist() for c in ("first", "comp")), t.column("text").cast(pa.binary()).to_pylist()):
            both[not first].append((comp, text))
        return _link_batch(_forest(*both, words, percent))

    blocked = rows.join(texts, "sig").select("pair", "i", "j", "first", "comp", "text").groupBy("pair", "i", "j").applyInArrow(run, "a binary, b binary")
    return single.unionByName(blocked)


ORACLE_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower_az, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS sh FROM w),
sizes AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS root, doc_id FROM sizes UNION SELECT r.root, e.b FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY 1, 2
"""


@register("op4_jaccard_components", ORACLE_OP4)
def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: distinct 4-word shingles, linked at a similarity of 0.85."""
    return link_components(table(spark, sf_dir, "documents"), words=4, percent=85)
