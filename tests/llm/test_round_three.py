"""SimHash classes, phrase collocations and periodic runs against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, fp string, n int, rank string"
ODD = [(1, None, None, "x", 1, None), (2, "", "en", None, 2, ""), (3, " \n\t ", "en", "", None, "r"), (4, "a b c", "en", "y", 3, None),
       (4, "a b c", "en", "y", 3, None), (5, "A B  C", None, "z", 3, None), (None, "a b c", "en", "z", 3, None),
       (7, "word " * 30_000, "en", None, 0, None), (8, "q. r; q. r; " * 12, "", None, 0, None), (8, "other text", "fr", None, 0, None),
       (9, "naïve ΑΣ İ " * 11, "fr", None, 0, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


# SimHash

def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [words] if len(words) < width else [words[i:i + width] for i in range(len(words) - width + 1)]
    h = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows, radius=2, width=3):
    prints = [plain_fingerprint(t, width) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[find(parent, b)] = find(parent, a)
    low = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        low[find(parent, p)].append(i)
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in low.items()}
    return Counter((i, f"{p:016x}", least[find(parent, p)]) for (i, _), p in zip(rows, prints))


def test_simhash_equals_brute_force(spark):
    from lakeledger.llm.simhash import simhash_classes
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = plain_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = simhash_classes(spark, SF_SMALL)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == want


def test_simhash_odd_rows(spark, odd):
    from lakeledger.llm.simhash import near_classes
    assert Counter(map(tuple, near_classes(odd).collect())) == plain_classes([r[:2] for r in ODD])
    assert near_classes(odd.where("false")).collect() == []
    nulls = near_classes(odd.where("doc_id is null")).collect()
    assert [r.component_id for r in nulls] == [None]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_of_fingerprints(spark, monkeypatch, radius):
    """Chains, dense balls and far fingerprints; small cells send the balls through the fine table."""
    from lakeledger.llm import simhash
    from lakeledger.llm.common import components
    rng = random.Random(radius)
    prints = {0, (1 << 64) - 1, 1, 3, 7}
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(150):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
        for _ in range(20):
            base ^= sum(1 << b for b in rng.sample(range(64), radius))
            prints.add(base)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    parent = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= radius:
                parent[find(parent, b)] = find(parent, a)
    want = Counter(frozenset(p for p in prints if find(parent, p) == c) for c in {find(parent, p) for p in prints})
    want = {c for c in want if len(c) > 1}
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for cell in (simhash.CELL, 8):
        monkeypatch.setattr(simhash, "CELL", cell)
        groups = defaultdict(set)
        for r in components(simhash.print_links(rows, radius)).collect():
            groups[r.comp].add(r.node % (1 << 64))
        assert {frozenset(g) for g in groups.values()} == want


def test_cells_hold_every_link():
    from lakeledger.llm import simhash
    rng = random.Random(5)
    for radius in (1, 2, 3):
        for keys in (simhash.coarse_keys, simhash.fine_keys):
            a = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64)
            b = np.array([int(x) ^ sum(1 << t for t in rng.sample(range(64), radius)) for x in a], np.uint64)
            assert np.logical_or.reduce([x == y for x, y in zip(keys(a, radius), keys(b, radius))]).all()


def test_a_cell_sends_no_more_links_than_rows():
    from lakeledger.llm.simhash import link_cells
    fp = np.arange(256, dtype=np.uint64)
    a, b = link_cells(fp, np.zeros(256, np.int64), 2)
    assert len(a) == 255 and len(set(a.tolist())) == 255


# Collocations

def plain_phrases(rows, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if len(p) == 2 and any(100 * b >= percent * a for q, b in cand.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((lang, " ".join(p), a, left, right, n[lang], score))
        rows_.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(rows_[:top], 1)]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    from lakeledger.llm.collocations import stripes_collocations
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("lang", "text").collect()
    got = stripes_collocations(spark, SF_SMALL)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(docs)


def test_collocations_odd_rows(odd):
    from lakeledger.llm.collocations import collocations
    assert sorted(map(tuple, collocations(odd).collect())) == plain_phrases([(r[2], r[1]) for r in ODD])
    assert collocations(odd.where("false")).collect() == []
    assert collocations(odd.where("doc_id = 4")).collect() == []


def test_collocations_in_small_memory(spark, odd, monkeypatch):
    """Tiny task memories, slices and merges give the same phrases; so does a full bitmap."""
    from lakeledger.llm import collocations as C
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("lang", "text")
    want = sorted(map(tuple, C.collocations(docs, least=4, top=50).collect()))
    assert want == plain_phrases(docs.collect(), least=4, top=50)
    for name, value in (("TOKENS", 50), ("ENTRIES", 300), ("WORDS", 200), ("MERGE", 64), ("SEGMENTS", 3), ("BITMAP_BITS", 18)):
        monkeypatch.setattr(C, name, value)
    assert sorted(map(tuple, C.collocations(docs, least=4, top=50).collect())) == want
    assert sorted(map(tuple, C.collocations(odd).collect())) == plain_phrases([(r[2], r[1]) for r in ODD])


# Periodic runs

def plain_runs(w):
    """Every maximal stretch, by comparing words at each distance."""
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def runs_of(texts):
    from lakeledger.llm.periodic import runs_of as fast
    out = [[] for _ in texts]
    for t, s, length, q in zip(*(x.tolist() for x in fast([np.array(t, np.int64) for t in texts]))):
        out[t].append((s, length, q))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=80), max_size=6))
def test_runs_of_few_words(texts):
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_runs_of_periodic_texts():
    rng = random.Random(3)
    texts = []
    for _ in range(200):
        t = []
        for _ in range(rng.randint(1, 4)):
            base = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, 40))]
            size = rng.randint(1, 6 * len(base))
            t += (base * 7)[:size]
        texts.append(t)
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_runs_of_hard_words():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    thue = [i.bit_count() & 1 for i in range(1024)]
    texts = [fib[-1], thue, [0] * 3000, [0, 1] * 700 + [0] * 9, [], [1], [2] * 5, [2] * 6, list(range(900)) * 4]
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_common_extensions():
    from lakeledger.llm.periodic import CommonExtension, _apart
    rng = np.random.default_rng(1)
    words, starts = _apart([rng.integers(0, 2, 300), np.tile(rng.integers(0, 3, 17), 20), np.zeros(200, np.int64)])
    i, j = rng.integers(13, len(words) - 13, (2, 4000))
    i, j = i[i != j], j[i != j]
    got = CommonExtension(words).extend(i, j)
    for a, b, n in zip(i, j, got):
        assert (words[a:a + n] == words[b:b + n]).all() and words[a + n] != words[b + n]


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in runs),
                                                            " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], *sha)


def test_periodic_query_equals_brute_force(spark):
    from lakeledger.llm.periodic import periodic_runs
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = periodic_runs(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) > 10
    short = [r for r in rows if len((r.text or "").split()) < 1500]
    assert len(short) > 150
    assert [got[r.doc_id] for r in short] == [plain_digest(*r) for r in short]


def test_planted_texts_and_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    from lakeledger.llm.periodic import planted, with_runs
    rows = [(i, t) for i in [*range(120), None, 2**40 + 5] for t in (None, "", " \n", "a b c d e f g h i j k l m n o p", "x  y\tz\nx", "w")]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", planted(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(120)) > 5
    for r in got:
        w = (r.text or "").split()
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert (r.t or "").split() == w
    out = with_runs(odd)
    assert out.columns == [*odd.columns, "runs", "collapsed"]
    for r in out.collect():
        w = (r.text or "").split()
        assert [tuple(x) for x in r.runs] == (plain_runs(w) if len(w) < 2000 else [(0, 30_000, 1)])
        assert r.collapsed == (" ".join(w) if not r.runs else "word" if len(w) > 2000 else r.collapsed)
    assert with_runs(odd.where("false")).collect() == []
    with pytest.raises(ValueError):
        with_runs(odd, runs_col="fp")


# M-tree

def plain_top_k(rows, k=5, every=50):
    import math
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def found_top_k(spark, rows):
    from lakeledger.llm.mtree import top_k
    return sorted(map(tuple, top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))


@pytest.mark.parametrize("page, tree, block", [(256, 8192, 4096), (8, 64, 3)])
def test_top_k_of_clusters_copies_and_repeated_ids(spark, monkeypatch, page, tree, block):
    from lakeledger.llm import mtree
    for name, value in (("PAGE", page), ("TREE", tree), ("QUERY_BLOCK", block), ("NODE_BLOCK", block), ("SAMPLE", 40), ("PIVOTS", 4)):
        monkeypatch.setattr(mtree, name, value)
    rng = random.Random(11)
    centres = [[rng.uniform(-2, 2) for _ in range(5)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, .05) for c in centres[i % 9]]) for i in range(700)]
    rows += [(5000 + i, rows[3][1]) for i in range(200)] + [(50, rows[9][1]), (50, rows[1][1]), (100, rows[100][1])]
    rows += [(-50, [0.0] * 5), (6000, [-0.0, 0.0, 1e-9, -1e-9, 0.0]), (6050, None), (6051, [None] * 5), (6052, [float("inf")] * 5), (None, rows[0][1]), (6053, [])]
    assert found_top_k(spark, rows) == plain_top_k(rows)


@pytest.mark.parametrize("large", [2.0 ** 16, 2.0 ** 24, 2.0 ** 53])
def test_top_k_with_large_components(spark, large):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1), 0.0]) for i in range(200)]
    rows += [(201, [0.0, 0.0, large]), (202, [0.5, 0.0, -large]), (250, [0.25, 0.0, 2.0 ** -8]), (251, [1 / 3, 0.1, 2.0 ** -7])]
    assert found_top_k(spark, rows) == plain_top_k(rows)


def test_a_score_beyond_a_long_fails_the_job(spark):
    with pytest.raises(Exception, match="beyond the range of a long"):
        found_top_k(spark, [(0, [2.0 ** 40]), (1, [2.0 ** 40]), (2, [1.0])])
    with pytest.raises(Exception, match="beyond 2"):
        found_top_k(spark, [(0, [1e300]), (1, [1.0])])
    with pytest.raises(Exception, match="different lengths"):
        found_top_k(spark, [(0, [1.0, 2.0]), (1, [1.0])])


def test_structured_vectors_are_left_out_by_the_bounds():
    """Far clusters: products are computed for a small part of the pairs only."""
    from lakeledger.llm import mtree
    rng = np.random.default_rng(0)
    raw = np.floor(256 * (np.repeat(rng.normal(0, 3, (16, 8)), 256, axis=0) + rng.normal(0, .02, (4096, 8))))
    norm = np.sqrt((raw * raw).sum(1))
    top = float(norm.max())
    x, pages, counted = mtree.lifted(raw, top), [], []
    parent = x.mean(0)
    for at in mtree.paged(x):
        centre = x[at].mean(0)
        d = mtree.distances(x[at], centre[None, :])[:, 0]
        pages.append({"centre": centre, "radius": d.max(), "to_parent": float(np.linalg.norm(centre - parent)), "largest": norm[at].max(),
                      "ids": at, "entries": raw[at], "to_centre": d, "parent": parent})
    real = mtree._scores
    mtree._scores = lambda q, n, e, m: counted.append(len(q) * len(e)) or real(q, n, e, m)
    try:
        q = np.arange(0, 4096, 50)
        got = mtree.search(q, raw[q], np.full(len(q), mtree._NONE), pages, top, 5)
    finally:
        mtree._scores = real
    score = (raw[q] @ raw.T).astype(np.int64)
    score[np.arange(len(q)), q] = mtree._NONE
    assert (np.sort(got[1].reshape(-1, 5)) == np.sort(score)[:, -5:]).all()
    assert sum(counted) < 0.25 * score.size


# Main text

LONG = ("Some words that make a sentence of an ordinary length, over and over. " * 4).strip()


@pytest.mark.parametrize("page, text", [
    # Bare text in the elements around the densest one.
    (f"<body>First paragraph, bare. {LONG}<br><br><div><p>{LONG}</p><p>{LONG}</p></div>Last <i>words</i> here.</body>",
     f"First paragraph, bare. {LONG}\n{LONG}\n{LONG}\nLast words here."),
    (f"<body><a href=/>Home</a> | <a href=/x>X</a><div><p>{LONG}</p><p>{LONG}</p></div></body>", f"|\n{LONG}\n{LONG}"),
    # Named paragraphs and holders of text inside an article stay, lists of other things go.
    (f"<article><p class='related-work'>{LONG}</p><p class='side-note'>A note.</p><div class='toc'>Read this first.</div><p>{LONG}</p></article>",
     f"{LONG}\nA note.\nRead this first.\n{LONG}"),
    (f"<article><div class='toc'><a href=#a>One</a> <a href=#b>Two</a></div><p>{LONG}</p><div class='comments'><p>Nice.</p></div><div class='ad'>Buy.</div></article>", LONG),
    # Lists of nothing but links are menus; lists with text are not.
    (f"<main><ul><li><a href=/a>A</a><li><a href=/b>B</a><li><a href=/c>C</a></ul><p>{LONG}</p><ul><li><a href=/d>D</a> says so<li>E<li>F</ul></main>",
     f"{LONG}\nD says so\nE\nF"),
    # Of two articles, that with the densest part.
    (f"<body><article><p>Short.</p></article><article><p>{LONG}</p><p>{LONG}</p></article></body>", f"{LONG}\n{LONG}"),
])
def test_main_text_keeps_what_belongs_to_it(page, text):
    from lakeledger.llm.html_text import extract
    assert extract(page) == text


def test_main_text_of_hostile_pages_takes_linear_time():
    import time

    from lakeledger.llm.html_text import extract
    def took(page):
        t = time.process_time()
        text = extract(page)
        return time.process_time() - t, text
    deep, text = took("<body>" + "".join(f"<b>w{i} " for i in range(20_000)))
    assert deep < 2 and text == " ".join(f"w{i}" for i in range(20_000))
    for page in ("<div>" * 20_000 + LONG, "<div class='side'>" * 10_000 + LONG, "<article class='x'>" * 10_000 + LONG,
                 "<p><b>x" * 10_000, "<b>" * 10_000 + "<li>x</i></q>" * 10_000, "<ul><li><a href=x>y</a></ul>" * 10_000 + LONG, "<article><p>a</p></article>" * 10_000):
        once, _ = took(page)
        assert once < 4, page[:40]


def test_densities_equal_their_definition():
    """Characters per tag, adjusted for links, computed for each node by walking its subtree."""
    import math

    from lakeledger.llm.html_text import Node, main_nodes, measure, parse, walk
    rng = random.Random(8)

    def page(depth=0):
        kids = "".join(page(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 5 else ""
        tag = rng.choice(["div", "span", "section", "a", "em"])
        return f"<{tag}>{'word ' * rng.randint(0, 30)}{kids}</{tag}>"
    for _ in range(40):
        root = parse(f"<body>{page()}{page()}</body>")
        nodes = walk(root)
        kept = {id(n) for n in nodes}
        measure(nodes)

        def under(n):
            return [x for x in n.items if isinstance(x, Node) and id(x) in kept]

        def counts(n, linked=False):
            linked = linked or n.tag == "a"
            own = sum(len("".join(x.split())) for x in n.items if isinstance(x, str))
            total = [own, 0, own if linked else 0, 0]
            for x in under(n):
                got = counts(x, linked)
                total = [total[0] + got[0], total[1] + got[1] + 1, total[2] + got[2], total[3] + got[3] + (linked or x.tag == "a")]
            return total
        c0, _, l0, _ = counts(root)
        for n in nodes:
            c, t, lc, lt = counts(n)
            base = math.log(c / max(1, c - lc) * max(1, lc) + l0 / max(1, c0) * c + math.e)
            want = c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base) if c else 0.0
            if n.tag != "a":  # a link's own tag counts to its parent
                assert math.isclose(n.density, want, rel_tol=1e-9), (n.tag, n.density, want)
            assert math.isclose(n.total, sum(x.density for x in under(n)), abs_tol=1e-9)
        assert main_nodes(parse("<body></body>"))


# Licences

@pytest.mark.parametrize("text, licenses", [
    ("SPDX-License-Identifier: MIT", ["MIT"]), ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", ["GPL-2.0"]),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]), ("# SPDX-License-Identifier: BSD-3-Clause AND (ISC)", ["BSD-3-Clause", "ISC"]),
    ("License: MIT", ["MIT"]), ("Licensed under the MIT license (http://opensource.org/licenses/MIT).", ["MIT"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your leisure", []),
    ("Licensed under either of Apache License, Version 2.0 or MIT license", ["Apache-2.0", "MIT"]),
    ("Licensed under either of\n\n * Apache License, Version 2.0 or\n * MIT license", ["MIT"]),
    ("This crate is dual licensed under the Apache License, Version 2.0\nor the MIT License.", ["Apache-2.0", "MIT"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", ["GPL-3.0"]),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", ["LGPL"]),
    ("Mozilla Public License Version 2.0\n==================================", ["MPL-2.0"]), ("ISC License\n\nCopyright", ["ISC"]),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", ["ISC"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("Boost Software License - Version 1.0 - August 17th, 2003", ["BSL-1.0"]),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at", ["EPL-2.0"]),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND"]),
    ("Licensed under CC BY-NC-ND 4.0.", ["CC-BY-NC-ND"]), ("This dataset is licensed under CC-BY-4.0.", ["CC-BY"]),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\n"
     "published by the Free Software Foundation.", ["GPL-2.0"]),
    ("foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
     "Foundation, either version 2 of the License, or (at your option) any later version.", ["GPL-2.0"]),
    ("Released under the MIT License.\n\nParts are by others.\n\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
    ("This software is provided 'as-is', without any express or implied\nwarranty.\n\n1. The origin of this software must not be misrepresented;", ["Zlib"]),
    ("Released under the GPLv3+.", ["GPL-3.0"]), ("Distributed under the GNU GPL v2 or later", ["GPL-2.0"]), ("Licensed under the LGPL 2.1", ["LGPL"]),
    ("It isn't\nlicensed under the MIT License.", []), ("The MIT License is short.", []), ("We were licensed under duress.", []), ("MIT", []),
    ("Licensed under the MIT License and the moon", []), ("\x01Released under the\x01 MIT License", ["MIT"]),
])
def test_licences_of_sentences(spark, duck, text, licenses):
    from lakeledger.llm.licenses import _oracle, scan_licenses
    rows = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, licenses string")
    assert scan_licenses(rows).first().licenses == licenses
    own = duck.cursor()
    own.execute("CREATE OR REPLACE TEMP TABLE documents AS SELECT 1::BIGINT AS doc_id, ?::VARCHAR AS text", [text])
    assert (own.execute(_oracle().replace("FROM documents", "FROM temp.documents")).df().licenses[0] or "") == "|".join(licenses)


def test_licence_scan_stays_in_the_engine(spark, odd):
    from lakeledger.llm.licenses import scan_licenses
    from tests.test_plans import PY_NODES, _plan
    out = scan_licenses(odd)
    assert not any(n in _plan(out) for n in PY_NODES) and "Exchange" not in _plan(out)
    assert out.count() == len(ODD) and scan_licenses(odd.where("false")).collect() == []


# Quality rules

def test_short_circuit_verdicts_equal_the_whole_measures(spark):
    """Whatever the order, ``verdicts`` keeps what ``judge`` keeps; clashing columns come back as they were."""
    from lakeledger.llm import quality
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    more = [(10_000 + i, t, "x") for i, t in enumerate([None, "", " ", "A " * 60, "same line\n" * 60, "word\n\n" * 70, "#$% " * 80, "é" * 4000,
            " ".join(f"W{i}" for i in range(60)), " ".join(f"really{i}!?!" for i in range(60)), " ".join(f"{i}" for i in range(400))])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({"n_words": F_lit("mine"), "__w": F_lit(1)})
    whole = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert 5 < sum(not k for i, k in whole.items() if i >= 10_000) and sum(whole.values()) > 50
    real = quality.cascade_order
    try:
        for order in (list(quality.rules()), list(quality.rules())[::-1]):
            quality.cascade_order = lambda *a: order
            out = quality.verdicts(docs)
            assert out.columns == [*docs.columns, "rejected_by", "kept"]
            rows = out.collect()
            assert {r.doc_id: r.kept for r in rows} == whole and {r.n_words for r in rows} == {"mine"}
            assert all((r.rejected_by is None) == r.kept for r in rows)
    finally:
        quality.cascade_order = real
    assert quality.verdicts(docs.where("false")).collect() == []


def F_lit(x):
    from pyspark.sql import functions as F
    return F.lit(x)


def test_quality_stays_in_the_engine(spark, odd):
    from lakeledger.llm.quality import judge, verdicts
    from tests.test_plans import PY_NODES, _plan
    for out in (judge(odd), verdicts(odd)):
        assert not any(n in _plan(out) for n in PY_NODES)
    # Rules after the first compute their measures only for rows that stand.
    assert "CASE WHEN" in _plan(verdicts(odd)) or "if" in _plan(verdicts(odd))


# Pipeline

def test_near_duplicate_stage_equals_brute_force(spark):
    """One row of each class of five-word shingles at 0.8, ids repeated and NULL included; documents without words stay."""
    import corpus_pipeline as C
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in base.select("doc_id", "text").collect()]
    words = " ".join(f"w{i}" for i in range(80))
    more = [(1, words), (2, words + " zz"), (1, words + " yy"), (None, words.replace("w", "v")), (None, words.replace("w", "v")), (None, words.replace("w", "u")),
            (5, None), (5, ""), (5, " \n"), (7, "x y z"), (7, "x y z"), (8, "X  y z"), (-3, rows[3][1]), (None, rows[4][1] + " end")]
    rows += more
    docs = base.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], base.schema))

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i in range(len(rows))}
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                parent[find(parent, i)] = find(parent, j)
    classes = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        classes[find(parent, i) if sets[i] else ("bare", i)].append(i)
    left = Counter(tuple(r) for r in C.drop_near_duplicates(spark, docs, SF_SMALL).select("doc_id", "text").collect())
    assert sum(left.values()) == len(classes)
    for members in classes.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        fits = [rows[i] for i in members if rows[i][0] == min(ids, default=None)]
        hit = next(f for f in fits if left[f])
        left[hit] -= 1
    assert not any(left.values())


# Toxicity

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distances(monkeypatch):
    """Exact and misspelled matches of words and stems against plain dynamic programming, also when states are forgotten."""
    from lakeledger.llm import toxicity
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    entries = {word(rng.randint(3, 11)) + rng.choice(["", "", "*"]): float(rng.randint(1, 9)) for _ in range(60)}
    words = [word(rng.randint(1, 12)) for _ in range(1500)] + [e.rstrip("*") for e in entries] + [e.rstrip("*") + word(2) for e in entries]

    def plain(w):
        exact = near = 0.0
        for e, weight in entries.items():
            name = e.rstrip("*")
            most = 0 if len(name) < 5 else 1 if len(name) < 9 else 2
            d = min(edit_distance(w[:k], name) for k in range(len(w) + 1)) if e.endswith("*") else edit_distance(w, name)
            if d == 0:
                exact = max(exact, weight)
            elif d <= most:
                near = max(near, weight)
        return exact, (0.0 if exact else near)
    lexicon = toxicity.Lexicon(entries)
    want = [plain(w) for w in words]
    assert [lexicon.read(w) for w in words] == want
    assert lexicon.held > 20_000
    monkeypatch.setattr(toxicity, "STATE_BYTES", 20_000)
    for w, (exact, near) in zip(words, want):
        got = lexicon.features(w)
        assert np.allclose(got[:2], np.log1p([exact, near]))


def test_an_automaton_keeps_within_its_bytes():
    """States of a large random lexicon: the count of bytes follows the memory really taken."""
    import tracemalloc

    from lakeledger.llm import toxicity
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 10)))
    lexicon = toxicity.Lexicon({word(): 1.0 for _ in range(2000)})
    tracemalloc.start()
    for _ in range(3000):
        lexicon.features(word())
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert 0.5 * taken < lexicon.held < 2 * taken, (taken, lexicon.held)


def test_repeated_ids_teach_once(spark):
    """A labelled id in many rows is one training row; every row is scored."""
    from lakeledger.llm.toxicity import scored
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    one = {r.doc_id: r.score for r in scored(docs, labels).collect()}
    twice = scored(docs.unionByName(docs).unionByName(docs), labels).collect()
    assert len(twice) == 3 * len(one) and all(abs(one[r.doc_id] - r.score) < 1e-9 for r in twice)


# Shards

def test_shard_sql_has_documents_over_the_limit(spark, duck, tmp_path):
    """A document larger than a shard has a row of its own on both sides."""
    from lakeledger.llm.sharding import ORACLE_OP2, op2_extendible_shards
    from tools.check_oracle import rows_of
    rows = [(i, "x" * (1_300_000 if i == 3 else 400_000), "en", "s", 1) for i in range(9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    own = duck.cursor()
    own.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = own.execute(ORACLE_OP2.replace("FROM documents", "FROM temp.documents")).df()
    got = op2_extendible_shards(spark, str(tmp_path)).select(*want.columns).toPandas()
    assert rows_of(got) == rows_of(want) and len(want) == 9


def test_repeated_windows_bound_never_hides_a_rejection(spark):
    """Texts of few and many different words, repeated in part: the verdict by the bound is that of the whole count."""
    import random

    from lakeledger.llm.quality import judge, verdicts
    rng, texts = random.Random(7), []
    for i in range(120):
        head = [f"word{rng.randrange(1, 2 + i * 4)}" for _ in range(rng.randrange(40, 120))]
        texts.append(" ".join(head + head[:rng.randrange(0, len(head) + 1)] + [f"tail{j}" for j in range(rng.randrange(0, 60))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = judge(docs).collect()
    for r in rows:
        w = r.text.split(" ")
        seen: dict = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i:i + 3]), []).append(i)
        inside = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        assert r.n_repeat_words == len(inside)
        assert len(inside) <= 2 * (len(w) - len(set(w)))
    assert 10 < sum(r.kept for r in rows) < 110
    assert {r.doc_id: r.kept for r in rows} == {r.doc_id: r.kept for r in verdicts(docs).collect()}
