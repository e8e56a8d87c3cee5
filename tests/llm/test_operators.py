"""The llm operators on small fixtures: brute force, round trips, odd rows."""

import hashlib
import zlib

import pytest

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_words int, score string"
ODD = [(1, None, None, 1, "x"), (2, "", "en", 2, None), (3, " \n\t ", "en", None, None), (4, "a b c", "en", 3, "y"), (4, "a b c", "en", 3, "y"),
       (5, "A B  C", None, 3, None), (None, "a b c", "en", 3, None), (7, "word " * 30_000, "en", 0, None),
       (8, "<|endoftext|> naïve ΑΣ 12½ don't", "fr", 0, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_encode_and_decode_equal_the_library(odd, library):
    from lakeledger.llm.bpe import decode, encode
    rows = decode(encode(odd)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_encode_empty_table(odd):
    from lakeledger.llm.bpe import encode
    assert encode(odd.where("false")).collect() == []


def test_packing_places_every_token_once(odd, library):
    from lakeledger.llm.packing import pack
    pieces = pack(odd).collect()
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ODD)
    assert sum(p.length for p in pieces) == total
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
        assert zlib.crc32(b"".join(int.from_bytes(p.ids[i:i + 2], "little").to_bytes(4, "little") for i in range(0, len(p.ids), 2))) == p.ids_crc32
    for seq in seqs.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at & (at - 1) == 0
    by_doc = {}
    for p in pieces:
        if p.doc_id in (7, 8):
            by_doc.setdefault(p.doc_id, []).append(p)
    for doc_id, text in ((7, ODD[7][1]), (8, ODD[8][1])):
        ids = b"".join(p.ids for p in sorted(by_doc[doc_id], key=lambda p: p.start))
        got = [int.from_bytes(ids[i:i + 2], "little") for i in range(0, len(ids), 2)]
        assert got == library.encode(text, add_special_tokens=False).ids + [2]
    assert pack(odd.where("false")).collect() == []


@pytest.mark.parametrize("block, single", [(256, 16), (8, 0)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, block, single):
    from lakeledger.llm import jaccard_join
    from lakeledger.llm.jaccard_join import link_components
    monkeypatch.setattr(jaccard_join, "FAMILY_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SINGLE_PAIRS", single)
    import random
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    rows = [(i, t) for i, t, *_ in ODD]
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, " ".join(base).upper()), (200, " ".join(base))]
    got = link_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    want = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        want.append((doc_id, len(sets[i]), min(ids, default=None)))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("linked", [False, True])
def test_large_classes_meet_in_blocks(spark, monkeypatch, linked):
    """Two classes of 60 sets that share a passage: no row for each pair, and the one link is found."""
    from lakeledger.llm import jaccard_join
    monkeypatch.setattr(jaccard_join, "FAMILY_BLOCK", 16)
    shared = [f"s{i}" for i in range(40)]
    text = {(c, k): " ".join(shared + [f"{c}{k}x{i}" for i in range(40)]) for c in "pq" for k in range(60)}
    if linked:
        text["q", 59] = text["p", 7] + " more"
    labels = spark.createDataFrame([(c.encode(), c.encode(), f"{c}{k}".encode()) for c, k in text], "g binary, comp binary, sig binary")
    texts = spark.createDataFrame([(f"{c}{k}".encode(), t) for (c, k), t in text.items()], "sig binary, text string")
    met = spark.createDataFrame([(b"p", b"p", b"q", b"q")], "g binary, comp binary, g2 binary, comp2 binary")
    links = jaccard_join._across(met, labels, texts, 4, 85)
    assert {(bytes(r.a), bytes(r.b)) for r in links.collect()} == ({(b"q", b"p")} if linked else set())


def test_jaccard_empty_table(odd):
    from lakeledger.llm.jaccard_join import link_components
    assert link_components(odd.where("false")).collect() == []


def test_top_k_equals_brute_force(spark):
    from lakeledger.llm.mtree import top_k
    import math
    import random
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)], i % 3) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(80)] + [(2000, None, 1), (2050, [float("nan")] * 6, 1), (2051, [None] * 6, 1), (None, rows[3][1], 1)]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).collect()))
    import numpy as np
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty).collect() == []


PAGES = [(1, "u", "<p>x</p>", 9), (2, "u", "<p>x</p>", 9), (3, None, None, 9), (4, "a b", "", None), (None, "n", "<p>x</p>", 1),
         (-5, "m", "<p>ä</p>", 1), (2, "u", "<p>x</p>", 9)]


def test_warc_round_trip(spark, tmp_path):
    from lakeledger.llm.warc import digest32, read_warc, write_warc
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")
    manifest = write_warc(pages, str(tmp_path / "w"), roll_bytes=300)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    got = read_warc(spark, str(tmp_path / "w")).collect()
    want = []
    for page_id, _, text, _ in PAGES:
        data = (text or "").encode()
        same = [p for p, _, t, _ in PAGES if (t or "") == (text or "") and p is not None]
        top = max(same) if same and sum((t or "") == (text or "") for _, _, t, _ in PAGES) > 1 else page_id
        revisit = top is not None and page_id != top
        want.append((page_id, len(data), digest32(data), "revisit" if revisit else "response", top if revisit else None))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(have, key=lambda r: repr(r)) == sorted(want, key=lambda r: repr(r))
    assert all(bytes(r.payload).decode() in {t or "" for _, _, t, _ in PAGES} for r in got if r.record_type == "response")
    write_warc(pages.where("false"), str(tmp_path / "e"))
    assert read_warc(spark, str(tmp_path / "e")).collect() == []


def test_warc_files_are_deterministic(spark, tmp_path):
    from lakeledger.llm.warc import write_warc
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")
    sums = []
    for name in "ab":
        write_warc(pages, str(tmp_path / name))
        sums.append({f.name: hashlib.md5(f.read_bytes()).hexdigest() for f in (tmp_path / name).glob("*.warc.gz")})
    assert sums[0] == sums[1] and sums[0]


P = "<p>" + "Lorem ipsum dolor sit amet, consectetur elit. " * 4 + "</p>"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<br>b&nbsp; c<p>d", "a b c\nd"),
    ("<nav>menu</nav><article><h1>T</h1><p>one <b>two</b><script>x()</script></p><form>f</form></article><footer>foot</footer>", "T\none two"),
    ("<body><div class='menu'><a>h</a></div><div id=content><h2>T</h2>" + P + P + "</div><div class='comments'><p>nice</p></div></body>",
     "T\n" + "\n".join([("Lorem ipsum dolor sit amet, consectetur elit. " * 4).strip()] * 2)),
])
def test_main_text(page, text):
    from lakeledger.llm.html_text import extract
    assert extract(page) == text


LOREM = ("Lorem ipsum dolor sit amet, consectetur elit. " * 4).strip()
NOTE = "<p>Nice.</p>"


@pytest.mark.parametrize("page, text", [
    # Names of a layout that only mention a part.
    *[(f"<body><div class='{c}'><h2>T</h2>{P}{P}</div><div class='menu'><a>h</a></div></body>", f"T\n{LOREM}\n{LOREM}")
      for c in ("content has-sidebar", "post no-comments", "layout with_sidebar", "layout-without-left-sidebar", "page-sidebar-left", "main-menu-open")],
    # The article or main element inside a named wrapper, also where other text is longer.
    (f"<body><div class='layout-sidebar'><article>{P}</article></div><div>{NOTE}</div></body>", LOREM),
    (f"<body><div id='comments-open'><main>{P}</main></div></body>", LOREM),
    (f"<body><article class='post category-social'>{P}</article><div class='sidebar'>{NOTE}</div></body>", LOREM),
    # Names still take out what is beside the article, articles of its own or not.
    (f"<body><main><div>{P}{P}</div><div class='comments'><article>{NOTE}</article><article>{NOTE}</article></div></main></body>", f"{LOREM}\n{LOREM}"),
    (f"<body><article>{P}{P}</article><div class='comments'>{P * 5}</div></body>", f"{LOREM}\n{LOREM}"),
    (f"<body><article>{P}{P}<div class='related'>{NOTE}</div></article><div class='sidebar'><article>{NOTE}</article></div></body>", f"{LOREM}\n{LOREM}"),
    (f"<body><div id='content'>{P}{P}</div><div class='comments'>{'<div class=comment>' + P + '</div>'}{'<div class=comment>' + P + '</div>'}"
     f"{'<div class=comment>' + P + '</div>'}</div></body>", f"{LOREM}\n{LOREM}"),
    # Three named parts of equal length are all that there is.
    ("<body>" + f"<div class='widget'>{P}</div>" * 3 + "</body>", "\n".join([LOREM] * 3)),
])
def test_main_text_in_elements_named_like_boilerplate(page, text):
    from lakeledger.llm.html_text import extract
    assert extract(page) == text


def test_main_text_keeps_rows_and_columns(spark):
    from lakeledger.llm.html_text import with_main_text
    pages = spark.createDataFrame([(1, "<p>a</p>", "old"), (1, "<p>a</p>", "old"), (None, None, None)], "page_id long, html string, text string")
    assert sorted(map(repr, with_main_text(pages).select("page_id", "text", "n_chars").collect())) == sorted(
        map(repr, spark.createDataFrame([(1, "a", 1), (1, "a", 1), (None, "", 0)], "page_id long, text string, n_chars long").collect()))


def test_quality_measures_equal_brute_force(spark, odd):
    from lakeledger.llm.quality import judge
    import re
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang"), allowMissingColumns=True)
    rows = judge(docs).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i:i + 3]), []).append(i)
        rep = {j for p in at.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert judge(docs.where("false")).collect() == []


def test_shards_fit_their_limit(spark, odd):
    from lakeledger.llm.sharding import shards
    rows = odd.unionByName(odd.where("doc_id = 7")).withColumn("size", F.octet_length("text"))
    out = shards(rows, "doc_id", "size", 40).collect()
    assert len(out) == rows.count()
    sums = {}
    for r in out:
        sums.setdefault((r.shard_depth, r.shard_prefix, r.shard_part), []).append(r["size"] or 0)
    # Rows of one key have one hash; bits cannot part them.
    assert all(sum(s) <= 40 or len(s) == 1 or k[0] == 60 for k, s in sums.items())
    keys = sorted((d, p) for d, p, _ in sums)
    assert not any(d < e and q >> (e - d) == p for d, p in keys for e, q in keys)
    assert shards(rows.where("false"), "doc_id", "size", 40).collect() == []


def test_shards_of_one_key_fit_their_limit(spark, monkeypatch):
    from lakeledger.llm import sharding
    monkeypatch.setattr(sharding, "BLOCK", 20)
    sizes = [(i * 37) % 90 for i in range(300)] + [0, 0, None, 100, 250]
    rows = spark.createDataFrame([(i, "a" if i % 10 else f"b{i}", n) for i, n in enumerate(sizes)], "id long, source string, size int").repartition(5)
    out = sharding.shards(rows, "source", "size", 100).collect()
    assert sorted(r.id for r in out) == list(range(len(sizes)))
    sums = {}
    for r in out:
        sums.setdefault((r.shard_depth, r.shard_prefix, r.shard_part), []).append(r["size"] or 0)
    assert all(sum(s) <= 100 or len(s) == 1 for s in sums.values())


def test_licenses(spark):
    from lakeledger.llm.licenses import scan_licenses
    rows = [(1, "Intro.\nReleased under the MIT License.\nrest", "z"), (2, None, "z"), (3, "", None), (4, "We talk of an MIT licence here.", "z"),
            (5, "Licensed under the Apache License, Version 2.0.", "z"), (5, "Licensed under the Apache License, Version 2.0.", "z"),
            (6, "This work is licensed under the GNU General Public License, version 3. All rights reserved.", "z")]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string"))
    assert sorted((r.doc_id, r.license or "") for r in out.collect()) == [
        (1, "MIT"), (2, ""), (3, ""), (4, ""), (5, "Apache-2.0"), (5, "Apache-2.0"), (6, "GPL-3.0")]
    assert scan_licenses(out.where("false")).collect() == []


def test_licenses_in_wrapped_texts(spark):
    from lakeledger.llm.licenses import scan_licenses
    gpl3 = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
            "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    lgpl = ["This library is free software; you can redistribute it and/or", "modify it under the terms of the GNU Lesser General Public",
            "License as published by the Free Software Foundation; either", "version 3 of the License, or (at your option) any later version."]
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal",
           "in the Software without restriction, subject to the following conditions:", "",
           "The above copyright notice and this permission notice shall be included in all", "copies or substantial portions of the Software."]
    bsd = ["Copyright (c) 2020, A. Writer", "All rights reserved.", "", "Redistribution and use in source and binary forms, with or without",
           "modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the notice.",
           "3. Neither the name of the copyright holder nor the names of its", "   contributors may be used to endorse or promote products derived from",
           "   this software without specific prior written permission."]
    cases = [
        ("\n".join(gpl3), "GPL-3.0"), (" ".join(gpl3), "GPL-3.0"), ("/*\n * " + "\n * ".join(gpl3) + "\n */\nint x;", "GPL-3.0"),
        ("\r\n".join(gpl3).replace("software: you", "software; you").replace("tion, either version 3", "tion; either version 2"), "GPL-2.0"),
        ("\n".join(lgpl), "LGPL"), ("\n".join(gpl3).replace("GNU General", "GNU Affero General"), "AGPL"),
        ("\n".join(mit), "MIT"), ("\n".join(bsd), "BSD-3-Clause"), ("\n".join(bsd[:6]), "BSD"),
        ("Licensed under the Apache License,\nVersion 2.0 (the \"License\");\nyou may not use this file except in compliance.", "Apache-2.0"),
        ("                Apache License\n          Version 2.0, January 2004\n", "Apache-2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not", "MPL-2.0"),
        ("This project is licensed under the MIT License.", "MIT"), ("This project is licensed under the\nMIT License - see the LICENSE file for details", "MIT"),
        ("The source code is released under the MIT\nlicense.", "MIT"), ("This file is in the public\ndomain.", "Public-Domain"),
        ("This dataset is licensed under\nCC BY-SA 4.0.", "CC-BY-SA"),
        ("My library 1.0\nReleased under the MIT License\nHave fun", "MIT"), ("Copyright 2020 A\nReleased under the MIT License\nAll rights reserved", "MIT"),
        # No licence: talk of one, a denial over a line end, and words on both sides of an empty line.
        ("We talk of an MIT\nlicence here.", None), ("This file is not\nlicensed under the MIT License.", None),
        ("This project is licensed\n\nunder the MIT License.", None), ("Copyright (c) 2020\nA, B and C, all rights\nreserved.", "All-Rights-Reserved"),
    ]
    out = scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"))
    found = {r.doc_id: (cases[r.doc_id][0], r.license) for r in out.collect()}
    assert [found[i] for i in range(len(cases))] == cases
    lines = "Released under the MIT License\nReleased under the MIT License\nAll rights reserved"
    assert scan_licenses(spark.createDataFrame([(lines,)], "text string")).first().license_ids == ["mit-name", "mit-name", "all-rights"]
    # A long text without a sentence end.
    assert scan_licenses(spark.createDataFrame([("copyright " + "word and\n" * 50_000,)], "text string")).first().license_ids == []


def test_levenshtein_lexicon():
    from lakeledger.llm.toxicity import Lexicon
    lex = Lexicon({"idiot": 5.0, "vequ*": 4.0, "worthless": 3.0, "scum": 2.0})
    for word, want in {"idiot": (5.0, 0.0), "idi0t": (0.0, 5.0), "iidiot": (0.0, 5.0), "idot": (0.0, 5.0), "idiotic": (0.0, 0.0), "vequaire": (4.0, 0.0),
                       "vaqu": (0.0, 0.0), "wrthles": (0.0, 3.0), "scum": (2.0, 0.0), "scums": (0.0, 0.0), "": (0.0, 0.0)}.items():
        assert lex.read(word) == want
    assert lex.features('he called you an "idiot" there')[2] > 0 == lex.features("you idiot there")[2]


def test_levenshtein_stems():
    from lakeledger.llm.toxicity import Lexicon
    lex = Lexicon({"idiot*": 5.0, "vequ*": 4.0, "clown": 3.0})
    for word, want in {"idiot": (5.0, 0.0), "idiotic": (5.0, 0.0), "idi0t": (0.0, 5.0), "idi0ts": (0.0, 5.0), "1diotic": (0.0, 5.0), "iidiots": (0.0, 5.0),
                       "idotic": (0.0, 5.0), "id10tic": (0.0, 0.0), "vequaire": (4.0, 0.0), "vaquaire": (0.0, 0.0), "cl0wn": (0.0, 3.0),
                       "cl0wns": (0.0, 0.0), "other": (0.0, 0.0), "": (0.0, 0.0)}.items():
        assert lex.read(word) == want, word
    assert Lexicon({"idiot*": 5.0}).read("idi0ts") == (0.0, 5.0)


def test_toxicity_on_held_out_rows(spark):
    from lakeledger.llm.toxicity import scored
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = scored(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.97 * len(rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.02 * len(rows)


def test_toxicity_odd_rows(spark, odd):
    from lakeledger.llm.toxicity import scored
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = scored(odd, none).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)
    assert scored(odd.where("false"), none).collect() == []
