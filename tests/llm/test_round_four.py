"""Findings of the third round's report (FINDINGS_r03.md), training-data operators."""

import random

from lakeledger.llm.bpe import codec_of


def test_codec_searches_for_rare_characters_only_where_they_are():
    """op7: the pattern of late lower-case forms runs over no text that has none of them."""
    from tokenizers import Tokenizer

    import public_tokenizers

    class Late:
        def __init__(self, pattern):
            self.pattern, self.runs = pattern, 0

        def sub(self, *args):
            self.runs += 1
            return self.pattern.sub(*args)

    codec, truth = codec_of(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    codec.late = Late(codec.late)
    texts = [None, "", "  ", "Caf\u00e9 \u00c9t\u00e9", "a\x1cb\x1f c", *(f"w{i} \u00fc" for i in range(40)), ""]
    for more, runs in (([], 0), (list(codec.lower)[:1], 1)):
        flat, ends = codec.encode(texts + more)
        want = [truth.encode(t or "", add_special_tokens=False).ids for t in texts + more]
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
        assert codec.late.runs == runs


def test_near_copies_in_several_families_are_not_listed_pair_by_pair(spark, monkeypatch):
    """Copies with one, two or four edits: leaders that share little split them into families that all meet."""
    from lakeledger.llm import jaccard_join
    rng = random.Random(2)
    words = [f"w{i}" for i in range(20_000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for _ in range(1500):
        t = list(base)
        for _ in range(rng.choice((1, 2, 4, 4, 4, 4))):
            t[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(t))
    across, listed = jaccard_join._across, []
    monkeypatch.setattr(jaccard_join, "_across", lambda met, *a: listed.append(met.count()) or across(met, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(docs, 4, 85).collect()}
    assert listed[0] <= 2 * len(texts)

    places, masks = {}, []
    for t in texts:
        w = t.split()
        masks.append(sum({1 << places.setdefault(tuple(w[i:i + 4]), len(places)) for i in range(len(w) - 3)}))
    size, parent = [m.bit_count() for m in masks], list(range(len(masks)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, m in enumerate(masks):
        for j in range(i):
            both = (m & masks[j]).bit_count()
            if 100 * both >= 85 * (size[i] + size[j] - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    assert got == {i: root(i) for i in range(len(texts))}


def test_tags_below_deep_inline_elements_take_linear_time():
    """op1: finding the elements that a tag closes does not walk up to the page's root."""
    import time

    from lakeledger.llm.html_text import extract
    for page, text in (("<b>" * 20_000 + "<li>x</i></q>" * 20_000, "\n".join("x" * 20_000)),
                       ("<p>" + "<b>" * 20_000 + "<td>x</i>" * 20_000, None), ("<i><p>" + "<b>" * 20_000 + "x</i>" * 20_000, None)):
        t = time.process_time()
        got = extract(page)
        assert time.process_time() - t < 5, page[:40]
        assert text is None or got == text
