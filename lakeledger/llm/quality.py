"""Quality rules as a short-circuit cascade of SQL expressions.

Every rule is a boolean expression that rejects a document, over measures of
the text.  A documented sample gives each rule's cost (time to evaluate it
there, its measures included) and its selectivity (share of the sample it
rejects).  ``verdicts`` evaluates the rules in order of rejection per cost: a
measure is computed when the first rule needs it, and only for documents that
no earlier rule rejected, so the 3-word windows of a text are sorted only if
it still stands then.  The order changes the cost and which rule is named,
never whether a document is kept.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.llm.common import discard, saved
from lakeledger.llm.registry import register, table

#: Documents in the sample that estimates cost and selectivity.
SAMPLE = 2000
_SPACE = r"[\x20\x09-\x0D]"
_SYMBOLS = "[#*$%&|<>]+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Columns of the row that measures share; dropped at the end.
_LOCALS = ["__w", "__l", "n_lines", "n_distinct", "letters", "capitals", "marks"]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def add_measure(df: DataFrame, name: str, on: Column | None = None) -> DataFrame:
    """Add a measure and what it is made of, where ``on`` holds (NULL or 0 elsewhere).

    ``n_repeat_words`` counts the words inside 3-word windows that occur more
    than once.  Windows are compared in the row: their hashes, cut to leave
    room for the position, are sorted, so equal windows become neighbours.
    At 1,000 words 54 bits of each hash remain, at a million 44."""
    def at(x: Column) -> Column:
        return x if on is None else F.when(on, x)

    if name in df.columns:
        return df
    if name == "n_words":
        df = df.withColumn("__w", at(F.filter(F.split(_text(), _SPACE + "+"), lambda w: w != "")))
        return df.withColumn(name, F.size("__w").cast("long"))
    if name == "word_chars":
        return add_measure(df, "n_words", on).withColumn(name, at(F.length(F.array_join("__w", "")).cast("long")))
    if name == "n_symbols":
        return df.withColumn(name, at((F.length(_text()) - F.length(F.regexp_replace(_text(), _SYMBOLS, ""))).cast("long")))
    if name == "n_dup_lines":
        df = df.withColumn("__l", at(F.filter(F.split(_text(), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
        return df.withColumns({"n_lines": F.size("__l").cast("long"), name: (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")})
    if name == "n_distinct":
        return add_measure(df, "n_words", on).withColumn(name, at(F.size(F.array_distinct("__w")).cast("long")))
    if name == "letters":
        return df.withColumn(name, at(F.length(F.regexp_replace(_text(), r"[^\p{L}]+", ""))))
    if name == "capitals":
        return df.withColumn(name, at(F.length(F.regexp_replace(_text(), r"[^\p{Lu}]+", ""))))
    if name == "marks":
        return df.withColumn(name, at(F.length(_text()) - F.length(F.regexp_replace(_text(), "[!?]+", ""))))
    if name != "n_repeat_words":
        raise ValueError(name)
    df = add_measure(df, "n_words", on)
    # Bits that hold a position, and windows as hash and position in one long.  The words pass through
    # lambdas as their variables: looking them up by position costs half as much again.
    df = df.withColumn("__b", F.greatest(F.lit(1), F.ceil(F.log2(F.col("n_words") + 1)).cast("int")))
    some = F.col("n_words") >= 3 if on is None else on & (F.col("n_words") >= 3)
    df = df.withColumn("__k", F.when(some, F.expr(
        "sort_array(transform(zip_with(zip_with(slice(__w, 1, int(n_words) - 2), slice(__w, 2, int(n_words) - 2), (x, y) -> xxhash64(x, y)),"
        " slice(__w, 3, int(n_words) - 2), (h, z) -> xxhash64(h, z)), (h, i) -> shiftleft(h, __b) | i))"))
        .otherwise(F.expr("cast(array() as array<bigint>)")))
    # Positions of windows that equal a neighbour in hash order, in text order.
    df = df.withColumn("__p", F.expr(
        "sort_array(transform(filter(__k, (k, i) -> (i > 0 and shiftright(__k[i - 1], __b) = shiftright(k, __b))"
        " or (i + 1 < size(__k) and shiftright(__k[i + 1], __b) = shiftright(k, __b))), k -> k & (shiftleft(1L, __b) - 1)))")).drop("__k", "__b")
    # A window adds the words past the window before it, three at most.
    return df.withColumn(name, F.expr(
        "aggregate(transform(__p, (p, i) -> if(i = 0, 3L, least(3L, p - __p[i - 1]))), 0L, (a, x) -> a + x)")).drop("__p")


def _once(df: DataFrame, keep: list[str], computed: list[str]) -> DataFrame:
    """``computed`` behind a generator of one row per document: the optimizer then
    can't copy their expressions into every later filter and rule."""
    return df.select(*keep, F.inline_outer(F.array(F.struct(*computed))))


def with_measures(docs: DataFrame) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and what the rules need besides.

    All are longs, 0 for a NULL or empty text.  Columns of these names are replaced.
    """
    keep = [c for c in docs.columns if c not in (*MEASURES, *_LOCALS)]
    df = docs.select(keep)
    for m in (*MEASURES, "letters", "capitals", "marks"):
        df = add_measure(df, m)
    return _once(df, keep, [*MEASURES, "n_lines", "letters", "capitals", "marks"])


def rules() -> dict[str, tuple[Column, list[str]]]:
    """Rules on a document, with the measures they need; true rejects, NULL rejects nothing."""
    n = F.col("n_words")
    return {
        "few_words": (n < 50, ["n_words"]),
        "repeated_words": (100 * F.col("n_repeat_words") > 50 * n, ["n_words", "n_repeat_words"]),
        "symbols": (10 * F.col("n_symbols") > n, ["n_words", "n_symbols"]),
        "repeated_lines": (10 * F.col("n_dup_lines") > 4 * F.col("n_lines"), ["n_dup_lines"]),
        "word_length": ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n), ["n_words", "word_chars"]),
        "shouting": (10 * F.col("capitals") > 5 * F.col("letters"), ["letters", "capitals"]),
        "exclaiming": (10 * F.col("marks") > 3 * n, ["n_words", "marks"]),
        "few_letters": (10 * F.col("letters") < 5 * F.col("word_chars"), ["letters", "word_chars"]),
    }


#: The rules of the base verdict.
BASE = ("few_words", "repeated_words")


def _for_rule(df: DataFrame, needs: list[str], standing: Column) -> DataFrame:
    """Add the measures of a rule for the documents still ``standing``.

    Every word of a repeated window occurs twice in its text, so of n words
    with d different ones at most 2 (n - d) lie in such windows.  Where that
    is half of the words or less, ``repeated_words`` can't reject: the windows
    are left alone and their number counts as 0."""
    for m in needs:
        if m == "n_repeat_words" and m not in df.columns:
            df = add_measure(df, "n_distinct", standing)
            standing = standing & (4 * (F.col("n_words") - F.col("n_distinct")) > F.col("n_words"))
        df = add_measure(df, m, standing)
    return df


def cascade_order(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Rule names by rejection per cost on the ``sample`` rows with the smallest hash.

    The hash is of ``doc_id`` where there is one, else of the whole row; only
    the rows chosen are read with their texts."""
    h = F.xxhash64(*(["doc_id"] if "doc_id" in docs.columns else docs.columns))
    last = docs.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = saved(docs.where(h <= F.lit(last)).select("text").limit(sample), "quality-sample")
    rule, count, cost = rules(), {}, {}
    for r, (reject, needs) in rule.items():
        asked = _for_rule(some, needs, F.lit(True)).agg(F.count("*").alias("n"), F.count_if(reject).alias("hits"))
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            n, count[r] = asked.first()
            cost[r] = time.perf_counter() - began
    discard(some)
    free, names = min(cost.values()), list(rule)
    return sorted(names, key=lambda r: (-(count[r] / max(1, n)) / (cost[r] - free + 1e-3), names.index(r)))


def verdicts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Add ``rejected_by`` (first rejecting rule in the cascade's order, NULL if none) and ``kept``, by short circuit.

    All rows and other columns stay; NULL and empty texts have no words and
    are rejected.  An empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c not in ("rejected_by", "kept")]
    df, rule = docs.select(keep), rules()
    clash = {c: f"__own_{i}" for i, c in enumerate(keep) if c in (*MEASURES, *_LOCALS)}
    df = df.withColumnsRenamed(clash).withColumn("__by", F.lit(None).cast("string"))
    for r in cascade_order(docs, sample):
        reject, needs = rule[r]
        df = _for_rule(df, needs, F.col("__by").isNull()).withColumn("__by", F.when(F.col("__by").isNotNull(), F.col("__by")).when(reject, F.lit(r)))
    out = _once(df, [F.col(clash.get(c, c)).alias(c) for c in keep], ["__by"])
    return out.withColumnRenamed("__by", "rejected_by").withColumn("kept", F.col("rejected_by").isNull())


def judge(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Measures and verdict of every document.

    As ``verdicts``, with all measures of all documents and ``base_failed`` (a
    base rule rejects).  The measures have to be there for every row, so only
    the comparisons are cut short.
    """
    measured, rule, chain = with_measures(docs), rules(), None
    for r in cascade_order(docs, sample):
        chain = F.when(rule[r][0], r) if chain is None else chain.when(rule[r][0], r)
    base = rule[BASE[0]][0]
    for r in BASE[1:]:
        base = base | rule[r][0]
    return (measured.withColumn("base_failed", F.coalesce(base, F.lit(False)))
            .withColumn("rejected_by", chain).withColumn("kept", F.col("rejected_by").isNull()).drop("n_lines", "letters", "capitals", "marks"))


ORACLE_OP9 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM t),
m AS (
  SELECT doc_id, text, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines FROM w),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) >= 3),
gg AS (SELECT doc_id, p, array_to_string(words[p:p + 2], ' ') AS x FROM g),
d AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, x) AS c FROM gg) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM d) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters,
    length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper_letters, length(text) - length(translate(text, '!?', '')) AS marks
  FROM m LEFT JOIN r ON r.doc_id = m.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words
    OR 10 * upper_letters > 5 * letters OR 10 * marks > 3 * n_words OR 10 * letters < 5 * word_chars) AS kept
FROM b
"""


@register("op9_quality_cascade", ORACLE_OP9)
def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, with the rule that rejected it."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
