"""Licence recognition by sentences and ordered rules, in SQL functions only.

A text is cut into pieces at line ends and sentence ends.  A run of pieces
(a sentence may be wrapped over lines) is normalised: words of a-z and 0-9,
the subject ("this project is hereby"), the verb ("released under the terms
of the") and references after it reduced to one form.  The normalised
sentence is looked up in tables of known licence sentences:
names of licences, titles, and the sentences of licence texts and notices,
the last by their first words.  The identifiers in text order are a sequence;
ordered rules over identifiers name the licences.

Runs don't cross a line without letters or digits, and none starts after a
piece that ends with a denial.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.llm.registry import register, table

#: Pieces that a sentence may be wrapped over.
PIECES = 16

# ---- fixed values: licence names, sentences and rules -----------------------
#: Identifier of the name sentence, licence, names (normalised, without "license" at the end).
NAMED = [
    ("mit-name", "MIT", ["mit", "expat", "mit expat", "mit x11"]),
    ("apache-2-name", "Apache-2.0", ["apache 2 0", "apache 2", "apache version 2 0", "apache version 2", "apache license 2 0", "apache license version 2 0",
                                     "apache license version 2", "apache license v2 0", "apache license v2", "apache software license version 2 0", "asl 2 0"]),
    ("apache-name", "Apache", ["apache", "apache software"]),
    ("bsd-3-name", "BSD-3-Clause", ["bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd"]),
    ("bsd-2-name", "BSD-2-Clause", ["bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"]),
    ("bsd-name", "BSD", ["bsd", "bsd style"]),
    ("isc-name", "ISC", ["isc"]),
    ("zlib-name", "Zlib", ["zlib", "zlib libpng"]),
    ("boost-name", "BSL-1.0", ["boost", "boost software", "boost software license 1 0", "boost software license version 1 0", "bsl 1 0"]),
    ("mpl-2-name", "MPL-2.0", ["mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0",
                               "mozilla public license v2 0", "mpl 2 0", "mpl v2 0", "mpl version 2 0"]),
    ("mpl-name", "MPL", ["mozilla public", "mpl"]),
    ("epl-2-name", "EPL-2.0", ["eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v 2 0", "epl 2 0", "epl v2 0"]),
    ("epl-1-name", "EPL-1.0", ["eclipse public license 1 0", "eclipse public license version 1 0", "eclipse public license v 1 0", "epl 1 0", "epl v1 0"]),
    ("epl-name", "EPL", ["eclipse public", "epl"]),
    ("unlicense-name", "Unlicense", ["unlicense"]),
    ("cc0", "CC0", ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero", "creative commons cc0", "creative commons zero v1 0 universal"]),
]
#: Key, licence, full name, short names, versions that are licences of their own.
GNU = [("gpl", "GPL", "general", ["gpl"], ["2", "3"]), ("lgpl", "LGPL", "lesser general", ["lgpl"], ["2 1", "3"]),
       ("lgpl", "LGPL", "library general", [], ["2"]), ("agpl", "AGPL", "affero general", ["agpl"], ["3"])]
#: Elements of the Creative Commons licences, most restricted first.
CC = [("by nc nd", "attribution noncommercial noderivatives"), ("by nc sa", "attribution noncommercial sharealike"),
      ("by nd", "attribution noderivatives"), ("by nc", "attribution noncommercial"), ("by sa", "attribution sharealike"), ("by", "attribution")]
#: Whole sentences and titles.
SENTENCES = {
    "mit license": "mit-title", "the mit license": "mit-title", "mit license mit": "mit-title", "the mit license mit": "mit-title",
    "apache license version 2 0": "apache-2-title", "apache license version 2 0 january 2004": "apache-2-title", "isc license": "isc-title",
    "bsd 3 clause license": "bsd-3-title", "bsd 2 clause license": "bsd-2-title", "boost software license version 1 0": "boost-title",
    "boost software license version 1 0 august 17th 2003": "boost-title", "mozilla public license version 2 0": "mpl-2-title",
    "eclipse public license v 2 0": "epl-2-title", "eclipse public license v 1 0": "epl-1-title", "the unlicense": "unlicense-title",
    "you may not use this file except in compliance with the license": "apache-2-use", "all rights reserved": "all-rights",
    "in the public domain": "public-domain",
}
#: First words of the sentences of licence texts and notices.
HEADS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-notice",
    "the software is provided as is without warranty of any kind": "as-is",
    "this software is provided as is without warranty of any kind": "as-is",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software": "boost-grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-redistribution",
    "neither the name may be used to endorse or promote products": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0": "epl-2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl-2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 1 0": "epl-1-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
}
#: Words that a subject or a text's kind may be.
_KIND = ("work|works|program|software|project|file|code|library|package|repository|module|script|tool|application|app|plugin|framework|document|"
         "documentation|data|dataset|text|article|book|page|site|website|content|contents|material|source|sample|example|crate|and|its|all")
#: Words that may stand before a name of a licence; ``@`` stands for "under".
CANONICAL = [
    ("licence", "license"),
    (r"^(?:[0-9]{1,2}|[a-z]) ", ""),
    (r"^(?:this|the|our|all)(?: (?:" + _KIND + r"|open|entire|whole)){1,4} (?:is|are|has been|have been)(?: (?:hereby|dual|also|now|being))* "
     r"(?:licensed|released|distributed|available|made available|published|provided) (?:under|with|subject to) ", "licensed under "),
    (r"^(?:dual )?(?:licensed|released|distributed|available|made available|published|provided) (?:under|with|subject to) ", "@ "),
    (r"^license (?:is )?", "@ "),
    (r"^spdx license identifier ", "@ "),
    (r"^@ (?:either )?(?:of )?(?:the )?(?:terms of )?(?:either )?(?:of )?(?:the |a |an )?", "@ "),
    (r" (?:see|please see|read|https?|unless|you may|as described|as found) .*$", ""),
    (r"(?: or| and)?(?: at your option)?(?: any)? later(?: versions?)?$", " plus"),
    (r"^this(?: (?:" + _KIND + r")){1,3} (?:is|has been) (?:hereby )?(?:released |placed |dedicated )?(?:in|into|to) the public domain", "in the public domain"),
    (r"^(?:[a-z0-9]+ ){1,6}is free software you can redistribute it and or modify it under the terms of (?:the )?", "& "),
    (r"^neither the name of (?:[a-z0-9]+ ){1,40}?may be used to endorse", "neither the name may be used to endorse"),
]
#: A copyright line ends in this sentence only where no licence lies between.
_RIGHTS = (r"^(?:c )?copyright .{0,400}all rights reserved$", r"licen|permission|redistribut|released|distributed|available|public domain")
#: Rules in order: licence, pattern over ``|id|id|``, licences that make this one superfluous.
RULES = (
    [(f"CC-{e.upper().replace(' ', '-')}", rf"\|cc-{e.replace(' ', '-')}\|", []) for e, _ in CC]
    + [("CC0", r"\|cc0\|", []), ("AGPL", r"\|agpl(?:-[0-9-]+)?-(?:name|notice|title)\|", []), ("LGPL", r"\|lgpl(?:-[0-9-]+)?-(?:name|notice|title)\|", []),
       ("GPL-3.0", r"\|gpl-3-(?:name|notice|title)\|", []), ("GPL-2.0", r"\|gpl-2-(?:name|notice|title)\|", []),
       ("GPL", r"\|gpl-(?:name|notice)\|", ["GPL-3.0", "GPL-2.0"]),
       ("Apache-2.0", r"\|apache-2-(?:name|title)\|", []), ("Apache", r"\|apache-name\|", ["Apache-2.0"]),
       ("MPL-2.0", r"\|mpl-2-(?:name|title|notice)\|", []), ("MPL", r"\|mpl-name\|", ["MPL-2.0"]),
       ("EPL-2.0", r"\|epl-2-(?:name|title|notice)\|", []), ("EPL-1.0", r"\|epl-1-(?:name|title|notice)\|", []),
       ("EPL", r"\|epl-name\|", ["EPL-2.0", "EPL-1.0"]),
       ("BSD-3-Clause", r"\|bsd-3-(?:name|title)\||\|bsd-redistribution\|(?:.*\|)?bsd-endorse\|", []), ("BSD-2-Clause", r"\|bsd-2-(?:name|title)\|", []),
       ("BSD", r"\|bsd-(?:redistribution|name)\|", ["BSD-3-Clause", "BSD-2-Clause"]),
       ("BSL-1.0", r"\|boost-(?:name|title|grant)\|", []), ("ISC", r"\|isc-(?:name|title|grant)\|", []),
       ("Zlib", r"\|zlib-name\||\|zlib-as-is\|(?:.*\|)?zlib-origin\|", []),
       ("MIT", r"\|mit-(?:name|title)\||\|mit-grant\|(?:.*\|)?(?:mit-notice|as-is)\|", []),
       ("Unlicense", r"\|unlicense-(?:name|title|notice)\|", []), ("Public-Domain", r"\|public-domain\|", []),
       ("All-Rights-Reserved", r"\|all-rights\|", [])])
#: Only texts with one of these words, only runs that begin like this, and none after these words, are looked at.
_HINT = (r"(?i)licen[cs]|permission|copyright|redistribut|rights\W+reserved|warranty|free\W+software|endorse|public\W+domain|creative\W+commons|misrepresented"
         r"|\b[AL]?GPL|\bGNU\b|\bMPL\b|\bEPL\b|\bCC[ -]BY|\bCC0\b")
_START = (r"^(?:(?:[0-9]{1,2}|[a-z]) )?(?:this|the|our|all|licen[cs]ed?|released|distributed|available|made|published|provided|dual|spdx|permission|redistribution|"
          r"neither|copyright|you|mit|apache|isc|bsd|boost|mozilla|eclipse|gnu|in)(?: |$)|^(?:[a-z0-9]+ ){1,6}is free software")
_DENIED = r"(?:^| )(?:not|never|nor|isn t|aren t|wasn t)$"
#: Piece ends, and lines without letters or digits (they become a piece of their own).
_ENDS, _BLANK = r"[.;:!?]+(?:\s|\z)|\n", r"\n[^\p{L}\p{N}\n]*\n"
# -----------------------------------------------------------------------------
_MARK = "\x01"


def known_names() -> dict[str, str]:
    """Licence name -> identifier, from the tables above."""
    out: dict[str, str] = {}
    for ident, _, names in NAMED:
        for n in names:
            out |= {n: ident, f"{n} license": ident, f"{n} license the license": ident, f"{n} the license": ident}
    for key, _, full, short, versions in GNU:
        for base in [f"gnu {full} public license", f"gnu {full} public licenses", *short, *(f"gnu {s}" for s in short), *(f"{s} license" for s in short)]:
            out[base] = out[f"{base} plus"] = f"{key}-name"
            for v in versions:
                ident = f"{key}-{v.replace(' ', '-')}-name"
                for form in {v, f"{v} 0"} if " " not in v else {v}:
                    for mid in (" version ", " v", " v ", " ", " license version "):
                        out |= {f"{base}{mid}{form}": ident, f"{base}{mid}{form} plus": ident, f"{base}{mid}{form} only": ident}
                    if base in short:
                        out |= {f"{base}v{form}": ident, f"{base}v{form} plus": ident}
    for short, full in CC:
        for base in (f"cc {short}", f"creative commons {short}", f"creative commons {full}", f"cc {full}"):
            for version in ("", " 1 0", " 2 0", " 2 5", " 3 0", " 4 0"):
                for scope in ("", " international", " unported", " generic"):
                    for end in ("", " license", " public license"):
                        out[f"{base}{version}{scope}{end}"] = f"cc-{short.replace(' ', '-')}"
                        if version:
                            out[f"{base}{end}{version}{scope}"] = f"cc-{short.replace(' ', '-')}"
    return out


def known_sentences() -> dict[str, str]:
    """Whole normalised sentence -> identifier."""
    out = dict(SENTENCES)
    for key, _, full, _, versions in GNU:
        by = "as published by the free software foundation"
        notice = f"& gnu {full} public license"
        out |= {f"{notice} {by}": f"{key}-notice", notice: f"{key}-notice"}
        for v in versions:
            ident = f"{key}-{v.replace(' ', '-')}-notice"
            for form in {v, f"{v} 0"} if " " not in v else {v}:
                for form_of in (f"{notice} {by} either version {form} of the license", f"{notice} {by} version {form} of the license",
                                f"{notice} version {form} {by}", f"{notice} version {form}"):
                    out |= {form_of: ident, f"{form_of} plus": ident, f"{form_of} or at your option plus": ident}
            for day in ("", " june 1991", " 29 june 2007", " 19 november 2007", " february 1999"):
                out[f"gnu {full} public license version {v}{day}"] = f"{key}-{v.replace(' ', '-')}-title"
    return out


def _lookup(found: dict[str, str]) -> Column:
    """The table as a constant map from a sentence to its identifier."""
    return F.str_to_map(F.lit("\n".join(f"{s}\t{i}" for s, i in sorted(found.items()))), F.lit("\n"), F.lit("\t"))


def _pieces(text: Column) -> Column:
    lower = F.translate(F.regexp_replace(text, "\r\n?", "\n"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = F.regexp_replace(F.translate(lower, _MARK, " "), _BLANK, f"\n{_MARK}\n")
    cut = F.transform(F.split(marked, _ENDS), lambda p: F.trim(F.regexp_replace(p, f"[^a-z0-9{_MARK}]+", " ")))
    return F.filter(cut, lambda p: p != "")


def canonical(s: Column) -> Column:
    """The one form of a normalised run that the tables hold."""
    out = reduce(lambda x, rule: F.regexp_replace(x, *rule), CANONICAL, s)
    return F.when(out.rlike(_RIGHTS[0]) & ~out.rlike(_RIGHTS[1]), F.lit("all rights reserved")).otherwise(out)


def sentence_ids(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: identifiers of the known licence sentences of column ``text``, in text order.

    At each start the longest run that is a known sentence counts, else the
    shortest that begins like one; runs that overlap one counted before don't."""
    names, whole, heads = (_lookup(x) for x in (known_names(), known_sentences(), HEADS))
    sizes = sorted({len(h.split()) for h in HEADS})
    longest = max(len(x) for t in (known_names(), known_sentences(), HEADS) for x in t)

    def found(table_: Column, s: Column) -> Column:
        return F.when(F.length(s) <= longest, F.try_element_at(table_, s))

    def full(s: Column) -> Column:
        parts = F.split(F.substring(s, 3, 1_000_000), " (?:or|and|with) (?:the )?")
        one, all_ = found(names, F.substring(s, 3, 1_000_000)), F.transform(parts, lambda p: found(names, p))
        several = F.when((F.size(parts) > 1) & F.forall(all_, lambda x: x.isNotNull()), all_).otherwise(F.array().cast("array<string>"))
        return (F.when(~s.startswith("@ "), F.array_compact(F.array(found(whole, s))))
                .otherwise(F.when(one.isNotNull(), F.array(one)).otherwise(several)))

    def head(s: Column) -> Column:
        tries = [F.when(F.size(F.split(s, " ")) >= n, found(heads, F.substring_index(s, " ", n))) for n in sizes]
        return F.array_compact(F.array(F.coalesce(*tries)))

    p = F.col("__pieces")
    # Position and words of every run start: up to PIECES pieces, cut at a blank line.
    start = F.transform(F.filter(F.transform(p, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.get(p, i - 1).alias("before"))),
                                 lambda x: x["x"].rlike(_START) & ~F.coalesce(x["before"].rlike(_DENIED), F.lit(False))),
                        lambda x: F.struct(x["i"].alias("i"), F.filter(F.split(F.get(F.split(
                            F.array_join(F.slice(p, x["i"] + 1, PIECES), "\n"), _MARK), F.lit(0)), "\n"), lambda w: w != "").alias("w")))
    runs = F.transform(F.col("__starts"), lambda x: F.struct(x["i"].alias("i"), F.transform(
        F.sequence(F.lit(1), F.size(x["w"])), lambda n: F.struct(n.alias("n"), canonical(F.array_join(F.slice(x["w"], F.lit(1), n), " ")).alias("s"))).alias("r")))
    hits = F.transform(F.col("__runs"), lambda x: F.struct(
        x["i"].alias("i"),
        F.array_max(F.filter(F.transform(x["r"], lambda r: F.struct(r["n"].alias("n"), full(r["s"]).alias("ids"))), lambda r: F.size(r["ids"]) > 0)).alias("whole"),
        F.array_min(F.filter(F.transform(x["r"], lambda r: F.struct(r["n"].alias("n"), head(r["s"]).alias("ids"))), lambda r: F.size(r["ids"]) > 0)).alias("head")))
    flat = F.filter(F.transform(F.col("__hits"), lambda x: F.struct(x["i"].alias("i"), F.coalesce(x["whole"], x["head"]).alias("h"))), lambda x: x["h"].isNotNull())
    first = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("ids"))
    taken = F.aggregate(F.col("__flat"), first, lambda acc, x: F.when(x["i"] > acc["end"], F.struct(
        (x["i"] + x["h"]["n"] - 1).alias("end"), F.concat(acc["ids"], x["h"]["ids"]).alias("ids"))).otherwise(acc), lambda acc: acc["ids"])
    t = F.coalesce(F.col(text), F.lit(""))
    steps = {"__pieces": F.when(t.rlike(_HINT), _pieces(t)), "__starts": start, "__runs": runs, "__hits": hits, "__flat": flat,
             out: F.coalesce(taken, F.array().cast("array<string>"))}
    for name, column in steps.items():
        docs = docs.withColumn(name, column)
    return docs.drop(*[n for n in steps if n != out])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Add ``license_ids`` (array, in text order), ``licenses`` (all that the rules name, in rule order) and ``license`` (the first; NULL if none).

    The whole text is read.  A NULL or empty text has no sentences.  All rows
    and other columns stay; columns of the three names are replaced.
    """
    out = sentence_ids(docs.drop("license_ids", "licenses"), "text", "license_ids")
    seq = F.concat(F.lit("|"), F.array_join("license_ids", "|"), F.lit("|"))
    patterns = {licence: pattern for licence, pattern, _ in RULES}
    hit = [F.when(reduce(lambda c, o: c & ~seq.rlike(patterns[o]), over, seq.rlike(pattern)), F.lit(licence)) for licence, pattern, over in RULES]
    licenses = F.when(F.size("license_ids") > 0, F.array_compact(F.array(*hit))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("licenses", licenses).withColumn("license", F.get("licenses", F.lit(0)))


def _oracle() -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def rows(found: dict[str, str]) -> str:
        return ", ".join(f"({q(s)}, {q(i)})" for s, i in sorted(found.items()))

    canon = reduce(lambda x, r: f"regexp_replace({x}, {q(r[0])}, {q(r[1])}, 'g')", CANONICAL, "raw")
    patterns = {licence: pattern for licence, pattern, _ in RULES}
    hits = ", ".join("CASE WHEN " + " AND ".join([f"regexp_matches(ids, {q(p)})", *(f"NOT regexp_matches(ids, {q(patterns[o])})" for o in over)])
                     + f" THEN {q(n)} END" for n, p, over in RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = f"replace(translate(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '{upper}', '{lower}'), chr(1), ' ')"
    return f"""
WITH names(s, id) AS (VALUES {rows(known_names())}), whole(s, id) AS (VALUES {rows(known_sentences())}), heads(s, id) AS (VALUES {rows(HEADS)}),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace({text}, {q(_BLANK)}, chr(10) || chr(1) || chr(10), 'g'), {q(_ENDS)}),
        lambda x: trim(regexp_replace(x, '[^a-z0-9\\x01]+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents WHERE regexp_matches(text, {q(_HINT)})),
st AS (SELECT doc_id, p, i FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)
       WHERE regexp_matches(p[i], {q(_START)}) AND NOT coalesce(i > 1 AND regexp_matches(p[i - 1], {q(_DENIED)}), false)),
ru AS (SELECT doc_id, i, n, array_to_string(p[i:i + n - 1], ' ') AS raw FROM st, range(1, {PIECES + 1}) ns(n)
       WHERE i + n - 1 <= len(p) AND NOT contains(array_to_string(p[i:i + n - 1], ' '), chr(1))),
c0 AS (SELECT doc_id, i, n, {canon} AS s FROM ru),
c AS (SELECT doc_id, i, n, CASE WHEN regexp_matches(s, {q(_RIGHTS[0])}) AND NOT regexp_matches(s, {q(_RIGHTS[1])}) THEN 'all rights reserved' ELSE s END AS s FROM c0),
parts AS (SELECT DISTINCT s, unnest(string_split_regex(substr(s, 3), ' (?:or|and|with) (?:the )?')) AS part,
          generate_subscripts(string_split_regex(substr(s, 3), ' (?:or|and|with) (?:the )?'), 1) AS k FROM c WHERE starts_with(s, '@ ')),
several AS (SELECT parts.s, list(names.id ORDER BY k) AS ids FROM parts LEFT JOIN names ON names.s = part GROUP BY parts.s HAVING count(*) > 1 AND count(*) = count(names.id)),
f AS (SELECT c.doc_id, c.i, c.n, CASE WHEN NOT starts_with(c.s, '@ ') THEN CASE WHEN whole.id IS NOT NULL THEN [whole.id] END
        WHEN names.id IS NOT NULL THEN [names.id] ELSE several.ids END AS ids
      FROM c LEFT JOIN whole ON whole.s = c.s LEFT JOIN names ON starts_with(c.s, '@ ') AND names.s = substr(c.s, 3) LEFT JOIN several ON several.s = c.s),
h AS (SELECT c.doc_id, c.i, c.n, [heads.id] AS ids FROM c JOIN heads ON c.s = heads.s OR starts_with(c.s, heads.s || ' ')),
b AS (SELECT doc_id, i, arg_max(n, n) AS n, arg_max(ids, n) AS ids FROM f WHERE ids IS NOT NULL GROUP BY doc_id, i
      UNION ALL SELECT doc_id, i, arg_min(n, n), arg_min(ids, n) FROM h ANTI JOIN (SELECT doc_id, i FROM f WHERE ids IS NOT NULL) USING (doc_id, i) GROUP BY doc_id, i),
l AS (SELECT doc_id, list({{'i': i, 'n': n, 'ids': ids}} ORDER BY i) AS l FROM b GROUP BY doc_id),
t AS (SELECT doc_id, list_reduce(list_prepend({{'e': 0::BIGINT, 'ids': []::VARCHAR[]}}, list_transform(l, lambda x: {{'e': x.i * 1000 + x.n, 'ids': x.ids}})),
        lambda a, x: CASE WHEN x.e // 1000 > a.e THEN {{'e': x.e // 1000 + x.e % 1000 - 1, 'ids': list_concat(a.ids, x.ids)}} ELSE a END).ids AS ids FROM l),
a AS (SELECT d.doc_id, '|' || coalesce(array_to_string(t.ids, '|'), '') || '|' AS ids, coalesce(len(t.ids), 0) AS n FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id),
r AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS found FROM a)
SELECT doc_id, found[1] AS license, array_to_string(found, '|') AS licenses, ids AS sentence_ids, CAST(n AS BIGINT) AS n_sentences FROM r
"""


@register("op5_license_scan", _oracle())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document states, with its licence sentences."""
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "license", F.array_join("licenses", "|").alias("licenses"),
                      F.concat(F.lit("|"), F.array_join("license_ids", "|"), F.lit("|")).alias("sentence_ids"),
                      F.size("license_ids").cast("long").alias("n_sentences"))
