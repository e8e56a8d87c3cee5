"""Suggestions as tables.

The catalogue asks a language model for descriptions.  Calling the service
is outside the engine; what the engine does is build one prompt per table
from the catalogue (a grouped string aggregation), read a table of replies
back (split, trim, ``from_json``) and fill catalogue fields from them
(keyed joins).  Every step is built-in Column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger.functions.empties import first_truthy, has_text, nullify_empty
from lakeledger.functions.layers import REFRESH_FREQUENCIES
from lakeledger.operators.reconcile import guard_unique

# ---- fixed values: prompt texts and reply shapes ----------------------------
TABLE_PROMPT_INTRO = "You are a data dictionary assistant for a supply chain analytics lakehouse."
TABLE_PROMPT_LAYER_HINT = "(brz=raw/bronze, slv=cleaned/silver, gld=aggregated/gold, ref=reference/master)"
TABLE_PROMPT_TAIL = """Based on the table name, layer, column names, data types and sample values, suggest:
1. description: A concise English business description (1-2 sentences)
2. business_owner: Which team likely owns this (e.g. "Supply Chain", "Sales", "Finance", "Analytics")
3. source_system: The likely source system
4. tags: Comma-separated relevant tags
5. refresh_frequency: One of: hourly, daily, weekly, monthly, ad-hoc

Respond in JSON format only, no explanation:
{"description": "...", "business_owner": "...", "source_system": "...", "tags": "...", "refresh_frequency": "..."}"""
COLUMN_PROMPT_TAIL = """Column naming convention:
- id_* = identifiers/keys, code_* = category codes, name_* = descriptive text
- dt_* = date, ts_* = timestamp, amt_* = monetary, qty_* = quantity
- num_* = count, val_* = values, pct_* = percentage, is_* = boolean, sk_* = surrogate key

For each column, suggest:
- description: Concise English description
- business_name: Human-readable English business name

Respond as a JSON array only, no explanation:
[{"column_name": "...", "description": "...", "business_name": "..."}, ...]"""
PROMPT_COLUMN_LIMIT = 30      # columns listed in a table prompt
FENCE = "```"
TABLE_REPLY_FIELDS = ["description", "business_owner", "source_system", "tags", "refresh_frequency"]
COLUMN_REPLY_FIELDS = ["description", "business_name"]
# ---------------------------------------------------------------------------

TABLE_REPLY_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in TABLE_REPLY_FIELDS])
COLUMN_REPLY_SCHEMA = T.StructType([T.StructField(f, T.StringType())
                                    for f in ["column_name"] + COLUMN_REPLY_FIELDS])


def _q(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("?"))


def _lines_per_table(columns: DataFrame, line: Column, limit: int | None) -> DataFrame:
    """``(table_name, lines)``: one text line per column in ordinal order,
    joined by newlines; with ``limit`` only the first ``limit`` columns (W1)."""
    c = columns.select("table_name", "ordinal_position", "column_name", line.alias("_line"))
    if limit is not None:
        w = Window.partitionBy("table_name").orderBy("ordinal_position", "column_name")
        c = c.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    g = c.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "_line"))).alias("_l"))
    return g.select("table_name", F.array_join(F.col("_l._line"), "\n").alias("lines"))


def table_prompts(tables: DataFrame, columns: DataFrame, limit: int = PROMPT_COLUMN_LIMIT) -> DataFrame:
    """G1: ``(table_name, prompt)``: name, layer and the first ``limit``
    columns as ``name (type)`` plus `` - samples: ...`` when there are any."""
    line = F.concat(_q("column_name"), F.lit(" ("), _q("data_type"), F.lit(")"),
                    F.when(has_text(F.col("sample_values")),
                           F.concat(F.lit(" - samples: "), F.col("sample_values"))).otherwise(F.lit("")))
    lines = _lines_per_table(columns, line, limit)
    j = tables.select("table_name", "layer").join(lines, "table_name", "left")
    prompt = F.concat(
        F.lit(TABLE_PROMPT_INTRO + "\n\nTable: "), F.col("table_name"),
        F.lit("\nLayer: "), F.coalesce(F.col("layer"), F.lit("None")),
        F.lit(" " + TABLE_PROMPT_LAYER_HINT + "\nColumns:\n"), F.coalesce(F.col("lines"), F.lit("")),
        F.lit("\n\n" + TABLE_PROMPT_TAIL))
    return j.select("table_name", prompt.alias("prompt"))


def column_prompts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``(table_name, prompt)`` listing every column as
    ``name | type | samples: ... | null: p%``; absent parts left out."""
    pct = F.col("null_percentage")
    line = F.concat_ws(
        " | ", _q("column_name"), _q("data_type"),
        F.when(has_text(F.col("sample_values")), F.concat(F.lit("samples: "), F.col("sample_values"))),
        F.when(pct.isNotNull() & ~F.isnan(pct), F.concat(F.lit("null: "), pct.cast("string"), F.lit("%"))))
    lines = _lines_per_table(columns, line, None)
    j = tables.select("table_name", "layer").join(lines, "table_name", "left")
    prompt = F.concat(
        F.lit(TABLE_PROMPT_INTRO + "\n\nTable: "), F.col("table_name"),
        F.lit(" (layer: "), F.coalesce(F.col("layer"), F.lit("None")), F.lit(")\nColumns:\n"),
        F.coalesce(F.col("lines"), F.lit("")), F.lit("\n\n" + COLUMN_PROMPT_TAIL))
    return j.select("table_name", prompt.alias("prompt"))


def reply_text(text: Column) -> Column:
    """The JSON part of a reply: if fenced, the text between the first
    and second fence, without a leading ``json``, trimmed; else as is."""
    inner = F.try_element_at(F.split(text, FENCE), F.lit(2))
    inner = F.regexp_replace(F.regexp_replace(inner, "^json", ""), r"^\s+|\s+$", "")
    return F.when(text.contains(FENCE), inner).otherwise(text)


def _one_value(t: Column) -> Column:
    """Whether a text is exactly one JSON value, with nothing after it."""
    listed = F.size(F.from_json(F.concat(F.lit("["), t, F.lit("]")), T.ArrayType(T.StringType()))) == 1
    wrapped = F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"].isNotNull()
    return F.coalesce(listed & wrapped, F.lit(False))


def parse_replies(df: DataFrame, schema: T.StructType = TABLE_REPLY_SCHEMA,
                  text_col: str = "response", keys: list[str] = ("table_name",)) -> DataFrame:
    """Replies holding one JSON object -> one row of fields, plus
    ``is_bad`` for a reply that is not a JSON object (Q21: the batch goes on;
    its fields are NULL)."""
    t = reply_text(F.col(text_col))
    parsed = df.select(*keys, t.alias("_t"))
    bad = F.json_object_keys(F.col("_t")).isNull() | ~_one_value(F.col("_t"))
    return parsed.select(*keys, F.from_json(F.col("_t"), schema).alias("_p"), bad.alias("is_bad")) \
        .select(*keys, *[F.when(~F.col("is_bad"), F.col(f"_p.{f.name}")).alias(f.name) for f in schema.fields],
                "is_bad")


def explode_replies(df: DataFrame, schema: T.StructType = COLUMN_REPLY_SCHEMA,
                    text_col: str = "response", keys: list[str] = ("table_name",),
                    item_key: str = "column_name") -> DataFrame:
    """Replies holding a JSON array of objects -> one row per
    ``item_key``; when a name occurs twice the later element wins.  Each
    field comes with ``has_<field>``: whether the element had that key
    (a missing key and a JSON null differ for the fill rule)."""
    t = reply_text(F.col(text_col))
    t = F.when(_one_value(t), t)
    items = df.select(*keys, F.posexplode(F.from_json(t, T.ArrayType(T.StringType()))).alias("_pos", "_e"))
    fields = [f.name for f in schema.fields if f.name != item_key]
    ks = F.json_object_keys(F.col("_e"))
    rec = items.select(*keys, "_pos", F.from_json(F.col("_e"), schema).alias("_r"), ks.alias("_ks"))
    rec = rec.select(*keys, "_pos", F.col(f"_r.{item_key}").alias(item_key),
                     *[F.col(f"_r.{f}").alias(f) for f in fields],
                     *[F.coalesce(F.array_contains("_ks", f), F.lit(False)).alias(f"has_{f}") for f in fields])
    rec = rec.filter(F.col(item_key).isNotNull())
    last = F.max_by(F.struct(*fields, *[f"has_{f}" for f in fields]), F.col("_pos"))
    return rec.groupBy(*keys, item_key).agg(last.alias("_w")) \
        .select(*keys, item_key, *[F.col(f"_w.{f}").alias(f) for f in fields],
                *[F.col(f"_w.has_{f}").alias(f"has_{f}") for f in fields])


def fill_from(df: DataFrame, sugg: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fill fields that are NULL (not '') from a suggestion row with
    the same keys; a suggestion without the field's key fills ''.  A key
    suggested twice fails the job (``explode_replies`` keeps the last)."""
    s = sugg.select(*keys, *[F.col(f).alias(f"_s_{f}") for f in fields],
                    *[(F.col(f"has_{f}") if f"has_{f}" in sugg.columns else F.col(f).isNotNull()).alias(f"_h_{f}")
                      for f in fields])
    j = df.join(guard_unique(s, keys, "suggestions")[0], keys, "left")
    out = []
    for c in df.columns:
        if c in fields:
            filled = F.when(F.col(f"_h_{c}"), F.col(f"_s_{c}")).otherwise(F.lit(""))
            out.append(F.when(F.col(c).isNull() & F.coalesce(F.col("_present"), F.lit(False)), filled)
                       .otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(out)


def prefer(stored: DataFrame, sugg: DataFrame, keys: list[str], fields: list[str],
           domains: dict[str, list[str]] | None = None, nullify: bool = True) -> DataFrame:
    """The values a person would save from the suggestion form.

    Text: a non-empty suggestion wins, else the stored value, else ''.
    A field with a domain: a suggestion inside the domain wins; otherwise
    the stored value if inside the domain, else '' (Q10 fix: an empty
    suggestion no longer hides the stored value).  With ``nullify`` ''
    becomes NULL, as saving does.  A key suggested twice fails the job."""
    domains = domains or {}
    s = guard_unique(sugg.select(*keys, *fields), keys, "suggestions")[0].select(
        *keys, *[F.when(F.col("_present"), F.col(f)).alias(f"_s_{f}") for f in fields])
    j = stored.select(*keys, *fields).join(s, keys, "left")
    out = []
    for f in fields:
        sv, st = F.col(f"_s_{f}"), F.col(f)
        if f in domains:
            dom = [d for d in domains[f]]
            nonempty = [d for d in dom if d != ""]
            v = F.when(sv.isin(nonempty), sv).when(st.isin(dom), st).otherwise(F.lit(""))
        else:
            v = F.coalesce(first_truthy(sv, st), F.lit(""))
        out.append((nullify_empty(v) if nullify else v).alias(f))
    return j.select(*keys, *out)


def nullify_fields(df: DataFrame, cols: list[str]) -> DataFrame:
    """G8: '' -> NULL in ``cols`` before saving."""
    return df.select([nullify_empty(c).alias(c) if c in cols else F.col(c) for c in df.columns])


FREQUENCY_DOMAIN = {"refresh_frequency": REFRESH_FREQUENCIES}
