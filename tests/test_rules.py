"""One small, hand-computed test per catalogue rule."""

import pytest
from pyspark.sql import functions as F

from lakeledger.functions.layers import detect_layer
from lakeledger.operators.edits import apply_edits, collapse_edits, diff_rows, overlay
from lakeledger.operators.profile import profile, samples
from lakeledger.operators.reconcile import (
    delete_stale, preserve_columns, preserve_tables, stale_columns, upsert,
)
from lakeledger.operators.report import coverage, layer_summary, search_tables
from lakeledger.operators.suggest import (
    FREQUENCY_DOMAIN, TABLE_REPLY_FIELDS, fill_from, parse_replies, prefer, table_prompts,
)
from lakeledger.sources.schema import COLUMNS_SCHEMA, TABLES_SCHEMA

EDIT_SCHEMA = "table_name string, field string, value string, edited_at timestamp_ntz, seq long"


def tables(spark, rows):
    return spark.createDataFrame(rows, TABLES_SCHEMA)


def trow(name, layer="brz", rc=1, cc=1, desc=None, owner=None, src=None, freq=None, tags=None,
         scanned="2024-01-01T00:00:00", upd=None, by=None):
    return (name, layer, rc, cc, desc, owner, src, freq, tags, scanned, upd, by)


def test_q1_batch_edit_keeps_unedited_fields(spark):
    t = tables(spark, [trow("a", desc="keep", owner="old")])
    log = spark.sql("SELECT 'a' table_name, 'business_owner' field, 'new' value, "
                    "timestamp_ntz'2024-01-02 00:00:00' edited_at, 1L seq")
    r = apply_edits(t, log, ["table_name"], "2024-03-01T00:00:00").first()
    assert (r.description, r.business_owner, r.updated_at) == ("keep", "new", "2024-03-01T00:00:00")


def test_q2_table_edits_drop_falsy_column_edits_keep_empty(spark):
    log = spark.createDataFrame([
        ("a", "description", "x", "2024-01-01 00:00:00", 1),
        ("a", "description", "", "2024-01-02 00:00:00", 2),
        ("a", "description", None, "2024-01-03 00:00:00", 3)],
        "table_name string, field string, value string, edited_at string, seq long") \
        .withColumn("edited_at", F.col("edited_at").cast("timestamp_ntz"))
    assert collapse_edits(log, ["table_name"], "falsy").first().value == "x"
    assert collapse_edits(log, ["table_name"], "null").first().value == ""


def test_q3_apply_ignores_unknown_keys_unless_insert(spark):
    t = tables(spark, [trow("brz_a")])
    log = spark.sql("SELECT 'slv_new' table_name, 'description' field, 'd' value, "
                    "timestamp_ntz'2024-01-02 00:00:00' edited_at, 1L seq")
    assert apply_edits(t, log, ["table_name"], "N").count() == 1
    ins = apply_edits(t, log, ["table_name"], "2024-03-01T00:00:00", insert=True)
    r = ins.filter("table_name = 'slv_new'").first()
    assert (r.layer, r.scanned_at, r.description) == ("slv", "2024-03-01T00:00:00", "d")


def test_q4_rescan_turns_stored_empty_into_null(spark):
    stored = tables(spark, [trow("a", desc="", owner="kept")])
    scan = spark.createDataFrame([("a", "brz", 5, 2, "2024-02-01T00:00:00")],
                                 "table_name string, layer string, row_count long, column_count int, scanned_at string")
    r = preserve_tables(scan, stored).first()
    assert (r.description, r.business_owner, r.row_count) == (None, "kept", 5)


def test_q5_key_flag_is_sticky(spark):
    stored = spark.createDataFrame([("t", "a", True), ("t", "b", False)],
                                   "table_name string, column_name string, is_primary_key boolean")
    scan = spark.createDataFrame([("t", "a", "int", 1, "YES", False, "s"), ("t", "b", "int", 2, "YES", True, "s")],
                                 "table_name string, column_name string, data_type string, ordinal_position int, "
                                 "is_nullable string, is_primary_key boolean, scanned_at string")
    got = {r.column_name: r.is_primary_key for r in preserve_columns(scan, stored).collect()}
    assert got == {"a": True, "b": True}


def test_q6_upsert_overwrites_stats_with_scan_nulls(spark):
    target = spark.createDataFrame([("t", "a", "int", 1, "YES", False, None, None, "s", 1.0, 3, "x", None, None)],
                                   COLUMNS_SCHEMA)
    source = spark.createDataFrame([("t", "a", "int", 1, "YES", False, "s2")],
                                   "table_name string, column_name string, data_type string, ordinal_position int, "
                                   "is_nullable string, is_primary_key boolean, scanned_at string")
    r = upsert(target, source, ["table_name", "column_name"]).first()
    assert (r.sample_values, r.null_percentage, r.distinct_count, r.scanned_at) == (None, None, None, "s2")


def test_q7_dropped_column_of_living_table_only_with_live_columns(spark):
    cols = spark.createDataFrame([("t", "a", 1), ("t", "gone", 2)],
                                 "table_name string, column_name string, ordinal_position int")
    live = spark.createDataFrame([("t",)], "table_name string")
    assert stale_columns(cols, live).count() == 0
    lc = spark.createDataFrame([("t", "a")], "table_name string, column_name string")
    assert [r.column_name for r in stale_columns(cols, live, lc).collect()] == ["gone"]


def test_q8_empty_live_list_refused(spark):
    t = tables(spark, [trow("a")])
    empty = spark.createDataFrame([], "table_name string")
    with pytest.raises(ValueError):
        delete_stale(t, t, empty)
    kept, _ = delete_stale(t, t.select("table_name"), empty, force=True)
    assert kept.count() == 0


def test_q11_unsupported_types_profiled_as_text(spark):
    df = spark.sql("SELECT map('a', id) m, named_struct('x', id) s, binary(string(id)) b, id FROM range(4)")
    p = {r.column_name: r.distinct_count for r in profile(df).collect()}
    assert p == {"m": 4, "s": 4, "b": 4, "id": 4}


def test_q12_samples_are_the_five_smallest_in_order(spark):
    df = spark.createDataFrame([(x,) for x in ["e", "b", "a", "d", "c", "f", "a", None]], "v string")
    assert samples(df).first().sample_values == "a | b | c | d | e"


def test_samples_cut_to_width_before_dedup_and_blank_is_null(spark):
    df = spark.createDataFrame([("x" * 250,), ("x" * 260,), ("   ",)], "v string")
    s = samples(df).first().sample_values
    assert s == "   " + " | " + "x" * 200
    blank = spark.createDataFrame([("  ",), ("  ",)], "v string")
    assert samples(blank).first().sample_values is None
    two = spark.createDataFrame([("  ",), (" ",)], "v string")
    assert samples(two).first().sample_values == " " + " | " + "  "


def test_q13_rounding_half_even(spark):
    # 1 null of 8 rows = 12.5 exactly; 1 of 3 = 33.333.. -> 33.33
    df = spark.createDataFrame([(None if i == 0 else i,) for i in range(8)], "v int")
    assert profile(df).first().null_percentage == 12.5
    df3 = spark.createDataFrame([(None,), (1,), (2,)], "v int")
    assert profile(df3).first().null_percentage == 33.33


def test_q14_coverage_counts_empty_as_described(spark):
    t = tables(spark, [trow("a", desc=""), trow("b"), trow("c", desc="x"), trow("d")])
    r = coverage(t).first()
    assert (r.total, r.described, r.coverage) == (4, 2, 50)


def test_q15_layer_sum_of_unknown_rows_is_zero(spark):
    t = tables(spark, [trow("a", rc=None, cc=2), trow("b", rc=None, cc=3)])
    r = layer_summary(t).first()
    assert (r.table_count, r.total_rows, r.avg_columns) == (2, 0, 2.5)


def test_q17_literal_search(spark):
    t = tables(spark, [trow("a.b"), trow("axb")])
    assert search_tables(t, None, "a.b").count() == 2
    assert [r.table_name for r in search_tables(t, None, "A.B", literal=True).collect()] == ["a.b"]


def test_q18_diff_counts_filled_values_as_changes(spark):
    before = spark.createDataFrame([("t", "a", None, None, None)],
                                   "table_name string, column_name string, description string, "
                                   "business_name string, is_primary_key boolean")
    after = spark.createDataFrame([("t", "a", "", "filled", False)], before.schema)
    d = diff_rows(before, after, ["table_name", "column_name"], ["description", "business_name"],
                  ["is_primary_key"]).collect()
    assert [(r.field, r.new_value) for r in d] == [("business_name", "filled")]


def test_q20_nan_exported_as_null(spark):
    from lakeledger.operators.report import export_nested
    t = tables(spark, [trow("a")])
    c = spark.createDataFrame([("a", "x", "double", 1, "YES", False, None, None, None, float("nan"), 1, "s",
                                None, None)], COLUMNS_SCHEMA)
    doc = export_nested(t, c).first().doc
    assert '"null_percentage":null' in doc and "NaN" not in doc


def test_q21_malformed_reply_flagged(spark):
    df = spark.createDataFrame([("a", '{"description": '), ("b", "```json\n{\"tags\": \"x\"}\n```")],
                               "table_name string, response string")
    got = {r.table_name: (r.is_bad, r.tags) for r in parse_replies(df).collect()}
    assert got == {"a": (True, None), "b": (False, "x")}


def test_q22_layer_prefix_rules(spark):
    df = spark.createDataFrame([(n,) for n in ["brz2_x", "brz", "brz_x", "dq_y", "DQ_y", "utl_"]], "n string")
    got = [r.l for r in df.select(detect_layer("n").alias("l")).collect()]
    assert got == ["other", "other", "brz", "dq", "other", "utl"]


def test_q10_g7_frequency_domain(spark):
    stored = tables(spark, [trow("a", freq="weekly"), trow("b", freq="bogus"), trow("c", freq="daily")])
    sugg = spark.createDataFrame([("a", None), ("b", "hourly"), ("c", "yearly")],
                                 "table_name string, refresh_frequency string")
    got = {r.table_name: r.refresh_frequency for r in
           prefer(stored, sugg, ["table_name"], ["refresh_frequency"], FREQUENCY_DOMAIN).collect()}
    assert got == {"a": "weekly", "b": "hourly", "c": "daily"}


def test_g5_fill_only_null_and_missing_key_gives_empty(spark):
    cols = spark.createDataFrame([("t", "a", None), ("t", "b", ""), ("t", "c", None)],
                                 "table_name string, column_name string, description string")
    sugg = spark.createDataFrame([("t", "a", "s", True), ("t", "b", "s", True), ("t", "c", None, False)],
                                 "table_name string, column_name string, description string, has_description boolean")
    got = {r.column_name: r.description for r in
           fill_from(cols, sugg, ["table_name", "column_name"], ["description"]).collect()}
    assert got == {"a": "s", "b": "", "c": ""}


def test_w1_prompt_lists_first_30_columns(spark):
    t = tables(spark, [trow("wide")])
    cols = spark.createDataFrame([("wide", f"c{i:02d}", "int", i, None) for i in range(1, 41)],
                                 "table_name string, column_name string, data_type string, "
                                 "ordinal_position int, sample_values string")
    p = table_prompts(t, cols).first().prompt
    assert "c30 (int)" in p and "c31 (int)" not in p


def test_overlay_touches_existing_rows_and_stamps_last_save(spark):
    t = tables(spark, [trow("a", desc="old")])
    log = spark.createDataFrame([("a", "description", "new", "2024-01-02 03:04:05", 1),
                                 ("a", "tags", "", "2024-01-03 00:00:00.5", 2),
                                 ("zz", "description", "x", "2024-01-02 00:00:00", 3)],
                                "table_name string, field string, value string, edited_at string, seq long") \
        .withColumn("edited_at", F.col("edited_at").cast("timestamp_ntz"))
    rows = overlay(t, log, ["table_name"]).collect()
    assert len(rows) == 1
    assert (rows[0].description, rows[0].tags, rows[0].updated_at) == ("new", None, "2024-01-03T00:00:00.500000")


def test_upsert_rejects_duplicate_source_keys(spark):
    t = tables(spark, [trow("a")])
    src = tables(spark, [trow("a", desc="1"), trow("a", desc="2")])
    with pytest.raises(Exception, match="duplicate key"):
        upsert(t, src, ["table_name"]).collect()


def test_parse_fields_listed():
    assert TABLE_REPLY_FIELDS == ["description", "business_owner", "source_system", "tags", "refresh_frequency"]


def test_samples_print_each_type_like_spark(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (true, DATE'2024-01-02', TIMESTAMP'2024-01-02 03:04:05', CAST(1.5 AS FLOAT), -0.0D, 7),
        (NULL, NULL, NULL, NULL, 0.0D, NULL),
        (true, DATE'2024-01-02', TIMESTAMP'2024-01-02 03:04:05', CAST(1.5 AS FLOAT), 2.25D, 7)
        AS t(b, dt, ts, f, d, i)""")
    got = {r.column_name: (r.sample_values, r.distinct_count) for r in profile(df, with_samples=True).collect()}
    assert got["b"] == ("true", 1)
    assert got["dt"] == ("2024-01-02", 1)
    assert got["ts"] == ("2024-01-02 03:04:05", 1)
    assert got["f"] == ("1.5", 1)
    assert got["d"] == ("0.0 | 2.25", 2)
    assert got["i"] == ("7", 1)


def test_profile_handles_awkward_column_names(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (None, "y", 2.0)], ["a.b", "c d", "e`f"])
    got = {r.column_name: (r.null_count, r.distinct_count, r.sample_values)
           for r in profile(df, with_samples=True).collect()}
    assert got == {"a.b": (1, 1, "1"), "c d": (0, 2, "x | y"), "e`f": (0, 1, "2.0")}
    approx = {r.column_name: r.distinct_count for r in profile(df, mode="approx").collect()}
    assert approx == {"a.b": 1, "c d": 2, "e`f": 1}


def test_float_arrays_with_signed_zero_are_one_value(spark):
    df = spark.sql("SELECT array(CAST(-0.0 AS FLOAT), 1.0F) a UNION ALL SELECT array(0.0F, 1.0F) "
                   "UNION ALL SELECT array(2.0F)")
    assert profile(df).first().distinct_count == 2
    assert df.selectExpr("count(DISTINCT a)").first()[0] == 2


def test_signed_zero_inside_structs_and_maps_is_one_value(spark):
    df = spark.sql("""SELECT named_struct('a', -0.0D, 'b', array(named_struct('c', CAST(-0.0 AS FLOAT))), 'n', 'x') s,
                             map('k', -0.0D) m
                      UNION ALL
                      SELECT named_struct('a', 0.0D, 'b', array(named_struct('c', 0.0F)), 'n', 'x'), map('k', 0.0D)
                      UNION ALL
                      SELECT CAST(NULL AS STRUCT<a: DOUBLE, b: ARRAY<STRUCT<c: FLOAT>>, n: STRING>), NULL""")
    got = {r.column_name: (r.distinct_count, r.null_count) for r in profile(df).collect()}
    assert got == {"s": (1, 1), "m": (1, 1)}
