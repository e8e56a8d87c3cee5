"""Catalogue-shaped frames derived from the driver tables (FIXTURES.md §4).

Each builder reads the driver tables and derives rows of a catalogue shape,
so every operator has an input whose size grows with the data and a DuckDB
oracle (``plans/oracle.py`` holds the same derivations as SQL).  The moduli
only decide which rows carry NULL, '' or a real value, or which names count
as dropped; no builder caps or samples rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.sources.tables import read_table


def _case(key: Column, mapping: list[tuple[int, object]], default) -> Column:
    expr = None
    for k, v in mapping:
        val = F.lit(v) if not isinstance(v, Column) else v
        expr = F.when(key == k, val) if expr is None else expr.when(key == k, val)
    dv = F.lit(default) if not isinstance(default, Column) else default
    return expr.otherwise(dv)


_PREFIX_BY_MOD9 = [(0, "brz_"), (1, "slv_"), (2, "gld_"), (3, "ref_"), (4, "dq_"), (5, "utl_"),
                   (6, "dd_"), (7, "brz2_")]
#: Rows of a wide fixture in one task: its sorts then hold some 50 MB each at any scale.
ROWS_PER_TASK = 250_000
_LAYER_BY_MOD9 = [(0, "brz"), (1, "slv"), (2, "gld"), (3, "ref"), (4, "dq"), (5, "utl"), (6, "dd")]


class Fixtures:
    """Lazy, memoised fixture frames for one ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._memo: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._memo:
            self._memo[key] = read_table(self.spark, self.sf_dir, name)
        return self._memo[key]

    def parts(self, name: str) -> int:
        """Partitions for rows made of the table ``name``: in proportion to its
        rows (from the file footers), at least one for each core."""
        key = "parts:" + name
        if key not in self._memo:
            self._memo[key] = max(self.spark.sparkContext.defaultParallelism, -(-self.table(name).count() // ROWS_PER_TASK))
        return self._memo[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            if name not in self._memo:
                self._memo[name] = getattr(self, "_build_" + name)()
            return self._memo[name]
        raise AttributeError(name)

    # -- names and live list -------------------------------------------------
    # The name of order k is a function of k, and o_orderkey is the key of
    # orders, so "rows of orders joined to their names" is computed inline
    # (no self-join).  Rows of lineitem / events keep the inner-join rule
    # "the order exists" as a semi-join on the order keys.
    @staticmethod
    def _name(k: Column) -> Column:
        return F.concat(_case(k % 9, _PREFIX_BY_MOD9, "tmp_"), F.lit("t"), k.cast("string"))

    def _order_keys(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("k"))

    def _build_fx_names(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(k.alias("k"), self._name(k).alias("table_name"))

    def _build_fx_live_tables(self) -> DataFrame:
        return self.fx_names.filter(F.col("k") % 11 != 0).select("table_name")

    # -- stored catalogue ----------------------------------------------------
    def _layer_of(self, k: Column) -> Column:
        return _case(k % 9, _LAYER_BY_MOD9, "other")

    def _build_fx_tables(self) -> DataFrame:
        o = self.table("orders").filter(F.col("o_orderkey") % 13 != 0)
        k = F.col("o_orderkey")
        return o.select(
            self._name(k).alias("table_name"),
            self._layer_of(k).alias("layer"),
            F.when(k % 7 == 0, F.lit(None).cast("long"))
             .otherwise(F.floor("o_totalprice").cast("long")).alias("row_count"),
            (F.col("o_custkey") % 40 + 1).cast("int").alias("column_count"),
            _case(k % 4, [(0, F.lit(None).cast("string")), (1, "")], F.col("o_orderpriority")).alias("description"),
            F.when(k % 7 == 1, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")).alias("business_owner"),
            F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("erp")).alias("source_system"),
            _case(k % 6, [(0, "daily"), (1, "weekly"), (2, "real-time")],
                  F.lit(None).cast("string")).alias("refresh_frequency"),
            F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("a,b")).alias("tags"),
            F.lit("2024-01-01T00:00:00").alias("scanned_at"),
            F.when(k % 8 == 0, F.lit("2024-01-15T00:00:00")).otherwise(F.lit(None).cast("string")).alias("updated_at"),
            F.lit(None).cast("string").alias("updated_by"))

    def _build_fx_columns_k(self) -> DataFrame:
        # Dealt by table name once, in tasks of bounded size: grouping by key and
        # line, and whatever is grouped or joined by table later, stays in place.
        # An inner join, as a semi-join would be moved below and dealt out again;
        # the maxima are the same however often an order's key occurs.  Merged, not
        # broadcast: every task would hold all names.
        li = self.table("lineitem").withColumn("table_name", self._name(F.col("l_orderkey"))) \
            .repartition(self.parts("lineitem"), "table_name") \
            .join(self.fx_names.select("table_name").hint("merge"), "table_name")
        g = li.groupBy("table_name", "l_orderkey", "l_linenumber").agg(
            F.max("l_returnflag").alias("_rf"), F.max("l_linestatus").alias("_ls"))
        ln, ok = F.col("l_linenumber"), F.col("l_orderkey")
        return g.select(
            ok.alias("_k"),
            "table_name",
            F.concat(F.lit("c"), ln.cast("string")).alias("column_name"),
            F.lit("double").alias("data_type"),
            ln.cast("int").alias("ordinal_position"),
            F.when(ln == 1, F.lit("NO")).otherwise(F.lit("YES")).alias("is_nullable"),
            (ln == 1).alias("is_primary_key"),
            _case((ok + ln) % 3, [(0, F.lit(None).cast("string")), (1, "")], F.col("_rf")).alias("description"),
            F.when((ok + ln) % 5 == 0, F.col("_ls")).otherwise(F.lit(None).cast("string")).alias("business_name"),
            F.lit(None).cast("string").alias("sample_values"),
            F.lit(None).cast("double").alias("null_percentage"),
            F.lit(None).cast("long").alias("distinct_count"),
            F.lit("2024-01-01T00:00:00").alias("scanned_at"),
            F.lit(None).cast("string").alias("updated_at"),
            F.lit(None).cast("string").alias("updated_by"))

    def _build_fx_columns(self) -> DataFrame:
        return self.fx_columns_k.drop("_k")

    # -- fresh scan ----------------------------------------------------------
    def _build_fx_scan_tables(self) -> DataFrame:
        o = self.table("orders").filter(F.col("o_orderkey") % 11 != 0)
        k = F.col("o_orderkey")
        return o.select(
            self._name(k).alias("table_name"), self._layer_of(k).alias("layer"),
            (F.floor("o_totalprice").cast("long") + 1).alias("row_count"),
            (F.col("o_custkey") % 40 + 2).cast("int").alias("column_count"),
            F.lit("2024-02-01T00:00:00").alias("scanned_at"))

    def _build_fx_scan_columns(self) -> DataFrame:
        li = self.table("lineitem").filter((F.col("l_orderkey") % 11 != 0) & (F.col("l_linenumber") < 7))
        li = li.join(self._order_keys(), F.col("l_orderkey") == F.col("k"), "left_semi")
        g = li.select("l_orderkey", "l_linenumber").distinct()
        ln = F.col("l_linenumber")
        return g.select(
            self._name(F.col("l_orderkey")).alias("table_name"), F.concat(F.lit("c"), ln.cast("string")).alias("column_name"),
            F.lit("decimal").alias("data_type"), ln.cast("int").alias("ordinal_position"),
            F.lit("YES").alias("is_nullable"), (ln == 2).alias("is_primary_key"),
            F.lit("2024-02-01T00:00:00").alias("scanned_at"))

    # -- edit logs -----------------------------------------------------------
    def _edit_value(self, eid: Column) -> Column:
        return _case(eid % 11, [(0, F.lit(None).cast("string")), (1, "")],
                     F.concat(F.lit("v"), eid.cast("string")))

    def _build_fx_edits(self) -> DataFrame:
        eid = F.col("event_id")
        j = self.table("events").join(self._order_keys(), (eid % 500) == F.col("k"), "left_semi") \
            .withColumn("table_name", self._name(eid % 500))
        field = (F.when(F.col("event_type") == "click", F.lit("description"))
                 .when(F.col("event_type") == "view", F.lit("business_owner"))
                 .when(F.col("event_type") == "purchase", F.lit("source_system"))
                 .when(F.col("event_type") == "signup", F.lit("refresh_frequency"))
                 .otherwise(F.lit("tags")))
        return j.select("table_name", field.alias("field"), self._edit_value(eid).alias("value"),
                        F.col("ts").alias("edited_at"), eid.alias("seq"))

    def _build_fx_column_edits(self) -> DataFrame:
        eid = F.col("event_id")
        j = self.table("events").join(self._order_keys(), (eid % 500) == F.col("k"), "left_semi") \
            .withColumn("table_name", self._name(eid % 500))
        field = F.when(F.col("event_type").isin("click", "view"), F.lit("description")) \
                 .otherwise(F.lit("business_name"))
        return j.select("table_name",
                        F.concat(F.lit("c"), (eid % 7 + 1).cast("string")).alias("column_name"),
                        field.alias("field"), self._edit_value(eid).alias("value"),
                        F.col("ts").alias("edited_at"), eid.alias("seq"))

    def _build_fx_columns_edited(self) -> DataFrame:
        c = self.fx_columns
        op = F.col("ordinal_position")
        return c.select(
            "table_name", "column_name",
            F.when(op == 3, F.lit("changed")).when(F.col("description").isNull(), F.lit(""))
             .otherwise(F.col("description")).alias("description"),
            F.when(op == 4, F.lit(None).cast("string")).otherwise(F.col("business_name")).alias("business_name"),
            F.when(op == 5, F.lit(True)).otherwise(F.col("is_primary_key")).alias("is_primary_key"))

    # -- suggestion replies --------------------------------------------------
    def _build_fx_ai_tables(self) -> DataFrame:
        o = self.table("orders")
        k = F.col("o_orderkey")
        ks = k.cast("string")
        resp = _case(k % 5, [
            (0, F.concat(F.lit("```json\n{\"description\": \"d"), ks,
                         F.lit("\", \"refresh_frequency\": \"daily\"}\n```"))),
            (1, F.concat(F.lit("{\"description\": \"d"), ks,
                         F.lit("\", \"business_owner\": \"Sales\", \"tags\": \"x, y\"}"))),
            (2, F.lit("Here: ```{\"description\": \"\", \"refresh_frequency\": \"yearly\"}``` done")),
            (3, F.lit("{\"description\": ")),
        ], "{\"source_system\": \"crm\"}")
        return o.select(self._name(k).alias("table_name"), resp.alias("response"))

    def _build_fx_ai_columns(self) -> DataFrame:
        """Column replies (ours, not in FIXTURES.md): per table, a JSON array
        with one object per stored column; ordinal 2 is answered twice (the
        later answer must win), ordinal 6 lacks ``business_name`` and tables
        with key % 5 = 3 reply with malformed text."""
        c = self.fx_columns_k
        op = F.col("ordinal_position")
        obj = F.concat(F.lit("{\"column_name\": \""), F.col("column_name"),
                       F.lit("\", \"description\": \"sd_"), F.col("column_name"), F.lit("\""),
                       F.when(op == 6, F.lit("")).otherwise(
                           F.concat(F.lit(", \"business_name\": \"B "), F.col("column_name"), F.lit("\""))),
                       F.lit("}"))
        dup = F.concat(F.lit("{\"column_name\": \""), F.col("column_name"),
                       F.lit("\", \"description\": \"late_"), F.col("column_name"),
                       F.lit("\", \"business_name\": \"late\"}"))
        items = c.select("table_name", "_k", F.explode(F.array(
            F.struct((op * 2).alias("pos"), obj.alias("obj")),
            F.struct(F.when(op == 2, op * 2 + 1).alias("pos"), dup.alias("obj")))).alias("it")) \
            .select("table_name", "_k", "it.pos", "it.obj").filter(F.col("pos").isNotNull())
        arr = items.groupBy("table_name", "_k").agg(
            F.array_sort(F.collect_list(F.struct("pos", "obj"))).alias("_items"))
        body = F.concat(F.lit("["), F.array_join(F.col("_items.obj"), ", "), F.lit("]"))
        k = F.col("_k")
        return arr.select(
            "table_name", F.when(k % 5 == 3, F.lit("[{\"column_name\": ")).otherwise(body).alias("response"))

    def _build_fx_columns_profiled(self) -> DataFrame:
        """Stored column rows with statistics (ours, not in FIXTURES.md):
        samples are NULL, '' or text; the NULL share is NULL for ordinal 7."""
        c = self.fx_columns
        op = F.col("ordinal_position")
        return c.select(
            "table_name", "column_name", "data_type", "ordinal_position", "description", "business_name",
            _case(op % 3, [(0, F.lit(None).cast("string")), (1, "")],
                  F.concat(F.lit("x"), op.cast("string"), F.lit(" | y"))).alias("sample_values"),
            F.when(op == 7, F.lit(None).cast("double"))
             .otherwise(F.bround(op * 12.5 / 3, 2)).alias("null_percentage"))

    # -- profiler inputs -----------------------------------------------------
    def _build_fx_lineitem_nulls(self) -> DataFrame:
        li = self.table("lineitem")
        return li.select(
            "l_orderkey", "l_linenumber",
            F.when(F.col("l_orderkey") % 8 == 0, F.lit(None).cast("long")).otherwise(F.col("l_partkey")).alias("l_partkey"),
            F.when(F.col("l_returnflag") == "N", F.lit(None).cast("string")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
            F.when(F.col("l_quantity") > 25, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("l_shipdate")).alias("l_shipdate"),
            F.lit(None).cast("string").alias("all_null"))

    def _build_fx_empty(self) -> DataFrame:
        return self.table("orders").filter(F.col("o_orderkey") < 0).select("o_orderkey", "o_orderstatus")
