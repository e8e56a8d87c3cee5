"""The registered query set: one Spark query and one DuckDB oracle per name.

Each query takes ``(spark, sf_dir)``, reads the driver tables (directly or
through the derived fixture frames) and returns a lazy DataFrame.  Output
columns are aliased identically on both sides.  A fixed ``NOW`` stands in
for the wall clock so results are reproducible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ---- fixed values ----------------------------------------------------------
NOW = "2024-03-01T12:00:00"
# ---------------------------------------------------------------------------


def register(name: str, oracle: str | None = None):
    """Decorator: add a query (and its oracle SQL, if it has one)."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from lakeledger.plans import q_scan, q_profile, q_reconcile, q_edits, q_report, q_suggest, q_store  # noqa: F401
