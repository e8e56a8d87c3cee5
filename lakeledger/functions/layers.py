"""Medallion layer of a table, from its name.  Pure Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the catalogue's conventions) ----------------
# Layer prefixes, tried in this order; a name is in layer p when it starts
# with "p_".  Anything else is "other".
LAYER_PREFIXES = ["brz", "slv", "gld", "ref", "dq", "dd", "utl"]
OTHER_LAYER = "other"
# Live tables whose name starts with one of these (case-sensitive) are not
# catalogued at all.
EXCLUDE_PREFIXES = ["dd_", "brz2"]
# Allowed refresh frequencies; "" means unset.
REFRESH_FREQUENCIES = ["", "hourly", "daily", "weekly", "monthly", "ad-hoc", "real-time"]
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def detect_layer(name, prefixes=LAYER_PREFIXES, other: str = OTHER_LAYER) -> Column:
    """First prefix ``p`` with ``name`` starting ``p_`` (case-sensitive), else ``other``."""
    name = _col(name)
    expr = None
    for p in prefixes:
        cond = name.startswith(p + "_")
        expr = F.when(cond, F.lit(p)) if expr is None else expr.when(cond, F.lit(p))
    return expr.otherwise(F.lit(other)) if expr is not None else F.lit(other)


def excluded(name, prefixes=EXCLUDE_PREFIXES) -> Column:
    """True when ``name`` starts with any excluded prefix (NULL name -> NULL)."""
    name = _col(name)
    if not prefixes:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [name.startswith(p) for p in prefixes])
