"""The three "empty" rules the catalogue uses, named once.

- *falsy*:     NULL or ''             (table edits, re-scan preservation)
- *null-only*: NULL, but '' is a value (column edits, suggestion fill)
- *NULL = ''*: compare with NULL and '' equal (before/after diff)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullify_empty(c) -> Column:
    """'' -> NULL, everything else unchanged."""
    c = _col(c)
    return F.when(c == F.lit(""), F.lit(None).cast("string")).otherwise(c)


def has_text(c) -> Column:
    """True for a non-NULL, non-empty text (Python truthiness of a str)."""
    c = _col(c)
    return F.coalesce(c.isNotNull() & (c != F.lit("")), F.lit(False))


def first_truthy(*cols) -> Column:
    """``a or b or ...`` for text: first value that is neither NULL nor ''.

    NULL when none is.  (Python's ``or`` would return the last falsy value;
    the catalogue stores that as NULL either way.)
    """
    return F.coalesce(*[nullify_empty(c) for c in cols])


def differs_text(a, b) -> Column:
    """Text inequality with NULL and '' treated as equal; never NULL."""
    return F.coalesce(_col(a), F.lit("")) != F.coalesce(_col(b), F.lit(""))


def differs_flag(a, b) -> Column:
    """Boolean inequality with NULL treated as false; never NULL."""
    return F.coalesce(_col(a).cast("boolean"), F.lit(False)) != F.coalesce(_col(b).cast("boolean"), F.lit(False))
