"""Text forms of values.

``value_text`` maps a column of any type to text so that two values are equal
exactly when their texts are equal (for the types Spark can group on).  It
lets the profiler put every column of a table into one ``(column, value)``
shape and count distinct values with one grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value_text(c: Column, dtype: T.DataType) -> Column:
    """Injective text of a value of type ``dtype``; NULL stays NULL."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # -0.0 and 0.0 are one value when grouped as numbers, two as text.
        # All NaNs are one value in Spark grouping and print as "NaN".
        return F.when(c == F.lit(0.0), F.lit("0.0")).otherwise(c.cast("string"))
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    if isinstance(dtype, (T.StructType, T.MapType)) or (
            isinstance(dtype, T.ArrayType) and _has_nested(dtype.elementType)):
        if isinstance(dtype, T.MapType):
            c = F.array_sort(F.map_entries(c))
        return F.to_json(c, {"ignoreNullFields": "false"})
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.FloatType, T.DoubleType)):
        # -0.0 and 0.0 are one value inside arrays too (as Spark groups them)
        zero = F.lit(0.0).cast(dtype.elementType)
        return F.transform(c, lambda x: F.when(x == 0, zero).otherwise(x)).cast("string")
    # integers, decimals, booleans, dates, timestamps, arrays of scalars
    return c.cast("string")


def _has_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.MapType, T.ArrayType, T.BinaryType))


def iso_text(ts) -> Column:
    """ISO-8601 text of a timestamp as Python's ``isoformat`` writes it:
    ``YYYY-MM-DDTHH:MM:SS`` plus ``.ffffff`` only when microseconds are set."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    frac = F.date_format(ts, "SSSSSS")
    return F.when(frac == F.lit("000000"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
