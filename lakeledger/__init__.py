"""lakeledger: a catalogue and profiling engine for a lakehouse, on Spark.

Every operator is a DataFrame -> DataFrame function built from Spark's
built-in Column functions, joins, aggregations and windows.  Key and field
names are parameters, so the operators work on any keyed table; the
catalogue (table rows and column rows) is one use of them.

Sub-packages:

- ``functions``  Column helpers (layers, "empty" rules, text forms, ISO text)
- ``sources``    catalogue schemas, scanning live tables, snapshot store
- ``operators``  profiling, reconciliation, edit log, reports, suggestions
- ``plans``      derived fixture frames and the registered query set
- ``streaming``  applying the edit log incrementally with Structured Streaming
"""

from lakeledger.session import get_spark, checkpoint_root

__all__ = ["get_spark", "checkpoint_root"]
