"""DataFrame operators: profiling, reconciliation, the edit log, reports and
suggestions.  Every operator takes and returns DataFrames."""
