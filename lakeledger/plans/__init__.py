"""Query plans: fixture frames derived from the driver tables, and the
registered query set with its DuckDB oracle SQL."""
