"""Sources and sinks: catalogue schemas, live-table scans, snapshot store."""

from lakeledger.sources.schema import (
    TABLES_SCHEMA, COLUMNS_SCHEMA, EDITS_SCHEMA, TABLE_KEYS, COLUMN_KEYS,
    TABLE_USER_FIELDS, COLUMN_USER_FIELDS, COLUMN_STAT_FIELDS,
    metadata_frame, select_existing, align_to, restrict_to_target,
)
from lakeledger.sources.scan import (
    live_tables, live_columns, row_counts, scan_tables, scan_columns,
    primary_keys, keys_by_table, scan_totals, scan, ScanResult,
)
from lakeledger.sources.tables import (
    DRIVER_TABLES, CATALOGUE_NAMES, DECLARED_KEYS, read_table, read_sources, driver_sources,
    declared_key_metadata, catalog_tables, catalog_sources,
)
