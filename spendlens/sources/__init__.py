"""Reading ledgers, landed files and derived tables; writing them back."""

from .calendar import high_water_mark, month_chunks, refresh_window
from .catalog import catalog_resources, with_year_in_name
from .chunks import combine_chunks, ingest_export
from .csv import combine_years, ingest_year_file, normalize_column_name
from .ledger import anomaly_source, conform, open_ledger, open_table, open_yoy, with_year
from .sinks import write_by_month, write_by_year, write_table, write_yoy

__all__ = [
    "anomaly_source", "catalog_resources", "combine_chunks", "combine_years",
    "conform", "high_water_mark", "ingest_export", "ingest_year_file",
    "month_chunks", "normalize_column_name", "open_ledger", "open_table",
    "open_yoy", "refresh_window", "with_year", "with_year_in_name",
    "write_by_month", "write_by_year", "write_table", "write_yoy",
]
