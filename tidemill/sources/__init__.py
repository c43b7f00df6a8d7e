"""Table access: Parquet tables as DataFrames and views."""

from tidemill.sources.catalog import TABLES, Catalog, read_table, register
from tidemill.sources.sink import write_table

__all__ = ["TABLES", "Catalog", "read_table", "register", "write_table"]
