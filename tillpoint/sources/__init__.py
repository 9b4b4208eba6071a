"""Typed readers for the invoice-line extract and writers for marts."""

from tillpoint.sources.adapter import read_extract, load_tables
from tillpoint.sources.extract import RAW_SCHEMA, read_csv_extract

__all__ = ["read_extract", "load_tables", "RAW_SCHEMA", "read_csv_extract"]
