"""Sources and sinks: parquet tables, CSV/JSON files, page id ranges."""

from .tables import load_table, reviews_standin, TABLES
from .files import (scan_csv, scan_csv_renamed, sink_csv_append, sink_csv_overwrite, sink_json)
from .csv_split import csv_records, infer_types, scan_csv_inferred, scan_csv_split
from .ledger import append_once, publish, read_committed, read_version
from .pages import page_url_range, page_batches, ingest_summary

__all__ = ["load_table", "reviews_standin", "TABLES", "scan_csv", "scan_csv_renamed", "sink_csv_append",
           "sink_csv_overwrite", "sink_json", "page_url_range", "page_batches",
           "ingest_summary", "csv_records", "infer_types", "scan_csv_inferred", "scan_csv_split", "append_once", "publish",
           "read_committed", "read_version"]
