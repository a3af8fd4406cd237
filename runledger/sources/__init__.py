"""Sources and sinks: parquet tables, NDJSON logs, ledger rows, state blobs."""
