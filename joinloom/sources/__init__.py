"""CSV, Parquet cache and in-memory sources and sinks."""
