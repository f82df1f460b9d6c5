"""Sources and sinks: JSON hits, dictionary files, Parquet tables, records."""
