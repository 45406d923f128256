"""Readers of note folders, parquet tables, configuration and change feeds."""
