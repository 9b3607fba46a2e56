"""Columnar profiling, encoding and archiving of tabular, log and sensor files on Spark."""
