"""Multiset reconciliation of tabular extracts and quoting profiles of delimited text, on Spark."""
