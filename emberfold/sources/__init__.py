"""Readers: folded text, Parquet tables, derived stacks."""
