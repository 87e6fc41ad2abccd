"""Incremental statistics over arriving folded files."""
