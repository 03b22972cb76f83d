"""Readers of text formats and partitioned writers."""
