"""Structured Streaming forms of the read tools."""

from .reads import barcoded_pairs, write_parts

__all__ = ["barcoded_pairs", "write_parts"]
