"""Whole chains of operators, and the registered queries."""
