"""Training-data operators: scoring, counting, packing, joining and cleaning documents.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only where it can be imported.
"""
