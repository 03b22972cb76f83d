"""CIGAR strings and reads laid on the reference."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ColumnOrName, col

_PATTERN = r"(\d+)([MIDNSHPX=])"


def cigar_ops(cigar: ColumnOrName) -> Column:
    """An array of structs (op, n)."""
    counts = F.transform(F.regexp_extract_all(col(cigar), F.lit(_PATTERN), F.lit(1)), lambda x: x.cast("int"))
    return F.zip_with(F.regexp_extract_all(col(cigar), F.lit(_PATTERN), F.lit(2)), counts, lambda o, n: F.struct(o.alias("op"), n.alias("n")))


def cigar_counts(cigar: ColumnOrName, op: str) -> Column:
    """Bases under one operation."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x.op == op), F.lit(0), lambda a, x: a + x.n)


def reference_span(cigar: ColumnOrName) -> Column:
    """Reference bases that the alignment covers: M, D, N, X and =."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x.op.isin("M", "D", "N", "X", "=")), F.lit(0), lambda a, x: a + x.n)


def realigned(sequence: ColumnOrName, cigar: ColumnOrName, *, pad_skipped: bool = True) -> Column:
    """The read base by base along the reference: insertions and clips dropped, a dash for each deleted base.

    Skipped bases (N) are dashes as well; ``pad_skipped=False`` leaves them out,
    which shifts what follows.
    """
    s = col(sequence)
    gaps = ("D", "N") if pad_skipped else ("D",)
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        reads = x.op.isin("M", "X", "=")
        at = F.when(reads | x.op.isin("I", "S"), a["at"] + x.n).otherwise(a["at"])
        out = F.when(reads, F.concat(a["out"], F.substring(s, a["at"], x.n))).when(x.op.isin(*gaps), F.concat(a["out"], F.repeat(F.lit("-"), x.n))).otherwise(a["out"])
        return F.struct(at.alias("at"), out.alias("out"))

    return F.aggregate(cigar_ops(cigar), start, step, lambda a: a["out"])
