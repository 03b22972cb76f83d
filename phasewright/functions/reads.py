"""Reads: barcodes, tags, flags, locus names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ColumnOrName, col


def barcode_parts(sequence: ColumnOrName, quality: ColumnOrName, *, barcode: int = 16, umi: int = 6) -> Column:
    """A struct of barcode, umi, and the read and quality behind them."""
    at = barcode + umi + 1
    s, q = col(sequence), col(quality)
    return F.struct(
        F.substring(s, 1, barcode).alias("barcode"), F.substring(s, barcode + 1, umi).alias("umi"),
        F.substr(s, F.lit(at)).alias("sequence"), F.substr(q, F.lit(at)).alias("quality"),
    )


def sam_tag(line: ColumnOrName, tag: str) -> Column:
    """The value of a ``TAG:Z:`` field of a line; null if it has none."""
    return F.nullif(F.regexp_extract(col(line), f"\t{tag}:Z:([^\t]+)", 1), F.lit(""))


def corrected_barcode(corrected: ColumnOrName, raw: ColumnOrName) -> Column:
    """The corrected barcode less its two-character suffix, else the raw one."""
    c = col(corrected)
    return F.coalesce(F.when(F.length(c) > 2, F.substring(c, F.lit(1), F.length(c) - 2)), col(raw))


def read_end(flag: ColumnOrName) -> Column:
    """1 or 2 for the first or second read of a pair; null if the flags say neither or both."""
    f = col(flag)
    first, second = f.bitwiseAND(64) != 0, f.bitwiseAND(128) != 0
    return F.when(first & ~second, 1).when(second & ~first, 2)


def is_reverse(flag: ColumnOrName) -> Column:
    return col(flag).bitwiseAND(16) != 0


def canonical_locus(locus: ColumnOrName, *, suffix: str = "_pilon", special: dict[str, str] | None = None) -> Column:
    """The contig of a locus name such as ``tig7_le``; ``special`` maps names of their own."""
    name = F.regexp_extract(col(locus), r"^(.*)_(?:le|ri)[^_]*$", 1)
    out = F.concat(F.when(name != "", name).otherwise(col(locus)), F.lit(suffix))
    for key, value in (special or {}).items():
        out = F.when(col(locus).startswith(key), F.lit(value)).otherwise(out)
    return out
