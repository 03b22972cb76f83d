"""Depths and read counts of regions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ColumnOrName, col, half_away


def depth_class(depth: ColumnOrName, cutoff: int = 200) -> Column:
    """hap_high up to the cutoff, then hap_low and hom_low by whole quarters and halves of it, else hom_high."""
    d = col(depth)
    return F.when(d <= cutoff, "hap_high").when(d <= cutoff + cutoff // 4, "hap_low").when(d <= cutoff + cutoff // 2, "hom_low").otherwise("hom_high")


def depth_code(depth: ColumnOrName) -> Column:
    """One character: the digit up to 9, a letter for each ten up to 99, j from 100."""
    d = col(depth)
    at = F.when(d < 10, d).otherwise(F.least(F.lit(19), 9 + F.floor(d / 10)))
    return F.substr(F.lit("0123456789abcdefghij"), (at + 1).cast("int"), F.lit(1))


def reads_per_kilobase(count: ColumnOrName, start: ColumnOrName, end: ColumnOrName, aligned: ColumnOrName) -> Column:
    """Reads by region length in thousands and by millions of aligned mates, rounded; null without any of either."""
    size = col(end) - col(start) + 1
    return half_away(F.try_divide(F.try_divide(col(count) * 1.0, size) * 1000.0, 2 * col(aligned)) * 1000000.0)


def counts_per_million(count: ColumnOrName, aligned: ColumnOrName) -> Column:
    return half_away(F.try_divide(col(count) * 1.0, 2 * col(aligned)) * 1000000.0)


def support_class(klass: ColumnOrName, support: ColumnOrName, cells: ColumnOrName, *, least: float = 0.503) -> Column:
    """hap_low regions that more than ``least`` of the cells support are hom_low."""
    share = F.try_divide(col(support).cast("double"), col(cells).cast("double"))
    return F.when((col(klass) == "hap_low") & (share > least), "hom_low").otherwise(col(klass))


def presence(codes: ColumnOrName) -> Column:
    """P for every depth code above 1, else U."""
    return F.regexp_replace(F.regexp_replace(col(codes), "[01]", "U"), "[^U]", "P")
