"""Strings: tokens, complements, counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_tokens(text: ColumnOrName, separator: str = "\t") -> Column:
    """Tokens of a line; empty ones are dropped, so that runs of separators count as one."""
    return F.array_remove(F.split(col(text), separator), "")


def complement_reverse(sequence: ColumnOrName) -> Column:
    """Reverse complement in upper case; U pairs with A."""
    return F.translate(F.reverse(F.upper(col(sequence))), "ACGTU", "TGCAA")


def complement_reverse_lower(sequence: ColumnOrName) -> Column:
    """Reverse complement that leaves every letter but A, C, G and T in lower case."""
    return F.translate(F.reverse(F.lower(col(sequence))), "acgt", "TGCA")


def count_of(text: ColumnOrName, letter: str) -> Column:
    """How often one character occurs."""
    return F.length(col(text)) - F.length(F.replace(col(text), F.lit(letter), F.lit("")))


def without(text: ColumnOrName, letter: str) -> Column:
    return F.replace(col(text), F.lit(letter), F.lit(""))


def half_away(value: Column) -> Column:
    """Rounding with halves away from zero, as a whole number."""
    return F.round(value).cast("long")


def even_hash(*keys: ColumnOrName, parts: int = 2) -> Column:
    """A choice among ``parts`` that depends on the keys alone: the same in every run."""
    return F.pmod(F.xxhash64(*map(col, keys)), F.lit(parts)).cast("int")


def path_part(path: ColumnOrName, number: int) -> Column:
    """The ``number``-th part of a path, from 1; empty parts don't count."""
    return F.try_element_at(split_tokens(path, "/"), F.lit(number))
