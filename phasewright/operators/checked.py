"""Joins that fail where a key has no match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def checked_join(left: DataFrame, right: DataFrame, on: list[str], *, what: str, only: Column | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, by a left join whose unmatched rows make the query fail.

    The error names ``what`` is missing and the first key that is met, from inside
    the plan, so no pass of its own is needed. Rows for which ``only`` isn't true
    may stay without a match. ``right`` must have one row for each key.
    """
    mark = "_matched"
    while mark in left.columns or mark in right.columns:
        mark = f"_{mark}"
    rows = left.join(right.withColumn(mark, F.lit(True)), on, "left")
    must = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    said = F.concat(F.lit(f"{what}: "), F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in on]))
    # the check is part of the mark, which is read in every row, so that no plan leaves it out
    checked = F.when(F.col(mark), True).when(must, F.raise_error(said).cast("boolean")).otherwise(False)
    return rows.where(checked.isNotNull()).drop(mark)
