"""Crossovers from allele counts: smoothing, blocks, breakpoints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .intervals import point_join


def informative_positions(counts: DataFrame, *, key: str = "cell_id", a: str = "count_a", b: str = "count_b", least: int = 1000) -> DataFrame:
    """Places where either allele has reads, of cells with more than ``least`` of them."""
    rows = counts.where((F.col(a) > 0) | (F.col(b) > 0))
    return rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key))).where(F.col("_n") > least).drop("_n")


def smoothed(counts: DataFrame, *, keys: list[str], order: str = "pos", a: str = "count_a", b: str = "count_b", second_pass: bool = True) -> DataFrame:
    """Rows with ``af``, the share of allele a, and ``smooth``.

    First pass, a window: of two neighbours on each side, the share with ``af``
    above 0 decides over 0.7 and under 0.3, else the raw value stays. Second
    pass, in order: where the share of the smoothed neighbours is 0.4 to 0.6 the
    raw value comes back, and later rows see it; each group is one fold.
    """
    w = W.partitionBy(*keys).orderBy(order)
    rows = counts.withColumn("af", F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")))
    on = (F.col("af") > 0).cast("int")
    near = F.coalesce(F.sum(on).over(w.rowsBetween(-2, -1)), F.lit(0)) + F.coalesce(F.sum(on).over(w.rowsBetween(1, 2)), F.lit(0))
    n = F.count("af").over(w.rowsBetween(-2, 2)) - F.count("af").over(w.rowsBetween(0, 0))
    share = F.try_divide(near.cast("double"), n.cast("double"))
    rows = rows.withColumn("smooth", F.when(share > 0.7, 1.0).when(share < 0.3, 0.0).otherwise(F.col("af")))
    if not second_pass:
        return rows

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        raw, s = pdf["af"].tolist(), pdf["smooth"].tolist()
        for i in range(len(s)):
            window = s[max(0, i - 2) : i] + s[i + 1 : i + 3]
            if window and 0.4 <= sum(x > 0 for x in window) / len(window) <= 0.6:
                s[i] = raw[i]
        return pdf.assign(smooth=s)

    return rows.groupBy(*keys).applyInPandas(fold, rows.schema)


def blocks(rows: DataFrame, *, keys: list[str], order: str = "pos", value: str = "smooth") -> DataFrame:
    """(keys, block, start, end, genotype, markers): runs of one smoothed value; 1 from 0.8, 0 to 0.2, else -1."""
    w = W.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    numbered = rows.withColumn("_c", changed).withColumn("block", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "block").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.min(value).alias("_v"), F.count(F.lit(1)).alias("markers"))
    return out.withColumn("genotype", F.when(F.col("_v") >= 0.8, 1).when(F.col("_v") <= 0.2, 0).otherwise(-1)).drop("_v")


def large_blocks(rows: DataFrame, *, size: int = 500_000, markers: int = 20) -> DataFrame:
    return rows.where((F.col("end") - F.col("start") >= size) & (F.col("markers") >= markers))


def breakpoints(rows: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, bp, start, end, before, after, markers): between neighbouring blocks of different genotypes."""
    w = W.partitionBy(*keys).orderBy("start")
    b = rows.withColumns({"_g": F.lag("genotype").over(w), "_e": F.lag("end").over(w)})
    b = b.withColumn("_new", F.when(F.col("_g") == F.col("genotype"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    b = b.withColumn("_m", F.sum("markers").over(W.partitionBy(*keys, "_run").orderBy("start")))
    b = b.withColumn("_before", F.lag("_m").over(w))
    out = b.where("_g IS NOT NULL AND _new = 1").select(*keys, F.col("_e").alias("start"), F.col("start").alias("end"), F.col("_g").alias("before"), F.col("genotype").alias("after"), F.col("_before").alias("markers"))
    return out.withColumn("bp", F.row_number().over(W.partitionBy(*keys).orderBy("start")))


def refined_breakpoints(points: DataFrame, rows: DataFrame, *, keys: list[str], order: str = "pos", value: str = "smooth") -> DataFrame:
    """Breakpoints with the two markers between which the values differ most, the first of equal splits.

    Shares of 0 and of 1 are of all markers on each side, so this joins each
    breakpoint with its own markers, by bins, and takes prefix sums.
    """
    spans = points.select(*keys, "bp", F.col("start").alias("_s"), F.col("end").alias("_e"), "before", "after")
    inside = point_join(rows.select(*keys, F.col(order).alias("_p"), F.col(value).alias("_v")), spans, key=keys, pos="_p", start="_s", end="_e")
    g = [*keys, "bp"]
    w = W.partitionBy(*g).orderBy("_p")
    upto, whole = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*g)
    zero, one = (F.col("_v") == 0).cast("long"), (F.col("_v") == 1).cast("long")
    t = inside.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole), "_z": F.sum(zero).over(upto), "_o": F.sum(one).over(upto), "_zt": F.sum(zero).over(whole), "_ot": F.sum(one).over(whole), "_next": F.lead("_p").over(w)}).where("_next IS NOT NULL")
    rest = F.col("_n") - F.col("_i")
    score = F.greatest(F.col("_z") / F.col("_i") * ((F.col("_ot") - F.col("_o")) / rest), F.col("_o") / F.col("_i") * ((F.col("_zt") - F.col("_z")) / rest))
    best = t.withColumn("score", score).groupBy(*g, "before", "after").agg(F.max_by(F.struct("_p", "_next", "score"), F.struct("score", (-F.col("_i")).alias("i"))).alias("_b"))
    return best.select(*g, "before", "after", F.col("_b._p").alias("start"), F.col("_b._next").alias("end"), F.col("_b.score").alias("score"))


def final_blocks(rows: DataFrame, sizes: DataFrame, *, keys: list[str], chromosome: str, size: str = "size", compat: bool = False) -> DataFrame:
    """(keys, rank, start, end, genotype, markers): neighbours of one genotype merged, from 1 to the chromosome's size.

    ``markers`` are those of the merged blocks; with ``compat`` the running sum of
    all blocks that continue a genotype, which never starts anew.
    """
    w = W.partitionBy(*keys).orderBy("start")
    b = rows.withColumn("_new", F.when(F.lag("genotype").over(w) == F.col("genotype"), 0).otherwise(1))
    b = b.withColumn("rank", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    b = b.withColumn("_acc", F.sum(F.when(F.col("_new") == 0, F.col("markers")).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = b.groupBy(*keys, "rank").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("genotype").alias("genotype"), (F.max("_acc") if compat else F.sum("markers")).alias("markers"))
    last = F.lead("rank").over(W.partitionBy(*keys).orderBy("rank")).isNull()
    out = out.withColumn("_last", last).join(sizes.select(chromosome, F.col(size).alias("_size")), chromosome, "left")
    return out.select(*keys, "rank", F.when(F.col("rank") == 1, 1).otherwise(F.col("start")).alias("start"), F.when(F.col("_last"), F.greatest("end", "_size")).otherwise(F.col("end")).alias("end"), "genotype", "markers")


def adjusted_blocks(final: DataFrame, refined: DataFrame, *, keys: list[str]) -> DataFrame:
    """Final blocks whose inner edges are the refined breakpoints."""
    ends = refined.select(*keys, F.col("bp").alias("rank"), F.col("start").alias("_end"))
    starts = refined.select(*keys, (F.col("bp") + 1).alias("rank"), F.col("end").alias("_start"))
    out = final.join(ends, [*keys, "rank"], "left").join(starts, [*keys, "rank"], "left")
    return out.withColumns({"start": F.coalesce("_start", "start"), "end": F.coalesce("_end", "end")}).drop("_start", "_end")
