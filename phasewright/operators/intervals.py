"""Joins of points and intervals with intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Width of the smallest bins that intervals are dealt into.
BIN = 10_000
#: Bins of a level are so many times as wide as those of the level below.
STEP = 8
#: Levels that hold every span of 64-bit places.
LEVELS = 20


def _width(level: Column, width: int) -> Column:
    return F.lit(width).cast("long") * F.element_at(F.array(*[F.lit(STEP**k) for k in range(LEVELS)]), level + 1)


def _level(start: Column, end: Column, width: int) -> Column:
    """The first level whose bins are no narrower than the interval, which so touches two of them at most."""
    span = end.cast("long") - start.cast("long") + 1
    return F.size(F.filter(F.array(*[F.lit(width * STEP**k) for k in range(LEVELS - 1) if width * STEP**k < 2**63]), lambda w: w < span))


def _levels(rows: DataFrame) -> DataFrame:
    """One row: the levels that any of ``rows`` has."""
    return F.broadcast(rows.agg(F.array_sort(F.collect_set("_level")).alias("_levels")))  # LEVELS numbers at most


def _bins(rows: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """``rows`` under each bin of the level in ``_level`` that they touch, in ``_bin``."""
    w = _width(F.col("_level"), width)
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(start / w), F.floor(end / w))))


def point_join(points: DataFrame, regions: DataFrame, *, key: str | list[str] = "contig", pos: str = "pos", start: str = "start", end: str = "end", half_open: bool = False, width: int = BIN) -> DataFrame:
    """Points with every region that holds them; ``half_open`` leaves the region's start out.

    A region is listed under the one or two bins that it touches at the level of
    its length, a point under its own bin of every level that has regions. So a long
    sequence is many join keys, no pair meets twice, and rows grow with the
    levels, not with the length of regions.
    """
    keys = [key] if isinstance(key, str) else key
    r = regions.where(F.col(start) <= F.col(end)).withColumn("_level", _level(F.col(start), F.col(end), width))
    p = points.crossJoin(_levels(r)).withColumn("_level", F.explode("_levels")).drop("_levels")
    p = p.withColumn("_bin", F.floor(F.col(pos) / _width(F.col("_level"), width)))
    inside = (F.col(pos) > F.col(start) if half_open else F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end))
    return p.join(_bins(r, F.col(start), F.col(end), width), [*keys, "_level", "_bin"]).where(inside).drop("_level", "_bin")


def overlap_join(left: DataFrame, right: DataFrame, *, key: str = "contig", left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("rstart", "rend"), least: Column | int = 1, width: int = BIN) -> DataFrame:
    """Pairs of intervals that share at least ``least`` places, with ``overlap``; each pair once.

    Two intervals meet at the level of the longer one, where both touch two bins at
    most, and a pair is kept in its first common bin only. An interval is
    listed at its own level and at those higher ones that the other side has.
    """
    ls, le, rs, re = (F.col(c) for c in (*left_span, *right_span))
    a = left.where(ls <= le).withColumn("_level", _level(ls, le, width))
    b = right.where(rs <= re).withColumn("_level", _level(rs, re, width))

    def at(rows: DataFrame, start: Column, end: Column, others: DataFrame, above: Callable[[Column, Column], Column]) -> DataFrame:
        """``rows`` in the bins of those levels of ``others`` that are ``above`` their own."""
        each = rows.withColumnRenamed("_level", "_own").crossJoin(_levels(others)).withColumn("_level", F.explode(F.filter("_levels", lambda x: above(x, F.col("_own")))))
        return _bins(each.drop("_own", "_levels"), start, end, width)

    longer = _bins(a, ls, le, width).join(at(b, rs, re, a, lambda x, own: x >= own), [key, "_level", "_bin"])
    shorter = at(a, ls, le, b, lambda x, own: x > own).join(_bins(b, rs, re, width), [key, "_level", "_bin"])
    shared = F.least(le, re) - F.greatest(ls, rs) + 1
    first = F.floor(F.greatest(ls, rs) / _width(F.col("_level"), width))
    return longer.unionByName(shorter).withColumn("overlap", shared).where((F.col("_bin") == first) & (F.col("overlap") >= least)).drop("_level", "_bin")


def region_depth(depth: DataFrame, regions: DataFrame, *, key: str = "contig", pos: str = "pos", value: str = "depth", start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end, depth): mean depth of each region, cut to a whole number; 0 without any depth."""
    d = point_join(depth.select(key, pos, F.col(value).alias("_d")), regions.select(key, start, end).distinct(), key=key, pos=pos, start=start, end=end, half_open=True)
    means = d.groupBy(key, start, end).agg(F.floor(F.sum("_d") / F.count(F.lit(1))).alias("depth"))
    return regions.select(key, start, end).distinct().join(means, [key, start, end], "left").withColumn("depth", F.coalesce("depth", F.lit(0)).cast("long"))


def region_counts(reads: DataFrame, regions: DataFrame, *, key: str = "contig", read_span: tuple[str, str] = ("rstart", "rend"), start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end, count): reads that touch each region; 0 without any."""
    r = regions.select(key, start, end).distinct()
    hits = overlap_join(r, reads.select(key, *read_span), key=key, left_span=(start, end), right_span=read_span)
    n = hits.groupBy(key, start, end).agg(F.count(F.lit(1)).alias("count"))
    return r.join(n, [key, start, end], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def read_regions(reads: DataFrame, regions: DataFrame, *, key: str = "contig", read: str = "read_id", read_span: tuple[str, str] = ("rstart", "rend"), long: int = 500, short: int = 250, short_read: int = 1000) -> DataFrame:
    """Reads with regions that they overlap by ``long`` places, by ``short`` if the read is no longer than ``short_read``."""
    size = F.col(read_span[1]) - F.col(read_span[0]) + 1
    return overlap_join(reads, regions, key=key, left_span=read_span, right_span=("start", "end"), least=F.when(size <= short_read, short).otherwise(long))


def region_genotype(overlaps: DataFrame, *, read: str = "read_id", klass: str = "klass", geno: str = "geno") -> DataFrame:
    """(read, geno): the genotype of hap regions with the larger overlap; U if as large or without any."""
    n = overlaps.groupBy(read).agg(*[F.coalesce(F.sum(F.when(F.col(klass).contains("hap") & (F.col(geno) == g), F.col("overlap"))), F.lit(0)).alias(f"_{g}") for g in "PM"])
    return n.select(read, F.when(F.col("_P") > F.col("_M"), "P").when(F.col("_M") > F.col("_P"), "M").otherwise("U").alias("geno"))


def broken_points(rows: DataFrame, breaks: DataFrame, *, contig: str = "contig", pos: str = "pos", break_col: str = "break_pos") -> DataFrame:
    """Rows with the contig's name split at its break: ``sA`` before it, ``sB`` from it on; one break a contig."""
    b = breaks.select(contig, F.col(break_col).alias("_b")).dropDuplicates([contig])
    split = F.concat(F.col(contig), F.when(F.col(pos) < F.col("_b"), "sA").otherwise("sB"))
    return rows.join(b, contig, "left").withColumn(contig, F.when(F.col("_b").isNull(), F.col(contig)).otherwise(split)).drop("_b")


def broken_intervals(rows: DataFrame, breaks: DataFrame, *, contig: str = "contig", start: str = "start", end: str = "end", break_col: str = "break_pos") -> DataFrame:
    """The same for intervals: the side that holds the larger part, ``sA`` if both hold as much."""
    b = breaks.select(contig, F.col(break_col).alias("_b")).dropDuplicates([contig])
    left, right = F.least(F.col(end), F.col("_b") - 1) - F.col(start) + 1, F.col(end) - F.greatest(F.col(start), F.col("_b")) + 1
    split = F.concat(F.col(contig), F.when(left >= right, "sA").otherwise("sB"))
    return rows.join(b, contig, "left").withColumn(contig, F.when(F.col("_b").isNull(), F.col(contig)).otherwise(split)).drop("_b")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
