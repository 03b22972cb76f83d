"""Barcodes, read pairs and counts by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import depth_code, support_class
from .lineage import checkpoint
from .sequences import packed


def barcode_histogram(reads: DataFrame, *, sequence: str = "sequence", length: int = 16) -> DataFrame:
    """(barcode, reads): how many reads begin with each barcode."""
    return reads.groupBy(F.substring(sequence, 1, length).alias("barcode")).agg(F.count(F.lit(1)).alias("reads"))


def histogram_totals(histogram: DataFrame, cutoff: int = 5000) -> DataFrame:
    """(barcodes, reads, good_barcodes, good_reads) in one row."""
    good = F.col("reads") >= cutoff
    return histogram.agg(F.count(F.lit(1)).alias("barcodes"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"), F.count_if(good).alias("good_barcodes"), F.coalesce(F.sum(F.when(good, F.col("reads"))), F.lit(0)).alias("good_reads"))


def good_reads(reads: DataFrame, *, sequence: str = "sequence", length: int = 16, cutoff: int = 5000) -> DataFrame:
    """Reads of barcodes with at least ``cutoff`` reads, with ``barcode``.

    The good barcodes are few (their reads divided by the cutoff), but are left
    to the planner to broadcast or not by their measured size.
    """
    good = barcode_histogram(reads, sequence=sequence, length=length).where(F.col("reads") >= cutoff).select("barcode")
    return reads.withColumn("barcode", F.substring(sequence, 1, length)).join(good, "barcode", "left_semi")


def numbered_parts(reads: DataFrame, *, keys: list[str], order: str, size: int = 500_000) -> DataFrame:
    """Reads with ``part``: the ``size`` first accepted reads of each key are part 1, and so on."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return reads.withColumn("part", (F.floor((n - 1) / size) + 1).cast("int"))


def paired(first: DataFrame, second: DataFrame, *, key: str | list[str]) -> DataFrame:
    """Rows of both reads of a pair, the columns of the second with the ending 2."""
    keys = [key] if isinstance(key, str) else key
    return first.join(second.select(*keys, *[F.col(c).alias(f"{c}2") for c in second.columns if c not in keys]), keys)


def unpaired(reads: DataFrame, *, name: str = "name", end: str = "end") -> DataFrame:
    """(name, first, second): names that don't have exactly one first and one second read."""
    n = reads.groupBy(name).agg(F.count_if(F.col(end) == 1).alias("first"), F.count_if(F.col(end) == 2).alias("second"))
    return n.where("first <> 1 OR second <> 1")


def presence_patterns(counts: DataFrame, *, keys: list[str], cell: str = "cell_id", value: str = "rpkm") -> DataFrame:
    """(keys, codes, support, cells): a depth code for each cell in cell order, and cells above 0."""
    rows = counts.withColumn("_code", depth_code(value))
    codes = packed(rows, keys=keys, order=cell, symbol="_code", name="codes")
    n = counts.groupBy(*keys).agg(F.count_if(F.col(value) > 0).alias("support"), F.count(F.lit(1)).alias("cells"))
    return codes.join(n, keys)


def reclassified(regions: DataFrame, *, klass: str = "klass", support: str = "support", cells: str = "cells", least: float = 0.503) -> DataFrame:
    return regions.withColumn(klass, support_class(klass, support, cells, least=least))


def missing_counts(regions: DataFrame, counts: DataFrame, *, keys: list[str]) -> DataFrame:
    """Regions for which there is no count."""
    return regions.join(counts.select(*keys), keys, "left_anti")


def quality_markers(markers: DataFrame, *, quality: str = "qual", coverage: str = "alt_cov", frequency: str = "af") -> DataFrame:
    """Markers of quality 100 up, alternative coverage 60 to 140, total 120 to 280, frequency 0.38 to 0.62."""
    total = F.try_divide(F.col(coverage).cast("double"), F.col(frequency).cast("double"))
    return markers.where((F.col(quality) >= 100) & F.col(coverage).between(60, 140) & total.between(120, 280) & F.col(frequency).between(0.38, 0.62))


def binned(rows: DataFrame, value: str, width: float, *, right_closed: bool = True) -> DataFrame:
    """(bin, n): a histogram; bin b ends (or, not right-closed, begins) at ``b * width``."""
    v = F.col(value) / width
    return rows.groupBy((F.ceil(v) if right_closed else F.floor(v)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cell_filter(cells: DataFrame, *, ratio: str | None = None, most_ratio: float = 0.05, count: str | None = None, most: int = 2500) -> DataFrame:
    """Cells whose ratio and count don't exceed their bounds."""
    keep = F.lit(True)
    if ratio:
        keep &= F.col(ratio) <= most_ratio
    if count:
        keep &= F.col(count) <= most
    return cells.where(keep)


def two_groups(rows: DataFrame, value: str, *, rounds: int = 20) -> DataFrame:
    """Rows with ``group`` 0 or 1: two means of one number, from its ends, until they stand still.

    The rows are read once: rounds add up over the different values and their
    counts, which are kept. A null value has no group.
    """
    values = checkpoint(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return rows.withColumn("group", F.lit(None).cast("int"))

    def second(x: Column, low: float, high: float) -> Column:
        return F.abs(x - low) > F.abs(x - high)

    for _ in range(rounds):
        near = second(F.col("v"), low, high)
        mean = lambda which: F.sum(F.when(which, F.col("v") * F.col("n"))) / F.sum(F.when(which, F.col("n")))
        a, b = values.agg(mean(~near), mean(near)).first()
        after = (low if a is None else a, high if b is None else b)
        if after == (low, high):
            break
        low, high = after
    return rows.withColumn("group", second(F.col(value), low, high).cast("int"))


def top_hits(hits: DataFrame, *, query: str = "query", subject: str = "subject", order: str = "row", length: str = "length", least: int = 30, limit: int = 10) -> DataFrame:
    """(query, subject, rank): subjects by first appearance, without hits on oneself and short ones."""
    first = hits.where((F.col(query) != F.col(subject)) & (F.col(length) >= least)).groupBy(query, subject).agg(F.min(order).alias("_first"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy("_first", subject))).where(F.col("rank") <= limit).drop("_first")


def kmers(sequences: DataFrame, *, sequence: str = "sequence", k: int = 21, canonical: bool = True) -> DataFrame:
    """(kmer, n): counts of all k-mers; a k-mer and its reverse complement are one if canonical."""
    s = F.upper(F.col(sequence))
    windows = F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substr(s, i, F.lit(k))))
    rows = sequences.select(F.explode(windows).alias("kmer")).where(F.col("kmer").rlike("^[ACGT]+$"))
    if canonical:
        rows = rows.select(F.least("kmer", F.translate(F.reverse("kmer"), "ACGT", "TGCA")).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_spectrum(counts: DataFrame) -> DataFrame:
    """(n, kmers): how many k-mers occur n times."""
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))
