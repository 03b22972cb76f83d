"""Ends of contigs against those of the contigs that they come from, in the order of a phase file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import count_of, flip_strict, genotype_difference


def compared_ends(child: DataFrame, parent: DataFrame, order: DataFrame) -> DataFrame:
    """Three rows for each end that the phase file names: the child's pattern, its differences, and the parent's.

    ``child``, ``parent``: contig, side, pattern. ``order``: contig, side, swap and
    ``ord``, the place in the file (``sources.ordered_lines`` gives one over many
    files and splits); it is kept, so that rows can be sorted by (ord, line) at the
    end whatever was shuffled between. The child's pattern is changed over where ``swap`` is
    true, its unknown places becoming U. An end whose contig has no parent is compared with itself
    and called ``parent-missing``; ends that the child lacks give no rows.

    (ord, line, contig, side, kind, pattern, count, flip, ratio, both): ``count`` is the
    number of P and M, or of conflicts; ``ratio`` conflicts among ``both``, the places known in both.
    """
    turned = F.when(F.coalesce("swap", F.lit(False)), flip_strict("pattern")).otherwise(F.col("pattern"))
    rows = order.select("ord", "contig", "side", "swap").join(child.select("contig", "side", "pattern"), ["contig", "side"]).withColumn("_c", turned)
    of = parent.select("contig", "side", F.col("pattern").alias("_p"))
    paired = parent.select("contig").distinct().withColumn("_paired", F.lit(True))
    rows = rows.join(paired, "contig", "left").join(of, ["contig", "side"], "left").withColumn("_other", F.coalesce("_p", "_c"))
    rows = rows.withColumn("_d", genotype_difference("_c", "_other"))
    eff = lambda c: (count_of(F.col(c), "P") + count_of(F.col(c), "M")).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    line = lambda i, kind, pattern, count, flip, ratio, both: F.struct(F.lit(i).alias("line"), kind.alias("kind"), pattern.alias("pattern"), count.alias("count"), flip.alias("flip"), ratio.alias("ratio"), both.alias("both"))
    both, missing = F.col("_d.both").cast("long"), F.col("_paired").isNull()
    three = F.array(
        line(0, F.lit("child"), F.col("_c"), eff("pattern"), F.when(F.coalesce("swap", F.lit(False)), "flipped").otherwise("nonflipped"), none("double"), none("long")),
        line(1, F.lit("misma"), F.col("_d.visual"), F.col("_d.mismatch").cast("long"), none("string"), F.try_divide(F.col("_d.mismatch").cast("double"), both), none("long")),
        line(2, F.when(missing, "parent-missing").otherwise("parent"), F.col("_other"), F.when(missing, eff("pattern")).otherwise(eff("_other")), none("string"), none("double"), both),
    )
    return rows.select("ord", "contig", "side", F.explode(three).alias("_l")).select("ord", "_l.line", "contig", "side", "_l.kind", "_l.pattern", "_l.count", "_l.flip", "_l.ratio", "_l.both")
