"""Allele calls, phase of markers along a sequence, clusters of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BASES = ("A", "C", "G", "T", "-", "N")


def exploded_markers(markers: DataFrame, *, contig: str = "contig", pos: str = "pos", ref: str = "ref", alt: str = "alt") -> DataFrame:
    """(contig, pos, ref, alt): one row for each base of markers whose alleles have one length; others go."""
    rows = markers.where(F.length(ref) == F.length(alt)).select(contig, F.col(pos).alias("_p"), F.posexplode(F.arrays_zip(F.split(ref, ""), F.split(alt, ""))).alias("_i", "_z"))
    return rows.select(contig, (F.col("_p") + F.col("_i")).alias("pos"), F.col("_z")["0"].alias("ref"), F.col("_z")["1"].alias("alt"))


def indexed(markers: DataFrame, *, contig: str = "contig", pos: str = "pos") -> DataFrame:
    """Markers with ``idx``, their place along the contig from 1."""
    return markers.withColumn("idx", F.row_number().over(W.partitionBy(contig).orderBy(pos)))


def allele_call(ref: Column, alt: Column, counts: dict[str, Column]) -> Column:
    """U if both alleles have reads, the allele that has, N if none."""
    of = lambda base: sum((F.when(base == b, c).otherwise(0) for b, c in counts.items()), F.lit(0))
    r, a = of(ref), of(alt)
    return F.when((r > 0) & (a > 0), "U").when(r > 0, ref).when(a > 0, alt).otherwise("N")


def called(markers: DataFrame, cells: DataFrame, counts: DataFrame, *, contig: str = "contig", pos: str = "pos", cell: str = "cell_id") -> DataFrame:
    """(contig, pos, ref, alt, cell, base): a row for every marker and cell; N where a cell has no reads.

    Each marker carries the list of all cells, so that dense rows come from a
    generator beside the markers; counts join by place and cell.
    """
    every = cells.select(cell).distinct().groupBy().agg(F.collect_set(cell).alias("_cells"))
    dense = markers.join(F.broadcast(every)).select(contig, pos, "ref", "alt", F.explode("_cells").alias(cell))
    found = counts.select(contig, pos, cell, *[F.col(f"`{b}`").alias(f"_{i}") for i, b in enumerate(BASES)])
    out = dense.join(found, [contig, pos, cell], "left")
    base = allele_call(F.col("ref"), F.col("alt"), {b: F.coalesce(f"_{i}", F.lit(0)) for i, b in enumerate(BASES)})
    return out.select(contig, pos, "ref", "alt", cell, base.alias("base"))


def dimer_phase(bases: DataFrame, *, contig: str = "contig", idx: str = "idx", cell: str = "cell_id", backbone: bool = True) -> DataFrame:
    """(contig, idx, trans, mat, pat): phase of each marker by its pair with the next one.

    Pairs of neighbouring bases of a cell are counted by (ref or alt, ref or alt);
    with ``backbone`` the all-reference sequence is one more cell. Neighbours are in
    trans if mixed pairs outnumber equal ones; if as many, if the most frequent
    pair (the first in order of letters of several) is mixed. A marker's phase is
    the parity of the trans pairs before it.
    """
    w = W.partitionBy(contig, cell).orderBy(idx)
    side = lambda b: F.when(F.col(b) == F.col("ref" if b == "base" else "_ref"), "r").when(F.col(b) == F.col("alt" if b == "base" else "_alt"), "a")
    pairs = bases.withColumns({"_base": F.lead("base").over(w), "_ref": F.lead("ref").over(w), "_alt": F.lead("alt").over(w)}).withColumn("_d", F.concat(side("base"), side("_base")))
    kinds = ("rr", "aa", "ra", "ar")
    counts = pairs.groupBy(contig, idx, "ref", "alt").agg(F.max("_ref").alias("_ref"), F.max("_alt").alias("_alt"), *[F.count_if(F.col("_d") == d).alias(d) for d in kinds])
    rr = F.col("rr") + F.when(F.col("_ref").isNotNull(), 1 if backbone else 0).otherwise(0)
    counts = counts.withColumn("rr", rr)
    letters = lambda d: F.concat(F.col("ref" if d[0] == "r" else "alt"), F.col("_ref" if d[1] == "r" else "_alt"))
    options = F.array_sort(F.array(*[F.struct((-F.col(d)).alias("n"), letters(d).alias("s"), F.lit(d).alias("d"), F.lit(d in ("ra", "ar")).alias("t")) for d in kinds]))
    top = F.get(options, F.lit(0))
    cis, trans = F.col("rr") + F.col("aa"), F.col("ra") + F.col("ar")
    is_trans = (trans > cis) | ((trans == cis) & top.t)
    line = W.partitionBy(contig).orderBy(idx)
    # the first pair's own letters fix the start: the larger member of the winning pairing
    member = F.when(is_trans == top.t, F.substring(top.d, 1, 1)).when(
        is_trans, F.when(F.col("ra") > F.col("ar"), "r").when(F.col("ar") > F.col("ra"), "a").otherwise(F.substring(top.d, 1, 1))
    ).otherwise(F.when(F.col("rr") > F.col("aa"), "r").when(F.col("aa") > F.col("rr"), "a").otherwise(F.substring(top.d, 1, 1)))
    out = counts.withColumns({"trans": F.when(F.col("_ref").isNotNull(), is_trans).otherwise(F.lit(False)), "_m": F.when(F.col("_ref").isNotNull(), member).otherwise("r")})
    parity = F.coalesce(F.sum(F.col("trans").cast("int")).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = (F.first("_m").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == "a").cast("int")
    swapped = (parity + start) % 2 == 1
    return out.select(contig, idx, "trans", F.when(swapped, F.col("alt")).otherwise(F.col("ref")).alias("mat"), F.when(swapped, F.col("ref")).otherwise(F.col("alt")).alias("pat"))


def symbols(bases: DataFrame, phased: DataFrame, *, contig: str = "contig", idx: str = "idx") -> DataFrame:
    """Bases with ``sym``: M or P where they equal one haplotype, else u."""
    p = phased.select(contig, idx, "mat", "pat")
    return bases.join(p, [contig, idx]).withColumn("sym", F.when(F.col("base") == F.col("mat"), "M").when(F.col("base") == F.col("pat"), "P").otherwise("u"))


def clusters(seq: DataFrame, *, contig: str = "contig", cell: str = "cell_id", symbol: str = "sym") -> DataFrame:
    """(contig, cell, mat_score, pat_score, cluster): which haplotype each cell is like; U if as much like both."""
    s = seq.groupBy(contig, cell).agg(F.count_if(F.col(symbol) == "M").alias("mat_score"), F.count_if(F.col(symbol) == "P").alias("pat_score"))
    return s.withColumn("cluster", F.when(F.col("mat_score") > F.col("pat_score"), "M").when(F.col("mat_score") < F.col("pat_score"), "P").otherwise("U"))


def consensus(bases: DataFrame, phased: DataFrame, members: DataFrame, *, contig: str = "contig", idx: str = "idx", cell: str = "cell_id") -> DataFrame:
    """``phased`` with alleles swapped where the two most frequent bases are exactly as frequent.

    Cells of the paternal cluster are read in the maternal frame first; bases are
    those of clustered cells.
    """
    rows = bases.join(members.where("cluster <> 'U'").select(contig, cell, "cluster"), [contig, cell]).join(phased.select(contig, idx, "mat", "pat"), [contig, idx])
    framed = F.when(F.col("cluster") == "M", F.col("base")).when(F.col("base") == F.col("mat"), F.col("pat")).when(F.col("base") == F.col("pat"), F.col("mat")).otherwise(F.col("base"))
    n = rows.withColumn("_b", framed).groupBy(contig, idx).agg(*[F.count_if(F.col("_b") == b).alias(f"_{b}") for b in "ACGT"])
    top = F.sort_array(F.array(*[F.col(f"_{b}") for b in "ACGT"]), asc=False)
    tie = n.select(contig, idx, ((F.get(top, F.lit(0)) == F.get(top, F.lit(1))) & (F.get(top, F.lit(0)) > 0)).alias("_t"))
    return _swapped(phased, tie, contig, idx)


def _swapped(phased: DataFrame, flags: DataFrame, contig: str, idx: str) -> DataFrame:
    t = F.coalesce("_t", F.lit(False))
    return phased.join(flags, [contig, idx], "left").select(contig, idx, F.when(t, F.col("pat")).otherwise(F.col("mat")).alias("mat"), F.when(t, F.col("mat")).otherwise(F.col("pat")).alias("pat"))


def cluster_counts(seq: DataFrame, members: DataFrame, *, contig: str = "contig", idx: str = "idx", cell: str = "cell_id", symbol: str = "sym") -> DataFrame:
    """(contig, idx, p_in_p, m_in_p, u_in_p, p_in_m, m_in_m, u_in_m) by site."""
    rows = seq.join(members.select(contig, cell, "cluster"), [contig, cell])
    return rows.groupBy(contig, idx).agg(*[F.count_if((F.col("cluster") == c) & (F.col(symbol) == s)).alias(f"{s.lower()}_in_{c.lower()}") for c in "PM" for s in ("P", "M", "u")])


def count_corrected(seq: DataFrame, phased: DataFrame, members: DataFrame, *, contig: str = "contig", idx: str = "idx", cell: str = "cell_id") -> DataFrame:
    """``phased`` swapped where the P cluster has fewer P than M and the M cluster more P than M."""
    n = cluster_counts(seq, members, contig=contig, idx=idx, cell=cell)
    return _swapped(phased, n.select(contig, idx, ((F.col("p_in_p") < F.col("m_in_p")) & (F.col("p_in_m") > F.col("m_in_m"))).alias("_t")), contig, idx)


def cluster_statistics(seq: DataFrame, members: DataFrame, *, contig: str = "contig", idx: str = "idx", cell: str = "cell_id", symbol: str = "sym") -> DataFrame:
    """(contig, cluster, markers, cells, covered, confusing, covered_share): for M, P and both together.

    Covered places are P or M; a confusing one is of the other cluster.
    """
    rows = seq.join(members.where("cluster IN ('M', 'P')").select(contig, cell, "cluster"), [contig, cell])
    markers = seq.groupBy(contig).agg(F.countDistinct(idx).alias("markers"))
    known = F.col(symbol).isin("P", "M")
    grouped = rows.groupingSets([[F.col(contig), F.col("cluster")], [F.col(contig)]], contig, "cluster").agg(F.countDistinct(cell).alias("cells"), F.count_if(known).alias("covered"), F.count_if(known & (F.col(symbol) != F.col("cluster"))).alias("confusing"))
    out = grouped.join(markers, contig).withColumn("cluster", F.coalesce("cluster", F.lit("P&M")))
    return out.select(contig, "cluster", "markers", "cells", "covered", "confusing", (F.col("covered") / F.col("markers")).alias("covered_share"))
