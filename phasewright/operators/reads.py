"""Long reads: from alignments to haplotypes and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import even_hash, realigned, reference_span
from .checked import checked_join
from .intervals import point_join, read_regions, region_genotype
from .sequences import change_points, ends


def disposition(seq: str = "seq", cigar: str = "cigar", flag: str = "flag") -> Column:
    """What becomes of an alignment, in this order: without sequence, unmapped, secondary, kept."""
    return F.when(F.col(seq) == "*", "no_sequence").when(F.col(cigar) == "*", "unmapped_starcigar").when(F.col(flag) > 255, "secondary").otherwise("kept")


def placed(alignments: DataFrame) -> DataFrame:
    """Kept alignments with ``rstart``, ``rend`` and ``aligned``, the read along the reference."""
    rows = alignments.where(disposition() == "kept")
    return rows.withColumns({"rstart": F.col("pos"), "rend": F.col("pos") + reference_span("cigar") - 1, "aligned": realigned("seq", "cigar")})


def read_symbols(reads: DataFrame, markers: DataFrame, *, read: str = "aln_id", contig: str = "rname") -> DataFrame:
    """(read, pos, sym): M or P where a read has a marker's base, u where it has neither."""
    m = markers.select(F.col("contig").alias(contig), F.col("pos").alias("mpos"), "mat", "pat")
    hits = point_join(m, reads.select(read, contig, "rstart", "rend", "aligned"), key=contig, pos="mpos", start="rstart", end="rend")
    base = F.substr("aligned", (F.col("mpos") - F.col("rstart") + 1).cast("int"), F.lit(1))
    return hits.select(read, F.col("mpos").alias("pos"), F.when(base == F.col("mat"), "M").when(base == F.col("pat"), "P").otherwise("u").alias("sym"))


def majority(symbols: DataFrame, *, read: str = "aln_id") -> DataFrame:
    """(read, p, m, geno): the symbol seen more often; a tie falls by a hash of the read, none is U."""
    n = symbols.groupBy(read).agg(F.count_if(F.col("sym") == "P").alias("p"), F.count_if(F.col("sym") == "M").alias("m"))
    tie = F.when(even_hash(read) == 0, "P").otherwise("M")
    return n.withColumn("geno", F.when(F.col("p") > F.col("m"), "P").when(F.col("m") > F.col("p"), "M").when(F.col("p") > 0, tie).otherwise("U"))


def read_breaks(symbols: DataFrame, *, read: str = "aln_id", min_score: float = 0.64, least: int = 8, end: int = 4) -> DataFrame:
    """(read, split): reads that switch: 8 informative markers or more, the score, and 4 of the other symbol at its end."""
    c = change_points(symbols, keys=read, order="pos").join(majority(symbols, read=read), read).join(ends(symbols, keys=read, order="pos").select(read, "first", "last"), read)
    other = F.when(F.col("geno") == "M", "P").otherwise("M")
    on_left = F.substring("call", 1, 1) == other
    held = F.when(other == "P", F.when(on_left, F.col("left_p")).otherwise(F.col("right_p"))).otherwise(F.when(on_left, F.col("left_m")).otherwise(F.col("right_m")))
    differs = F.when(on_left, F.col("first") == other).otherwise(F.col("last") == other)
    return c.where((F.col("n") >= least) & (F.col("p") > 0) & (F.col("m") > 0) & (F.col("score") >= min_score) & differs & (held >= end)).select(read, "split")


def routed(alignments: DataFrame, markers: DataFrame, regions: DataFrame, groups: DataFrame, *, min_score: float = 0.64) -> DataFrame:
    """(aln_id, qname, span, routes): where each alignment's read goes.

    ``alignments``: aln_id and SAM columns; ``markers``: contig, pos, mat, pat;
    ``regions``: contig, start, end, klass, geno; ``groups``: contig, group_id.
    Markers decide first, then overlapping deletions, then a hash. Contigs of
    no group, and of several (joined by #), go to ``mapped_no_lg``. A read that
    switches goes to its own route and to ``crossover``.
    """
    kept = placed(alignments)
    symbols = read_symbols(kept, markers)
    calls = majority(symbols).select("aln_id", F.col("geno").alias("_snp"))
    breaks = read_breaks(symbols, min_score=min_score).select("aln_id", F.lit(True).alias("_co"))
    deletions = region_genotype(read_regions(kept.select("aln_id", F.col("rname").alias("contig"), "rstart", "rend"), regions, read="aln_id"), read="aln_id").select("aln_id", F.col("geno").alias("_del"))
    rows = kept.join(calls, "aln_id", "left").join(breaks, "aln_id", "left").join(deletions, "aln_id", "left").join(groups.select(F.col("contig").alias("rname"), "group_id"), "rname", "left")
    by_hash = F.when(even_hash("qname", "pos") == 0, "P").otherwise("M")
    geno = F.coalesce(F.nullif("_snp", F.lit("U")), F.nullif("_del", F.lit("U")), by_hash)
    home = F.when(F.col("group_id").isNull() | F.col("group_id").contains("#"), "mapped_no_lg").otherwise(F.concat("group_id", F.lit("_"), F.repeat(geno, F.lit(3)), F.lit("_pbreads")))
    out = rows.select("aln_id", "qname", (F.col("rend") - F.col("rstart") + 1).alias("span"), F.when(F.coalesce("_co", F.lit(False)), F.array(home, F.lit("crossover"))).otherwise(F.array(home)).alias("routes"))
    star = alignments.where(disposition() == "unmapped_starcigar").select("aln_id", "qname", F.length("seq").alias("span"), F.array(F.lit("unmapped_starcigar")).alias("routes"))
    return out.unionByName(star)


def route_totals(routes: DataFrame) -> DataFrame:
    """(route, alignments, reads, bases)."""
    rows = routes.select("qname", "span", F.explode("routes").alias("route"))
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("alignments"), F.countDistinct("qname").alias("reads"), F.sum("span").alias("bases"))


def dispositions(alignments: DataFrame) -> DataFrame:
    """(disposition, alignments, bases): what becomes of alignments before they are routed; bases by the reads' length, none without sequence."""
    rows = alignments.select(disposition().alias("disposition"), F.when(F.col("seq") == "*", 0).otherwise(F.length("seq")).alias("_n"))
    return rows.groupBy("disposition").agg(F.count(F.lit(1)).alias("alignments"), F.sum("_n").cast("long").alias("bases"))


def counted(routes: DataFrame) -> tuple[DataFrame, Observation]:
    """The routes, and an observation that holds their counts once they have been written or collected.

    Counted in the same pass: alignments, bases, alignments of two routes,
    of no one group, and without a place.
    """
    seen = Observation()
    first = F.get("routes", F.lit(0))
    n = lambda what, name: F.count_if(what).alias(name)
    out = routes.observe(seen, F.count(F.lit(1)).alias("alignments"), F.coalesce(F.sum("span"), F.lit(0)).cast("long").alias("bases"), n(F.size("routes") > 1, "crossovers"), n(first == "mapped_no_lg", "no_group"), n(first == "unmapped_starcigar", "no_place"))
    return out, seen


def shared_reads(a: DataFrame, b: DataFrame, *, read: str = "qname", span: str = "span") -> DataFrame:
    """(reads, bases) of reads that are in both sets; bases by the first."""
    both = a.join(b.select(read), read, "left_semi")
    return both.agg(F.countDistinct(read).alias("reads"), F.coalesce(F.sum(span), F.lit(0)).alias("bases"))


def best_route(routes: DataFrame) -> DataFrame:
    """(qname, listing, alignments, best): all routes of a read with their spans, and the one of the largest span."""
    rows = routes.select("aln_id", "qname", "span", F.get("routes", F.lit(0)).alias("route"))
    listed = F.sort_array(F.collect_list(F.struct("aln_id", "route", "span")))
    return rows.groupBy("qname").agg(F.array_join(F.transform(listed, lambda r: F.concat(r.route, F.lit(":"), r.span.cast("string"))), ";").alias("listing"), F.count(F.lit(1)).alias("alignments"), F.max_by("route", F.struct("span", (-F.col("aln_id")).alias("_o"))).alias("best"))


#: The lines between two contigs of a scaffold.
SEPARATOR = ("N" * 80, "N" * 80)


def scaffold_chunks(pairs: DataFrame, sequences: DataFrame, breaks: DataFrame | None = None, *, group: str = "group", compat: bool = False) -> DataFrame:
    """(group, rank, part, bases): scaffolds as rows in the order of rank and part; contigs as they lie, with ``SEPARATOR`` between them.

    ``pairs``: group, rank, contig, reverse. ``sequences``: id, start, bases, the
    parts of each contig (``sources.fasta_lines``); a scaffold is never one value.
    A contig turned round has its parts in falling order, each turned.

    A contig split at ``breaks`` (contig, break_pos) is named with sA or sB: the
    first ``break_pos`` bases, or those from there on. With ``compat`` split
    contigs are never turned, as their flag is looked for by the name before the split.
    A contig without sequence, or a split one without a break, makes the query fail.
    """
    from ..functions import complement_reverse_lower

    half = F.when(F.col("contig").rlike("s[AB]$"), F.substring("contig", -1, 1))
    rows = pairs.select(F.col(group).alias("group"), "rank", "reverse", half.alias("_half"), F.when(half.isNotNull(), F.regexp_replace("contig", "s[AB]$", "")).otherwise(F.col("contig")).alias("id"))
    cuts = sequences.sparkSession.createDataFrame([], "contig string, break_pos long") if breaks is None else breaks
    rows = checked_join(rows, cuts.select(F.col("contig").alias("id"), F.col("break_pos").cast("long").alias("_at")).dropDuplicates(["id"]), ["id"], what="split contig without a break", only=F.col("_half").isNotNull())
    there = sequences.select("id").distinct().withColumn("_there", F.lit(True))
    rows = checked_join(rows, there, ["id"], what="contig without sequence").drop("_there")
    parts = rows.join(sequences.select("id", "start", "bases"), "id")
    at, n = F.col("_at") - F.col("start"), F.length("bases")
    kept = F.when(F.col("_half") == "A", F.substr("bases", F.lit(1), F.greatest(F.least(at, n), F.lit(0)).cast("int"))).when(F.col("_half") == "B", F.substr("bases", F.greatest(at + 1, F.lit(1)).cast("int"))).otherwise(F.col("bases"))
    turned = F.col("reverse") & F.col("_half").isNull() if compat else F.col("reverse")
    body = parts.select("group", "rank", turned.alias("_t"), "start", kept.alias("_b")).where(F.length("_b") > 0)
    body = body.select("group", "rank", F.when(F.col("_t"), -F.col("start") - 1).otherwise(F.col("start")).alias("part"), F.when(F.col("_t"), complement_reverse_lower("_b")).otherwise(F.col("_b")).alias("bases"))
    first = rows.groupBy("group").agg(F.min("rank").alias("_first"))
    between = rows.select("group", "rank").join(first, "group").where(F.col("rank") > F.col("_first"))
    lowest = F.lit(-(2**63)).cast("long")  # before every part of its contig
    lines = between.select("group", "rank", F.posexplode(F.array(*map(F.lit, SEPARATOR))).alias("_i", "bases")).select("group", "rank", (lowest + F.col("_i")).alias("part"), "bases")
    return lines.unionByName(body).withColumnRenamed("group", group)
