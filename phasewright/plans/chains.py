"""The tools of the pipeline as chains of operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import counts_per_million, depth_class, presence, reads_per_kilobase
from ..operators import cells, intervals, maps, phasing, sequences
from ..operators.lineage import checkpoint


@dataclass
class Phased:
    """What phasing the markers of all cells gives; what follows from the haplotypes is lazy."""

    haplotypes: DataFrame
    symbols: DataFrame
    clusters: DataFrame
    calls: DataFrame
    regions: DataFrame
    gates: DataFrame
    statistics: DataFrame
    edges: DataFrame


def phase_markers(markers: DataFrame, cell_ids: DataFrame, counts: DataFrame, sizes: DataFrame, *, correct: bool = True, min_score: float = 0.64) -> Phased:
    """Markers (contig, pos, ref, alt) and base counts by cell to haplotypes, cell regions, gates and edges."""
    known = phasing.indexed(phasing.exploded_markers(markers).dropDuplicates(["contig", "pos"]))
    known = checkpoint(known)
    # every step below reads all calls again, and the haplotypes of the step before
    bases = checkpoint(phasing.called(known, cell_ids, counts).join(known.select("contig", "pos", "idx"), ["contig", "pos"]))
    if correct:
        phase = checkpoint(phasing.dimer_phase(bases).select("contig", "idx", "mat", "pat"))
        members = phasing.clusters(phasing.symbols(bases, phase))
        phase = checkpoint(phasing.consensus(bases, phase, members))
        seq = phasing.symbols(bases, phase)
        phase = checkpoint(phasing.count_corrected(seq, phase, phasing.clusters(seq)))
    else:
        phase = known.select("contig", "idx", F.col("ref").alias("mat"), F.col("alt").alias("pat"))
    seq = phasing.symbols(bases, phase)
    members = phasing.clusters(seq)
    calls = sequences.accepted_breaks(seq, members, min_score=min_score)
    runs = sequences.segments(seq).join(members.select("contig", "cell_id", "cluster"), ["contig", "cell_id"])
    gate = sequences.gates(calls)
    ends = gate.groupBy("contig").agg(*[F.min(F.when(F.col("kind") == f"{side}-sequence", F.col("pattern"))).alias(f"{side}_pattern") for side in ("left", "right")])
    return Phased(
        haplotypes=phase.join(known.select("contig", "idx", "pos"), ["contig", "idx"]), symbols=seq, clusters=members, calls=calls,
        regions=sequences.region_coordinates(runs, known, sizes), gates=gate, statistics=phasing.cluster_statistics(seq, members), edges=maps.contig_edges(ends),
    )


def deletion_markers(markers: DataFrame, sizes: DataFrame, depth: DataFrame, *, min_gap: int = 2000, cutoff: int = 200) -> DataFrame:
    """(contig, start, end, depth, klass): stretches without markers, classed by their mean depth."""
    found = sequences.gap_regions(markers, sizes, min_gap=min_gap)
    return intervals.region_depth(depth, found).withColumn("klass", depth_class("depth", cutoff))


def deletion_genotypes(regions: DataFrame, counts: DataFrame, aligned: DataFrame, *, hap_to_hom: float = 0.503) -> DataFrame:
    """(contig, start, end, klass, codes, pattern, support, cells) from reads by region and cell.

    ``counts``: contig, start, end, cell_id, count; ``aligned``: cell_id, aligned.
    """
    keys = ["contig", "start", "end"]
    rows = counts.join(aligned, "cell_id").withColumns({"rpkm": reads_per_kilobase("count", "start", "end", "aligned"), "cpm": counts_per_million("count", "aligned")})
    codes = cells.presence_patterns(rows, keys=keys)
    out = cells.reclassified(regions.select(*keys, "klass").join(codes, keys), least=hap_to_hom)
    return out.withColumn("pattern", presence("codes"))


def flipped_regions(regions: DataFrame, flags: DataFrame) -> DataFrame:
    """Cell regions of flagged contigs with P and M, 0_p and 0_m changed over; 0_u stays."""
    rows = regions.join(flags.select("contig", "swap"), "contig", "left")
    s = F.coalesce("swap", F.lit(False))
    return rows.withColumns({"sym": F.when(s, F.translate("sym", "PM", "MP")).otherwise(F.col("sym")), "cluster": F.when(s, F.translate("cluster", "pm", "mp")).otherwise(F.col("cluster"))}).drop("swap")
