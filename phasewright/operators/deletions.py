"""Deletion-like regions on genetic maps: three cases, a vote of each contig, and the maps with its two markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import flip, match_score
from .checked import checked_join
from .lineage import checkpoint
from .maps import best_slots, group_votes, slots, with_deletions

# The name of no map, and of no group, in results.
NO_MAP, NO_GROUP = "gmap.file.unavailable", "unphased.txt"


@dataclass
class PlacedDeletions:
    """``regions``: each region with case, status, phase, score and map; ``chosen``: contigs to be put before a marker; ``maps``: maps with their markers."""

    regions: DataFrame
    chosen: DataFrame
    maps: DataFrame


def placed_deletions(regions: DataFrame, gmap: DataFrame, gates: DataFrame, groups: DataFrame, matched: DataFrame, *, renamed: Column | None = None) -> PlacedDeletions:
    """Regions (contig, start, end, klass, pattern) given a map, a phase and a score.

    ``gmap``: group_id, ord, contig, side, pattern. ``gates``: contig, side,
    pattern of all contigs' ends. ``groups``: contig, side, phase_group.
    ``matched``: phase_group, map_group, one to one. ``renamed`` is the name that a
    region's contig has in the other tables, if it was cut there.

    Case 1: the contig has no end on a map or in a phase group. Its hom regions and
    hap regions without P stay unphased, on no map; others go before the second marker
    of the best slot of all maps. Case 2: an end is in a phase group; hom regions
    take its map and score twice their length, others the best slot of that map.
    Case 3: an end is on a map; hom as in case 2, others are compared with the
    contig's own two ends, which must be there. Of ends the left one counts
    first. Where no score is above 0 a region keeps its pattern, has no
    marker and score 0, and in case 1 no map.

    Every region votes for its map, with its score in case 1 and twice its length in the others;
    all regions of a contig get the map that most chose (``maps.group_votes``).
    A contig of case 1 or 2 is put before the marker of that map with the
    highest score of its regions, the first name of equal ones, as ``left_del`` and
    ``right_del`` with the pattern of the first such region by start.
    """
    name = F.col("contig") if renamed is None else renamed
    side = lambda df, value, out: df.groupBy("contig").agg(F.coalesce(F.min(F.when(F.col("side") == "left", F.col(value))), F.min(F.when(F.col("side") == "right", F.col(value)))).alias(out))
    on_map = side(gmap.select("contig", "side", F.col("group_id").cast("string").alias("group_id")), "group_id", "_map").withColumnRenamed("contig", "_name")
    in_group = side(groups, "phase_group", "_phase").withColumnRenamed("contig", "_name")
    pairs = matched.select(F.col("phase_group").alias("_phase"), F.col("map_group").cast("string").alias("_phase_map"))
    rows = regions.select("contig", "start", "end", "klass", "pattern", name.alias("_name")).join(on_map, "_name", "left").join(in_group, "_name", "left")
    rows = checked_join(rows, pairs, ["_phase"], what="phase group without a map", only=F.col("_map").isNull() & F.col("_phase").isNotNull())
    case = F.when(F.col("_map").isNotNull(), 3).when(F.col("_phase").isNotNull(), 2).otherwise(1)
    hom, bad = F.col("klass").contains("hom"), ~F.col("pattern").contains("P")
    rows = rows.withColumns({"case": case, "_hom": hom, "_bad": (case == 1) & ~hom & bad, "_id": F.to_json(F.array(F.col("contig"), F.col("start").cast("string"), F.col("end").cast("string")))})
    rows = rows.withColumns({"_own": F.when(F.col("case") == 3, F.col("_map")).when(F.col("case") == 2, F.col("_phase_map")), "_slot": ~F.col("_hom") & ~F.col("_bad") & (F.col("case") < 3), "_ends": ~F.col("_hom") & (F.col("case") == 3)})
    # both are read by each step below
    rows, maps = checkpoint(rows), checkpoint(gmap.withColumn("group_id", F.col("group_id").cast("string")))
    free = slots(maps)
    best = best_slots(rows.where("_slot"), free, marker="_id", pattern="pattern", own_group="_own")
    marker = _next_markers(maps)
    best = best.join(marker, ["group_id", "ord"], "left").select("_id", F.col("group_id").alias("_best"), "marker", "swap", F.col("score").alias("_s"))
    ends = gates.groupBy(F.col("contig").alias("_name")).agg(F.min(F.when(F.col("side") == "left", F.col("pattern"))).alias("_l"), F.min(F.when(F.col("side") == "right", F.col("pattern"))).alias("_r"))
    rows = checked_join(rows, ends.where("_l IS NOT NULL AND _r IS NOT NULL"), ["_name"], what="contig on a map without gates", only=F.col("_ends"))
    rows = rows.join(best, "_id", "left")
    sum_of = lambda p: match_score(p, "_l", scale=False) + match_score(p, "_r", scale=False)
    keep, turned = F.when(F.col("_ends"), sum_of(F.col("pattern"))), F.when(F.col("_ends"), sum_of(flip("pattern")))
    rows = rows.withColumns({"_k": F.greatest(keep, F.lit(0)), "_t": turned})
    double = (2 * F.length("pattern")).cast("long")
    rows = rows.withColumns({
        "swap": F.when(F.col("_ends"), F.col("_t") > F.col("_k")).otherwise(F.coalesce("swap", F.lit(False))),
        "score": F.when(F.col("_hom"), F.when(F.col("case") == 1, 0).otherwise(double)).when(F.col("_bad"), 0).when(F.col("_ends"), F.greatest("_k", "_t")).otherwise(F.coalesce("_s", F.lit(0))).cast("long"),
        "region_map": F.when(F.col("case") > 1, F.col("_own")).otherwise(F.coalesce("_best", F.lit(NO_MAP))),
        "marker": F.when(F.col("_ends"), F.concat(F.col("_name"), F.lit("\tright"))).otherwise(F.col("marker")),
        "status": _status(),
    })
    rows = checkpoint(rows.withColumn("pattern", F.when(F.col("swap"), flip("pattern")).otherwise(F.col("pattern"))))
    votes = group_votes(rows.select("contig", F.col("region_map").alias("map_file"), F.when(F.col("case") == 1, F.col("score")).otherwise(double).alias("score")))
    rows = rows.join(votes.select("contig", F.col("map_file").alias("map_group")), "contig")
    names = matched.select(F.col("map_group").cast("string").alias("map_group"), "phase_group")
    out = rows.join(names, "map_group", "left").select(
        "contig", "start", "end", "klass", F.when(F.col("pattern").contains("P"), "P").otherwise("M").alias("phase"), "score", F.coalesce("phase_group", F.lit(NO_GROUP)).alias("phase_group"),
        "map_group", "pattern", "case", "status", "region_map", "marker",
    )
    found = rows.where((F.col("case") < 3) & F.col("marker").isNotNull() & (F.col("region_map") == F.col("map_group")))
    least = F.min(F.struct((-F.col("score")).alias("s"), "marker", "start", "end", "pattern")).alias("_m")
    chosen = found.groupBy("contig", "map_group").agg(least).select("contig", "map_group", "_m.marker", (-F.col("_m.s")).alias("score"), "_m.pattern")
    anchors = maps.select(F.col("group_id").alias("map_group"), F.concat_ws("\t", "contig", "side").alias("marker"), "ord")
    placed = chosen.join(anchors, ["map_group", "marker"]).select(F.col("map_group").alias("group_id"), "ord", "contig")
    return PlacedDeletions(out, chosen, with_deletions(maps, placed))


def _next_markers(markers: DataFrame) -> DataFrame:
    """(group_id, ord, marker): the name of the marker behind each one."""
    w = W.partitionBy("group_id").orderBy("ord")
    return markers.select("group_id", "ord", F.lead(F.concat_ws("\t", "contig", "side")).over(w).alias("marker"))


def _status() -> Column:
    case = F.col("case").cast("string")
    hap = F.when(F.col("case") == 1, "1.2.2").otherwise(F.concat(case, F.lit(".2")))
    return F.when(F.col("_hom"), F.concat(F.lit("unphased.hom.case"), case, F.lit(".1"))).when(F.col("_bad"), "unphased.hap.case1.2.1").otherwise(F.concat(F.lit("phased.hap.case"), hap))


def status_counts(regions: DataFrame) -> DataFrame:
    """(case, status, regions, contigs): how many regions, and of how many contigs, each case and status has."""
    return regions.groupBy("case", "status").agg(F.count(F.lit(1)).alias("regions"), F.countDistinct("contig").alias("contigs"))


def map_contigs(gmap: DataFrame) -> DataFrame:
    """(markers, contigs): markers and different contigs of all maps."""
    return gmap.agg(F.count(F.lit(1)).alias("markers"), F.countDistinct("contig").alias("contigs"))
