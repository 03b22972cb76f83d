"""More registered queries: scalars, calls, maps and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import functions as X
from ..operators import cells, maps, phasing, reads, recombination, sequences
from . import chains
from .queries import _AC_SQL, _CLU_SQL, _PAT_SQL, _SEQ_SQL, _alleles, _patterns, _query, _seq, _symbols, _t


@_query("""SELECT c_custkey, substr(c_name, 1, 4) AS barcode, substr(c_name, 5, 3) AS umi, substr(c_name, 8) AS sequence, substr(c_mktsegment, 8) AS quality FROM customer""")
def barcode_fields(spark: SparkSession, d: str) -> DataFrame:
    """Barcode, UMI and the rest of a read."""
    return _t(spark, d, "customer").select("c_custkey", X.barcode_parts("c_name", "c_mktsegment", barcode=4, umi=3).alias("p")).select("c_custkey", "p.*")


@_query("""SELECT c_custkey, translate(reverse(upper(c_mktsegment)), 'ACGTU', 'TGCAA') AS rc, translate(reverse(lower(c_mktsegment)), 'acgt', 'TGCA') AS rc_lower FROM customer""")
def complements(spark, d):
    """Reverse complements."""
    return _t(spark, d, "customer").select("c_custkey", X.complement_reverse("c_mktsegment").alias("rc"), X.complement_reverse_lower("c_mktsegment").alias("rc_lower"))


@_query("""SELECT o_orderkey, CAST(CASE WHEN o_custkey & 64 <> 0 AND o_custkey & 128 = 0 THEN 1 WHEN o_custkey & 64 = 0 AND o_custkey & 128 <> 0 THEN 2 END AS INTEGER) AS read_end, o_custkey & 16 <> 0 AS is_reverse FROM orders""")
def read_flags(spark, d):
    """First and second reads, and strands, by flag bits."""
    return _t(spark, d, "orders").select("o_orderkey", X.read_end("o_custkey").alias("read_end"), X.is_reverse("o_custkey").alias("is_reverse"))


@_query("""SELECT o_orderkey, list_filter(string_split(o_orderpriority, '-'), lambda x: x <> '')[1] AS first, len(list_filter(string_split(o_orderpriority || '--', '-'), lambda x: x <> '')) AS n, CAST(round(o_totalprice / 3) AS BIGINT) AS third FROM orders""")
def tokens_and_rounding(spark, d):
    """Tokens without empty ones; halves away from zero."""
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", F.get(X.split_tokens("o_orderpriority", "-"), F.lit(0)).alias("first"), F.size(X.split_tokens(F.concat("o_orderpriority", F.lit("--")), "-")).cast("long").alias("n"), X.half_away(F.col("o_totalprice") / 3).alias("third"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) + 3 + l_linenumber AS span, CAST(l_quantity AS INTEGER) AS matched FROM lineitem""")
def cigar_spans(spark, d):
    """Reference bases under an alignment."""
    li = _t(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    c = F.concat(F.lit("5S"), q, F.lit("M2I3D"), F.col("l_linenumber").cast("string"), F.lit("N4H"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", X.reference_span(c).alias("span"), X.cigar_counts(c, "M").alias("matched"))


@_query("""SELECT o_orderkey, substr(o_orderstatus || 'bcdefghij', 3, 2) || '--' || substr('abcdefghij', 6, 3) AS aligned FROM orders""")
def realigned_reads(spark, d):
    """Reads along the reference."""
    s = F.concat("o_orderstatus", F.lit("bcdefghij"))
    return _t(spark, d, "orders").select("o_orderkey", X.realigned(s, F.lit("2S2M2D1I3M2S")).alias("aligned"))


_CALL_SQL = "cnt AS (SELECT CAST(user_id % 3 AS VARCHAR) AS contig, (event_id % 40) * 10 AS pos, user_id AS cell_id, count(*) FILTER (event_type IN ('click', 'purchase')) AS a, count(*) FILTER (event_type IN ('view', 'signup')) AS c FROM events GROUP BY ALL)"


def _counts(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("contig"), ((F.col("event_id") % 40) * 10).alias("pos"), F.col("user_id").alias("cell_id"), "event_type")
    one = lambda kinds: F.count_if(F.col("event_type").isin(*kinds))
    n = e.groupBy("contig", "pos", "cell_id").agg(one(["click", "purchase"]).alias("A"), one(["view", "signup"]).alias("C"))
    return n.withColumns({b: F.lit(0) for b in ("G", "T", "-", "N")})


def _markers(spark, d):
    return _counts(spark, d).select("contig", "pos").distinct().withColumns({"ref": F.lit("A"), "alt": F.lit("C")})


@_query(f"""WITH {_CALL_SQL}, m AS (SELECT DISTINCT contig, pos FROM cnt), cells AS (SELECT DISTINCT cell_id FROM cnt)
SELECT m.contig, m.pos, 'A' AS ref, 'C' AS alt, cells.cell_id, CASE WHEN coalesce(a, 0) > 0 AND coalesce(c, 0) > 0 THEN 'U' WHEN coalesce(a, 0) > 0 THEN 'A' WHEN coalesce(c, 0) > 0 THEN 'C' ELSE 'N' END AS base FROM m CROSS JOIN cells LEFT JOIN cnt ON cnt.contig = m.contig AND cnt.pos = m.pos AND cnt.cell_id = cells.cell_id""")
def allele_calls(spark, d):
    """A base for every marker and cell."""
    n = _counts(spark, d)
    return phasing.called(_markers(spark, d), n.select("cell_id"), n)


@_query("""WITH m AS (SELECT p_partkey AS contig, p_size AS pos, substr(p_brand, 1, 3) AS r, substr(p_type, 1, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END) AS a FROM part), x AS (SELECT contig, pos, r, a, unnest(range(0, 3)) AS i FROM m WHERE length(r) = length(a) AND length(r) = 3)
SELECT contig, pos + i AS pos, substr(r, CAST(i AS INTEGER) + 1, 1) AS ref, substr(a, CAST(i AS INTEGER) + 1, 1) AS alt FROM x""")
def exploded_markers(spark, d):
    """Markers of several bases, base by base."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("contig"), F.col("p_size").cast("long").alias("pos"), F.substring("p_brand", 1, 3).alias("ref"), F.when(F.col("p_partkey") % 2 == 0, F.substring("p_type", 1, 3)).otherwise(F.substring("p_type", 1, 2)).alias("alt"))
    return phasing.exploded_markers(p)


@_query("""SELECT l_orderkey AS contig, CAST(l_linenumber AS BIGINT) AS pos, CASE WHEN c % 3 = 0 THEN 'M' ELSE 'P' END AS sym, CASE WHEN c % 3 = 0 THEN '0_p' ELSE '0_m' END AS cluster FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS c FROM lineitem)""")
def flipped_cell_regions(spark, d):
    """Regions of flagged contigs with their symbols changed over."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("contig"), F.col("l_linenumber").cast("long").alias("pos"), F.lit("P").alias("sym"), F.lit("0_m").alias("cluster"))
    flags = _t(spark, d, "orders").select(F.col("o_orderkey").alias("contig"), (F.col("o_orderkey") % 7 % 3 == 0).alias("swap")).dropDuplicates(["contig"])
    return chains.flipped_regions(li, flags)


_MAP_SQL = f"{_PAT_SQL}, gm AS (SELECT contig % 10 AS group_id, contig // 2 AS contig, contig AS ord, CASE WHEN contig % 2 = 0 THEN 'left' ELSE 'right' END AS side, substr(pattern || 'UUUUUU', 1, 6) AS pattern FROM pat)"


def _gmap(spark, d):
    p = _patterns(spark, d)
    return p.select((F.col("contig") % 10).alias("group_id"), F.expr("contig div 2").alias("contig"), F.col("contig").alias("ord"), F.when(F.col("contig") % 2 == 0, "left").otherwise("right").alias("side"), F.substring(F.concat("pattern", F.lit("UUUUUU")), 1, 6).alias("pattern"))


def _whole_gmap(spark, d):
    """The map of ``_gmap`` with whole patterns, filled to the longest; the SQL of other map queries holds their six symbols."""
    p = sequences.packed_letters(_symbols(spark, d), key="l_orderkey", order=["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).withColumnRenamed("l_orderkey", "contig")
    # a symbol a row
    longest = F.broadcast(_t(spark, d, "lineitem").groupBy("l_orderkey").count().agg(F.max("count").cast("int").alias("_n")))
    whole = p.crossJoin(longest).select("contig", F.rpad("pattern", F.col("_n"), F.lit("U")).alias("pattern"))
    return whole.select((F.col("contig") % 10).alias("group_id"), F.expr("contig div 2").alias("contig"), F.col("contig").alias("ord"), F.when(F.col("contig") % 2 == 0, "left").otherwise("right").alias("side"), "pattern")


@_query(f"""WITH {_MAP_SQL}, n AS (SELECT *, lead(contig) OVER w AS next_contig, lead(pattern) OVER w AS next_pattern FROM gm WINDOW w AS (PARTITION BY group_id ORDER BY ord)) SELECT * FROM n WHERE contig <> next_contig""")
def map_slots(spark, d):
    """Places between markers of different contigs."""
    return maps.slots(_gmap(spark, d))


@_query(f"""WITH {_MAP_SQL}, n AS (SELECT *, lead(pattern) OVER (PARTITION BY group_id ORDER BY ord) AS q FROM gm), s AS (SELECT group_id, ord, unnest(string_split(pattern, '')) AS x, unnest(string_split(q, '')) AS y FROM n WHERE q IS NOT NULL),
r AS (SELECT group_id, ord, round(count(*) FILTER (x <> 'U' AND y <> 'U' AND x <> y) * 100.0 / nullif(count(*) FILTER (x <> 'U' AND y <> 'U'), 0), 6) AS recomb_pct FROM s GROUP BY ALL)
SELECT n.group_id, n.contig, n.ord, n.side, n.pattern, r.recomb_pct FROM n LEFT JOIN r ON n.group_id = r.group_id AND n.ord = r.ord""")
def map_recombination(spark, d):
    """Recombination of neighbours on a map."""
    return maps.neighbours_recombination(_gmap(spark, d)).withColumn("recomb_pct", F.round("recomb_pct", 6))


@_query(f"""WITH {_MAP_SQL}, u AS (SELECT group_id, contig, 'right' AS side FROM gm WHERE side = 'left' AND ord % 3 = 0), x AS (SELECT group_id, CAST(ord AS DOUBLE) AS o, contig, side FROM gm UNION ALL SELECT u.group_id, g.ord + 0.5, u.contig, u.side FROM u JOIN gm g ON g.group_id = u.group_id AND g.contig = u.contig)
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY o, side) AS INTEGER) AS ord, contig, side, CAST(1 AS DOUBLE) AS distance FROM x""")
def placed_mates(spark, d):
    """Unmapped ends beside their mates."""
    g = _gmap(spark, d).select("group_id", "ord", "contig", "side", F.lit(1.0).alias("distance"))
    un = g.where("side = 'left' AND ord % 3 = 0").select("group_id", "contig", F.lit("right").alias("side"))
    return maps.placed_mates(g, un)


@_query(f"""WITH {_MAP_SQL}, c AS (SELECT group_id, ord, contig + 1000000 AS contig FROM gm WHERE ord % 5 = 0), x AS (SELECT group_id, ord AS o, 1 AS k, contig, side FROM gm UNION ALL SELECT group_id, ord, 0, contig, 'left_del' FROM c UNION ALL SELECT group_id, ord, 0, contig, 'right_del' FROM c)
SELECT group_id, contig, side, CAST(row_number() OVER (PARTITION BY group_id ORDER BY o, k, contig, side) AS INTEGER) AS ord FROM x""")
def maps_with_deletions(spark, d):
    """Deletion markers before their anchors."""
    g = _gmap(spark, d)
    return maps.with_deletions(g, g.where("ord % 5 = 0").select("group_id", "ord", (F.col("contig") + 1000000).alias("contig")))


@_query(f"""WITH {_MAP_SQL}, r AS (SELECT *, row_number() OVER w AS n, lead(contig) OVER w AS q FROM gm WINDOW w AS (PARTITION BY group_id ORDER BY ord)) SELECT group_id AS "group", CAST((n + 1) // 2 AS INTEGER) AS rank, contig, side = 'right' AS reverse, coalesce(q = contig, false) AS paired FROM r WHERE n % 2 = 1""")
def scaffold_pairs(spark, d):
    """Map rows two by two, with orientation."""
    return sequences.scaffold_pairs(_gmap(spark, d).withColumnRenamed("group_id", "group"))


@_query(f"""WITH {_CLU_SQL}, f AS (SELECT s.contig, s.cell_id, s.idx, s.pos, s.sym, c.cluster FROM seq s JOIN clu c USING (contig, cell_id)) SELECT contig, cell_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) FILTER (sym = cluster) AS own FROM f GROUP BY contig, cell_id""")
def cluster_members(spark, d):
    """Symbols of each cell with its cluster."""
    s = _seq(spark, d)
    return s.join(phasing.clusters(s).select("contig", "cell_id", "cluster"), ["contig", "cell_id"]).groupBy("contig", "cell_id").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count_if(F.col("sym") == F.col("cluster")).alias("own"))


_BLOCK_SQL = f"""{_AC_SQL}, c AS (SELECT *, CASE WHEN lag(smooth) OVER (PARTITION BY cell_id ORDER BY pos) = smooth THEN 0 ELSE 1 END AS c FROM s2), b AS (SELECT *, sum(c) OVER (PARTITION BY cell_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM c),
bl AS (SELECT cell_id, min(pos) AS start, max(pos) AS "end", count(*) AS markers, CASE WHEN min(smooth) >= 0.8 THEN 1 WHEN min(smooth) <= 0.2 THEN 0 ELSE -1 END AS genotype FROM b GROUP BY cell_id, block)"""


def _blocks(spark, d):
    return recombination.blocks(recombination.smoothed(_alleles(spark, d), keys=["cell_id"], second_pass=False), keys=["cell_id"])


@_query(f"""WITH {_BLOCK_SQL} SELECT cell_id, start, "end", markers, CAST(genotype AS INTEGER) AS genotype FROM bl WHERE "end" - start >= 10 AND markers >= 8""")
def large_blocks(spark, d):
    """Blocks of enough markers and length."""
    return recombination.large_blocks(_blocks(spark, d), size=10, markers=8).drop("block")


@_query(f"""WITH {_BLOCK_SQL}, f AS (SELECT * FROM bl WHERE markers >= 3), l AS (SELECT *, lag(genotype) OVER w AS g, lag("end") OVER w AS e FROM f WINDOW w AS (PARTITION BY cell_id ORDER BY start)),
r AS (SELECT *, sum(CASE WHEN g = genotype THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM l), m AS (SELECT *, sum(markers) OVER (PARTITION BY cell_id, run ORDER BY start ROWS UNBOUNDED PRECEDING) AS acc FROM r), p AS (SELECT *, lag(acc) OVER (PARTITION BY cell_id ORDER BY start) AS pm FROM m)
SELECT cell_id, e AS start, start AS "end", CAST(g AS INTEGER) AS before, CAST(genotype AS INTEGER) AS after, CAST(pm AS BIGINT) AS markers, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY start) AS INTEGER) AS bp FROM p WHERE g IS NOT NULL AND g <> genotype""")
def breakpoints(spark, d):
    """Changes of genotype between blocks."""
    return recombination.breakpoints(_blocks(spark, d).where("markers >= 3"), keys=["cell_id"])


@_query(f"""WITH {_BLOCK_SQL}, f AS (SELECT * FROM bl WHERE markers >= 3), l AS (SELECT *, CASE WHEN lag(genotype) OVER (PARTITION BY cell_id ORDER BY start) = genotype THEN 0 ELSE 1 END AS c FROM f), r AS (SELECT *, sum(c) OVER (PARTITION BY cell_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS rank FROM l),
g AS (SELECT cell_id, rank, min(start) AS start, max("end") AS "end", max(genotype) AS genotype, sum(markers) AS markers FROM r GROUP BY ALL)
SELECT cell_id, CAST(rank AS BIGINT) AS rank, CASE WHEN rank = 1 THEN 1 ELSE start END AS start, CASE WHEN lead(rank) OVER (PARTITION BY cell_id ORDER BY rank) IS NULL THEN greatest("end", 100000) ELSE "end" END AS "end", CAST(genotype AS INTEGER) AS genotype, CAST(markers AS BIGINT) AS markers FROM g""")
def final_blocks(spark, d):
    """Blocks of one genotype merged, from 1 to the size."""
    b = _blocks(spark, d)
    sizes = b.select("cell_id").distinct().withColumn("size", F.lit(100000))
    return recombination.final_blocks(b.where("markers >= 3"), sizes, keys=["cell_id"], chromosome="cell_id").withColumn("rank", F.col("rank").cast("long"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 AND l_quantity / 50 > 0.503 THEN 'hom_low' WHEN l_suppkey % 2 = 0 THEN 'hap_low' ELSE 'hom_high' END AS klass FROM lineitem""")
def support_classes(spark, d):
    """hap_low regions that most cells support."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_suppkey") % 2 == 0, "hap_low").otherwise("hom_high").alias("klass"), F.col("l_quantity").alias("support"), F.lit(50).alias("cells"))
    return cells.reclassified(li).drop("support", "cells")


@_query("""WITH r AS (SELECT o_custkey AS name, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS INTEGER) AS e FROM orders) SELECT name, count(*) FILTER (e = 1) AS first, count(*) FILTER (e = 2) AS second FROM r GROUP BY name HAVING count(*) FILTER (e = 1) <> 1 OR count(*) FILTER (e = 2) <> 1""")
def unpaired_reads(spark, d):
    """Names without exactly one read of each end."""
    return cells.unpaired(_t(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("end")))


@_query("""SELECT a.o_orderkey AS record, a.o_custkey AS v, b.o_totalprice AS v2 FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey""")
def paired_records(spark, d):
    """Both files' records by number."""
    o = _t(spark, d, "orders")
    first, second = o.select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("v")), o.select(F.col("o_orderkey").alias("record"), F.col("o_totalprice").alias("v"))
    return cells.paired(first, second, key="record")


@_query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal / 100000 <= 0.05 AND c_nationkey <= 20""")
def filtered_cells(spark, d):
    """Cells within both bounds."""
    c = _t(spark, d, "customer").withColumn("r", F.col("c_acctbal") / 100000)
    return cells.cell_filter(c, ratio="r", count="c_nationkey", most=20).select("c_custkey", "c_acctbal")


@_query("""WITH f AS (SELECT l_orderkey AS locus, 'g' || CAST(l_suppkey % 3 AS VARCHAR) AS g, l_linestatus = 'F' AS s FROM lineitem) SELECT locus, bool_or(s) AS swap, array_to_string(list_sort(list_distinct(list(g))), '#') AS groups FROM f GROUP BY locus""")
def phase_flags(spark, d):
    """Flips and groups of each locus."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("locus"), F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string")).alias("group_id"), F.when(F.col("l_linestatus") == "F", "{1}").otherwise("{0}").alias("flip"))
    return maps.phase_flags(li)


@_query("""WITH RECURSIVE v AS (SELECT CAST(c_acctbal AS DOUBLE) AS v, count(*) AS n FROM customer GROUP BY ALL),
m AS (SELECT 0 AS i, (SELECT min(v) FROM v) AS lo, (SELECT max(v) FROM v) AS hi
UNION ALL SELECT i + 1, coalesce(sum(v * n) FILTER (abs(v - lo) <= abs(v - hi)) / sum(n) FILTER (abs(v - lo) <= abs(v - hi)), min(lo)), coalesce(sum(v * n) FILTER (abs(v - lo) > abs(v - hi)) / sum(n) FILTER (abs(v - lo) > abs(v - hi)), min(hi)) FROM m, v WHERE i < 20 GROUP BY i)
SELECT c_custkey, c_acctbal, CAST(abs(c_acctbal - lo) > abs(c_acctbal - hi) AS INTEGER) AS "group" FROM customer, m WHERE i = 20""")
def two_groups(spark, d):
    """Two groups of one number."""
    return cells.two_groups(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@_query(f"""WITH {_CALL_SQL}, m AS (SELECT contig, pos, row_number() OVER (PARTITION BY contig ORDER BY pos) AS idx FROM (SELECT DISTINCT contig, pos FROM cnt)), cells AS (SELECT DISTINCT cell_id FROM cnt),
b AS (SELECT m.contig, m.idx, cells.cell_id, CASE WHEN coalesce(a, 0) > 0 AND coalesce(c, 0) > 0 THEN NULL WHEN coalesce(a, 0) > 0 THEN 'r' WHEN coalesce(c, 0) > 0 THEN 'a' END AS side FROM m CROSS JOIN cells LEFT JOIN cnt ON cnt.contig = m.contig AND cnt.pos = m.pos AND cnt.cell_id = cells.cell_id),
p AS (SELECT *, side || lead(side) OVER (PARTITION BY contig, cell_id ORDER BY idx) AS d FROM b),
n AS (SELECT contig, idx, idx = max(idx) OVER (PARTITION BY contig) AS last, rr + CASE WHEN idx < max(idx) OVER (PARTITION BY contig) THEN 1 ELSE 0 END AS rr, aa, ra, ar FROM (SELECT contig, idx, count(*) FILTER (d = 'rr') AS rr, count(*) FILTER (d = 'aa') AS aa, count(*) FILTER (d = 'ra') AS ra, count(*) FILTER (d = 'ar') AS ar FROM p GROUP BY contig, idx)),
o AS (SELECT *, list_sort([{{'n': -rr, 's': 'AA', 'd': 'rr'}}, {{'n': -aa, 's': 'CC', 'd': 'aa'}}, {{'n': -ra, 's': 'AC', 'd': 'ra'}}, {{'n': -ar, 's': 'CA', 'd': 'ar'}}])[1].d AS top FROM n),
t AS (SELECT *, top IN ('ra', 'ar') AS mixed, NOT last AND (ra + ar > rr + aa OR (ra + ar = rr + aa AND top IN ('ra', 'ar'))) AS trans FROM o),
k AS (SELECT *, CASE WHEN last THEN 'r' WHEN trans = mixed THEN substr(top, 1, 1) WHEN trans THEN CASE WHEN ra > ar THEN 'r' WHEN ar > ra THEN 'a' ELSE substr(top, 1, 1) END ELSE CASE WHEN rr > aa THEN 'r' WHEN aa > rr THEN 'a' ELSE substr(top, 1, 1) END END AS member FROM t),
s AS (SELECT contig, idx, trans, (coalesce(sum(trans::INT) OVER (PARTITION BY contig ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (first_value(member) OVER (PARTITION BY contig ORDER BY idx) = 'a')::INT) % 2 = 1 AS swapped FROM k)
SELECT contig, CAST(idx AS INTEGER) AS idx, trans, CASE WHEN swapped THEN 'C' ELSE 'A' END AS mat, CASE WHEN swapped THEN 'A' ELSE 'C' END AS pat FROM s""")
def dimer_phases(spark, d):
    """Phase of each marker by pairs of neighbours."""
    m = phasing.indexed(_markers(spark, d))
    n = _counts(spark, d)
    return phasing.dimer_phase(phasing.called(m, n.select("cell_id"), n).join(m.select("contig", "pos", "idx"), ["contig", "pos"]))


@_query()
def routed_reads(spark, d):
    """Routes of alignments."""
    o = _t(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("aln_id"), F.col("o_custkey").cast("string").alias("qname"), F.lit(0).alias("flag"), (F.col("o_custkey") % 5).cast("string").alias("rname"), (F.col("o_orderkey") % 100 + 1).cast("long").alias("pos"), F.lit("12M").alias("cigar"), F.translate(F.rpad(F.lower(F.concat("o_orderstatus", "o_orderpriority")), 12, "x"), "fopx", "MMPP").alias("seq"))
    m = spark.range(1, 120).select(F.explode(F.array(*[F.lit(str(k)) for k in range(5)])).alias("contig"), F.col("id").alias("pos"), F.lit("M").alias("mat"), F.lit("P").alias("pat"))
    regions = m.where("pos = 1").select("contig", F.lit(1).cast("long").alias("start"), F.lit(900).cast("long").alias("end"), F.lit("hap_low").alias("klass"), F.lit("P").alias("geno"))
    groups = m.where("pos = 1 AND contig <> '4'").select("contig", F.concat(F.lit("g"), "contig").alias("group_id"))
    return reads.routed(a, m, regions, groups)


@_query(f"""WITH {_SEQ_SQL} SELECT contig, cell_id, count(*) AS n FROM seq GROUP BY contig, cell_id""")
def unpacked_patterns(spark, d):
    """A11 and back: symbols of packed patterns, counted."""
    p = sequences.packed(_seq(spark, d), keys=["contig", "cell_id"], order="idx")
    return sequences.unpacked(p).groupBy("contig", "cell_id").agg(F.count(F.lit(1)).alias("n"))
