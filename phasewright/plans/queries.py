"""Registered queries: each operator over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import functions as X
from ..operators import cells, intervals, maps, phasing, reads, recombination, sequences
from ..operators.lineage import checkpoint
from . import chains

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# events as ordered symbols: contig c0..c4, a cell for each user, the event's number as position
_SYM = "CASE WHEN event_type IN ('click', 'purchase') THEN 'P' WHEN event_type IN ('view', 'signup') THEN 'M' ELSE 'u' END"
_SEQ_SQL = f"seq AS (SELECT 'c' || CAST(user_id % 5 AS VARCHAR) AS contig, user_id AS cell_id, event_id AS pos, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS idx, {_SYM} AS sym FROM events)"


def _seq(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = _t(spark, d, "events").select("user_id", "event_id", "event_type")
    sym = F.when(F.col("event_type").isin("click", "purchase"), "P").when(F.col("event_type").isin("view", "signup"), "M").otherwise("u")
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.select(F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("contig"), F.col("user_id").alias("cell_id"), F.col("event_id").alias("pos"), idx.alias("idx"), sym.alias("sym"))


# patterns: one of P, M, U for each line of an order
_PAT_SQL = "pat AS (SELECT l_orderkey AS contig, string_agg(CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'M' ELSE 'U' END, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pattern FROM lineitem GROUP BY l_orderkey)"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    return li.withColumn("sym", F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "M").otherwise("U"))


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = _symbols(spark, d).withColumn("_o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return sequences.packed(rows, keys="l_orderkey", order="_o").withColumnRenamed("l_orderkey", "contig")


_PAIR_SQL = f"WITH {_PAT_SQL}, pairs AS (SELECT a.contig, a.pattern AS a, b.pattern AS b FROM pat a JOIN pat b ON b.contig = a.contig + 1 AND length(a.pattern) = length(b.pattern)), sy AS (SELECT contig, a, b, unnest(string_split(a, '')) AS x, unnest(string_split(b, '')) AS y, generate_subscripts(string_split(a, ''), 1) AS i FROM pairs)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _patterns(spark, d)
    b = p.select((F.col("contig") - 1).alias("contig"), F.col("pattern").alias("b"))
    return p.withColumnRenamed("pattern", "a").join(b, "contig").where(F.length("a") == F.length("b"))


@_query(f"""WITH {_SEQ_SQL}, i AS (SELECT *, lag(sym) OVER w AS b, lag(idx) OVER w AS before_idx FROM (SELECT *, max(idx) OVER (PARTITION BY contig, cell_id) AS n FROM seq) WHERE sym <> 'u' WINDOW w AS (PARTITION BY contig, cell_id ORDER BY idx)),
s AS (SELECT *, CASE WHEN b IS NOT NULL THEN (before_idx + idx - 2) // 2 + 1 END AS cut FROM i WHERE b IS NULL OR b <> sym)
SELECT contig, cell_id, coalesce(cut + 1, 1) AS start_idx, coalesce(lead(cut) OVER (PARTITION BY contig, cell_id ORDER BY idx), n) AS end_idx, sym FROM s""")
def segments(spark, d):
    """Runs of one symbol, tiling each sequence."""
    return sequences.segments(_seq(spark, d))


@_query(f"""WITH {_SEQ_SQL}, c AS (SELECT contig, cell_id, idx, sum((sym = 'P')::INT) OVER u AS pl, sum((sym = 'M')::INT) OVER u AS ml, sum((sym = 'P')::INT) OVER w AS pt, sum((sym = 'M')::INT) OVER w AS mt FROM seq
WINDOW u AS (PARTITION BY contig, cell_id ORDER BY idx ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY contig, cell_id)),
s AS (SELECT *, pl / (pl + ml) * ((mt - ml) / (pt + mt - pl - ml)) AS pm, ml / (pl + ml) * ((pt - pl) / (pt + mt - pl - ml)) AS mp FROM c WHERE pl + ml > 0 AND pt + mt > pl + ml),
r AS (SELECT *, row_number() OVER (PARTITION BY contig, cell_id ORDER BY greatest(pm, mp) DESC, idx DESC) AS k FROM s)
SELECT contig, cell_id, idx AS split, round(greatest(pm, mp), 9) AS score, CASE WHEN pm >= mp THEN 'PM' ELSE 'MP' END AS call, CAST(pt + mt AS BIGINT) AS n, CAST(pl AS BIGINT) AS left_p, CAST(ml AS BIGINT) AS left_m, CAST(pt - pl AS BIGINT) AS right_p, CAST(mt - ml AS BIGINT) AS right_m FROM r WHERE k = 1""")
def change_points(spark, d):
    """The best single switch of each sequence."""
    return sequences.change_points(_seq(spark, d)).withColumn("score", F.round("score", 9))


@_query(f"""WITH {_SEQ_SQL}, s AS (SELECT cell_id, (lag(sym) OVER (PARTITION BY contig, cell_id ORDER BY idx) <> sym)::INT AS c FROM seq WHERE sym <> 'u')
SELECT cell_id, CAST(coalesce(sum(c), 0) AS BIGINT) AS switches, count(*) AS covered FROM s GROUP BY cell_id""")
def switch_counts(spark, d):
    """Changes of symbol by cell."""
    return sequences.switch_counts(_seq(spark, d))


@_query(f"""WITH {_SEQ_SQL}, s AS (SELECT contig, cell_id, count(*) FILTER (sym = 'M') AS mat_score, count(*) FILTER (sym = 'P') AS pat_score FROM seq GROUP BY ALL)
SELECT *, CASE WHEN mat_score > pat_score THEN 'M' WHEN mat_score < pat_score THEN 'P' ELSE 'U' END AS cluster FROM s""")
def cell_clusters(spark, d):
    """Similarity to both haplotypes and the cluster of each cell."""
    return phasing.clusters(_seq(spark, d))


_CLU_SQL = f"{_SEQ_SQL}, clu AS (SELECT contig, cell_id, CASE WHEN count(*) FILTER (sym = 'M') > count(*) FILTER (sym = 'P') THEN 'M' WHEN count(*) FILTER (sym = 'M') < count(*) FILTER (sym = 'P') THEN 'P' ELSE 'U' END AS cluster FROM seq GROUP BY contig, cell_id)"


@_query(f"""WITH {_CLU_SQL}, j AS (SELECT s.*, c.cluster FROM seq s JOIN clu c USING (contig, cell_id) WHERE c.cluster <> 'U'), m AS (SELECT contig, count(DISTINCT idx) AS markers FROM seq GROUP BY contig),
g AS (SELECT contig, coalesce(cluster, 'P&M') AS cluster, count(DISTINCT cell_id) AS cells, count(*) FILTER (sym <> 'u') AS covered, count(*) FILTER (sym <> 'u' AND sym <> j.cluster) AS confusing FROM j GROUP BY GROUPING SETS ((contig, j.cluster), (contig)))
SELECT g.contig, g.cluster, markers, cells, covered, confusing, round(covered / markers, 9) AS covered_share FROM g JOIN m USING (contig)""")
def cluster_statistics(spark, d):
    """Coverage of both clusters and of both together."""
    s = _seq(spark, d)
    return phasing.cluster_statistics(s, phasing.clusters(s)).withColumn("covered_share", F.round("covered_share", 9))


@_query(f"""WITH {_CLU_SQL} SELECT s.contig, s.idx, count(*) FILTER (c.cluster = 'P' AND sym = 'P') AS p_in_p, count(*) FILTER (c.cluster = 'P' AND sym = 'M') AS m_in_p, count(*) FILTER (c.cluster = 'P' AND sym = 'u') AS u_in_p,
count(*) FILTER (c.cluster = 'M' AND sym = 'P') AS p_in_m, count(*) FILTER (c.cluster = 'M' AND sym = 'M') AS m_in_m, count(*) FILTER (c.cluster = 'M' AND sym = 'u') AS u_in_m FROM seq s JOIN clu c USING (contig, cell_id) GROUP BY s.contig, s.idx""")
def cluster_counts(spark, d):
    """A5: symbols by site and cluster."""
    s = _seq(spark, d)
    return phasing.cluster_counts(s, phasing.clusters(s))


@_query(f"""WITH {_SEQ_SQL} SELECT contig, cell_id, string_agg(sym, '' ORDER BY idx) AS pattern FROM seq GROUP BY contig, cell_id""")
def packed_patterns(spark, d):
    """Symbols of a cell joined in order."""
    return sequences.packed(_seq(spark, d), keys=["contig", "cell_id"], order="idx")


@_query(f"""WITH {_SEQ_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY contig, cell_id ORDER BY idx) - row_number() OVER (PARTITION BY contig, cell_id, sym ORDER BY idx) AS g, min(idx) OVER (PARTITION BY contig, cell_id) AS f FROM seq),
x AS (SELECT contig, cell_id, sym, count(*) AS length, min(idx) AS s FROM r GROUP BY contig, cell_id, sym, g) SELECT contig, cell_id, row_number() OVER (PARTITION BY contig, cell_id ORDER BY s) AS run, sym, length FROM x""")
def run_lengths(spark, d):
    """Runs of equal neighbours."""
    return sequences.run_lengths(_seq(spark, d), keys=["contig", "cell_id"], order="idx", value="sym").withColumn("run", F.col("run").cast("long"))


@_query(f"""WITH {_SEQ_SQL}, n AS (SELECT contig, cell_id, idx, sym, lead(sym) OVER (PARTITION BY contig, cell_id ORDER BY idx) AS next_sym, lead(pos) OVER (PARTITION BY contig, cell_id ORDER BY idx) AS next_pos FROM seq) SELECT * FROM n WHERE sym <> next_sym""")
def adjacent_pairs(spark, d):
    """Neighbours that differ."""
    return sequences.adjacent_pairs(_seq(spark, d), keys=["contig", "cell_id"], order="idx", columns=["sym", "pos"], different="sym").drop("pos")


@_query(f"""WITH {_SEQ_SQL}, x AS (SELECT contig, cell_id, count(*) FILTER (sym <> 'u') AS n, arg_min(sym, idx) FILTER (sym <> 'u') AS first, arg_max(sym, idx) FILTER (sym <> 'u') AS last FROM seq GROUP BY contig, cell_id) SELECT * FROM x""")
def informative_ends(spark, d):
    """The outermost known symbols of each sequence."""
    return sequences.ends(_seq(spark, d), keys=["contig", "cell_id"])


def _calls_sql(cluster: str, least: float) -> str:
    """Accepted switches of each cell, by its cluster as ``cluster`` says and the least score."""
    return f"""{_CLU_SQL}, c AS (SELECT contig, cell_id, idx, sum((sym = 'P')::INT) OVER u AS pl, sum((sym = 'M')::INT) OVER u AS ml, sum((sym = 'P')::INT) OVER w AS pt, sum((sym = 'M')::INT) OVER w AS mt FROM seq
WINDOW u AS (PARTITION BY contig, cell_id ORDER BY idx ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY contig, cell_id)),
s AS (SELECT *, pl / (pl + ml) * ((mt - ml) / (pt + mt - pl - ml)) AS pm, ml / (pl + ml) * ((pt - pl) / (pt + mt - pl - ml)) AS mp FROM c WHERE pl + ml > 0 AND pt + mt > pl + ml),
r AS (SELECT *, row_number() OVER (PARTITION BY contig, cell_id ORDER BY greatest(pm, mp) DESC, idx DESC) AS k FROM s),
cp AS (SELECT contig, cell_id, idx AS split, greatest(pm, mp) AS score, CASE WHEN pm >= mp THEN 'PM' ELSE 'MP' END AS call, pl AS left_p, ml AS left_m, pt - pl AS right_p, mt - ml AS right_m FROM r WHERE k = 1),
en AS (SELECT contig, cell_id, count(*) FILTER (sym <> 'u') AS n, arg_min(sym, idx) FILTER (sym <> 'u') AS first, arg_max(sym, idx) FILTER (sym <> 'u') AS last FROM seq GROUP BY contig, cell_id),
b AS (SELECT en.*, cp.* EXCLUDE (contig, cell_id), {cluster} AS cc FROM en LEFT JOIN cp USING (contig, cell_id) JOIN clu USING (contig, cell_id)),
o AS (SELECT *, CASE WHEN cc = 'M' THEN 'P' ELSE 'M' END AS other FROM b),
e AS (SELECT *, CASE WHEN substr(call, 1, 1) = other THEN first = other ELSE last = other END AS differs, CASE WHEN substr(call, 1, 1) = other THEN CASE WHEN other = 'P' THEN left_p ELSE left_m END ELSE CASE WHEN other = 'P' THEN right_p ELSE right_m END END AS held FROM o),
f AS (SELECT *, n > 1 AND coalesce((n < 10 AND score > 0 AND differs AND held > 0 AND held >= n / 3.0) OR (n > 10 AND score >= {least} AND differs AND held >= 5), false) AS switch FROM e),
calls AS (SELECT contig, cell_id, CASE WHEN n = 0 THEN 'UU' WHEN n = 1 THEN first || first WHEN switch THEN call ELSE cc || cc END AS call, CASE WHEN switch THEN split END AS split FROM f)"""


@_query(f"""WITH {_calls_sql("clu.cluster", 0.64)}, g AS (SELECT contig, cell_id, unnest(['left-sequence', 'CO-info', 'right-sequence']) AS kind, unnest([substr(call, 1, 1), CASE WHEN substr(call, 1, 1) <> substr(call, 2, 1) THEN 'R' ELSE '|' END, substr(call, 2, 1)]) AS sym FROM calls)
SELECT contig, kind, string_agg(sym, '' ORDER BY cell_id) AS pattern FROM g GROUP BY contig, kind""")
def gate_patterns(spark, d):
    """Accepted switches and the gates of each contig."""
    s = _seq(spark, d)
    return sequences.gates(sequences.accepted_breaks(s, phasing.clusters(s)))


@_query(f"""WITH {_calls_sql("CASE WHEN clu.cluster = 'P' THEN 'P' ELSE 'M' END", 0.3)}, j AS (SELECT contig, cell_id, calls.split, max(seq.pos) FILTER (idx <= calls.split) AS left_pos, min(seq.pos) FILTER (idx > calls.split) AS right_pos FROM calls JOIN seq USING (contig, cell_id) WHERE calls.split IS NOT NULL AND sym <> 'u' GROUP BY contig, cell_id, calls.split)
SELECT *, right_pos - left_pos + 1 AS size FROM j""")
def switch_intervals(spark, d):
    """W3c: accepted switches between their nearest known markers."""
    s = _seq(spark, d)
    return sequences.widened(sequences.accepted_breaks(s, phasing.clusters(s).withColumn("cluster", F.when(F.col("cluster") == "P", "P").otherwise("M")), min_score=0.3), s)


_GAP_SQL = """m AS (SELECT DISTINCT o_custkey AS contig, o_orderkey AS pos FROM orders), z AS (SELECT c_custkey AS contig, (SELECT max(o_orderkey) + 50 FROM orders) AS size FROM customer),
g AS (SELECT m.contig, pos, size, lag(pos) OVER w AS p, lead(pos) OVER w AS q FROM m LEFT JOIN z USING (contig) WINDOW w AS (PARTITION BY m.contig ORDER BY pos)),
own AS (SELECT contig, p AS start, pos AS "end" FROM g WHERE pos - p >= 100 UNION ALL SELECT contig, 1, pos FROM g WHERE p IS NULL AND pos - 1 >= 100 UNION ALL SELECT contig, pos, size FROM g WHERE q IS NULL AND size - pos >= 100),
gaps AS (SELECT * FROM own UNION ALL SELECT contig, 1, size FROM z WHERE contig NOT IN (SELECT contig FROM own))"""


def _gaps(spark, d):
    o = _t(spark, d, "orders")
    top = o.agg((F.max("o_orderkey") + 50).alias("size"))
    sizes = _t(spark, d, "customer").select(F.col("c_custkey").alias("contig")).join(F.broadcast(top))  # one row
    return sequences.gap_regions(o.select(F.col("o_custkey").alias("contig"), F.col("o_orderkey").alias("pos")), sizes, min_gap=100)


@_query(f"""WITH {_GAP_SQL} SELECT * FROM gaps""")
def gap_regions(spark, d):
    """Stretches without markers."""
    return _gaps(spark, d)


@_query(f"""WITH {_GAP_SQL}, d AS (SELECT o_custkey AS contig, o_orderkey AS pos, CAST(floor(o_totalprice / 1000) AS BIGINT) AS depth FROM orders),
r AS (SELECT contig, start, "end", CAST(coalesce(floor(sum(depth) / count(depth)), 0) AS BIGINT) AS depth FROM gaps LEFT JOIN d USING (contig) WHERE true AND (d.pos IS NULL OR d.pos > start AND d.pos <= "end") GROUP BY ALL),
a AS (SELECT g.contig, g.start, g."end", coalesce(r.depth, 0) AS depth FROM gaps g LEFT JOIN r ON g.contig = r.contig AND g.start = r.start AND g."end" = r."end")
SELECT *, CASE WHEN depth <= 200 THEN 'hap_high' WHEN depth <= 250 THEN 'hap_low' WHEN depth <= 300 THEN 'hom_low' ELSE 'hom_high' END AS klass FROM a""")
def region_depth_classes(spark, d):
    """Regions without markers, their mean depth and class."""
    depth = _t(spark, d, "orders").select(F.col("o_custkey").alias("contig"), F.col("o_orderkey").alias("pos"), F.floor(F.col("o_totalprice") / 1000).alias("depth"))
    return intervals.region_depth(depth, _gaps(spark, d)).withColumn("klass", X.depth_class("depth"))


@_query(f"""WITH {_GAP_SQL}, r AS (SELECT o_custkey AS contig, o_orderkey - 30 AS rs, o_orderkey + 30 AS re FROM orders)
SELECT DISTINCT g.contig, g.start, g."end", r.rs AS rstart, r.re AS rend, least(g."end", r.re) - greatest(g.start, r.rs) + 1 AS overlap FROM gaps g JOIN r ON g.contig = r.contig AND r.re >= g.start AND r.rs <= g."end" WHERE least(g."end", r.re) - greatest(g.start, r.rs) + 1 >= 20""")
def interval_overlaps(spark, d):
    """Intervals that share 20 places or more."""
    r = _t(spark, d, "orders").select(F.col("o_custkey").alias("contig"), (F.col("o_orderkey") - 30).alias("rstart"), (F.col("o_orderkey") + 30).alias("rend"))
    return intervals.overlap_join(_gaps(spark, d), r, least=20, width=1000)


@_query(f"""WITH {_GAP_SQL}, p AS (SELECT o_custkey AS contig, o_orderkey AS pos FROM orders) SELECT g.contig, p.pos, g.start, g."end" FROM gaps g JOIN p ON g.contig = p.contig AND p.pos BETWEEN g.start AND g."end" """)
def points_in_intervals(spark, d):
    """Points with the intervals that hold them."""
    p = _t(spark, d, "orders").select(F.col("o_custkey").alias("contig"), F.col("o_orderkey").alias("pos"))
    return intervals.point_join(p, _gaps(spark, d), width=1000)


@_query(f"""WITH {_GAP_SQL}, r AS (SELECT o_custkey AS contig, o_orderkey - 30 AS rs, o_orderkey + 30 AS re FROM orders)
SELECT g.contig, g.start, g."end", count(r.rs) AS count FROM (SELECT DISTINCT * FROM gaps) g LEFT JOIN r ON g.contig = r.contig AND r.re >= g.start AND r.rs <= g."end" GROUP BY ALL""")
def interval_counts(spark, d):
    """Reads that touch each region."""
    r = _t(spark, d, "orders").select(F.col("o_custkey").alias("contig"), (F.col("o_orderkey") - 30).alias("rstart"), (F.col("o_orderkey") + 30).alias("rend"))
    return intervals.region_counts(r, _gaps(spark, d))


@_query("""SELECT o_orderkey AS pos, CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey < 300 THEN 'sA' ELSE 'sB' END ELSE CAST(o_custkey AS VARCHAR) END AS contig FROM orders""")
def broken_contigs(spark, d):
    """Names split at a break."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("contig"), F.col("o_orderkey").alias("pos"))
    breaks = _t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("contig"), F.lit(300).alias("break_pos"))
    return intervals.broken_points(o, breaks).select("pos", "contig")


@_query("""SELECT o_orderkey AS start, o_orderkey + 40 AS "end", CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey % 3 > 0 THEN '' WHEN least(o_orderkey + 40, 299) - o_orderkey + 1 >= o_orderkey + 40 - greatest(o_orderkey, 300) + 1 THEN 'sA' ELSE 'sB' END AS contig FROM orders""")
def broken_interval_contigs(spark, d):
    """Names of intervals split at a break, by the larger part."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("contig"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 40).alias("end"))
    breaks = _t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("contig"), F.lit(300).alias("break_pos"))
    return intervals.broken_intervals(o, breaks).select("start", "end", "contig")


@_query("""SELECT substr(c_name, 1, 16) AS barcode, count(*) AS reads FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def barcode_histogram(spark, d):
    """A1: reads by their first letters."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).join(_t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    return cells.barcode_histogram(o, sequence="c_name")


@_query("""WITH h AS (SELECT o_custkey AS b, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS barcodes, CAST(sum(n) AS BIGINT) AS reads, count(*) FILTER (n >= 12) AS good_barcodes, CAST(coalesce(sum(n) FILTER (n >= 12), 0) AS BIGINT) AS good_reads FROM h""")
def barcode_totals(spark, d):
    """Totals of all barcodes and of those over the cutoff."""
    h = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("barcode")).agg(F.count(F.lit(1)).alias("reads"))
    return cells.histogram_totals(h, 12)


@_query("""WITH g AS (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 600), r AS (SELECT CAST(l_suppkey AS VARCHAR) AS barcode, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM g))
SELECT barcode, CAST((k - 1) // 100 + 1 AS INTEGER) AS part, count(*) AS reads FROM r GROUP BY 1, 2""")
def barcode_parts(spark, d):
    """Reads of good barcodes in parts of bounded size."""
    li = _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("sequence"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("o"))
    good = cells.good_reads(li, length=20, cutoff=600)
    return cells.numbered_parts(good, keys=["barcode"], order="o", size=100).groupBy("barcode", "part").agg(F.count(F.lit(1)).alias("reads"))


@_query(f"""{_PAIR_SQL}, s AS (SELECT contig, a, b, sum(CASE WHEN x = y AND x <> 'U' THEN 2 WHEN x <> 'U' AND y <> 'U' THEN -1 ELSE 0 END) AS pts, count(*) FILTER (x <> 'U' AND y <> 'U') AS eff, count(*) AS n, count(*) FILTER (x = 'P') AS p, count(*) FILTER (x = 'M') AS m, count(*) FILTER (y <> 'U') AS k FROM sy GROUP BY ALL)
SELECT contig, CAST(round(pts / greatest(eff, 1) * n) AS BIGINT) AS scaled, CAST(round(pts / greatest(CASE WHEN (CASE WHEN p = 0 THEN m ELSE p END) > k AND k >= n // 4 THEN k ELSE (CASE WHEN p = 0 THEN m ELSE p END) END, 1) * n) AS BIGINT) AS own FROM s""")
def pattern_scores(spark, d):
    """Match scores of two patterns, both ways."""
    return _pairs(spark, d).select("contig", X.match_score("a", "b").alias("scaled"), X.match_score("a", "b", scale=False).alias("own"))


@_query(f"""{_PAIR_SQL}, s AS (SELECT contig, count(*) FILTER (x = y AND x <> 'U') AS nr, count(*) AS n FROM sy GROUP BY contig), r AS (SELECT contig, n, nr, n - nr AS r FROM s)
SELECT contig, round(CASE WHEN r = 0 OR nr = 0 THEN 0 ELSE r * log10(r / n) + nr * log10(nr / n) END + n * log10(2), 6) AS lod FROM r""")
def lod_scores(spark, d):
    """Odds of linkage of two patterns."""
    return _pairs(spark, d).select("contig", F.round(X.lod_score("a", "b"), 6).alias("lod"))


@_query(f"""{_PAIR_SQL} SELECT contig, round(count(*) FILTER (x <> 'U' AND y <> 'U' AND x <> y) * 100.0 / nullif(count(*) FILTER (x <> 'U' AND y <> 'U'), 0), 6) AS percent FROM sy GROUP BY contig""")
def recombination_percents(spark, d):
    """Share of known places that differ."""
    return _pairs(spark, d).select("contig", F.round(X.recombination_percent("a", "b"), 6).alias("percent"))


@_query(f"""{_PAIR_SQL} SELECT contig, CAST(count(*) FILTER (x = y) AS INTEGER) AS score, CAST(count(*) FILTER (x || y IN ('PM', 'MP')) AS INTEGER) AS mismatch, CAST(count(*) FILTER (x <> 'U' AND y <> 'U') AS INTEGER) AS both,
string_agg(CASE WHEN x || y IN ('PP', 'MM') THEN '+' WHEN x || y IN ('PM', 'MP') THEN '-' WHEN x || y = 'UU' THEN '|' ELSE '*' END, '' ORDER BY i) AS visual FROM sy GROUP BY contig""")
def genotype_differences(spark, d):
    """How two patterns differ."""
    return _pairs(spark, d).select("contig", X.genotype_difference("a", "b").alias("d")).select("contig", "d.*")


@_query(f"""{_PAIR_SQL} SELECT contig, CAST(count(*) FILTER (x || y = 'MM') AS INTEGER) AS mm, CAST(count(*) FILTER (x || y = 'PP') AS INTEGER) AS pp, CAST(count(*) FILTER (x || y = 'PM') AS INTEGER) AS pm, CAST(count(*) FILTER (x || y = 'MP') AS INTEGER) AS mp, CAST(count(*) FILTER (x || y NOT IN ('MM', 'PP', 'PM', 'MP')) AS INTEGER) AS ot FROM sy GROUP BY contig""")
def match_reports(spark, d):
    """Places of two patterns by kind."""
    return _pairs(spark, d).select("contig", X.match_report("a", "b").alias("m")).select("contig", "m.*")


@_query(f"""WITH {_PAT_SQL} SELECT contig, translate(replace(pattern, 'U', 'u'), 'PM', 'MP') AS flipped, translate(pattern, 'PM', 'MP') AS swapped, CAST(length(pattern) - length(replace(pattern, 'P', '')) AS INTEGER) AS ps, replace(pattern, 'U', '') AS known FROM pat""")
def flipped_patterns(spark, d):
    """P and M changed over; letters counted and taken out."""
    return _patterns(spark, d).select("contig", X.flip("pattern").alias("flipped"), X.flip_strict("pattern").alias("swapped"), X.count_of("pattern", "P").alias("ps"), X.without("pattern", "U").alias("known"))


@_query("""SELECT l_orderkey, l_linenumber, CAST(round(l_quantity / (l_partkey + 1) * 1000.0 / nullif(2 * l_suppkey, 0) * 1000000.0) AS BIGINT) AS rpkm, CAST(round(l_quantity / nullif(2 * l_suppkey, 0) * 1000000.0) AS BIGINT) AS cpm,
substr('0123456789abcdefghij', CAST(CASE WHEN l_partkey < 10 THEN l_partkey ELSE least(19, 9 + l_partkey // 10) END AS INTEGER) + 1, 1) AS code, CASE WHEN l_partkey <= 200 THEN 'hap_high' WHEN l_partkey <= 250 THEN 'hap_low' WHEN l_partkey <= 300 THEN 'hom_low' ELSE 'hom_high' END AS klass FROM lineitem""")
def normalised_counts(spark, d):
    """Counts by length and reads, depth codes and classes."""
    li = _t(spark, d, "lineitem").withColumns({"_s": F.lit(0), "_c": F.col("l_quantity")})
    return li.select("l_orderkey", "l_linenumber", X.reads_per_kilobase("_c", "_s", "l_partkey", "l_suppkey").alias("rpkm"), X.counts_per_million("_c", "l_suppkey").alias("cpm"), X.depth_code("l_partkey").alias("code"), X.depth_class("l_partkey").alias("klass"))


@_query("""WITH c AS (SELECT l_partkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, string_agg(substr('0123456789abcdefghij', CAST(CASE WHEN q < 10 THEN q ELSE least(19, 9 + q // 10) END AS INTEGER) + 1, 1), '' ORDER BY l_suppkey) AS codes, count(*) FILTER (q > 10) AS support, count(*) AS cells FROM c GROUP BY 1""")
def presence_patterns(spark, d):
    """Depth codes of all cells of a region, and its support."""
    c = _t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("rpkm"))
    out = cells.presence_patterns(c, keys=["l_partkey"], cell="l_suppkey")
    n = c.groupBy("l_partkey").agg(F.count_if(F.col("rpkm") > 10).alias("support"))
    return out.drop("support").join(n, "l_partkey")


@_query("""WITH a AS (SELECT l_orderkey AS rid, l_returnflag AS sym FROM lineitem), n AS (SELECT rid, count(*) FILTER (sym = 'A') AS p, count(*) FILTER (sym = 'R') AS m FROM a GROUP BY rid) SELECT rid, p, m, CASE WHEN p > m THEN 'P' WHEN m > p THEN 'M' WHEN p > 0 THEN 'tie' ELSE 'U' END AS geno FROM n""")
def read_majority(spark, d):
    """The symbol that a read has more often."""
    sym = F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "M").otherwise("u")
    out = reads.majority(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("rid"), sym.alias("sym")), read="rid")
    return out.withColumn("geno", F.when((F.col("p") == F.col("m")) & (F.col("p") > 0), "tie").otherwise(F.col("geno")))


@_query("""WITH o AS (SELECT l_orderkey AS read_id, l_linestatus AS geno, l_returnflag, l_quantity AS overlap FROM lineitem), n AS (SELECT read_id, coalesce(sum(overlap) FILTER (l_returnflag <> 'N' AND geno = 'F'), 0) AS p, coalesce(sum(overlap) FILTER (l_returnflag <> 'N' AND geno = 'O'), 0) AS m FROM o GROUP BY 1)
SELECT read_id, CASE WHEN p > m THEN 'P' WHEN m > p THEN 'M' ELSE 'U' END AS geno FROM n""")
def overlap_genotypes(spark, d):
    """The genotype with the larger overlap."""
    li = _t(spark, d, "lineitem")
    return intervals.region_genotype(li.select(F.col("l_orderkey").alias("read_id"), F.when(F.col("l_returnflag") != "N", "hap_low").otherwise("hom_high").alias("klass"), F.when(F.col("l_linestatus") == "F", "P").otherwise("M").alias("geno"), F.col("l_quantity").alias("overlap")))


@_query("""WITH r AS (SELECT o_orderstatus AS route, o_custkey AS qname, o_orderkey % 97 + 1 AS span FROM orders) SELECT route, count(*) AS alignments, count(DISTINCT qname) AS reads, CAST(sum(span) AS BIGINT) AS bases FROM r GROUP BY route""")
def route_totals(spark, d):
    """Alignments, reads and bases by route."""
    return reads.route_totals(_routes(spark, d))


def _routes(spark, d):
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("aln_id"), F.col("o_custkey").alias("qname"), (F.col("o_orderkey") % 97 + 1).alias("span"), F.array("o_orderstatus").alias("routes"))


@_query("""WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS route, o_custkey AS qname, o_orderkey % 97 + 1 AS span FROM orders) SELECT qname, string_agg(route || ':' || CAST(span AS VARCHAR), ';' ORDER BY id) AS listing, count(*) AS alignments, arg_max(route, (span, -id)) AS best FROM r GROUP BY qname""")
def best_routes(spark, d):
    """All routes of a read and the longest."""
    return reads.best_route(_routes(spark, d))


@_query("""SELECT count(DISTINCT qname) AS reads, CAST(coalesce(sum(span), 0) AS BIGINT) AS bases FROM (SELECT o_custkey AS qname, o_orderkey % 97 + 1 AS span FROM orders WHERE o_orderstatus = 'F') WHERE qname IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def shared_reads(spark, d):
    """Reads of two routes."""
    r = _routes(spark, d).withColumn("route", F.get("routes", F.lit(0)))
    return reads.shared_reads(r.where("route = 'F'"), r.where("route = 'O'"))


@_query("""WITH v AS (SELECT o_custkey AS contig, o_orderpriority AS map_file, count(*) AS votes, max(o_orderkey % 50) AS score FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY votes DESC, score DESC, map_file) AS k FROM v) SELECT contig, map_file, votes, score FROM r WHERE k = 1""")
def group_votes(spark, d):
    """The map that most markers of a contig chose."""
    return maps.group_votes(_t(spark, d, "orders").select(F.col("o_custkey").alias("contig"), F.col("o_orderpriority").alias("map_file"), (F.col("o_orderkey") % 50).alias("score")))


@_query("""WITH r AS (SELECT o_custkey, o_orderkey AS marker, o_orderkey % 50 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 50 DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, marker, score FROM r WHERE k = 1""")
def best_markers(spark, d):
    """The first row of the highest score."""
    o = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("marker"), (F.col("o_orderkey") % 50).alias("score"))
    return maps.best_marker(o, keys=["o_custkey"])


@_query("""WITH n AS (SELECT o_custkey % 20 AS phase_group, s_nationkey AS map_group, count(DISTINCT o_orderkey) AS shared FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY phase_group ORDER BY shared DESC, map_group) AS r FROM n), c AS (SELECT *, row_number() OVER (PARTITION BY map_group ORDER BY phase_group) AS q FROM b WHERE r = 1) SELECT phase_group, map_group, shared FROM c WHERE q = 1""")
def matched_groups(spark, d):
    """Phase groups and map groups, one to one."""
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 20).alias("phase_group"), F.col("o_orderkey").alias("contig"))
    m = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("contig"), F.col("l_suppkey").alias("s_suppkey")).join(_t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("map_group")), "s_suppkey").select("contig", "map_group")
    return maps.matched_groups(o, m)


@_query("""WITH r AS (SELECT o_custkey AS query, o_orderstatus || substr(o_orderpriority, 1, 1) AS subject, min(o_orderkey) AS f FROM orders WHERE o_totalprice >= 30 GROUP BY 1, 2), k AS (SELECT query, subject, row_number() OVER (PARTITION BY query ORDER BY f, subject) AS rank FROM r) SELECT query, subject, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def top_hits(spark, d):
    """First ten subjects of each query."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("query"), F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("subject"), F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("length"))
    return cells.top_hits(o).withColumn("query", F.col("query").cast("long"))


_LETTERS, _BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


@_query(f"""WITH s AS (SELECT translate(upper(p_name), '{_LETTERS}', '{_BASES}') AS s FROM part), k AS (SELECT substr(s, i, 5) AS w FROM s, range(1, 80) t(i) WHERE i <= length(s) - 4), c AS (SELECT least(w, translate(reverse(w), 'ACGT', 'TGCA')) AS kmer FROM k WHERE regexp_full_match(w, '[ACGT]+')) SELECT kmer, count(*) AS n FROM c GROUP BY kmer""")
def kmer_counts(spark, d):
    """Canonical k-mers, each with its reverse complement."""
    p = _t(spark, d, "part").select(F.translate(F.upper("p_name"), _LETTERS, _BASES).alias("sequence"))
    return cells.kmers(p, k=5)


@_query(f"""WITH s AS (SELECT translate(upper(p_name), '{_LETTERS}', '{_BASES}') AS s FROM part), k AS (SELECT substr(s, i, 5) AS w FROM s, range(1, 80) t(i) WHERE i <= length(s) - 4), c AS (SELECT w, count(*) AS n FROM k WHERE regexp_full_match(w, '[ACGT]+') GROUP BY w) SELECT n, count(*) AS kmers FROM c GROUP BY n""")
def kmer_spectrum(spark, d):
    """How many k-mers occur how often."""
    p = _t(spark, d, "part").select(F.translate(F.upper("p_name"), _LETTERS, _BASES).alias("sequence"))
    return cells.kmer_spectrum(cells.kmers(p, k=5, canonical=False))


@_query("""SELECT CAST(ceil(o_totalprice / 500) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1""")
def histogram(spark, d):
    """A histogram whose bins hold their right ends."""
    return cells.binned(_t(spark, d, "orders"), "o_totalprice", 500.0)


@_query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_partkey BETWEEN 60 AND 140 AND l_partkey / nullif(l_discount * 10, 0) BETWEEN 120 AND 280 AND l_discount * 10 BETWEEN 0.38 AND 0.62""")
def quality_filter(spark, d):
    """Markers of good quality, coverage and frequency."""
    li = _t(spark, d, "lineitem").withColumns({"qual": F.col("l_quantity") * 10, "alt_cov": F.col("l_partkey"), "af": F.col("l_discount") * 10})
    return cells.quality_markers(li).select("l_orderkey", "l_linenumber")


@_query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 4 = 0)""")
def missing_counts(spark, d):
    """Rows without a count."""
    return cells.missing_counts(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey")), keys=["c_custkey"])


@_query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE k = 1""")
def first_rows(spark, d):
    """The first row of each key."""
    return intervals.first_of(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


_AC_SQL = "ac AS (SELECT user_id % 5 AS cell_id, event_id AS pos, (CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS count_a, (CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE 0 END) AS count_b FROM events WHERE event_type <> 'error'), sm AS (SELECT *, count_a / (count_a + count_b) AS af FROM ac), s1 AS (SELECT *, coalesce(sum(CASE WHEN af > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) + coalesce(sum(CASE WHEN af > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS near, count(*) OVER (PARTITION BY cell_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - 1 AS n FROM sm), s2 AS (SELECT cell_id, pos, count_a, count_b, af, CASE WHEN near / nullif(n, 0) > 0.7 THEN 1.0 WHEN near / nullif(n, 0) < 0.3 THEN 0.0 ELSE af END AS smooth FROM s1)"


def _alleles(spark, d):
    e = _t(spark, d, "events").where("event_type <> 'error'")
    return e.select((F.col("user_id") % 5).alias("cell_id"), F.col("event_id").alias("pos"), F.col("event_type").isin("click", "purchase").cast("int").alias("count_a"), F.col("event_type").isin("view", "signup").cast("int").alias("count_b"))


@_query(f"WITH {_AC_SQL} SELECT cell_id, pos, count_a, count_b, CAST(af AS DOUBLE) AS af, CAST(smooth AS DOUBLE) AS smooth FROM s2")
def smoothed_counts(spark, d):
    """Allele shares smoothed by their neighbours."""
    return recombination.smoothed(_alleles(spark, d), keys=["cell_id"], second_pass=False)


@_query(f"""WITH {_AC_SQL}, c AS (SELECT *, CASE WHEN lag(smooth) OVER (PARTITION BY cell_id ORDER BY pos) = smooth THEN 0 ELSE 1 END AS c FROM s2), b AS (SELECT *, sum(c) OVER (PARTITION BY cell_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM c)
SELECT cell_id, CAST(block AS BIGINT) AS block, min(pos) AS start, max(pos) AS "end", count(*) AS markers, CAST(CASE WHEN min(smooth) >= 0.8 THEN 1 WHEN min(smooth) <= 0.2 THEN 0 ELSE -1 END AS INTEGER) AS genotype FROM b GROUP BY cell_id, block""")
def genotype_blocks(spark, d):
    """Runs of one smoothed value."""
    return recombination.blocks(recombination.smoothed(_alleles(spark, d), keys=["cell_id"], second_pass=False), keys=["cell_id"]).withColumn("block", F.col("block").cast("long"))


@_query()
def refined_crossovers(spark, d):
    """Both passes, breakpoints, and their best split."""
    s = checkpoint(recombination.smoothed(_alleles(spark, d), keys=["cell_id"]))  # a fold, read for the blocks and for their edges
    points = recombination.breakpoints(recombination.blocks(s, keys=["cell_id"]).where("markers >= 3"), keys=["cell_id"])
    return recombination.refined_breakpoints(points, s, keys=["cell_id"])


@_query()
def phased_haplotypes(spark, d):
    """Markers, calls, phase and clusters, end to end."""
    counts = _t(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("contig"), ((F.col("event_id") % 40) * 10).alias("pos"), F.col("user_id").alias("cell_id"), "event_type")
    one = lambda kinds: F.count_if(F.col("event_type").isin(*kinds))
    zero = F.lit(0)
    counts = counts.groupBy("contig", "pos", "cell_id").agg(one(["click", "purchase"]).alias("A"), one(["view", "signup"]).alias("C")).withColumns({"G": zero, "T": zero, "-": zero, "N": zero})
    markers = counts.select("contig", "pos").distinct().withColumns({"ref": F.lit("A"), "alt": F.lit("C")})
    sizes = markers.groupBy("contig").agg((F.max("pos") + 100).alias("size"))
    return chains.phase_markers(markers, counts.select("cell_id").distinct(), counts, sizes).haplotypes


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
