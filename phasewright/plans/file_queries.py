"""Registered queries of sources and sinks: tables are written as text, read back, and given as they were read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import reads
from ..operators.lineage import shared_folder
from ..sources import readers, writers
from .map_queries import _to_complete
from .more_queries import _whole_gmap
from .queries import _query, _t


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _text(spark: SparkSession, rows: DataFrame, *columns) -> str:
    """A folder of tab-separated lines of the columns."""
    path = _folder(spark)
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]).alias("value")).write.text(path)
    return path


@_query("""SELECT '@' || c_name AS name, translate(c_mktsegment, 'BUIDNO', 'ACGTAC') AS sequence, repeat('I', length(c_mktsegment)) AS quality FROM customer""")
def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    """Reads written as FASTQ and read by splits."""
    path = _folder(spark)
    rows = _t(spark, d, "customer").select(F.concat(F.lit("@"), "c_name").alias("name"), F.translate("c_mktsegment", "BUIDNO", "ACGTAC").alias("sequence"), F.expr("repeat('I', length(c_mktsegment))").alias("quality"))
    rows.select(writers.fastq_text().alias("value")).write.text(path)
    return readers.fastq(spark, path).select("name", "sequence", "quality")


@_query("""SELECT 'k' || CAST(o_orderkey AS VARCHAR) AS id, translate(upper(o_orderpriority), 'URGENTHIMDLOW-PCF1234 5', 'ACGTACGTACGTACGTACGTACG') AS sequence, o_orderstatus AS route FROM orders""")
def fasta_by_route(spark: SparkSession, d: str) -> DataFrame:
    """Sequences written in a folder for each route, and read with their folders."""
    path = _folder(spark)
    bases = F.translate(F.upper("o_orderpriority"), "URGENTHIMDLOW-PCF1234 5", "ACGTACGTACGTACGTACGTACG")
    rows = _t(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("id"), bases.alias("sequence"), F.col("o_orderstatus").alias("route"))
    writers.write_fasta(rows, path, by=["route"])
    found = [r[0] for r in rows.select("route").distinct().collect()]  # three
    read = [readers.fasta(spark, f"{path}/route={r}").withColumn("route", F.lit(r)) for r in sorted(found)]
    out = read[0]
    for more in read[1:]:
        out = out.unionByName(more)
    return out


@_query("""WITH s AS (SELECT o_orderkey // 2 AS contig, o_orderkey % 10 AS g, o_orderkey AS k, o_orderkey % 3 = 0 AS rev, translate(upper(o_orderpriority), 'URGENTHIMDLOW-PCF1234 5', 'ACGTACGTACGTACGTACGTACG') AS b FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS n FROM s), c AS (SELECT g, n, CASE WHEN rev THEN translate(reverse(lower(b)), 'acgt', 'TGCA') ELSE b END AS bases FROM r)
SELECT g AS "group", CAST(n AS INTEGER) AS rank, 2 AS piece, bases FROM c UNION ALL SELECT g, CAST(n AS INTEGER), i, repeat('N', 80) FROM c, (SELECT unnest([0, 1]) AS i) WHERE n > 1""")
def scaffold_lines(spark: SparkSession, d: str) -> DataFrame:
    """Contigs of a map in order, turned where they lie so, with lines of N between them."""
    o = _t(spark, d, "orders").select("o_orderkey", F.translate(F.upper("o_orderpriority"), "URGENTHIMDLOW-PCF1234 5", "ACGTACGTACGTACGTACGTACG").alias("bases"))
    contig = F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))
    rank = F.row_number().over(W.partitionBy(F.col("o_orderkey") % 10).orderBy("o_orderkey"))
    pairs = o.select((F.col("o_orderkey") % 10).alias("group"), rank.alias("rank"), contig.alias("contig"), (F.col("o_orderkey") % 3 == 0).alias("reverse"))
    chunks = reads.scaffold_chunks(pairs, o.select(contig.alias("id"), F.lit(0).cast("long").alias("start"), "bases"))
    low = F.lit(-(2**63)).cast("long")
    piece = F.when(F.col("part") == low, 0).when(F.col("part") == low + 1, 1).otherwise(2)
    return chunks.select("group", "rank", piece.alias("piece"), "bases")


@_query("""SELECT CAST(l_orderkey AS VARCHAR) AS contig, CAST(l_linenumber AS BIGINT) AS pos, l_returnflag AS ref, l_linestatus AS alt, CAST(l_quantity AS DOUBLE) AS qual FROM lineitem""")
def read_markers(spark: SparkSession, d: str) -> DataFrame:
    """Lines of markers."""
    path = _text(spark, _t(spark, d, "lineitem"), F.lit("p"), "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_suppkey")
    return readers.markers(spark, path).select("contig", "pos", "ref", "alt", "qual")


@_query("""SELECT CAST(l_orderkey AS VARCHAR) AS contig, CAST(l_linenumber AS BIGINT) AS pos, 'A' AS cons, CAST(l_partkey AS BIGINT) AS cov, CAST(l_suppkey AS BIGINT) AS "A", CAST(NULL AS BIGINT) AS "N" FROM lineitem WHERE l_linenumber > 1""")
def read_base_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of base counts; short ones are none, a word is no number."""
    x = F.lit("x")
    path = _text(spark, _t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.lit("A"), "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") > 1, F.concat_ws("\t", x, x, x, x, x)).otherwise(x))
    return readers.base_counts(spark, path).select("contig", "pos", "cons", "cov", "A", "N")


@_query("""SELECT CAST(l_orderkey AS VARCHAR) AS contig, CAST(l_linenumber AS BIGINT) AS pos, CAST(l_partkey AS BIGINT) AS depth FROM lineitem""")
def read_depths(spark: SparkSession, d: str) -> DataFrame:
    """Lines of depths."""
    return readers.depths(spark, _text(spark, _t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey"))


@_query("""SELECT CAST(l_orderkey AS VARCHAR) AS contig, CAST(l_linenumber AS BIGINT) AS start, CAST(l_partkey AS BIGINT) AS "end" FROM lineitem""")
def sorted_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions written in order over many files, and read back."""
    path = _folder(spark)
    writers.write_tables(_t(spark, d, "lineitem"), path, columns=["l_orderkey", "l_linenumber", "l_partkey"], order=["l_orderkey", "l_linenumber", "l_partkey"])
    return readers.regions(spark, path)


@_query("""SELECT CAST(l_orderkey AS VARCHAR) AS contig, CAST(l_linenumber AS BIGINT) AS start, CAST(l_partkey AS BIGINT) AS "end", CAST(l_suppkey AS INTEGER) AS count FROM lineitem""")
def read_region_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of region counts."""
    return readers.region_counts(spark, _text(spark, _t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).drop("file")


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS contig, CAST(c_nationkey AS BIGINT) AS size FROM customer""")
def read_contig_sizes(spark: SparkSession, d: str) -> DataFrame:
    """I8: sizes of contigs; a second line of a contig doesn't count."""
    c = _t(spark, d, "customer")
    lines = F.concat_ws("\t", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))
    path = _folder(spark)
    c.select(F.concat(lines, F.lit("\n"), F.col("c_custkey").cast("string"), F.lit("\t0")).alias("value")).write.text(path)
    return readers.contig_sizes(spark, path)


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS contig, CAST(1 AS BIGINT) AS start, CAST(o_custkey AS BIGINT) AS "end", CAST(o_custkey AS BIGINT) AS depth, o_orderstatus AS klass FROM orders""")
def read_region_depths(spark: SparkSession, d: str) -> DataFrame:
    """Depths of regions; the first line of a start counts."""
    o = _t(spark, d, "orders")
    line = lambda end: F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.lit("1"), end, end, "o_orderstatus")
    path = _folder(spark)
    o.select(F.concat(line(F.col("o_custkey").cast("string")), F.lit("\n"), line(F.lit("7"))).alias("value")).write.text(path)
    return readers.region_depths(spark, path)


@_query("""WITH p AS (SELECT l_orderkey AS contig, string_agg(CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'M' ELSE 'U' END, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pattern FROM lineitem GROUP BY l_orderkey),
q AS (SELECT contig, rpad(pattern, (SELECT CAST(max(length(pattern)) AS INTEGER) FROM p), 'U') AS pattern FROM p)
SELECT CASE WHEN contig % 3 = 0 THEN translate(replace(pattern, 'U', 'u'), 'PM', 'MP') ELSE pattern END AS pattern, CAST(contig // 2 AS VARCHAR) AS contig, CASE WHEN contig % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM q""")
def read_gates(spark: SparkSession, d: str) -> DataFrame:
    """Lines of gates, changed over where their end is flagged."""
    g = _whole_gmap(spark, d)
    flags = g.select(F.col("contig").cast("string").alias("contig"), "side", (F.col("ord") % 3 == 0).alias("swap"))
    return readers.gates(spark, _text(spark, g, "pattern", "contig", F.concat("side", F.lit("-sequence"))), flags)


@_query("""WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN '*' ELSE o_orderpriority END AS seq, CASE WHEN o_orderkey % 3 = 0 THEN '*' ELSE '12M' END AS cigar, o_custkey % 400 AS flag FROM orders)
SELECT CASE WHEN seq = '*' THEN 'no_sequence' WHEN cigar = '*' THEN 'unmapped_starcigar' WHEN flag > 255 THEN 'secondary' ELSE 'kept' END AS disposition, count(*) AS alignments, CAST(sum(CASE WHEN seq = '*' THEN 0 ELSE length(seq) END) AS BIGINT) AS bases FROM a GROUP BY 1""")
def alignment_counts(spark: SparkSession, d: str) -> DataFrame:
    """Alignments by what becomes of them."""
    k = F.col("o_orderkey")
    return reads.dispositions(_t(spark, d, "orders").select(F.when(k % 5 == 0, "*").otherwise(F.col("o_orderpriority")).alias("seq"), F.when(k % 3 == 0, "*").otherwise("12M").alias("cigar"), (F.col("o_custkey") % 400).alias("flag")))


@_query("""SELECT 'c' || CAST(o_orderkey AS VARCHAR) AS contig, CAST(o_custkey AS BIGINT) AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'A' END AS mat, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'C' END AS pat FROM orders""")
def read_phased_markers(spark: SparkSession, d: str) -> DataFrame:
    """Phased markers, their alleles changed over where the contig is flagged."""
    o = _t(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("contig"), "o_custkey", "o_orderkey")
    flags = o.select("contig", (F.col("o_orderkey") % 2 == 0).alias("swap"))
    return readers.phased_markers(spark, _text(spark, o, F.lit("corr"), "contig", "o_custkey", F.lit("A"), F.lit("C")), flags)


@_query("""SELECT o_orderpriority AS codes, CAST(o_orderkey AS VARCHAR) AS contig, CAST(1 AS BIGINT) AS start, CAST(9 AS BIGINT) AS "end", 'hap_low' AS klass, CAST(o_custkey AS BIGINT) AS support, CAST(o_orderkey AS BIGINT) AS cells FROM orders WHERE o_orderkey % 2 = 0""")
def read_deletion_gates(spark: SparkSession, d: str) -> DataFrame:
    """Codes of deletion-like regions from the lines of normalised counts."""
    share = F.concat_ws("/", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "rpkm").otherwise("raw_cnt")
    return readers.deletion_gates(spark, _text(spark, _t(spark, d, "orders"), "o_orderpriority", "o_orderkey", F.lit(1), F.lit(9), F.lit("hap_low"), share, kind))


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS contig, CAST(o_custkey AS BIGINT) AS start, CAST(o_custkey + 5 AS BIGINT) AS "end", 'hap_low' AS klass, 'P' AS geno, CAST(7 AS BIGINT) AS score, o_orderstatus AS phase_group, 'm' AS map_group FROM orders""")
def read_phased_deletions(spark: SparkSession, d: str) -> DataFrame:
    """Phased deletion-like regions."""
    o = _t(spark, d, "orders")
    path = _text(spark, o, "o_orderkey", "o_custkey", F.col("o_custkey") + 5, F.lit("hap_low"), F.lit("P"), F.lit(7), "o_orderstatus", F.lit("m"), F.lit("PM"))
    return readers.phased_deletions(spark, path).drop("pattern")


@_query("""SELECT c_name AS qname, 99 AS flag, CAST(c_nationkey AS VARCHAR) AS rname, CAST(c_custkey AS BIGINT) AS pos, '12M' AS cigar, c_mktsegment AS seq FROM customer""")
def read_alignments(spark: SparkSession, d: str) -> DataFrame:
    """I4: alignment lines."""
    star, zero = F.lit("*"), F.lit(0)
    c = _t(spark, d, "customer")
    path = _text(spark, c, "c_name", F.lit(99), "c_nationkey", "c_custkey", F.lit(60), F.lit("12M"), star, zero, zero, "c_mktsegment", star)
    return readers.sam(spark, path).select("qname", "flag", "rname", "pos", "cigar", "seq")


@_query("""WITH r AS (SELECT c_custkey AS n, c_name AS name, c_mktsegment AS s FROM customer) SELECT name, CAST(CASE WHEN n % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS "end", CASE WHEN n % 2 = 0 THEN 'CCCC' ELSE '' END || s AS sequence, CASE WHEN n % 2 = 0 THEN 'JJJJ' ELSE '' END || repeat('I', length(s)) AS quality FROM r""")
def barcoded_lines(spark: SparkSession, d: str) -> DataFrame:
    """Reads of tagged alignment lines; first reads carry the corrected barcode."""
    star, zero = F.lit("*"), F.lit(0)
    flag = F.when(F.col("c_custkey") % 2 == 0, 77).otherwise(141)
    line = F.concat_ws("\t", "c_name", flag.cast("string"), star, zero.cast("string"), zero.cast("string"), star, star, zero.cast("string"), zero.cast("string"), "c_mktsegment", F.expr("repeat('I', length(c_mktsegment))"), F.lit("CR:Z:AAAA"), F.lit("CY:Z:JJJJ"), F.lit("CB:Z:CCCC-1"))
    return readers.barcoded_reads(_t(spark, d, "customer").select(line.alias("value")))


@_query("""WITH k AS (SELECT l_orderkey AS contig, l_orderkey % 16 AS i FROM lineitem GROUP BY ALL) SELECT count(*) FILTER (i NOT IN (0, 3, 8, 9)) AS mapped, count(*) FILTER (i IN (0, 3, 8, 9)) AS waiting FROM k""")
def gates_to_place(spark: SparkSession, d: str) -> DataFrame:
    """Gates that are on a map, and those that are not."""
    g, new = _to_complete(spark, d)
    on = g.select("contig", "side").withColumn("_on", F.lit(True))
    both = g.select("contig", "side").unionByName(new.select("contig", "side")).join(on, ["contig", "side"], "left")
    return both.agg(F.count_if(F.col("_on").isNotNull()).alias("mapped"), F.count_if(F.col("_on").isNull()).alias("waiting"))
