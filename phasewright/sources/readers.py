"""Text formats as DataFrames.

Lines are split as the tools that write these files do: runs of separators count
as one, ``#`` lines and blank lines are no rows. Gzip files are read as they are;
one such file is one task, so callers that go on to shuffle lose nothing, and
others may ``repartition``. Where line order matters it is the order inside each
file, which a hidden line number of the file's splits keeps.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import flip, is_reverse, path_part, read_end, sam_tag, split_tokens

Paths = str | Sequence[str]


def lines(spark: SparkSession, paths: Paths, *, comments: bool = True) -> DataFrame:
    """(value, file): lines without comments and blank ones."""
    df = spark.read.text(paths if isinstance(paths, str) else list(paths)).select("value", F.col("_metadata.file_path").alias("file"))
    return df.where((F.trim("value") != "") & ~F.col("value").startswith("#")) if comments else df


def _order() -> Column:
    """Rises along each file: splits begin at rising offsets, rows of a split are numbered in order."""
    return F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def ordered_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """(value, file, at): all lines with their order in the file."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).select("value", F.col("_metadata.file_path").alias("file"), _order().alias("at"))


def columns(df: DataFrame, schema: str, *, separator: str = "\t", least: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Lines as typed columns by place; what can't be read as its type is null; short lines go."""
    parts = [x.strip().split(" ") for x in schema.split(",")]
    tokens = df.withColumn("_t", split_tokens("value", separator)).where(F.size("_t") >= max(least, 1))
    return tokens.select(*keep, *[F.get("_t", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(parts) if name != "_"])


def markers(spark: SparkSession, paths: Paths) -> DataFrame:
    """(project, contig, pos, ref, alt, qual, alt_cov, af, flag)."""
    return columns(lines(spark, paths), "project string, contig string, pos bigint, ref string, alt string, qual double, alt_cov bigint, af double, flag string", least=5)


def base_counts(spark: SparkSession, paths: Paths) -> DataFrame:
    """(file, contig, pos, cons, cov, A, C, G, T, -, N); lines of under ten columns go."""
    return columns(lines(spark, paths), "contig string, pos bigint, cons string, cov bigint, A bigint, C bigint, G bigint, T bigint, - bigint, N bigint", least=10, keep=["file"])


def manifest(spark: SparkSession, path: str, *, id_col: str = "cell_id") -> DataFrame:
    """(cell_id, path): the files of a list, numbered from 1 in its order. A list without files is an error."""
    rows = ordered_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    out = rows.select(F.row_number().over(W.orderBy("at")).alias(id_col), F.trim("value").alias("path"))
    if out.isEmpty():
        raise ValueError(f"no files are listed in {path}")
    return out


def probed(cells: DataFrame, *, id_col: str = "cell_id", at_once: int = 8) -> DataFrame:
    """(cell_id, path, readable, id_readable): which files of a manifest can be read to their end.

    Each file is a job of its own, ``at_once`` at a time, so that an unreadable
    one fails alone: a missing file, or a broken archive, in any file system that Spark
    knows. ``id_readable`` numbers the readable ones alone: those behind an
    unreadable one move up. What the driver holds is the list.
    """
    spark = cells.sparkSession

    def readable(path: str) -> bool:
        try:
            spark.read.text(path).agg(F.sum(F.length("value"))).collect()
        except (PySparkException, Py4JJavaError):
            return False
        return True

    listed = [(r[id_col], r["path"]) for r in cells.orderBy(id_col).collect()]
    with ThreadPoolExecutor(at_once) as pool:
        fine = list(pool.map(readable, [path for _, path in listed]))
    rank = itertools.accumulate(map(int, fine))
    rows = [(i, path, ok, n if ok else None) for (i, path), ok, n in zip(listed, fine, rank, strict=True)]
    return spark.createDataFrame(rows, f"{id_col} int, path string, readable boolean, id_readable int")


def with_cells(rows: DataFrame, cells: DataFrame, *, id_col: str = "cell_id") -> DataFrame:
    """Rows of files with the number of their file in the manifest."""
    name = F.regexp_replace("path", "^file:/+", "/")
    return rows.withColumn("_f", F.regexp_replace("file", "^file:/+", "/")).join(cells.select(id_col, name.alias("_f")), "_f").drop("_f", "file")


def contig_sizes(spark: SparkSession, paths: Paths) -> DataFrame:
    """(contig, size): the first line of a contig counts."""
    rows = columns(ordered_lines(spark, paths).where(~F.col("value").startswith("#")), "contig string, size bigint", least=2, keep=["file", "at"])
    return rows.groupBy("contig").agg(F.min_by("size", F.struct("file", "at")).alias("size"))


def regions(spark: SparkSession, paths: Paths) -> DataFrame:
    """(contig, start, end) of BED lines."""
    return columns(lines(spark, paths), "contig string, start bigint, end bigint", least=3)


def depths(spark: SparkSession, paths: Paths) -> DataFrame:
    return columns(lines(spark, paths), "contig string, pos bigint, depth bigint", least=3)


def region_depths(spark: SparkSession, paths: Paths) -> DataFrame:
    """(contig, start, end, depth, klass): the first line of a (contig, start) counts."""
    rows = columns(ordered_lines(spark, paths).where(~F.col("value").startswith("#")), "contig string, start bigint, end bigint, depth bigint, klass string", least=5, keep=["file", "at"])
    first = rows.groupBy("contig", "start").agg(F.min_by(F.struct("end", "depth", "klass"), F.struct("file", "at")).alias("_r"))
    return first.select("contig", "start", "_r.*")


def region_counts(spark: SparkSession, paths: Paths) -> DataFrame:
    return columns(lines(spark, paths), "contig string, start bigint, end bigint, count int", least=4, keep=["file"])


def aligner_logs(spark: SparkSession, paths: Paths) -> DataFrame:
    """(file, reads, rate, aligned) from logs of an aligner; aligned is the rounded share."""
    df = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    reads, rate = F.regexp_extract("value", r"(\d+) reads; of these:", 1).try_cast("bigint"), F.regexp_extract("value", r"([0-9.]+)% overall alignment rate", 1).try_cast("double")
    return df.select("file", reads.alias("reads"), rate.alias("rate"), F.round(reads * rate / 100.0).cast("long").alias("aligned"))


def path_cells(paths: DataFrame, *, path: str = "path", sample: int = 1, barcode: int = 2) -> DataFrame:
    """Paths with the sample and barcode that are parts of them, and both joined as one name."""
    out = paths.withColumns({"sample": path_part(path, sample), "barcode": path_part(path, barcode)})
    return out.withColumn("sample_barcode", F.concat_ws("_", "sample", "barcode"))


def _side(locus: str = "locus") -> Column:
    return F.when(F.col(locus).contains("_le"), "left").when(F.col(locus).contains("_ri"), "right")


def _group() -> Column:
    return F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)


def phase_groups(spark: SparkSession, paths: Paths) -> DataFrame:
    """(group_id, locus, side, flip): the file's name is the group; flip is {0} or {1}."""
    rows = columns(lines(spark, paths).where(~F.col("value").contains("(Individual:)")), "no string, locus string, flip string", least=3, keep=["file"])
    return rows.where(F.col("flip").isin("{0}", "{1}")).select(_group().alias("group_id"), "locus", _side().alias("side"), "flip")


def individuals(spark: SparkSession, paths: Paths) -> DataFrame:
    """(file, column, individual): the header row of a table of loci."""
    rows = lines(spark, paths).where(F.col("value").contains("(Individual:)"))
    return rows.select("file", F.posexplode(split_tokens("value")).alias("column", "individual"))


def genetic_maps(spark: SparkSession, paths: Paths) -> DataFrame:
    """(group_id, ord, locus, side, distance): loci in map order; distance is null for unmapped ones."""
    rows = ordered_lines(spark, paths).where((F.trim("value") != "") & ~F.trim("value").rlike("^[;#]"))
    tokens = rows.withColumn("_t", split_tokens(F.regexp_replace("value", r"\s+", "\t")))
    out = tokens.where(F.get("_t", F.lit(0)).rlike("_(le|ri)")).select(_group().alias("group_id"), F.get("_t", F.lit(0)).alias("locus"), F.get("_t", F.lit(1)).try_cast("double").alias("distance"), "at")
    return out.select("group_id", F.row_number().over(W.partitionBy("group_id").orderBy("at")).alias("ord"), "locus", _side().alias("side"), "distance")


def updated_maps(spark: SparkSession, paths: Paths) -> DataFrame:
    """(group_id, ord, contig, side, distance, recomb_pct); NA is null."""
    rows = columns(ordered_lines(spark, paths).where((F.trim("value") != "") & ~F.col("value").startswith("#")), "contig string, side string, distance double, recomb_pct double", least=2, keep=["file", "at"])
    return rows.select(_group().alias("group_id"), F.row_number().over(W.partitionBy("file").orderBy("at")).alias("ord"), "contig", "side", "distance", "recomb_pct")


def gates(spark: SparkSession, paths: Paths, flags: DataFrame | None = None) -> DataFrame:
    """(pattern, contig, side) of lines that hold a left or right gate; patterns of ends that ``flags`` (contig, side, swap) marks are changed over."""
    rows = columns(lines(spark, paths), "pattern string, contig string, kind string", least=3)
    out = rows.where(F.col("kind").rlike("left|right")).select("pattern", "contig", F.when(F.col("kind").contains("left"), "left").otherwise("right").alias("side"))
    if flags is None:
        return out
    turned = out.join(flags.select("contig", "side", "swap"), ["contig", "side"], "left")
    return turned.select(F.when(F.col("swap"), flip("pattern")).otherwise(F.col("pattern")).alias("pattern"), "contig", "side")


def deletion_gates(spark: SparkSession, paths: Paths) -> DataFrame:
    """(codes, contig, start, end, klass, support, cells) of the lines of normalised counts."""
    rows = columns(lines(spark, paths), "codes string, contig string, start bigint, end bigint, klass string, share string, kind string", least=7).where(F.col("kind").contains("rpkm"))
    part = lambda i: F.split_part("share", F.lit("/"), F.lit(i)).try_cast("bigint")
    return rows.select("codes", "contig", "start", "end", "klass", part(1).alias("support"), part(2).alias("cells"))


def phased_markers(spark: SparkSession, paths: Paths, flags: DataFrame | None = None) -> DataFrame:
    """(contig, pos, mat, pat): the first line of a place; alleles change places where the contig is flagged."""
    rows = columns(ordered_lines(spark, paths).where(~F.col("value").startswith("#")), "tag string, contig string, pos bigint, mat string, pat string", least=5, keep=["file", "at"])
    out = rows.groupBy("contig", "pos").agg(F.min_by(F.struct("mat", "pat"), F.struct("file", "at")).alias("_r")).select("contig", "pos", "_r.mat", "_r.pat")
    if flags is None:
        return out
    j = out.join(flags.select("contig", "swap"), "contig", "left")
    s = F.coalesce("swap", F.lit(False))
    return j.select("contig", "pos", F.when(s, F.col("pat")).otherwise(F.col("mat")).alias("mat"), F.when(s, F.col("mat")).otherwise(F.col("pat")).alias("pat"))


def phased_deletions(spark: SparkSession, paths: Paths) -> DataFrame:
    """(contig, start, end, klass, geno, score, phase_group, map_group, pattern)."""
    return columns(lines(spark, paths), "contig string, start bigint, end bigint, klass string, geno string, score bigint, phase_group string, map_group string, pattern string", least=8)


def back_filled_groups(groups: DataFrame, deletions: DataFrame) -> DataFrame:
    """(contig, group_id): known groups, and those of deletions for contigs of none, but for unphased ones."""
    more = deletions.where(~F.col("phase_group").contains("unphased.txt")).groupBy("contig").agg(F.min("phase_group").alias("group_id"))
    return groups.select("contig", "group_id").unionByName(more.join(groups.select("contig"), "contig", "left_anti"))


def cell_patterns(spark: SparkSession, paths: Paths) -> DataFrame:
    """(contig_file, pattern, cell, cluster): lines of P, M and u; lines of bases and undetermined cells go."""
    rows = columns(lines(spark, paths), "pattern string, cell string, cluster string", least=3, keep=["file"])
    return rows.where(F.col("pattern").rlike("[PM]") & ~F.col("cluster").endswith("_u")).select(_group().alias("contig_file"), "pattern", "cell", "cluster")


def cell_regions(spark: SparkSession, paths: Paths) -> DataFrame:
    """(contig, start, end, start_idx, end_idx, sym, cluster, cell)."""
    return columns(lines(spark, paths), "contig string, start bigint, end bigint, start_idx int, end_idx int, sym string, cluster string, cell string", least=8)


def sam(spark: SparkSession, paths: Paths) -> DataFrame:
    """(qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual) of lines with 11 columns or more."""
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths)).where(~F.col("value").startswith("@"))
    return sam_columns(rows)


_SAM = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string"


def sam_columns(rows: DataFrame) -> DataFrame:
    return columns(rows, _SAM, least=11)


def barcoded_reads(rows: DataFrame) -> DataFrame:
    """(name, end, sequence, quality) of SAM lines with barcode tags: the first read carries barcode and its quality."""
    from ..functions import complement_reverse, corrected_barcode

    t = columns(rows.where(~F.col("value").startswith("@")), _SAM, least=11, keep=["value"])
    back = is_reverse("flag")
    s, q = F.when(back, complement_reverse("seq")).otherwise(F.col("seq")), F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    barcode, quality = corrected_barcode(sam_tag("value", "CB"), sam_tag("value", "CR")), sam_tag("value", "CY")
    e = read_end("flag")
    return t.select(F.col("qname").alias("name"), e.alias("end"), F.when(e == 1, F.concat(barcode, s)).otherwise(s).alias("sequence"), F.when(e == 1, F.concat(quality, q)).otherwise(q).alias("quality"))


def numbered_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """(value, file, block, line): all lines with their number in the file, from 0, and the offset of their split.

    A plain file is many splits. Lines are counted for each split, which gives a
    row for each; the number of a line is what the splits before hold, and its
    place in its own. So no file passes through one task, and the lines themselves aren't
    shuffled. An archive is one split.
    """
    rows = ordered_lines(spark, paths).select("value", "file", F.col("at.block").alias("block"), F.col("at.row").alias("row"))
    blocks = rows.groupBy("file", "block").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = blocks.select("file", "block", (before - F.col("_first")).alias("_add"))
    return rows.join(F.broadcast(splits), ["file", "block"]).select("value", "file", "block", (F.col("row") + F.col("_add")).alias("line"))  # a row for each split


def fastq(spark: SparkSession, paths: Paths) -> DataFrame:
    """(file, record, name, sequence, quality): four lines a record, kept if the first begins with @."""
    rows = numbered_lines(spark, paths).select("file", F.floor(F.col("line") / 4).alias("record"), (F.col("line") % 4).alias("_k"), "value")
    out = rows.groupBy("file", "record").agg(*[F.max(F.when(F.col("_k") == k, F.col("value"))).alias(n) for k, n in ((0, "name"), (1, "sequence"), (3, "quality"))])
    return out.where(F.col("name").startswith("@"))


def fastq_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of both files by their number."""
    return first.drop("file").join(second.select("record", *[F.col(c).alias(f"{c}2") for c in ("name", "sequence", "quality")]), "record")


def fasta_lines(spark: SparkSession, paths: Paths, wanted: DataFrame | None = None, *, id_col: str = "contig", most: int = 10_000) -> DataFrame:
    """(id, start, bases): sequences as the lines of their records, longer lines as parts of ``most`` bases.

    ``start`` is the place of a part's first base, from 0. A header begins its
    line, so a > inside one is part of it. Each split finds its own lines' header
    and place; what a split before it leaves open is carried on by a row for each
    split. With ``wanted`` only its ids are read, which may end in sA or sB.
    """
    rows = numbered_lines(spark, paths).where(F.trim("value") != "")
    is_head = F.col("value").startswith(">")
    bases = F.when(is_head, "").otherwise(F.regexp_replace("value", r"\s", ""))
    rows = rows.select("file", "block", "line", F.when(is_head, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("_id"), bases.alias("_b"))
    split = W.partitionBy("file", "block").orderBy("line")
    rows = rows.withColumn("_p", F.coalesce(F.sum(F.length("_b")).over(split.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    rows = rows.withColumn("_h", F.last(F.when(F.col("_id").isNotNull(), F.struct("_id", "_p")), ignorenulls=True).over(split))
    splits = rows.groupBy("file", "block").agg(F.sum(F.length("_b")).alias("_n"), F.max_by("_h", "line").alias("_last"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")))
    carried = F.when(F.col("_last").isNotNull(), F.struct(F.col("_last._id").alias("_id"), (F.col("_before") + F.col("_last._p")).alias("_p")))
    splits = splits.select("file", "block", "_before", F.last(carried, ignorenulls=True).over(before).alias("_carried"))
    rows = rows.where("_id IS NULL").join(F.broadcast(splits), ["file", "block"])  # a row for each split
    own = F.when(F.col("_h").isNotNull(), F.struct(F.col("_h._id").alias("_id"), (F.col("_before") + F.col("_h._p")).alias("_p"))).otherwise(F.col("_carried"))
    rows = rows.select(own["_id"].alias("id"), (F.col("_before") + F.col("_p") - own["_p"]).alias("start"), "_b").where("id IS NOT NULL")
    if wanted is not None:
        rows = rows.join(wanted.select(F.regexp_replace(id_col, "s[AB]$", "").alias("id")).distinct(), "id", "left_semi")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.length("_b") - 1, F.lit(0)), F.lit(most)), lambda i: F.struct(i.alias("i"), F.substring(F.col("_b"), i + 1, F.lit(most)).alias("bases")))
    return rows.select("id", "start", F.explode(parts).alias("_p")).select("id", (F.col("start") + F.col("_p.i")).alias("start"), "_p.bases")


def fasta(spark: SparkSession, paths: Paths, wanted: DataFrame | None = None, *, id_col: str = "contig") -> DataFrame:
    """(id, sequence): lines of each record joined; only ids in ``wanted``, which may end in sA or sB."""
    rows = fasta_lines(spark, paths, wanted, id_col=id_col).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "bases"))).alias("_p"))
    return rows.select("id", F.array_join(F.transform("_p", lambda p: p["bases"]), "").alias("sequence"))
