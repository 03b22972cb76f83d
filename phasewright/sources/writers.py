"""Sinks: one folder for each key, one line for each row."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F


#: Rows of one file, about, where a key's rows are many.
ROWS_A_FILE = 1_000_000


def dealt(rows: DataFrame, by: list[str], *, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """Rows dealt by ``by`` for a sink: a key of many rows goes to as many tasks, and so files, as its count asks for.

    Keys are counted first. A row's file within its key follows from the row
    itself, so it is the same whichever task writes it and whenever.
    """
    names = [f"_k{i}" for i in range(len(by))]
    counts = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.ceil(F.count(F.lit(1)) / rows_a_file).alias("_files"))
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)])
    # only keys of several files are sent along
    many = counts.where("_files > 1")
    out = rows.join(many, same, "left").withColumn("_file", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.coalesce("_files", F.lit(1))))
    return out.repartition(*by, "_file").drop(*names, "_files", "_file")


def tab_lines(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])


def write_tables(df: DataFrame, path: str, *, columns: list[str], by: list[str] | None = None, order: list[str] | None = None, compress: bool = False) -> None:
    """Tab-separated lines, in a folder for each value of ``by``, ordered in each file."""
    rows = df.select(*(by or []), *(order or []), tab_lines(df, columns).alias("value")) if not order else df.withColumn("value", tab_lines(df, columns))
    if by:
        rows = dealt(rows, by)
    if order:
        rows = (rows.sortWithinPartitions(*(by or []), *order) if by else rows.orderBy(*order)).select(*(by or []), "value")
    writer = rows.write.mode("overwrite").option("compression", "gzip" if compress else "none")
    (writer.partitionBy(*by) if by else writer).text(path)


def fastq_text(name: str = "name", sequence: str = "sequence", quality: str = "quality") -> Column:
    return F.concat(F.col(name), F.lit("\n"), F.col(sequence), F.lit("\n+\n"), F.col(quality))


def write_fastq_pairs(pairs: DataFrame, path: str, *, by: list[str] | None = None, compress: bool = True) -> None:
    """Both reads of each pair under R1 and R2, in folders by barcode and part."""
    for end, cols in (("R1", ("name", "sequence", "quality")), ("R2", ("name2", "sequence2", "quality2"))):
        rows = pairs.select(*(by or []), fastq_text(*cols).alias("value"))
        writer = (dealt(rows, by) if by else rows).write.mode("overwrite").option("compression", "gzip" if compress else "none")
        (writer.partitionBy(*by) if by else writer).text(f"{path}/{end}")


def write_fasta(df: DataFrame, path: str, *, id_col: str = "id", sequence: str = "sequence", by: list[str] | None = None) -> None:
    """>id and sequence; one folder for each route or group."""
    rows = df.select(*(by or []), F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(sequence)).alias("value"))
    writer = (dealt(rows, by) if by else rows).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def write_scaffolds(chunks: DataFrame, path: str, *, group: str = "group") -> None:
    """>group and the lines of ``operators.scaffold_chunks``, in files whose names follow the order of lines."""
    head = chunks.select(group).distinct().select(group, F.lit(None).cast("long").alias("rank"), F.lit(0).cast("long").alias("part"), F.concat(F.lit(">"), F.col(group).cast("string")).alias("value"))
    rows = head.unionByName(chunks.select(group, F.col("rank").cast("long").alias("rank"), "part", F.col("bases").alias("value")))
    rows.orderBy(group, F.col("rank").asc_nulls_first(), "part").select("value").write.mode("overwrite").text(path)


def write_dot(edges: DataFrame, path: str, *, name: str = "contigs") -> None:
    """A graph in DOT, in one file."""
    from ..operators.maps import dot_lines

    spark = edges.sparkSession
    body = dot_lines(edges).select(F.lit(1).alias("o"), "value")
    frame = spark.createDataFrame([(0, f"digraph {name} {{"), (2, "}")], "o int, value string")
    body.unionByName(frame).orderBy("o", "value").coalesce(1).select("value").write.mode("overwrite").text(path)
