import os

import pytest
from pyspark.sql import functions as F

from phasewright.streaming.pairing import paired_stream, stream_reads


def sam(name, end, seq, back=False):
    flag = (64 if end == 1 else 128) + (16 if back else 0) + 1
    tags = "CR:Z:AAAA\tCY:Z:JJJJ\tCB:Z:CCCC-1"
    return f"{name}\t{flag}\t*\t0\t0\t*\t*\t0\t0\t{seq}\t{'I' * len(seq)}\t{tags}"


def drain(spark, folder, out, checkpoint):
    """One run over what has come, ended as a job that is restarted would be."""
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).select(F.split("value", "%", 2).alias("_p"))
    lines = lines.select(F.get("_p", F.lit(0)).cast("timestamp").alias("arrived"), F.get("_p", F.lit(1)).alias("value"))
    q = paired_stream(stream_reads(lines, wait="1 minute"), wait_seconds=120).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return sorted((r.name, r.kind, r.sequence or "", r.sequence2 or "") for r in spark.read.parquet(str(out)).collect())


def put(folder, number, rows):
    path = folder / f"{number:03}.txt"
    path.write_text("".join(f"2024-01-01 00:{minute:02}:00%{line}\n" for minute, line in rows))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))  # files are taken in this order


def test_no_read_is_lost(spark, tmp_path):
    folder, out, kept = tmp_path / "in", tmp_path / "out", tmp_path / "kept"
    folder.mkdir()
    put(folder, 1, [(0, "@HD\tx"), (0, sam("a", 1, "ACGT")), (0, sam("b", 1, "GG")), (0, sam("c", 2, "AAC", True)), (0, "short\t65"), (0, "quit"), (0, sam("t", 1, "A")), (0, sam("t", 1, "C"))])
    put(folder, 2, [(1, sam("a", 2, "TT")), (1, sam("t", 2, "G")), (1, sam("t", 2, "T"))])
    first = drain(spark, folder, out, kept)
    assert first == [("a", "pair", "CCCCACGT", "TT"), ("t", "pair", "CCCCA", "G"), ("t", "repeated", "", "T"), ("t", "repeated", "CCCCC", "")]
    # after a restart: a late mate in time, then enough time for the rest
    put(folder, 3, [(2, sam("b", 2, "CC")), (2, sam("d", 2, "T"))])
    put(folder, 4, [(30, sam("z", 1, "A"))])
    put(folder, 5, [(31, sam("z", 2, "C"))])
    put(folder, 6, [(32, sam("y", 1, "G"))])
    last = drain(spark, folder, out, kept)
    assert set(last) == {*first, ("b", "pair", "CCCCGG", "CC"), ("c", "unpaired", "", "GTT"), ("d", "unpaired", "", "T"), ("z", "pair", "CCCCA", "C")} and len(last) == len(set(last))


@pytest.mark.parametrize("batch", [True])
def test_reads_of_lines(spark, batch):
    lines = spark.createDataFrame([("2024-01-01 00:00:00", sam("a", 1, "AC", True)), ("2024-01-01 00:00:00", "a\t1\t*\t0\t0\t*\t*\t0\t0\tA\tI")], "arrived string, value string").withColumn("arrived", F.col("arrived").cast("timestamp"))
    assert [tuple(r)[1:] for r in stream_reads(lines).collect()] == [("a", 1, "CCCCGT", "JJJJII")]
