"""Streams of SAM lines: pairing by name, and parts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import barcoded_reads


def barcoded_pairs(lines: DataFrame, *, wait: str = "10 minutes") -> DataFrame:
    """Pairs of reads from a stream of SAM lines with ``arrived``, a timestamp.

    First and second reads meet by name in a stream-stream join; the watermark
    bounds how long a read waits for its mate, and so the state.
    """
    reads = barcoded_reads(lines.where(~F.lower("value").isin("q", "quit", "exit"))) if not lines.isStreaming else None
    if reads is not None:
        first, second = reads.where("end = 1"), reads.where("end = 2")
        return first.drop("end").join(second.select("name", F.col("sequence").alias("sequence2"), F.col("quality").alias("quality2")), "name")
    from ..functions import complement_reverse, corrected_barcode, is_reverse, read_end, sam_tag, split_tokens

    t = lines.where(~F.col("value").startswith("@") & ~F.lower("value").isin("q", "quit", "exit")).withWatermark("arrived", wait)
    t = t.withColumn("_t", split_tokens("value")).where(F.size("_t") >= 11)
    flag = F.get("_t", F.lit(1)).try_cast("int")
    t = t.select("arrived", "value", F.get("_t", F.lit(0)).alias("name"), flag.alias("flag"), F.get("_t", F.lit(9)).alias("seq"), F.get("_t", F.lit(10)).alias("qual"))
    s, q = F.when(is_reverse("flag"), complement_reverse("seq")).otherwise(F.col("seq")), F.when(is_reverse("flag"), F.reverse("qual")).otherwise(F.col("qual"))
    barcode = corrected_barcode(sam_tag("value", "CB"), sam_tag("value", "CR"))
    first = t.where(read_end("flag") == 1).select("arrived", "name", F.concat(barcode, s).alias("sequence"), F.concat(sam_tag("value", "CY"), q).alias("quality"))
    second = t.where(read_end("flag") == 2).select(F.col("arrived").alias("arrived2"), F.col("name").alias("name2"), s.alias("sequence2"), q.alias("quality2"))
    on = (F.col("name") == F.col("name2")) & (F.col("arrived2") >= F.col("arrived") - F.expr(f"INTERVAL {wait}")) & (F.col("arrived2") <= F.col("arrived") + F.expr(f"INTERVAL {wait}"))
    return first.join(second, on).select("name", "sequence", "quality", "sequence2", "quality2")


def write_parts(pairs: DataFrame, path: str, checkpoint: str, *, barcode: int = 16) -> StreamingQuery:
    """Each micro-batch as a part of its own, in a folder for each barcode."""

    def flush(batch: DataFrame, number: int) -> None:
        batch.withColumns({"barcode": F.substring("sequence", 1, barcode), "part": F.lit(number)}).write.mode("overwrite").partitionBy("barcode").parquet(f"{path}/part={number}")

    return pairs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(flush).start()
