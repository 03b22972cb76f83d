"""Best-fit packing by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import checkpoint, literal_rows, map_texts, table
from .tokens import word_encoder


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest feasible bin that holds the longest length left.

    ``counts``: how many pieces of each length are left. Sums are bits of one
    integer: bit ``s`` is set if some pieces fill exactly ``s``. Copies of a
    length enter in powers of two, long lengths first, until the bin is full.
    """
    root = max(counts)
    room, mask = capacity - root, (1 << (capacity - root + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == root), room // length)
        take = 1
        while left > 0 and not reach >> room & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {root: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins and how often each is made, until no piece is left.

    The fullest combination stays the fullest for as long as its pieces last, so
    it is taken as often as they do. The work depends on the number of lengths,
    which the capacity bounds, and not on the number of pieces.
    """
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[k] // n for k, n in chosen.items())
        out.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def placements(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, pieces a bin, offset in it, first bin)."""
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    rows, first_bin = [], 0
    for chosen, times in patterns(histogram, capacity):
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * times, n, offset, first_bin))
            used[length] += n * times
            offset += length * n
        first_bin += times
    return rows


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and a closing 0, cut at ``capacity`` only if longer."""

    def work(x: dict[str, list]) -> dict[str, object]:
        encoder = word_encoder(tokenizer_path)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for key, text in zip(x[id_col], x[text_col], strict=True):
            ids = encoder.encode(text or "") + b"\0\0\0\0"
            n = len(ids) // 4
            for i, at in enumerate(range(0, n, capacity)):
                size = min(capacity, n - at)
                for k, v in zip(out, (key, i, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                    out[k].append(v)
        return out

    return map_texts(docs, [id_col, text_col], "doc_id long, piece int, start long, length long, ids_crc32 long", work)


def pack(cut: DataFrame, *, capacity: int = 2048, rows_per_bucket: int = 2_000) -> DataFrame:
    """Give each piece a sequence and a place in it.

    Only the histogram of lengths (at most ``capacity`` rows) goes to the driver,
    which returns at most a few runs of ranks for each length. Ranks within a
    length are counted in salted buckets, so that a length that holds a third of
    all pieces is dealt over many tasks; an earlier bucket's size is added to them.
    """
    spark = cut.sparkSession
    cut = checkpoint(cut)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = min(4096, max(1, math.ceil(max(histogram.values(), default=0) / rows_per_bucket)))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # bounded by the capacity alone: a bin has at most 63 different lengths of 2048
    runs = literal_rows(spark, placements(histogram, capacity), "length long, _from long, _to long, _each long, _offset long, _bin long")
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(runs["length"])
    at = F.col("_rank") - F.col("_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_bin") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def best_fit_packing(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Minimum bin slack: each bin takes the longest piece left and the combination
    of other lengths that leaves least room, found by a subset-sum bitset.

    A null text is empty and packs as its closing 0 alone. A null id stays null.
    Repeated rows are packed each. An empty table gives no rows. Other columns
    are not read.
    """
    return pack(pieces(docs, tokenizer_path, capacity=capacity, id_col=id_col, text_col=text_col), capacity=capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 2048 tokens."""
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
