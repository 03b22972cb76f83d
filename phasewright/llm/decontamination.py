"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import checkpoint, small_side, table, without

#: Blocks of a 64-bit fingerprint: where each begins and how wide it is.
BLOCKS = ((0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10))
#: Fingerprints within this many bits are all found: of 7 blocks one differs in 2 bits at most.
RADIUS = 20
_FLIPS = RADIUS // len(BLOCKS)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles_of(words: Column, size: int) -> Column:
    """A 64-bit hash of every ``size`` consecutive words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    several = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
    one = F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= size, several(h)).otherwise(F.array().cast("array<bigint>")))
    return F.get(one, F.lit(0))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), conditions)


def fingerprints(rows: DataFrame, key: list[str], tokens: str) -> DataFrame:
    """``key`` and the SimHash of each row's shingles, every occurrence weighing 1.

    Bit j is set if more than half of the shingles have it. Two bits are counted
    in one sum, in its lower and upper 32 bits, by partial aggregation.
    """
    each = rows.select(*key, F.size(tokens).alias("_m"), F.explode(tokens).alias("_t"))
    lane = lambda j: F.sum(F.shiftrightunsigned("_t", j).bitwiseAND(F.lit((1 << 32) + 1)))
    sums = each.groupBy(*key, "_m").agg(*[lane(j).alias(f"_s{j}") for j in range(32)])
    low = [F.when(F.col(f"_s{j}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("_m"), F.lit(1 << j)).otherwise(F.lit(0).cast("long")) for j in range(32)]
    high = [F.when(F.shiftrightunsigned(f"_s{j}", 32) * 2 > F.col("_m"), F.shiftleft(F.lit(1).cast("long"), 32 + j)).otherwise(F.lit(0).cast("long")) for j in range(32)]
    return sums.select(*key, _any(low + high).alias("fp"))


def _block(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _near_values(at: int, width: int) -> Column:
    """A block of ``fp`` with up to ``_FLIPS`` of its bits changed in every way."""
    masks = [sum(1 << b for b in bits) for n in range(_FLIPS + 1) for bits in combinations(range(width), n)]
    return F.transform(F.array(*map(F.lit, masks)), lambda x: x.bitwiseXOR(_block(F.col("fp"), at, width)))


def within_radius(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(win, item, distance): every pair of equal ``on`` whose fingerprints differ in RADIUS bits at most.

    ``right`` is indexed under each block and its near values, ``left`` looks its
    own blocks up. Were all seven blocks to differ in 3 bits or more, the
    fingerprints would differ in 21.
    """

    def numbered(i: int, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(i).alias("block"), x.alias("value")))

    entry = lambda values: F.explode(F.flatten(F.array(*[numbered(i, v) for i, v in enumerate(values)])))
    index = right.select(*on, "item", F.col("fp").alias("_fi"), entry([_near_values(a, w) for a, w in BLOCKS]).alias("_e")).select(*on, "item", "_fi", "_e.*")
    probe = left.select(*on, "win", F.col("fp").alias("_fw"), entry([F.array(_block(F.col("fp"), a, w)) for a, w in BLOCKS]).alias("_e")).select(*on, "win", "_fw", "_e.*")
    found = probe.join(index, [*on, "block", "value"]).select("win", "item", F.bit_count(F.col("_fw").bitwiseXOR(F.col("_fi"))).alias("distance"))
    return found.where(F.col("distance") <= RADIUS).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, start_word, n_words, distance, similarity) of passages like a benchmark item.

    A window is as many words of a document as the item has, or the whole document
    if that is shorter. Weighted-shingle
    similarity is the sum of the smaller over the sum of the larger numbers of
    occurrences of each shingle. A window as similar as ``percent`` holds at
    least ``p (m + v) / (100 + p)`` of the item's ``m`` shingles, ``v`` being its
    own, so only windows with
    that many shingles of items of their size are fingerprinted; pairs within
    the radius are found by blocks and verified exactly. A pair just at 0.8
    exceeds the radius with a chance under 0.0004, one at 0.85 under 0.00001.

    An item shorter than a shingle is one shingle by itself; an item without
    words is passed over, as are texts without words and null texts. Null ids
    are reported as null; rows repeated whole are reported once; of several
    windows the most similar is given, the first of equal ones. Empty tables
    give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    words = benchmark.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text_col)).alias("_words")).where(F.size("_words") > 0)
    words = words.withColumn("w", F.size("_words")).withColumn("k", F.least(F.lit(shingle), "w"))
    sized = reduce(DataFrame.union, [words.where(F.col("k") == k).select("item_id", "w", "k", shingles_of(F.col("_words"), k).alias("toks")) for k in range(1, shingle + 1)])
    items = checkpoint(sized.withColumn("item", F.monotonically_increasing_id()))
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most ``shingle`` of them
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    empty = "doc_id long, text_hash long, item_id long, start_word int, n_words int, distance int, similarity double"
    out = [_of_length(base, items.where(F.col("k") == k), k, percent) for k in lengths]
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], empty)


def _of_length(base: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    tokens = base.select("doc_id", "text_hash", shingles_of(words_of(F.col("_text")), k).alias("toks"))
    known = small_side(items.select(F.explode("toks").alias("_t"), "w").distinct(), 1_000_000)
    anchors = tokens.select("doc_id", "text_hash", F.size("toks").alias("n"), F.posexplode("toks").alias("at", "_t")).join(known, "_t")
    m = F.col("w") - (k - 1)
    # the shingles of a window: a document shorter than the item is one window as it is
    v = F.least(m, F.col("n"))
    need = F.ceil(percent * (m + v) / (100 + percent)).cast("int")
    runs = anchors.groupBy("doc_id", "text_hash", "n", "w").agg(F.sort_array(F.collect_set("at")).alias("p")).withColumns({"m": v, "need": need}).where(F.size("p") >= F.col("need"))
    first = lambda i: F.get("p", i)
    dense = F.filter(F.sequence(F.lit(0), F.size("p") - F.col("need")), lambda i: first(i + F.col("need") - 1) - first(i) < F.col("m"))
    low = lambda i: F.greatest(F.lit(0), first(i) - (F.col("m") - F.col("need")))
    high = lambda i: F.least(first(i), F.col("n") - F.col("m"))
    starts = F.array_distinct(F.flatten(F.transform(dense, lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i))).otherwise(F.array().cast("array<int>")))))
    places = checkpoint(runs.select("doc_id", "text_hash", "w", "m", F.explode(starts).alias("start")))
    by_doc = places.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.collect_list(F.struct("w", "m", "start")).alias("_at"))
    again = base.join(small_side(by_doc, lists="_at"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
    again = again.select("doc_id", "text_hash", "_at", shingles_of(words_of(F.col("_text")), k).alias("toks"))
    cut = again.select("doc_id", "text_hash", "toks", F.explode("_at").alias("_a")).select("doc_id", "text_hash", "_a.w", "_a.start", F.slice("toks", F.col("_a.start") + 1, F.col("_a.m")).alias("toks"))
    windows = checkpoint(cut.withColumn("win", F.monotonically_increasing_id()))
    near = within_radius(fingerprints(windows, ["win", "w"], "toks"), fingerprints(items, ["item", "w"], "toks"), ["w"])
    near = checkpoint(near)
    # exact: the smaller number of occurrences of each shared shingle, summed
    bag = lambda df, key, c: df.select(key, F.explode("toks").alias("_t")).groupBy(key, "_t").agg(F.count(F.lit(1)).alias(c))
    bags = small_side(bag(items, "item", "_ci"), 1_000_000)
    common = near.join(bag(windows.join(near.select("win").distinct(), "win", "left_semi"), "win", "_cw"), "win").join(bags, ["item", "_t"])
    common = common.groupBy("win", "item", "distance").agg(F.sum(F.least("_cw", "_ci")).alias("o"))
    found = common.join(windows.select("win", "doc_id", "text_hash", "w", "start", F.size("toks").alias("v")), "win").where(F.col("o") * (100 + percent) >= percent * (m + F.col("v")))
    found = found.select("doc_id", "text_hash", "item", F.struct((F.col("o") / (m + F.col("v") - F.col("o"))).alias("similarity"), (-F.col("start")).alias("_s"), (F.col("v") + (k - 1)).alias("w"), "distance").alias("_b"))
    best = found.groupBy("doc_id", "text_hash", "item").agg(F.max("_b").alias("_b")).join(small_side(items.select("item", "item_id")), "item")
    return best.select("doc_id", "text_hash", "item_id", (-F.col("_b._s")).alias("start_word"), F.col("_b.w").alias("n_words"), F.col("_b.distance").alias("distance"), F.col("_b.similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents in which no passage is like a benchmark item, with all their columns.

    Null and empty texts stay; documents of a null id are judged by their text;
    rows repeated whole stay or go together, texts that share an id are judged
    each. An empty table gives none, an empty benchmark leaves all. Columns may
    have any names.
    """
    found = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how).select("doc_id", "text_hash").distinct()
    return without(docs, checkpoint(found), id_col=id_col, text_col=text_col)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``documents`` that are like an item of ``benchmark``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
