"""Ordered symbols: gaps, islands, change-points, gates, runs.

Each operator is one window over (keys, order); prefix sums replace rescans, so
that a sequence of n symbols costs n log n wherever it is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _keys(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def gap_regions(markers: DataFrame, sizes: DataFrame, *, key: str = "contig", pos: str = "pos", size: str = "size", min_gap: int = 2000, compat: bool = False) -> DataFrame:
    """(key, start, end): stretches without a marker, and whole sequences that give none.

    Head, inner and tail gaps of at least ``min_gap``. A sequence without any
    region of its own is returned whole. With ``compat`` a tail marks the next
    sequence in marker order as having a region, not its own, as long as there is
    a next one. Sequences of no known size have no tail.
    """
    known = sizes.select(key, F.col(size).alias("_size")).dropDuplicates([key])
    m = markers.select(key, F.col(pos).cast("long").alias("_pos")).distinct()
    w = W.partitionBy(key).orderBy("_pos")
    m = m.withColumns({"_prev": F.lag("_pos").over(w), "_next": F.lead("_pos").over(w)}).join(known, key, "left")
    region = lambda start, end, tail: F.struct(start.alias("start"), end.alias("end"), F.lit(tail).alias("tail"))
    inner = F.when(F.col("_pos") - F.col("_prev") >= min_gap, region(F.col("_prev"), F.col("_pos"), False))
    head = F.when(F.col("_prev").isNull() & (F.col("_pos") - 1 >= min_gap), region(F.lit(1).cast("long"), F.col("_pos"), False))
    tail = F.when(F.col("_next").isNull() & (F.col("_size") - F.col("_pos") >= min_gap), region(F.col("_pos"), F.col("_size").cast("long"), True))
    own = m.select(key, F.explode(F.array_compact(F.array(inner, head, tail))).alias("_r")).select(key, "_r.start", "_r.end", "_r.tail")
    if compat:
        # one row for each sequence with markers: a window over the sequences, not over the markers
        order = m.groupBy(key).agg(F.lit(1).alias("_one"))
        flags = order.join(own.groupBy(key).agg(F.max(~F.col("tail")).alias("_inner"), F.max("tail").alias("_tail")), key, "left")
        line = W.orderBy(key)
        flags = flags.select(key, (F.coalesce("_inner", F.lit(False)) | F.coalesce(F.lag("_tail").over(line), F.lit(False)) | (F.lead("_one").over(line).isNull() & F.coalesce("_tail", F.lit(False)))).alias("_has"))
        seen = flags.where("_has").select(key)
    else:
        seen = own.select(key).distinct()
    whole = known.join(seen, key, "left_anti").select(key, F.lit(1).cast("long").alias("start"), F.col("_size").cast("long").alias("end"))
    return own.select(key, "start", "end").unionByName(whole)


def informative(symbol: str = "sym") -> Column:
    return F.col(symbol).isin("P", "M")


def segments(seq: DataFrame, *, keys: str | list[str] = ("contig", "cell_id"), order: str = "idx", symbol: str = "sym", compat: bool = False) -> DataFrame:
    """(keys, start_idx, end_idx, sym): runs of one symbol that tile each sequence from 1 to its length.

    Other symbols than P and M belong to the run around them; two runs meet
    half-way between their nearest informative places. With ``compat`` a last run
    that begins at the very last place is not returned.
    """
    k = _keys(keys)
    sizes = F.max(order).over(W.partitionBy(*k))
    w = W.partitionBy(*k).orderBy(order)
    # indices from 1; a boundary is the last place of the run before it
    rows = seq.withColumn("_n", sizes).where(informative(symbol))
    rows = rows.withColumns({"_before": F.lag(symbol).over(w), "_at": F.lag(order).over(w)})
    starts = rows.where(F.col("_before").isNull() | (F.col("_before") != F.col(symbol)))
    cut = F.floor((F.col("_at") - 1 + F.col(order) - 1) / 2) + 1
    starts = starts.withColumn("_cut", F.when(F.col("_before").isNotNull(), cut))
    following = F.lead("_cut").over(w)
    out = starts.select(*k, F.coalesce(F.col("_cut") + 1, F.lit(1)).cast("long").alias("start_idx"), F.coalesce(following, F.col("_n")).cast("long").alias("end_idx"), F.col(symbol).alias("sym"), F.col(order).alias("_o"), "_n", "_before", following.alias("_f"))
    if compat:
        out = out.where(~(F.col("_f").isNull() & F.col("_before").isNotNull() & (F.col("_o") == F.col("_n"))))
    return out.select(*k, "start_idx", "end_idx", "sym")


def region_coordinates(regions: DataFrame, markers: DataFrame, sizes: DataFrame, *, contig: str = "contig", idx: str = "idx", pos: str = "pos", size: str = "size") -> DataFrame:
    """Regions of marker indices with positions: the first starts at 1, the last ends at the contig's size."""
    m = markers.select(contig, F.col(idx).alias("_idx"), F.col(pos).alias("_pos"))
    n = m.groupBy(contig).agg(F.max("_idx").alias("_n"))
    first, last = m.toDF(contig, "start_idx", "_start"), m.toDF(contig, "end_idx", "_end")
    s = sizes.select(contig, F.col(size).alias("_size")).dropDuplicates([contig])
    out = regions.join(first, [contig, "start_idx"]).join(last, [contig, "end_idx"]).join(n, contig).join(s, contig)
    return out.withColumns({"start": F.when(F.col("start_idx") == 1, F.lit(1).cast("long")).otherwise(F.col("_start")), "end": F.when(F.col("end_idx") == F.col("_n"), F.col("_size")).otherwise(F.col("_end"))}).drop("_start", "_end", "_n", "_size")


def change_points(seq: DataFrame, *, keys: str | list[str] = ("contig", "cell_id"), order: str = "idx", symbol: str = "sym") -> DataFrame:
    """(keys, split, score, call, n, left_*, right_*): the best single switch of each sequence.

    Over all splits after an informative place the score is the larger of P left
    times M right and M left times P right, as shares of informative places; the
    last best split wins. Only splits with informative places on both sides count.
    """
    k = _keys(keys)
    upto = W.partitionBy(*k).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*k)
    p, m = (F.col(symbol) == "P").cast("long"), (F.col(symbol) == "M").cast("long")
    rows = seq.withColumns({"_pl": F.sum(p).over(upto), "_ml": F.sum(m).over(upto), "_pt": F.sum(p).over(whole), "_mt": F.sum(m).over(whole)})
    pr, mr = F.col("_pt") - F.col("_pl"), F.col("_mt") - F.col("_ml")
    left, right = F.col("_pl") + F.col("_ml"), pr + mr
    pm = F.try_divide(F.col("_pl").cast("double"), left) * F.try_divide(mr.cast("double"), right)
    mp = F.try_divide(F.col("_ml").cast("double"), left) * F.try_divide(pr.cast("double"), right)
    scored = rows.withColumns({"_pm": pm, "_mp": mp}).where("_pm IS NOT NULL AND _mp IS NOT NULL")
    best = scored.groupBy(*k).agg(F.max_by(F.struct(F.col(order).alias("split"), F.greatest("_pm", "_mp").alias("score"), F.when(F.col("_pm") >= F.col("_mp"), "PM").otherwise("MP").alias("call"), "_pl", "_ml", "_pt", "_mt"), F.struct(F.greatest("_pm", "_mp"), F.col(order))).alias("_b"))
    b = best.select(*k, "_b.*")
    return b.select(*k, "split", "score", "call", (F.col("_pt") + F.col("_mt")).alias("n"), F.col("_pl").alias("left_p"), F.col("_ml").alias("left_m"), (F.col("_pt") - F.col("_pl")).alias("right_p"), (F.col("_mt") - F.col("_ml")).alias("right_m"))


def ends(seq: DataFrame, *, keys: str | list[str], order: str = "idx", symbol: str = "sym") -> DataFrame:
    """(keys, n, first, last): number of informative symbols, the first and the last of them."""
    k = _keys(keys)
    s = F.when(informative(symbol), F.col(symbol))
    o = F.when(informative(symbol), F.col(order))
    return seq.groupBy(*k).agg(F.count(s).alias("n"), F.min_by(s, o).alias("first"), F.max_by(s, o).alias("last"))


def accepted_breaks(seq: DataFrame, clusters: DataFrame, *, keys: str | list[str] = ("contig", "cell_id"), order: str = "idx", symbol: str = "sym", cluster: str = "cluster", min_score: float = 0.64, compat: bool = True) -> DataFrame:
    """(keys, call, split, score): two letters for both ends of each cell, and where it switches.

    Without informative places UU, with one that symbol twice. Under 10 the
    switched end must differ from the cell's cluster and hold a third of all; over
    10 the score must reach ``min_score`` and the switched end hold five. With
    ``compat`` exactly 10 is never a switch; without it, it is judged as more.
    """
    k = _keys(keys)
    b = ends(seq, keys=k, order=order, symbol=symbol).join(change_points(seq, keys=k, order=order, symbol=symbol).drop("n"), k, "left").join(clusters.select(*k, F.col(cluster).alias("_c")), k)
    own = F.concat("_c", "_c")
    other = F.when(F.col("_c") == "M", "P").otherwise("M")
    left_other = F.when(other == "P", F.col("left_p")).otherwise(F.col("left_m"))
    right_other = F.when(other == "P", F.col("right_p")).otherwise(F.col("right_m"))
    on_left = F.substring("call", 1, 1) == other
    end_differs = F.when(on_left, F.col("first") == other).otherwise(F.col("last") == other)
    held = F.when(on_left, left_other).otherwise(right_other)
    few = (F.col("n") < 10) & (F.col("score") > 0) & end_differs & (held > 0) & (held >= F.col("n") / 3.0)
    many = ((F.col("n") > 10) if compat else (F.col("n") >= 10)) & (F.col("score") >= min_score) & end_differs & (held >= 5)
    switch = (F.col("n") > 1) & (few | many)
    call = F.when(F.col("n") == 0, "UU").when(F.col("n") == 1, F.concat("first", "first")).when(switch, F.col("call")).otherwise(own)
    return b.select(*k, call.alias("call"), F.when(switch, F.col("split")).alias("split"), "score", "n")


def widened(breaks: DataFrame, seq: DataFrame, *, keys: str | list[str] = ("contig", "cell_id"), order: str = "idx", pos: str = "pos", symbol: str = "sym") -> DataFrame:
    """(keys, split, left_pos, right_pos, size): each switch between its nearest informative markers."""
    k = _keys(keys)
    i = seq.where(informative(symbol)).select(*k, F.col(order).alias("_o"), F.col(pos).alias("_p"))
    j = breaks.where("split IS NOT NULL").select(*k, "split").join(i, k)
    out = j.groupBy(*k, "split").agg(F.max_by(F.when(F.col("_o") <= F.col("split"), F.col("_p")), F.when(F.col("_o") <= F.col("split"), F.col("_o"))).alias("left_pos"), F.min_by(F.when(F.col("_o") > F.col("split"), F.col("_p")), F.when(F.col("_o") > F.col("split"), F.col("_o"))).alias("right_pos"))
    return out.withColumn("size", F.col("right_pos") - F.col("left_pos") + 1)


def gates(calls: DataFrame, *, contig: str = "contig", cell: str = "cell_id", call: str = "call") -> DataFrame:
    """(contig, kind, pattern): one symbol for each cell in cell order: left end, R where the ends differ, right end."""
    left, right = F.substring(call, 1, 1), F.substring(call, 2, 1)
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), s.alias("sym")) for n, s in (("left-sequence", left), ("CO-info", F.when(left != right, "R").otherwise("|")), ("right-sequence", right))])
    return packed(calls.select(contig, cell, F.explode(kinds).alias("_k")).select(contig, cell, "_k.*"), keys=[contig, "kind"], order=cell, symbol="sym")


def packed(seq: DataFrame, *, keys: str | list[str], order: str, symbol: str = "sym", name: str = "pattern") -> DataFrame:
    """(keys, pattern): symbols joined in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(symbol).alias("s"))))
    return seq.groupBy(*_keys(keys)).agg(F.array_join(F.transform(rows, lambda r: r.s), "").alias(name))


def packed_letters(seq: DataFrame, *, key: str, order: list[str], symbol: str = "sym", name: str = "pattern") -> DataFrame:
    """``packed`` for a key of whole numbers and symbols of one ASCII letter: tasks sort their rows and lay the letters of a key behind one another."""
    rows = seq.repartition(key).sortWithinPartitions(key, *order, symbol).select(F.col(key).cast("long").alias(key), F.ascii(symbol).cast("byte").alias("s"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []  # the key that may go on in the next batch, its letters so far

        def packs(keys: pa.Array, letters: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
            text = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(letters)).cast(pa.string())
            return pa.RecordBatch.from_arrays([keys, text], names=[key, name])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, letters = batch.column(0), batch.column(1).to_numpy()
            value, known = keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (known[1:] != known[:-1]))))
            first = keys[0].as_py()
            if parts and first == last[0]:
                if len(starts) == 1:
                    parts.append(letters)
                    continue
                before = np.concatenate(parts)
                letters, starts = np.concatenate((before, letters)), np.concatenate(([0], starts[1:] + len(before)))
                keys = keys.take(pa.array(np.maximum(starts - len(before), 0)))
            elif parts:
                before = np.concatenate(parts)
                keys = pa.concat_arrays([pa.array(last, pa.int64()), keys.take(pa.array(starts))])
                letters, starts = np.concatenate((before, letters)), np.concatenate(([0], starts + len(before)))
            else:
                keys = keys.take(pa.array(starts))
            if len(starts) > 1:
                yield packs(keys[:-1], letters[: starts[-1]], starts)
            last, parts = [keys[-1].as_py()], [letters[starts[-1] :]]
        if parts:
            letters = np.concatenate(parts)
            yield packs(pa.array(last, pa.int64()), letters, np.array([0, len(letters)]))

    return rows.mapInArrow(work, f"`{key}` long, `{name}` string")


def unpacked(patterns: DataFrame, *, pattern: str = "pattern") -> DataFrame:
    """A row for each symbol, with its place ``idx`` from 1 and ``sym``."""
    rest = [c for c in patterns.columns if c != pattern]
    return patterns.select(*rest, F.posexplode(F.split(pattern, "")).alias("_i", "sym")).select(*rest, (F.col("_i") + 1).alias("idx"), "sym")


def switch_counts(seq: DataFrame, *, keys: str | list[str] = ("contig", "cell_id"), by: str | list[str] = "cell_id", order: str = "idx", symbol: str = "sym") -> DataFrame:
    """(by, switches, covered): changes between informative neighbours and informative places, summed over sequences."""
    w = W.partitionBy(*_keys(keys)).orderBy(order)
    rows = seq.where(informative(symbol)).withColumn("_s", (F.lag(symbol).over(w) != F.col(symbol)).cast("long"))
    return rows.groupBy(*_keys(by)).agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("switches"), F.count(F.lit(1)).alias("covered"))


def adjacent_pairs(rows: DataFrame, *, keys: str | list[str], order: str, columns: list[str], prefix: str = "next_", different: str | None = None) -> DataFrame:
    """Each row with ``columns`` of the one after it; only pairs that differ in ``different``, if named."""
    w = W.partitionBy(*_keys(keys)).orderBy(order)
    out = rows.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in columns})
    return out if different is None else out.where(F.col(different) != F.col(f"{prefix}{different}"))


def run_lengths(rows: DataFrame, *, keys: str | list[str], order: str, value: str) -> DataFrame:
    """(keys, run, value, length): runs of equal neighbours, numbered from 1."""
    k = _keys(keys)
    w = W.partitionBy(*k).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*k, "run", value).agg(F.count(F.lit(1)).alias("length"))


def scaffold_pairs(gmap: DataFrame, *, group: str = "group", order: str = "ord", contig: str = "contig", side: str = "side") -> DataFrame:
    """(group, rank, contig, reverse): consecutive rows taken two by two; reversed if the first is a right side.

    A pair of different contigs has ``paired`` false.
    """
    w = W.partitionBy(group).orderBy(order)
    rows = gmap.withColumns({"_n": F.row_number().over(w), "_next": F.lead(contig).over(w)})
    return rows.where("_n % 2 = 1").select(group, ((F.col("_n") + 1) / 2).cast("int").alias("rank"), contig, (F.col(side) == "right").alias("reverse"), F.coalesce(F.col("_next") == F.col(contig), F.lit(False)).alias("paired"))
