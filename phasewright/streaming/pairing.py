"""Pairs of reads from a stream, with state of each name, and nothing lost without a row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import complement_reverse, corrected_barcode, is_reverse, read_end, sam_tag, split_tokens

OUT = "name string, kind string, sequence string, quality string, sequence2 string, quality2 string"
_STATE = "sequence string, quality string, sequence2 string, quality2 string, paired boolean"


def stream_reads(lines: DataFrame, *, wait: str = "10 minutes", arrived: str = "arrived") -> DataFrame:
    """(name, end, sequence, quality, arrived) of a stream of SAM lines with a timestamp; first reads carry their barcode.

    Lines of headers, of fewer than eleven columns, of neither end, and the words that end a session are none.
    """
    rows = lines.where(~F.col("value").startswith("@") & ~F.lower("value").isin("q", "quit", "exit")).withWatermark(arrived, wait)
    rows = rows.withColumn("_t", split_tokens("value")).where(F.size("_t") >= 11)
    token = lambda i: F.get("_t", F.lit(i))
    rows = rows.select(arrived, "value", token(0).alias("name"), token(1).try_cast("int").alias("flag"), token(9).alias("_s"), token(10).alias("_q"))
    end, back = read_end("flag"), is_reverse("flag")
    s, q = F.when(back, complement_reverse("_s")).otherwise(F.col("_s")), F.when(back, F.reverse("_q")).otherwise(F.col("_q"))
    barcode, mark = corrected_barcode(sam_tag("value", "CB"), sam_tag("value", "CR")), sam_tag("value", "CY")
    first = end == 1
    return rows.where(end.isNotNull()).select(arrived, "name", end.alias("end"), F.when(first, F.concat(F.coalesce(barcode, F.lit("")), s)).otherwise(s).alias("sequence"), F.when(first, F.concat(F.coalesce(mark, F.lit("")), q)).otherwise(q).alias("quality"))


def _meet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, wait_ms: int) -> Iterator[pd.DataFrame]:
    """One name: what has come of it, against what is kept."""
    name = key[0]
    row = lambda kind, s=None, q=None, s2=None, q2=None: (name, kind, s, q, s2, q2)
    held = list(state.get) if state.exists else [None, None, None, None, False]
    out = []
    if state.hasTimedOut:
        if not held[4]:
            out.append(row("unpaired", *held[:4]))
        state.remove()
    else:
        latest = 0
        came = pd.concat(list(batches)).sort_values(["arrived", "end", "sequence", "quality"], kind="stable")
        for r in came.itertuples():
            at = 0 if r.end == 1 else 2
            latest = max(latest, int(r.arrived.timestamp() * 1000))
            if held[4] or held[at] is not None:
                out.append(row("repeated", r.sequence, r.quality) if at == 0 else row("repeated", None, None, r.sequence, r.quality))
                continue
            held[at : at + 2] = r.sequence, r.quality
            if held[0] is not None and held[2] is not None:
                out.append(row("pair", *held[:4]))
                held = [None, None, None, None, True]
        state.update(tuple(held))
        # the name is kept until no mate can be on time any more
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait_ms)
    if out:
        yield pd.DataFrame(out, columns=["name", "kind", "sequence", "quality", "sequence2", "quality2"])


def paired_stream(reads: DataFrame, *, wait_seconds: int = 600) -> DataFrame:
    """(name, kind, sequence, quality, sequence2, quality2): every read of ``stream_reads`` that is on time in exactly one row.

    ``pair``: a first and a second read of one name. ``unpaired``: a read whose
    mate hasn't come when the watermark is ``wait_seconds`` past it. ``repeated``: a
    read of a name and end that is there already, or of a name that is paired. State is
    a read for each waiting name, or a mark for each paired one, and goes with
    the watermark; a restart goes on from the query's checkpoint. Spark itself drops reads that
    come later than the watermark allows, so its delay must cover how late they may be.
    """
    rows = reads.select("name", "end", "sequence", "quality", F.col("arrived"))
    return rows.groupBy("name").applyInPandasWithState(lambda key, parts, state: _meet(key, parts, state, 1000 * wait_seconds), OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
