"""What the operators of this subpackage share: tables, checkpoints, word hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space as the contracts name it: x20 and x09 to x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, batch_rows: int = 500) -> DataFrame:
    """``df`` cut from its lineage, kept in the folder that the cluster names.

    ``spark.checkpoint.dir`` is a shared folder on a cluster. Only where nothing
    names one (tests on one machine) a temporary folder is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}"))
    # rows of long arrays or texts go to Python in batches of ``batch_rows`` meanwhile
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), batch_rows) if int(before) > 0 else batch_rows))
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """``checkpoint`` without Spark's guess of the size, for numbers that go through joins round after round.

    A checkpoint keeps the guess of the plan it came from, and that of a join is the
    product of both sides. Where each round joins what the last one left, the
    guess gets several times as many digits a round, until the driver is full of it.
    """
    kept = checkpoint(df)
    return DataFrame(kept.sparkSession._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), kept.sparkSession)


def small_side(df: DataFrame, most_rows: int = 200_000, *, lists: str | None = None) -> DataFrame:
    """``df``, of a few short columns, marked for a broadcast if it is counted to be small; else joins shuffle it.

    Elements of the array column ``lists`` count as rows of their own.
    """
    rows, elements = df.agg(F.count(F.lit(1)), F.sum(F.size(lists)) if lists else F.lit(0)).first()
    return F.broadcast(df) if rows + (elements or 0) <= most_rows else df


def release(spark: SparkSession) -> None:
    """Have the driver drop the shuffle files and checkpoints of frames that are no longer held.

    Spark removes them only when the driver's garbage is collected, which a step
    that moves much data but makes few objects may never bring about. The first
    collection frees what holds them, the second them.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def spare_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of ``taken``."""
    have, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame, *, id_col: str, text_col: str, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` less those of ``gone`` (doc_id, text_hash), by any names of columns; or those only, by ``left_semi``."""
    d, h = spare_names(docs.columns, "_d", "_h")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(h))
    return docs.join(small_side(gone.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))), same, how)


#: Arrow batches to Python: rows, and bytes, at most.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 24}


def text_batches(spark: SparkSession) -> None:
    """Bound batches to Python from now on: a row here is a whole text.

    Only the size of batches changes, never a result. Results are lazy, so the
    bounds have to hold for as long as the session may run them; settings that
    are lower already are left alone.
    """
    for key, most in _BATCH.items():
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def _values(column: pa.Array) -> list:
    """The column's values; lists of numbers as numpy views, not as Python numbers."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    whole = column.is_valid().to_pylist()
    return [values[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], whole, strict=True)]


def map_texts(
    df: DataFrame,
    columns: list[str],
    schema: str,
    work: Callable[[dict[str, list]], dict[str, object]],
) -> DataFrame:
    """Run ``work`` over Arrow batches of ``columns``; it gets and gives columns by name, lists as numpy arrays."""
    names = [part.strip().split(" ")[0].strip("`") for part in schema.split(",")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([(n, types[part.strip().split(" ")[1]]) for n, part in zip(names, schema.split(","), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = out = None
            # long texts make wide batches: a slice bounds what is decoded at once
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = work({c: _values(part.column(i)) for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type, from_pandas=False) for f in arrow], schema=arrow)
            del batch, part, out
            pa.default_memory_pool().release_unused()
        _trim()

    text_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    """The UTF-8 bytes of a text, none for null."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


# ---------------------------------------------------------------- word hashes

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(2 * n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = _powers(int(_BASE), self.n)
                self.down = _powers(pow(int(_BASE), -1, 1 << 64), self.n)
        return self.up, self.down


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_grams(words: list[bytes], n: int) -> np.ndarray:
    """64-bit hashes of every ``n`` consecutive words; the whole sequence if it is shorter."""
    return grams_of(words, (n,))[0]


def grams_of(words: list[bytes], sizes: tuple[int, ...]) -> list[np.ndarray]:
    """``word_grams`` of several sizes."""
    if not words:
        return [np.empty(0, np.uint64) for _ in sizes]
    joined = b" ".join(words)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    up, down = _POWERS.get(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
        out = []
        for n in (min(size, len(words)) for size in sizes):
            a, b = starts[: len(words) - n + 1], ends[n - 1 :]
            out.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
    return out


def grams_of_texts(texts: list[bytes], letters: bytes, sizes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words of each text, ``grams_of`` from each word on), of many texts at once.

    ``letters`` translates a text to its words, parted by blanks. The sequences of
    ``n`` words are those of all texts behind one another; the last ``n - 1`` that
    begin in a text run into the next and are for the caller to leave out.
    """
    raw = np.frombuffer(b"\n".join(texts).translate(letters) + b" ", np.uint8)
    word = raw != 32
    word[1:] |= word[:-1]  # and the blank behind a word
    at = np.flatnonzero(word)
    small = raw[at]
    blank = np.flatnonzero(small == 32)
    upto = np.searchsorted(at[blank], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
    starts = np.concatenate((np.zeros(1, np.int64), blank + 1))
    up, down = _POWERS.get(len(small) + 1)
    out = []
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[small] * up[: len(small)], dtype=np.uint64)))
        for n in sizes:
            a, b = starts[: max(0, len(blank) - n + 1)], blank[n - 1 :]
            out.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
    return np.diff(upto, prepend=0), out


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small local table; empty lists too."""
    return spark.createDataFrame(rows, schema)


def ascii_lower(column):
    """Lower-case A-Z only, on the JVM side."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
