"""Phrase collocations: suffix automata of a shard's words, counts reduced over all shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import _BYTE, _POWERS, _trim, checkpoint, mix, small_side, table, text_batches

#: Bytes of text from which one automaton is made.
SHARD = 1 << 20
#: Bits of a filter of frequent names at most; a fuller filter lets more names through, never fewer.
MOST_BITS = 1 << 27

# Lower-case letters; tabs become spaces, piece marks become line ends.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


@dataclass
class Words:
    """The words of one shard as numbers into a vocabulary, and which of them follow another in a piece."""

    vocabulary: pa.BinaryArray
    lang: np.ndarray  # number of each vocabulary word's language
    at: np.ndarray  # the words in their order
    follows: np.ndarray  # the word before stands in the same piece
    counted: np.ndarray  # false for words that only give context to those after them

    def phrases(self, last: np.ndarray, size: int) -> pa.BinaryArray:
        """The ``size`` words that end with each of ``last``, with one space between."""
        return pc.binary_join_element_wise(*(self.vocabulary.take(self.at[last - j]) for j in range(size - 1, -1, -1)), b" ")


def tokens(texts: list[bytes]) -> pa.DictionaryArray:
    """Words, line ends for piece marks, and nothing between spaces, of plain texts one after the other."""
    return pc.split_pattern(pa.array([b"\n".join(texts).replace(b"\n", b" \n ")], pa.binary()), b" ").flatten().dictionary_encode()


def numbered(texts: dict[str, list[bytes]], context: int = 0) -> Words:
    """The words of each language's texts; the first ``context`` ones aren't counted."""
    vocabulary, lang, at, follows, size = [], [], [], [], 0
    for i, held in enumerate(texts.values()):
        found = tokens(held)
        kind = found.dictionary
        mark, word = pc.equal(kind, b"\n").to_numpy(zero_copy_only=False), pc.greater(pc.binary_length(kind), 0).to_numpy(zero_copy_only=False)
        word &= ~mark
        ids = found.indices.to_numpy()
        here = np.flatnonzero(word[ids])
        piece = np.cumsum(mark[ids])[here]
        at.append((np.cumsum(word) - 1 + size)[ids[here]])
        follows.append(np.concatenate((np.zeros(min(1, len(here)), bool), piece[1:] == piece[:-1])))
        vocabulary.append(kind.filter(pa.array(word)))
        lang.append(np.full(len(vocabulary[-1]), i))
        size += len(vocabulary[-1])
    whole = np.concatenate(at)
    return Words(pa.concat_arrays(vocabulary), np.concatenate(lang), whole, np.concatenate(follows), np.arange(len(whole)) >= context)


def word_names(words: pa.BinaryArray, salts: np.ndarray) -> np.ndarray:
    """64-bit names of words, each with its language's salt."""
    if not len(words):
        return np.empty(0, np.uint64)
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    start, end = edges[:-1], edges[1:]
    up, down = _POWERS.get(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) + salts)


def longer_names(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Names of phrases of one word more, from the names of the phrases before and of that word."""
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + after)


@dataclass
class Automaton:
    """States of a suffix automaton over words, cut at a depth: sets of phrases that end at the same places.

    A state's phrases are the last ``shortest`` to ``longest`` words before any of
    its ends. ``link`` is the state of the next shorter one, which ends at more
    places; -1 is the root.
    """

    shortest: np.ndarray
    longest: np.ndarray
    ends: np.ndarray  # how many places
    link: np.ndarray
    last: np.ndarray  # one of the places


def automaton(base: np.ndarray, valid: list[np.ndarray], counted: np.ndarray) -> Automaton:
    """The automaton of all phrases of 1 to ``len(valid)`` words of ``base``; ``valid[d - 1]`` says where one of d words may end.

    Phrases that end at one place are suffixes of each other, so the tree of
    suffix links is grown level by level: a node of d words is a node of d - 1
    words and the word before it. A node whose ends are all its parent's is one
    state with it.
    """
    n = len(base)
    width = int(base.max(initial=0)) + 1
    node = np.full(n, -1, np.int64)  # the node, here and below numbered within its level
    state_of = np.full(1, -1, np.int64)
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    made, ends_before = 0, np.array([-1.0])
    for d, ok in enumerate(valid, 1):
        at = np.flatnonzero(ok & (node >= 0)) if d > 1 else np.flatnonzero(ok)
        key = node[at] * width + base[at - d + 1] if d > 1 else base[at]
        keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        up = node[at[first]] if d > 1 else np.zeros(len(keys), np.int64)
        ends = np.bincount(inverse, counted[at], len(keys))
        same = ends == ends_before[up] if d > 1 else np.zeros(len(keys), bool)
        state = np.where(same, state_of[up], made + np.cumsum(~same) - 1)
        for column, values in zip(parts, (np.full(len(keys), d), np.full(len(keys), d), ends, state_of[up], at[first]), strict=True):
            column.append(values[~same])
        if d > 1 and same.any():
            # such a state goes on with more words; at most one child of a node has all its ends
            longest, last = np.concatenate(parts[1]), np.concatenate(parts[4])
            longest[state[same]], last[state[same]] = d, at[first[same]]
            parts[1], parts[4] = [longest], [last]
        made += int((~same).sum())
        node = np.full(n, -1, np.int64)
        node[at] = inverse
        state_of, ends_before = state, ends
    return Automaton(*(np.concatenate(column).astype(np.int64) for column in parts))


class Filter:
    """A set of names as bits: it may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def holds(self, names: np.ndarray) -> np.ndarray:
        out = np.ones(len(names), bool)
        for spot in self.spots(names, self.mask):
            out &= (self.bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return out

    @staticmethod
    def spots(names: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        mixed = mix(names)
        return mixed & mask, mixed >> np.uint64(32) & mask


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def _parts(text: bytes, depth: int) -> Iterator[tuple[bytes, int]]:
    """A long text as parts of about a shard, each with the number of words that only give context.

    A part ends between words; the next one begins with the last ``depth - 1``
    words, so that every phrase is whole in the part where it ends.
    """
    between = b" \n"
    at = done = context = 0
    while len(text) - done > SHARD:
        done += SHARD
        while done < len(text) and text[done] not in between:
            done += 1
        yield text[at:done], context
        at, context = done, 0
        while context < depth - 1 and at:
            while at and text[at - 1] in between:
                at -= 1
            context += at > 0
            while at and text[at - 1] not in between:
                at -= 1
    if done < len(text) or not done:
        yield text[at:], context


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and plain bytes of every text."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            yield lang, (text.as_py() or b"").translate(_PLAIN)


def shards(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[Words, list[str]]]:
    """Words of a few megabytes of texts at a time, with the names of their languages."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for lang, text in _texts(batches):
        for part, context in _parts(text, depth):
            if context:
                yield numbered({lang: [part]}, context), [lang]
                continue
            held.setdefault(lang, []).append(part)
            size += len(part)
            if size >= SHARD:
                yield numbered(held), [*held]
                held, size = {}, 0
                pa.default_memory_pool().release_unused()
                _trim()
    if held:
        yield numbered(held), [*held]


def _rows(names: list[str], code: np.ndarray, phrases: pa.BinaryArray, more: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(phrases), 50_000):
        part = slice(at, at + 50_000)
        lang = pa.DictionaryArray.from_arrays(pa.array(code[part], pa.int32()), pa.array(names, pa.string())).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang, phrases[part], *(pa.array(v[part], pa.int64()) for v in more.values())], names=["lang", "phrase", *more])


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f): occurrences of each word of ``docs`` (lang, text); the empty phrase has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, names in shards(batches, 1):
            n = np.bincount(w.at, minlength=len(w.vocabulary))
            yield from _rows(names, w.lang, w.vocabulary, {"n": n})
            yield from _rows(names, np.arange(len(names)), pa.array([b""] * len(names)), {"n": np.bincount(w.lang, n, len(names))})

    text_batches(docs.sparkSession)
    states = docs.select("lang", "text").mapInArrow(run, "lang string, phrase binary, n long")
    return states.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))


def places(w: Words, names: list[str], depth: int, filters: list[Filter]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length up to ``depth`` where phrases of it end whose words, pairs ... may be frequent, all words' names of that length, and marks of their neighbours.

    A mark is 8 bits of the words before and behind a phrase, of its own piece.
    """
    word = word_names(w.vocabulary, np.array([_salt(x) for x in names], np.uint64)[w.lang])
    ok = filters[0].holds(word)[w.at]
    name = word = word[w.at]
    none = np.zeros(1, np.uint64)
    behind = np.concatenate((np.where(w.follows[1:], word[1:], 0), none))[: len(word)]
    before = np.where(w.follows, np.concatenate((none, word[:-1]))[: len(word)], 0)
    for d in range(1, depth + 1):
        if d > 1:
            ok = ok & np.concatenate(([False], ok[:-1]))[: len(ok)] & w.follows
            name = longer_names(np.concatenate((name[:1], name[:-1])), word)
            before = np.concatenate((none, before[:-1]))[: len(word)]
            if d <= len(filters):
                at = np.flatnonzero(ok)
                ok[at] = filters[d - 1].holds(name[at])
        yield ok, name, longer_names(before, behind) >> np.uint64(56)


def count_phrases(docs: DataFrame, shortest: int, longest: int, filters: list[Filter], *, reach: int) -> DataFrame:
    """(name, mark, f): occurrences of phrases of ``shortest`` to ``longest`` words that pass the filters of their words, pairs ..., by name.

    Every task makes automata of its own texts; their states' numbers of ends are
    added up over its texts, and then over all tasks. ``mark`` is the least mark of
    some occurrences, by which one is found again; ``reach`` is the most words of
    any round, so that long texts are cut alike in all of them.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filters)  # bits, MOST_BITS of each at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for w, names in shards(batches, reach + 1):
            levels = list(places(w, names, longest, sent.value))
            a = automaton(w.at, [ok for ok, _, _ in levels], w.counted)
            for size in range(shortest, longest + 1):
                rows = np.flatnonzero((a.shortest <= size) & (size <= a.longest) & (a.ends > 0))
                last, (_, name, mark) = a.last[rows], levels[size - 1]
                held.append(pa.table({"name": name[last].view(np.int64), "n": a.ends[rows], "mark": mark[last].astype(np.int32)}))
            if sum(t.num_rows for t in held) > _HELD:
                held = [_added(held)]
                if held[0].num_rows > _HELD // 2:
                    yield from held.pop().to_batches(50_000)
        if held:
            yield from _added(held).to_batches(50_000)

    text_batches(spark)
    rows = docs.select("lang", "text").mapInArrow(run, "name long, n long, mark int")
    return rows.groupBy("name").agg(F.min("mark").alias("mark"), F.sum("n").alias("f"))


#: Rows of counts that a task holds before it sends them.
_HELD = 250_000


def _added(tables: list[pa.Table]) -> pa.Table:
    """One row for each name."""
    out = pa.concat_tables(tables).group_by("name").aggregate([("n", "sum"), ("mark", "min")])
    return out.rename_columns({"n_sum": "n", "mark_min": "mark"}).select(["name", "n", "mark"])


def spelt(docs: DataFrame, longest: int, filters: list[Filter], wanted: Filter) -> DataFrame:
    """(lang, phrase, name): the words of phrases of ``wanted``, which holds each name with one mark; seldom of others."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((filters, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marked = sent.value
        for w, names in shards(batches, longest + 1):
            for size, (ok, name, mark) in enumerate(places(w, names, longest, known), 1):
                at = np.flatnonzero(ok) if size > 1 else np.empty(0, np.int64)
                at = at[marked.holds(longer_names(name[at], mark[at]))]
                first = np.unique(name[at], return_index=True)[1]
                at = at[first]
                yield from _rows(names, w.lang[w.at[at]], w.phrases(at, size), {"name": name[at].view(np.int64)})

    text_batches(spark)
    rows = docs.select("lang", "text").mapInArrow(run, "lang string, phrase binary, name long")
    return rows.select("lang", F.col("phrase").cast("string").alias("phrase"), "name").distinct()


def named(words: DataFrame) -> DataFrame:
    """(name): the names of words (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = np.array([_salt(x) for x in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word_names(batch.column(1).cast(pa.binary()), salts).view(np.int64))], names=["name"])

    return words.select("lang", "phrase").mapInArrow(run, "name long")


def name_filter(names: DataFrame) -> Filter:
    """A filter of names (name), with their marks if there is a column ``mark``; 16 bits a name, at most ``MOST_BITS``.

    Tasks make the bits, equal places are joined before they are collected.
    """
    bits, count = 1 << 10, names.count()
    while bits < 16 * count and bits < MOST_BITS:
        bits *= 2
    mask = np.uint64(bits - 1)
    marked = "mark" in names.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(0).to_numpy().view(np.uint64)
            name = longer_names(name, batch.column(1).to_numpy().astype(np.uint64)) if marked else name
            spots = np.unique(np.concatenate(Filter.spots(name, mask)))
            slot = (spots >> np.uint64(6)).astype(np.int64)
            at = np.flatnonzero(np.diff(slot, prepend=-1))
            joined = np.bitwise_or.reduceat(np.uint64(1) << (spots & np.uint64(63)), at)
            yield pa.RecordBatch.from_arrays([pa.array(slot[at]), pa.array(joined.view(np.int64))], names=["slot", "bits"])

    rows = names.select("name", *["mark"] * marked).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Filter(out)


def _first_words(words: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), k), " ")


def _last_words(words: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, -k, k), " ")


def collocations(docs: DataFrame, *, longest: int = 5, least: int = 100, top: int = 2000, share: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by their weakest cut.

    Counts are made in rounds of words, pairs, triples, and all longer phrases; only
    what is frequent in all of a language goes into longer ones, since a phrase is
    no more frequent than its parts. Filters between rounds are bits of bounded
    size, which may let too much through. Phrases are counted by names of 64 bits,
    and spelt by a last round over the texts, once they are known to be frequent.

    A phrase is subsumed if a longer one that holds it has ``share`` hundredths of
    its count. At 100, where both counts are equal, so is that of a phrase of one
    word more: before it, whose suffix link leads to it, or after it. Only other
    shares look at all sub-phrases.

    A null text is empty, a null language ``und``, together with rows that say so.
    Repeated rows count each; ties go as the contract says, by the phrase's bytes
    at last; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = checkpoint(count_words(rows).where((F.col("f") >= least) | (F.col("phrase") == "")), 10_000)
    totals = words.where("phrase = ''").select("lang", F.col("f").alias("n"))
    words = words.where("phrase <> ''")
    filters, counts = [name_filter(named(words))], None
    for size in range(2, min(longest, 4) + 1):
        most = longest if size == 4 else size  # longer ones are few by then
        found = checkpoint(count_phrases(rows, size, most, filters, reach=longest).where(F.col("f") >= least), 10_000)
        counts = found if counts is None else counts.unionByName(found)
        if size < most or size == longest:
            break
        filters.append(name_filter(found.select("name")))
    spellings = spelt(rows, longest, filters, name_filter(counts.select("name", "mark")))
    phrases = checkpoint(spellings.join(counts.select("name", "f"), "name").select("lang", "phrase", "f"), 10_000)
    counts = words.unionByName(phrases)
    split = F.split("phrase", " ")
    candidates = counts.withColumn("words", split).where(F.size("words") >= 2).select("lang", "phrase", "words", F.col("f").alias("a"))
    # subsumed phrases
    m = F.size("words")
    if share == 100:
        inner = F.array(_last_words(F.col("words"), m - 1), _first_words(F.col("words"), m - 1))
    else:
        spans = F.transform(F.sequence(F.lit(2), m - 1), lambda k: F.transform(F.sequence(F.lit(1), m - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")))
        inner = F.flatten(spans)
    longer = candidates.where(m > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (F.col("_most") * 100 < F.col("a") * share)).drop("_most")
    # every cut's parts are as frequent as the phrase, so their counts are known
    parts = small_side(counts.select("lang", F.col("phrase").alias("_part"), F.col("f").alias("_f")), 50_000)
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _first_words(F.col("words"), F.col("k")).alias("_first"), _last_words(F.col("words"), m - F.col("k")).alias("_rest"))
    cuts = cuts.join(parts.select("lang", F.col("_part").alias("_first"), F.col("_f").alias("l")), ["lang", "_first"])
    cuts = cuts.join(parts.select("lang", F.col("_part").alias("_rest"), F.col("_f").alias("r")), ["lang", "_rest"])
    cuts = cuts.join(F.broadcast(totals), "lang")  # a row for each language
    # products are exact to 38 digits; beyond them the query fails
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c")).select("lang", "phrase", "a", "n", "_c.score", "_c.l", "_c.r")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM lists GROUP BY lang
), grams AS (
  SELECT lang, m, unnest([array_to_string(w[i : i + m - 1], ' ') FOR i IN range(1, CAST(len(w) - m + 2 AS BIGINT))]) AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m
), counts AS (
  SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE m >= 2
), inside AS (
  SELECT lang, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, CAST(m - k + 2 AS BIGINT))]) AS phrase, a
  FROM candidates, (SELECT unnest([2, 3, 4]) AS k) WHERE k < m
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase WHERE o.most IS NULL OR 100 * o.most < 100 * c.a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, t.n, 1000 * c.a * t.n // (x.f * y.f) AS score
  FROM kept c JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON k < c.m JOIN totals t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.m], ' ')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE c = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
