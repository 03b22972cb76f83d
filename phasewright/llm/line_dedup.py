"""Line dedup: a suffix array over line names by distributed prefix doubling. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import checkpoint, spare_names, table

_TRIMMED = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_TRIMMED)))


def line_sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pos, end, doc_id, text_hash, idx, words, h1, h2): every line that is not blank, in corpus order.

    ``pos`` rises with doc_id, then with the text's hash, then with the line;
    lines of a document have consecutive numbers and ``end`` is one past its last.
    Rows repeated whole (same id and text) are one document.
    """
    text = F.col(text_col)
    line = lambda x, i: F.struct(i.alias("idx"), F.xxhash64(x).alias("h1"), F.hash(x, F.length(x)).alias("h2"), F.size(F.split(x, "[ \t\r\x0b\x0c]+")).alias("words"), (x == "").alias("blank"))  # noqa: E731
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.filter(F.transform(_lines(text), line), lambda s: ~s.blank).alias("lines"))
    rows = checkpoint(rows.where(F.size("lines") > 0).dropDuplicates(["doc_id", "text_hash"]))
    ordered = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    each = ordered.select("doc_id", "text_hash", F.size("lines").alias("_n"), F.posexplode("lines").alias("_k", "_line"))
    each = each.withColumn("pos", F.monotonically_increasing_id())
    return checkpoint(each.select("pos", (F.col("pos") - F.col("_k") + F.col("_n")).alias("end"), "doc_id", "text_hash", "_line.idx", "_line.words", "_line.h1", "_line.h2"))


def _named(rows: DataFrame, key: list[str]) -> DataFrame:
    """(pos, end, name, name_end) of the blocks that occur more than once; the name is the first one's position.

    Counted before it is shuffled, so that a block that is a third of all is one
    row from each task; rows are joined to their names, whose large partitions
    can be split.
    """
    names = rows.groupBy(*key).agg(F.min(F.struct("pos", "end")).alias("_f"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    names = names.select(*key, F.col("_f.pos").alias("name"), F.col("_f.end").alias("name_end"))
    return checkpoint(rows.join(names, key).select("pos", "end", "name", "name_end"))


def block_levels(sequences: DataFrame) -> list[DataFrame]:
    """By level: (pos, end, name, name_end) of the blocks of 2**level lines that occur more than once.

    Prefix doubling: names of two adjacent blocks name the block of twice the
    length. Sorted by its names of rising level, a suffix stands in the suffix
    array; those of one name at a level are an interval whose longest common
    prefix is 2**level lines or more. A suffix leaves as soon as its prefix is
    unique, and doubling ends when all have left.
    """
    out = [_named(sequences.select("pos", "end", "h1", "h2"), ["h1", "h2"])]
    while not out[-1].isEmpty():
        size, active = 2 ** (len(out) - 1), out[-1]
        following = active.select((F.col("pos") - size).alias("pos"), F.col("name").alias("_next"))
        pairs = active.join(following, "pos").where(F.col("pos") + 2 * size <= F.col("end"))
        out.append(_named(pairs.select("pos", "end", F.col("name").alias("_first"), "_next"), ["_first", "_next"]))
    return out[:-1]


def repeated_blocks(sequences: DataFrame) -> DataFrame:
    """(pos, end, level, name): the blocks of all levels in one table."""
    levels = block_levels(sequences)
    if not levels:
        return sequences.select("pos", "end", F.lit(0).alias("level"), F.col("pos").alias("name")).limit(0)
    return reduce(DataFrame.unionByName, [b.select("pos", "end", F.lit(i).alias("level"), "name") for i, b in enumerate(levels)])


def longest_copies(blocks: list[DataFrame]) -> DataFrame:
    """(pos, run, first): the longest run of lines at ``pos`` that also begins earlier, and where it first does.

    From the widest blocks down, a suffix goes to deeper intervals of longest
    common prefixes for as long as they hold an earlier suffix. An interval is
    named by its first suffix and its depth. If the first suffix goes on as this
    one does, it is the first of the deeper interval too; if not, all suffixes of
    the deeper interval have an earlier one at the present depth, so they are at
    this very step, and the least of them is the first.
    """
    at = None
    for level in range(len(blocks) - 1, -1, -1):
        size, names = 2**level, blocks[level]
        begun = names.where("name < pos").select("pos", "end", F.lit(size).cast("long").alias("run"), F.col("name").alias("first"), F.col("name_end").alias("first_end"))
        if at is None:
            at = begun
            continue
        # what follows this suffix's run, and what follows the first one's, in the same document
        next_ = lambda c: names.select((F.col("pos")).alias(f"_{c}"), F.col("end").alias(f"_{c}_end"), F.col("name").alias(c))  # noqa: E731
        going = at.join(next_("mine"), (F.col("pos") + F.col("run") == F.col("_mine")) & (F.col("end") == F.col("_mine_end")))
        going = going.join(next_("other"), (F.col("first") + F.col("run") == F.col("_other")) & (F.col("first_end") == F.col("_other_end")), "left")
        going = checkpoint(going.select("pos", "end", "run", "first", "first_end", "mine", F.coalesce(F.col("other") == F.col("mine"), F.lit(False)).alias("_same")))
        apart = going.where("NOT _same")
        least = apart.groupBy("first", "run", "mine").agg(F.min(F.struct("pos", "end")).alias("_f"))
        moved = apart.join(least, ["first", "run", "mine"]).where(F.col("_f.pos") < F.col("pos")).select("pos", "end", "run", F.col("_f.pos").alias("first"), F.col("_f.end").alias("first_end"))
        deeper = going.where("_same").select("pos", "end", "run", "first", "first_end").unionByName(moved).withColumn("run", F.col("run") + size)
        longest = F.max(F.struct("run", "end", "first", "first_end")).alias("_b")
        at = checkpoint(deeper.unionByName(at).unionByName(begun).groupBy("pos").agg(longest).select("pos", "_b.*"))
    return at.select("pos", "run", "first")


def later_copies(sequences: DataFrame, copies: DataFrame, *, min_lines: int = 2, min_words: int = 8) -> DataFrame:
    """(pos): lines inside a later copy of a repeated run.

    A repeated run counts if it has ``min_lines`` lines or is one line of
    ``min_words`` words. The run of the next suffix is at most one line shorter,
    so the first ``min_lines`` lines of each run are all that has to be listed.
    """
    single = copies.select("pos").join(sequences.where(F.col("words") >= min_words).select("pos"), "pos", "left_semi")
    longer = copies.where(F.col("run") >= min_lines).select(F.explode(F.sequence("pos", F.col("pos") + (min_lines - 1))).alias("pos"))
    return single.union(longer).distinct()


def dedup_lines(docs: DataFrame, *, min_lines: int = 2, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and _n_lines, _n_deleted, _longest_run, with later copies of runs deleted.

    Lines are compared without white space at their ends; blank lines are no part
    of a run and stay. The first copy, by doc_id and then by line, stays whole.

    A null text has no lines and stays null. Documents of a null id come first.
    Rows repeated whole are one document: both lose what it loses. Texts of one
    id that differ are ordered by a hash. An empty table gives no rows. Other
    columns are kept as they are, whatever their names; where they have one of the
    three added ones, that gets more underscores before it (``added_names``).
    """
    sequences = line_sequences(docs, id_col=id_col, text_col=text_col)
    blocks = block_levels(sequences)
    gone = sequences.select("pos").limit(0) if not blocks else later_copies(sequences, longest_copies(blocks), min_lines=min_lines, min_words=min_words)
    gone = checkpoint(gone)
    flags = sequences.select("pos", "doc_id", "text_hash", "idx").join(gone.withColumn("gone", F.lit(1)), "pos", "left")
    by_doc = flags.groupBy("doc_id", "text_hash").agg(F.count("gone").alias("_gone"), F.sort_array(F.collect_list(F.struct("idx", F.coalesce("gone", F.lit(0)).alias("gone")))).alias("_flags"))
    d, h, found, work = spare_names(docs.columns, "_d", "_h", "_found", "_work")
    by_doc = by_doc.where("_gone > 0").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.struct("_gone", "_flags").alias(found))
    joined = docs.join(by_doc, F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(h)), "left")
    gone, flags = F.col(f"{found}._gone"), F.col(f"{found}._flags")
    # lines between two deleted ones: the k-th kept stretch ends where the k-th deleted line stands
    after = lambda a, x: F.when(x.gone == 1, a.now + 1).otherwise(0)  # noqa: E731
    longest = F.aggregate(flags, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, x: F.struct(after(a, x).alias("now"), F.greatest(a.most, after(a, x)).alias("most")), lambda a: a.most)
    cuts = F.concat(F.array(F.lit(-1)), F.transform(F.filter(flags, lambda x: x.gone == 1), lambda x: x.idx), F.array(F.size(F.split(text_col, "\n"))))
    raw, ends = F.col(f"{work}.raw"), F.col(f"{work}.cuts")
    stretch = lambda c, i: F.slice(raw, c + 2, F.get(ends, i + 1) - c - 1)  # noqa: E731
    kept = F.array_join(F.flatten(F.transform(F.slice(ends, 1, F.size(ends) - 1), stretch)), "\n")
    lines = F.size(F.filter(_lines(F.col(text_col)), lambda x: x != ""))
    out = joined.withColumn(work, F.when(gone > 0, F.struct(F.split(text_col, "\n").alias("raw"), cuts.alias("cuts"))))
    return out.select(
        *[F.when(gone > 0, kept).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        *[c.alias(name) for c, name in zip((lines, F.coalesce(gone, F.lit(0)).cast("int"), F.coalesce(longest, F.lit(0))), added_names(docs), strict=True)],
    )  # fmt: skip


def added_names(docs: DataFrame) -> list[str]:
    """The names of the three columns that ``dedup_lines`` adds."""
    return spare_names(docs.columns, "_n_lines", "_n_deleted", "_longest_run")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the lines that are left of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), F.col("_longest_run").alias("longest_run"), "text")


#: The same by windows: a line goes if it, or a pair of lines that it is in, occurs earlier.
OP8_SQL = r"""
WITH cut AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS idx
  FROM documents
), lines AS (
  SELECT doc_id, idx, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM cut
), solid AS (
  SELECT doc_id, idx, line, len(regexp_split_to_array(line, '[ 	
]+')) AS words,
         row_number() OVER (ORDER BY doc_id, idx) AS pos, lead(line) OVER (PARTITION BY doc_id ORDER BY idx) AS next_line
  FROM lines WHERE line <> ''
), firsts AS (
  SELECT *, min(pos) OVER (PARTITION BY line) AS first_line,
         CASE WHEN next_line IS NOT NULL THEN min(CASE WHEN next_line IS NOT NULL THEN pos END) OVER (PARTITION BY line, next_line) END AS first_pair
  FROM solid
), marks AS (
  SELECT *, coalesce(first_pair < pos, false) AS pair_later FROM firsts
), judged AS (
  SELECT doc_id, idx, pos,
         CASE WHEN (words >= 8 AND first_line < pos) OR pair_later OR coalesce(lag(pair_later) OVER (PARTITION BY doc_id ORDER BY idx), false) THEN 1 ELSE 0 END AS gone
  FROM marks
), islands AS (
  SELECT doc_id, sum(gone) AS run FROM (
    SELECT doc_id, gone, sum(1 - gone) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM judged) GROUP BY doc_id, island
), longest AS (
  SELECT doc_id, max(run) AS run FROM islands GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN coalesce(j.gone, 0) = 0 THEN l.raw END, chr(10) ORDER BY l.idx) AS text, count(j.idx) AS n_lines, coalesce(sum(j.gone), 0) AS n_deleted
  FROM lines l LEFT JOIN judged j USING (doc_id, idx) GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(k.n_lines AS INTEGER) AS n_lines, CAST(k.n_deleted AS INTEGER) AS n_deleted, CAST(coalesce(g.run, 0) AS INTEGER) AS longest_run,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d JOIN kept k USING (doc_id) LEFT JOIN longest g USING (doc_id)
"""
