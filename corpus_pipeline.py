"""From documents to packed training sequences, one stage at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from phasewright.llm.common import table
from phasewright.llm.decontamination import drop_contaminated
from phasewright.llm.jaccard_join import one_of_each
from phasewright.llm.line_dedup import added_names, dedup_lines
from phasewright.llm.packing import best_fit_packing
from phasewright.llm.quality import keep_good

#: Trees, suffix arrays and packing can't be written as SQL; tests/llm checks each stage against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; a null text is judged as an empty one, repeated rows alike."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those of which nothing is left go.

    Null and empty texts stay as they are. Rows repeated whole are one document.
    """
    cut = dedup_lines(docs)
    n_lines, n_deleted, _ = map(F.col, added_names(docs))
    left = cut.where((n_deleted == 0) | (n_deleted < n_lines))
    return left.withColumn("n_chars", F.when(n_deleted > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, 0.8.

    Of a repeated row one stays; null and empty texts stay, as do groups in which no document has an id.
    """
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage is like a benchmark item; null and empty texts stay, an empty benchmark leaves all."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 2048 tokens; a null text is empty, a null id stays null."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents`` in order; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
