"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP11_SQL, op11_phrase_collocations
from .decontamination import op4_benchmark_decontamination
from .html_extraction import op10_html_extraction
from .jaccard_join import op6_ngram_jaccard_join
from .licenses import op9_license_scan
from .line_dedup import OP8_SQL, op8_line_dedup
from .packing import op3_best_fit_packing
from .quality import op1_quality_classifier
from .substring_dedup import op7_substring_dedup
from .token_counts import op2_token_counts
from .topk import OP5_SQL, op5_exact_top_k
from .toxicity import op13_toxicity
from .yinyang import OP12_SQL, op12_centroid_clusters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_token_counts": op2_token_counts,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_license_scan": op9_license_scan,
        "op10_html_extraction": op10_html_extraction,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_centroid_clusters": op12_centroid_clusters,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_top_k": OP5_SQL,
        "op8_line_dedup": OP8_SQL,
        "op11_phrase_collocations": OP11_SQL,
        "op12_centroid_clusters": OP12_SQL,
    }
