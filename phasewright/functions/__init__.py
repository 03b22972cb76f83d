"""Scalar functions over columns; each stays inside generated code or higher-order functions."""

from .alignment import cigar_counts, cigar_ops, realigned, reference_span
from .depth import counts_per_million, depth_class, depth_code, presence, reads_per_kilobase, support_class
from .patterns import effective_pairs, flip, flip_strict, genotype_difference, lod_score, match_report, match_score, recombination_percent
from .reads import barcode_parts, canonical_locus, corrected_barcode, is_reverse, read_end, sam_tag
from .text import complement_reverse, complement_reverse_lower, count_of, even_hash, half_away, path_part, split_tokens, without

__all__ = [
    "barcode_parts", "canonical_locus", "cigar_counts", "cigar_ops", "complement_reverse", "complement_reverse_lower", "corrected_barcode", "count_of",
    "counts_per_million", "depth_class", "depth_code", "effective_pairs", "even_hash", "flip", "flip_strict", "genotype_difference", "half_away", "is_reverse",
    "lod_score", "match_report", "match_score", "path_part", "presence", "read_end", "reads_per_kilobase", "realigned", "recombination_percent", "reference_span",
    "sam_tag", "split_tokens", "support_class", "without",
]
