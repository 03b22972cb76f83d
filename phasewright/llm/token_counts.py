"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table
from .tokens import token_counter


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Bytes and tokens of every text.

    A table made once per worker holds each vocabulary string that provably
    encodes alone as one token (it is merged alone and must come back whole).
    Pre-tokens in it count one each; only the others are merged, and their counts
    are kept in bounded memory.

    A null text is empty: 0 bytes, 0 tokens. A null id stays null; repeated rows
    give repeated rows; an empty table gives none; other columns are not read.
    Strings of special tokens inside a text count one each, as the library does
    by default.
    """

    def work(x: dict[str, list]) -> dict[str, object]:
        counter = token_counter(tokenizer_path)
        texts = [t or "" for t in x[text_col]]
        tokens = [counter.count(t) for t in texts]
        return {"doc_id": x[id_col], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return map_texts(docs, [id_col, text_col], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", work)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` counted with the byte-level vocabulary."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
