import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from phasewright.llm.packing import best_fit_packing, fullest, patterns
from phasewright.llm.token_counts import token_counts
from phasewright.llm.tokens import TokenCounter, WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "a", "Hello  world\n\n it's I'LL 123456", "<|endoftext|> x<|startoftext|>", "日本語のテキスト ΑΣ ΣΑΣ.", "é É ﬁ İstanbul ß ſ",
    "\x00\x1c\x85  \xa0\xa0x", "x" * 5000, "🙂🙂 👩‍👩‍👧 नमस्ते", "the the\tthe \r\n  ", "…—“quoted” €5 naïve Straße Ŝanĝo", "ȺȾ İ a", "日本 the ½ ²³ ｈｅｌｌｏ the", "word ￼ " * 70_000 + "é" * 200_000,
]
DOCS = "doc_id long, text string, n_tokens string, piece string"


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_as_the_library(text):
    assert TokenCounter(BYTE).count(text) == len(Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids)
    ids = np.frombuffer(WordEncoder(WORD).encode(text), "<u4").tolist()
    assert ids == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids


counter, encoder, byte_lib, word_lib = TokenCounter(BYTE), WordEncoder(WORD), Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_tokens_of_any_text(text):
    assert counter.count(text) == len(byte_lib.encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == word_lib.encode(text, add_special_tokens=False).ids


def test_every_plain_character():
    from phasewright.llm.tokens import _CHARACTERS

    for c in _CHARACTERS:
        for text in (c, f"a{c}b", f"1{c} {c}2", f"{c}{c} '{c}"):
            assert counter.count(text) == len(byte_lib.encode(text, add_special_tokens=False).ids), repr(text)
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == word_lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_of_counts_is_bounded():
    from phasewright.llm import tokens

    kept = tokens.Kept(len)
    assert all(kept[f"{i}"] == len(f"{i}") for i in range(3)) and kept["x" * 100] == 100 and "x" * 100 not in kept
    kept.old, before = {"again": 5}, len(kept)
    assert kept["again"] == 5 and len(kept) == before + 1


def test_count_table(spark):
    rows = [(1, None, "x", "y"), (1, None, "x", "y"), (None, "ab cd", None, None), (2, "word " * 600, "", "")]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, DOCS), BYTE).collect()), key=str)
    assert got == sorted([(1, 0, 0, False)] * 2 + [(None, 5, counter.count("ab cd"), False), (2, 3000, counter.count("word " * 600), True)], key=str)
    assert token_counts(spark.createDataFrame([], DOCS), BYTE).count() == 0


def brute_fullest(counts, capacity):
    root = max(counts)
    items = [k for k, n in counts.items() for _ in range(n - (k == root)) if k <= capacity - root]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= capacity - root}
    return root + max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=8))
def test_fullest_bin(counts):
    chosen = fullest(counts, 30)
    assert all(n <= counts[k] for k, n in chosen.items())
    assert sum(k * n for k, n in chosen.items()) == brute_fullest(counts, 30)
    total = defaultdict(int)
    for bin_, times in patterns(counts, 30):
        assert sum(k * n for k, n in bin_.items()) <= 30
        for k, n in bin_.items():
            total[k] += n * times
    assert dict(total) == counts


def check_packing(spark, rows, schema=DOCS, capacity=64):
    got = best_fit_packing(spark.createDataFrame(rows, schema), WORD, capacity=capacity).collect()
    want = []
    for r in rows:
        ids = np.array([*word_lib.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r[0], i, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for i, at in enumerate(range(0, len(ids), capacity))]
    assert sorted([tuple(g)[:5] for g in got], key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return bins, sum(w[3] for w in want)


def test_packing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "unlikely", "Ωmega", "42"], rng.integers(0, 150))), None, "p") for i in range(300)]
    rows += [(1, None, None, None), (1, None, None, None), (None, "a b", "", ""), *[(7, "same text here", "", "")] * 400]
    bins, total = check_packing(spark, rows)
    assert len(bins) <= -(-total // 64) + 2
    assert best_fit_packing(spark.createDataFrame([], DOCS), WORD).count() == 0
