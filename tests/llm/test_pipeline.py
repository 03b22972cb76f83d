import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from phasewright.llm.jaccard_join import Rule, one_of_each

from .test_decontamination import brute as brute_leaks
from .test_jaccard import brute as brute_components
from .test_jaccard import corpus
from .test_lines import brute as brute_lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)


def test_one_of_each(spark):
    rows = corpus(8, families=6, size=10)
    rows += [(1, rows[1][1]), (2, "a text of its own that shares the id"), (None, rows[0][1]), (900, None), (901, ""), (902, None)]
    docs = docs_of(spark, rows)
    kept = one_of_each(docs, Rule(5, 80))
    assert kept.columns == docs.columns
    got = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    comps = brute_components(rows, 5, 80)
    of = {}
    for (d, n, c), (e, t) in zip(comps, sorted([(d, t) for d, t in rows], key=str), strict=False):
        of.setdefault(c, []).append((d, t))
    names = {c for _, n, c in comps if n and c is not None}
    assert len(got) == len(names) + sum(n == 0 for _, n, _ in comps) + len({c for _, n, c in comps if n and c is None})
    assert {d for d, _ in got if d is not None} >= names


def test_stages_and_whole_run(spark, tmp_path):
    r = random.Random(12)
    lexicon = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    sentence = lambda: " ".join(r.choice(lexicon) for _ in range(r.randint(8, 20))).capitalize() + "."
    prose = lambda: "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(r.randint(1, 5)))
    items = [(i, " ".join(sentence() for _ in range(3))) for i in range(6)]
    rows = [(i, prose()) for i in range(140)]
    rows += [(200 + i, " ".join(f"{w.upper()}!! {w}$$$" for w in prose().split())) for i in range(60)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    rows += [(400 + i, prose() + "\n" + items[i % 6][1] + "\n" + prose()) for i in range(12)]
    rows += [(500, None), (501, "")]
    docs = docs_of(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 0 if 200 <= d < 300 else 1, 0) for d, _ in rows if d < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    d, now = str(tmp_path), docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(x.doc_id, x.text) for x in now.collect()] if k < 4 else None
        out = stage(spark, now, d)
        if k == 4:
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/stage{k}")
        now = spark.read.parquet(f"{d}/stage{k}")
        after = {x.doc_id: x.text for x in now.collect()}
        if k == 0:
            assert not [x for x in after if 200 <= x < 300] and {x for x, t in before if t and not 200 <= x < 300} <= set(after)
        if k == 1:
            want = {x: t for x, n, gone, t in brute_lines(before) if not gone or gone < n}
            assert after == want
        if k == 2:
            comps = brute_components(before, 5, 80)
            assert set(after) == {c if n else x for x, n, c in comps}
        if k == 3:
            assert set(after) == {x for x, _ in before} - {x for x, _ in brute_leaks(before, items)}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {x: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for x, t in after.items()}
    packed = out.collect()
    for x in {p.doc_id for p in packed}:
        assert sum(p.length for p in packed if p.doc_id == x) == total[x]
    assert {p.doc_id for p in packed} == set(total)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(map(tuple, packed))
