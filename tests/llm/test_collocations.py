import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from phasewright.llm import collocations as c

DOCS = "doc_id long, text string, lang string, score string, rank int, n int, f int"


def brute(rows, longest=5, least=3, top=2000, share=100):
    totals, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for q, b in cand.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    if 100 * b >= share * cand[q[i : i + m]]:
                        gone.add(q[i : i + m])
        scored = []
        for p, a in cand.items():
            if p not in gone:
                s, k = min((1000 * a * totals[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, lo, r, totals[lang], -s) for i, (s, a, p, lo, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["A", "b", "Cé", "d\x0b e", "x", "ÄB", "y\xa0z", "the", "of\t\tthe"]
    texts = [rng.choice([" ", ""]).join("") + "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "\t", ".", " "]) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [(t, rng.choice(["en", "de", None, "und"])) for t in texts] + [(None, "en"), ("", None), (" ,. \n", "fr"), ("only one", ""), ("a b " * 4000, "en")] + [(texts[3], "en")] * 5


def test_against_brute_force(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(i, *r, "x", 1, 2, 3) for i, r in enumerate(rows)], DOCS).repartition(5)
    for how in ({}, {"share": 80}, {"longest": 3, "top": 7}, {"longest": 2}):
        assert sorted(map(tuple, c.collocations(docs, least=3, **how).collect())) == brute(rows, **how)
    assert c.collocations(docs.limit(0)).count() == 0
    assert c.collocations(docs, least=10**6).count() == 0


def test_large_counts_are_exact(spark):
    rows = [("a b", "x")] * 40
    got = c.collocations(spark.createDataFrame(rows, "text string, lang string"), least=40).first()
    assert tuple(got) == ("x", 1, "a b", 40, 40, 40, 80, 2000)


def test_automaton_states_hold_all_phrases():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 4, 300)
    follows = rng.random(300) < 0.9
    follows[0] = False
    valid = [np.ones(300, bool)]
    for _ in range(4):
        valid.append(valid[-1] & np.concatenate(([False], valid[-1][:-1])) & follows)
    a = c.automaton(base, valid, np.ones(300, bool))
    want = Counter(tuple(base[i - d + 1 : i + 1]) for d in range(1, 6) for i in np.flatnonzero(valid[d - 1]))
    got = {}
    for s in range(len(a.ends)):
        for d in range(a.shortest[s], a.longest[s] + 1):
            p = tuple(base[a.last[s] - d + 1 : a.last[s] + 1])
            assert p not in got
            got[p] = a.ends[s]
        if a.link[s] >= 0:
            assert a.longest[a.link[s]] == a.shortest[s] - 1 and a.ends[a.link[s]] > a.ends[s]
    assert got == want


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "bb", "ccc" * 9]) + rng.choice([" ", ". ", "  "]) for _ in range(400)).encode().translate(c._PLAIN)
    monkeypatch.setattr(c, "SHARD", 40)
    for start in (text, b" " * 100 + text, b"x" * 200, b"", b" " * 90):
        batch = pa.record_batch({"lang": ["en", "en"], "text": [start.decode(), "a bb"]})
        counts = Counter()
        for w, _ in c.shards(iter([batch]), 3):
            valid = [np.ones(len(w.at), bool)]
            for _ in range(2):
                valid.append(valid[-1] & np.concatenate((valid[-1][:0], [False], valid[-1][:-1]))[: len(w.at)] & w.follows)
            for d, ok in enumerate(valid, 1):
                at = np.flatnonzero(ok & w.counted)
                counts.update(w.phrases(at, d).to_pylist())
        want = Counter()
        for piece in [*start.split(b"\n"), b"a bb"]:
            words = piece.split()
            want.update(b" ".join(words[i : i + d]) for d in (1, 2, 3) for i in range(len(words) - d + 1))
        assert counts == want


def test_filters_lose_nothing(spark):
    words = [f"w{i}" for i in range(3000)]
    one = c.name_filter(c.named(spark.createDataFrame([("en", w) for w in words], "lang string, phrase string")))
    names = c.word_names(pa.array([w.encode() for w in words]), np.full(len(words), c._salt("en")))
    assert one.holds(names).all() and one.holds(c.mix(names)).mean() < 0.1
    text = " ".join(words[i % 3000] for i in range(4000))
    docs = spark.createDataFrame([(i, text) for i in ("en", "de")], "lang string, text string")
    both = c.name_filter(c.named(docs.selectExpr("lang", "explode(split(text, ' ')) AS phrase").distinct()))
    got = c.count_phrases(docs, 2, 2, [both], reach=5)
    assert got.count() == 6000 and {r.f for r in got.collect()} == {1, 2}
    two = c.name_filter(got.select("name"))
    assert two.holds(c.longer_names(names[:-1], names[1:])).all()
    some = got.where("f = 2").orderBy("name").limit(50)
    spelt = c.spelt(docs, 5, [both, two], c.name_filter(some.select("name", "mark"))).join(some, "name").collect()
    assert len(spelt) == 50 and {r.phrase for r in spelt} <= {f"w{i} w{i + 1}" for i in range(1000)}
