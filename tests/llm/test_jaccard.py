import random
from itertools import combinations

import numpy as np
from hypothesis import given, settings, strategies as st

from phasewright.llm import jaccard_join
from phasewright.llm.jaccard_join import Rule, jaccard_components, low_part, shingles, signatures

DOCS = "doc_id long, text string, component_id string, key string, node string"


def brute(rows, words=4, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)], key=str)


def corpus(seed, families=12, size=14):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(50)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(r.choice((5, 12, 40, 60, 90, 300)))]
        if r.random() < 0.4:
            base += passage
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 6))):
                at = r.randrange(len(w))
                k = r.random()
                if k < 0.5:
                    w[at] = word()
                elif k < 0.75:
                    del w[at : at + 1]
                else:
                    w.insert(at, word())
                w = w or ["x"]
            rows.append((len(rows), r.choice((" ", "\n", "  ")).join(w)))
    return rows


def test_components_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 6)
    for seed in (1, 2):
        rows = corpus(seed)
        rows += [(None, rows[0][1] + " tail"), (None, None), (5000, ""), (5001, " \n"), (5002, "one two"), (5003, "ONE two"), (3, "another text of the same id"), rows[7], rows[7], (6000, "long " * 30_000)]
        got = jaccard_components(spark.createDataFrame([(*r, "x", None, None) for r in rows], DOCS)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_all_rounds_are_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    rows = corpus(5, families=3, size=40)
    got = jaccard_components(spark.createDataFrame([(*r, "x", None, None) for r in rows], DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6))
def test_linked_sets_share_a_key(seed):
    r = np.random.default_rng(seed)
    rule = Rule()
    universe = np.unique(r.integers(0, 2**62, 400))
    frequent = universe[r.random(len(universe)) < r.choice([0, 0.2, 0.7, 1])]
    n = int(r.integers(1, 300))
    x = np.sort(r.choice(universe, n, replace=False))
    y = np.unique(np.concatenate((x[r.random(n) < r.choice([0.88, 0.95, 1])], r.choice(universe, int(r.integers(0, n // 10 + 1))))))
    common = len(np.intersect1d(x, y))
    if common and 100 * common >= 85 * (len(x) + len(y) - common):
        keys = []
        for s in (x, y):
            k = signatures(low_part(s, rule), len(s), frequent, rule)
            keys.append(signatures(s, len(s), frequent, rule) if k is None else k)
        assert len(np.intersect1d(*keys))


def test_shingles():
    assert len(shingles("A b C d e a b c d", 4)) == 5
    assert len(shingles("a b", 4)) == len(shingles(" A\tB ", 4)) == 1 and len(shingles(None, 4)) == 0
    assert np.array_equal(shingles("É b c d", 4), shingles("É B C D", 4)) and not np.array_equal(shingles("É b c d", 4), shingles("é b c d", 4))
