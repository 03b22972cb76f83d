import math

import numpy as np
import pytest

from phasewright.llm.topk import exact_top_k

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank int"


def brute(rows, k, every):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(float(np.float32(x)) * 64) for x in v]))
    out = set()
    for i, q in {i: q for i, q in reversed(sorted(good, key=lambda g: (g[0], g[1]))) if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.2, 1, 3])).astype(np.float32).tolist()) for i in range(300)]
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(i, same) for i in range(300, 420)]
    rows += [(500, None), (520, []), (540, [1.0, None]), (560, [float("nan")] * 8), (580, [float("inf")] + [0.0] * 7), (600, [0.0] * 8), (620, [1.0, 2.0]), (640, [1e5] * 8), (None, same), (7, rows[7][1])]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    for how in ({}, {"block_rows": 50, "group_rows": 5}):
        got = list(map(tuple, exact_top_k(table, k=20, every=20, **how).collect()))
        assert len(got) == len(set(got)) and set(got) == brute(rows, 20, 20)
    few = spark.createDataFrame([(*r, 1, "x", 2) for r in rows[:5]], VECTORS)
    assert set(map(tuple, exact_top_k(few).collect())) == brute(rows[:5], 20, 20)
    assert exact_top_k(table.limit(0)).count() == 0


def test_large_and_empty_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=2).astype(np.float32).tolist()) for i in range(1, 60)]
    rows += [(80, [1.0, 2.0]), (81, [4e7, 1.0]), (82, [-4e7, 3e5]), (100, []), (101, []), (120, [3e7, 7e6])]
    for more in ([], [(140, [0.0, 1.0]), (141, [-3e38, 1.0])]):
        these = [r for r in rows if not more or r[1][:1] and (r[0] % 20 or r[1][0] > 0)] + more
        table = spark.createDataFrame([(*r, 1, "x", 2) for r in these], VECTORS)
        for how in ({}, {"block_rows": 16, "group_rows": 2}):
            assert set(map(tuple, exact_top_k(table, **how).collect())) == brute(these, 20, 20)
    for bad in ([(20, [1.0]), (21, [3e38])], [(20, [1.0]), (21, [-3e38])]):
        with pytest.raises(Exception, match="beyond a long|below every long"):
            exact_top_k(spark.createDataFrame([(*r, 1, "x", 2) for r in bad], VECTORS)).collect()
    none = spark.createDataFrame([(20, [], 1, "x", 2), (21, [], 1, "x", 2)], VECTORS)
    assert list(map(tuple, exact_top_k(none).collect())) == [(20, 1, 21, 0)]
