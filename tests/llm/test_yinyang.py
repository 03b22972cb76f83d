import hashlib
import math

import numpy as np
import pytest

from phasewright.llm import yinyang as y

VECTORS = "vec_id long, embedding array<float>, cluster int, distance string, q string"


def brute(rows, k, rounds, size):
    kept = [(i, [math.floor(float(np.float32(x)) * 64) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in seeds[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        a = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, x) in zip(kept, a, strict=True) if x == j]
            if mine:
                c[j] = [sum(z) // len(mine) for z in zip(*mine, strict=True)]
    a = assign()
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    total = {j: sum(d for d, x in a if x == j) for j in range(len(c))}
    return sorted(((-1 if i is None else i), j, d, total[j], sum(total.values()), names[j]) for (i, _), (d, j) in zip(kept, a, strict=True))


def run(spark, rows, **how):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS).repartition(3)
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, y.clusters(table, **how).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6)) * 2
    rows = [(i, (centres[i % 9] + rng.normal(size=6) * 0.4).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(500, 560)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, [0.0] * 6)]
    rows += [(600, None), (601, []), (602, [1.0] * 5), (603, [1.0] * 5 + [None]), (604, [float("nan")] * 6), (605, [float("inf")] * 6), (606, [-0.0] * 6)]
    for how in ({"k": 16, "rounds": 3}, {"k": 5, "rounds": 4, "groups": 2}, {"k": 40, "rounds": 2, "groups": 7}, {"k": 1, "rounds": 1}, {"k": 3, "rounds": 0}):
        assert run(spark, rows, size=6, **how) == brute(rows, how["k"], how["rounds"], 6)
    few = rows[:4]
    assert run(spark, few, size=6) == brute(few, 16, 3, 6)
    assert run(spark, [(1, None)], size=6) == [] == run(spark, rows[:0], size=6)
    same = [(i, [1.0, 2.0]) for i in range(40)]
    assert run(spark, same, size=2, k=4) == brute(same, 4, 3, 2)


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(np.float32(3e6 * (i % 3) + i)), float(i)]) for i in range(30)] + [(99, [3e7, 2.0])]
    assert run(spark, rows, size=2, k=4) == brute(rows, 4, 3, 2)
    with pytest.raises(Exception, match="beyond a long"):
        run(spark, [(0, [0.0, 1.0]), (1, [1e30, 1.0]), (2, [3e38, 1.0])], size=2, k=1)
    far = [(i, [3e38, float(i)]) for i in range(3)]  # sums of over a hundred bits
    assert run(spark, far, size=2, k=1) == brute(far, 1, 3, 2)


def test_bounds_spare_distances():
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (16, 8))
    q = np.concatenate([c + rng.integers(-60, 60, (200, 8)) for c in centres]).astype(float)
    c = [list(map(int, q[i * 200])) for i in range(16)]
    groups = y.centroid_groups(c, 4)
    assert sorted(np.concatenate(groups)) == list(range(16))
    a, upper, lower = y.scan(q, c, groups)
    after = [[int(v) for v in np.floor(q[a == j].mean(axis=0))] for j in range(16)]
    drift = np.array([math.dist(u, v) for u, v in zip(c, after, strict=True)])
    a, upper, lower, taken = y.step(q, a, upper, lower, after, groups, drift)
    assert taken < 0.25 * len(q) * 16
    want, d, _ = y.scan(q, after, groups)
    assert (a == want).all() and (upper >= d - 1e-6).all()
    for g, members in enumerate(groups):
        for i in range(len(q)):
            others = [math.dist(q[i], after[j]) for j in members if j != a[i]]
            assert not others or lower[i, g] <= min(others) + 1e-6
