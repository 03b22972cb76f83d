import random

import numpy as np
import pytest

from phasewright.functions import flip, lod_score, match_score
from phasewright.operators import map_completion, maps
from phasewright.operators.map_completion import completed_maps
from phasewright.operators.pattern_pairs import Planes, bit_planes, equal_places, pair_scores

MAP = "group_id string, ord int, contig string, side string, pattern string"
GATES = "group_id string, contig string, side string, pattern string"


def score(a, b, scale=True):
    a, b = a.upper(), b.upper()
    points = sum(2 if x == y else -1 for x, y in zip(a, b, strict=True) if x in "PM" and y in "PM")
    if scale:
        by = sum(x != "U" and y != "U" for x, y in zip(a, b, strict=True))
    else:
        by = a.count("P") or a.count("M")
        known = len(b) - b.count("U")
        by = known if by > known and known >= len(a) // 4 else by
    value = points * 1.0 / (by or 1) * len(a)
    return int(abs(value) + 0.5) * (1 if value >= 0 else -1)


def turned(p):
    return "".join({"P": "M", "M": "P"}.get(x, "u") for x in p)


def fold(gmap, gates, compat=False):
    """Gates one after the other, as a person would put them in."""
    lines = {}
    for g, _, c, s, p in sorted(gmap, key=lambda r: (r[0], r[1])):
        lines.setdefault(g, []).append((c, s, p, p, False, None))
    have = {(c, s) for line in lines.values() for c, s, *_ in line}
    first = {}
    for g, c, s, p in gates:
        key = (g is None, g or "", p)
        if (c, s) not in have and ((c, s) not in first or key < first[c, s][0]):
            first[c, s] = (key, g, p)
    left = set()

    def best(line, p):
        top, at = 0, None
        for i, (x, y) in enumerate(zip(line, line[1:], strict=False)):
            if x[0] != y[0] and (n := score(p, x[2]) + score(p, y[2])) > top:
                top, at = n, i
        return top, at

    for (c, s), (_, g, p) in sorted(first.items(), key=lambda r: "\t".join(r[0])):
        if g is None:
            top, place = 0, None
            for name in sorted(lines):
                for swap, q in ((False, p), (True, turned(p))):
                    n, i = best(lines[name], q)
                    if n > top:
                        top, place = n, (name, i, swap)
            if place is None:
                left.add((c, s))
                continue
            name, i, swap = place
            final = turned(p) if swap else p
            lines[name].insert(i + 1, (c, s, p if compat else final, final, swap, top))
            continue
        line = lines.get(g, [])
        mate = next((i for i, r in enumerate(line) if r[0] == c and r[1] != s), None)
        if mate is not None:
            if mate == 0:
                i = 0
            elif mate + 1 == len(line):
                i = mate + 1
            else:
                a, b = (score(p, line[mate + d][2]) for d in (-1, 1))
                i = mate if a > b or a == b and line[mate][1] == "right" else mate + 1
            line.insert(i, (c, s, p, p, False, 2 * len(p)))
        elif len(line) < 2:
            left.add((c, s))
        else:
            n, i = best(line, p)
            line.insert(1 if i is None else i + 1, (c, s, p, p, False, n))
    return {(g, i + 1, r[0], r[1], r[3], r[4], r[5]) for g, line in lines.items() for i, r in enumerate(line)}, left


def random_maps(seed, cells, markers, gates, groups=4, loose=0.4):
    r = random.Random(seed)
    pattern = lambda: "".join(r.choice("PMUPu") for _ in range(cells))
    ends = [(f"c{k}", s) for k in range(markers + gates) for s in ("left", "right")]
    r.shuffle(ends)
    gmap, at = [], {}
    for c, s in ends[:markers]:
        g = f"g{r.randrange(groups)}"
        at[c] = g
        gmap.append((g, len(gmap), c, s, pattern()))
    new = [(None if r.random() < loose else at.get(c, f"g{r.randrange(groups + 1)}"), c, s, pattern()) for c, s in ends[markers : markers + gates]]
    return gmap, [*new, new[0], (None, gmap[0][2], gmap[0][3], pattern())]


@pytest.mark.parametrize("cells", [3, 40])
def test_batches_as_one_by_one(spark, cells):
    for seed, (compat, batch) in enumerate([(False, 9), (True, 64)]):
        gmap, gates = random_maps(seed + cells, cells, 24 if seed % 2 else 9, 40)
        done = completed_maps(spark.createDataFrame(gmap, MAP), spark.createDataFrame(gates, GATES), batch_rows=batch, compat=compat)
        want, left = fold(gmap, gates, compat)
        assert set(map(tuple, done.maps.collect())) == want
        assert {(x.contig, x.side) for x in done.unplaced.collect()} == left


def test_completion_of_odd_tables(spark):
    gmap = spark.createDataFrame([("g", 1, "a", "left", "PP"), ("h", 1, "b", "left", "MM"), ("h", 2, "b", "right", "MM")], MAP)
    none = spark.createDataFrame([], GATES)
    assert completed_maps(gmap, none).maps.count() == 3 and completed_maps(gmap.limit(0), none).maps.count() == 0
    gates = spark.createDataFrame([("g", "c", "left", "PP"), ("g", "a", "right", "PP"), (None, "d", "left", "MM"), ("h", "e", "left", "PP"), ("x", "f", "left", "PP")], GATES)
    done = completed_maps(gmap, gates)
    assert [(r.group_id, r.contig, r.side, r.score) for r in done.maps.orderBy("group_id", "ord").collect()] == [("g", "a", "right", 4), ("g", "d", "left", 8), ("g", "c", "left", 0), ("g", "a", "left", None), ("h", "b", "left", None), ("h", "e", "left", 0), ("h", "b", "right", None)]
    assert {r.contig for r in done.unplaced.collect()} == {"f"}
    with pytest.raises(ValueError, match="places"):
        completed_maps(gmap, spark.createDataFrame([("g", "c", "left", "PPP")], GATES))


def test_planes_as_columns(spark):
    r = random.Random(2)
    for n in (1, 7, 59, 60, 61, 130):
        rows = [("".join(r.choice("PMUu") for _ in range(n)), "".join(r.choice("PMU") for _ in range(n))) for _ in range(12)]
        rows += [("U" * n, "P" * n), ("P" * n, "P" * n), ("M" * n, "U" * n)]
        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", bit_planes("a").alias("x"), bit_planes("b").alias("y"), match_score("a", "b").alias("s"), match_score("a", "b", scale=False).alias("t"), match_score(flip("a"), "b", scale=False).alias("f")).collect()
        x, y = Planes.of([g.x for g in got]), Planes.of([g.y for g in got])
        at = np.arange(len(got))
        assert list(pair_scores(x, y, scale=True)[at, at]) == [g.s for g in got] == [score(g.a, g.b) for g in got]
        assert list(pair_scores(x, y, scale=False)[at, at]) == [g.t for g in got]
        assert list(pair_scores(x.flipped(), y, scale=False)[at, at]) == [g.f for g in got]
        assert (pair_scores(Planes.read([g.a for g in got]), Planes.read([g.b for g in got]), scale=True) == pair_scores(x, y, scale=True)).all()
        assert equal_places(x, y)[at, at].tolist() == [sum(p == q != "U" for p, q in zip(g.a.upper(), g.b, strict=True)) for g in got]


def test_edges_as_brute_force(spark):
    r = random.Random(9)
    names = [f"c{k}" for k in range(70)]
    known = [("".join(r.choice("PMU") for _ in range(8))) for _ in range(25)]
    gates = [(c, r.choice(known), r.choice(known)) for c in names] + [("short", "PM", "PM"), ("bare", "UUUUUUUM", "PPPPPPPP")]
    want = {}
    for c, _, right in gates:
        top = None
        for o, left, _ in sorted(gates):
            if o != c and len(left) == len(right) and left.count("P") + left.count("M") >= len(left) // 3:
                equal = sum(x == y != "U" for x, y in zip(left, right, strict=True))
                if top is None or abs(2 * equal - len(left)) > top[0]:
                    top = (abs(2 * equal - len(left)), o, left)
        if top and top[0]:
            want[c] = (top[1], top[2], right)
    table = spark.createDataFrame(gates, "contig string, left_pattern string, right_pattern string")
    for block in (2048, 6):
        got = {x.from_contig: (x.to_contig, x.lod) for x in maps.contig_edges(table, block_rows=block).collect()}
        assert {c: v[0] for c, v in got.items()} == {c: v[0] for c, v in want.items()}
    pairs = spark.createDataFrame([(c, b, a) for c, (_, a, b) in want.items()], "c string, a string, b string").select("c", lod_score("a", "b").alias("lod")).collect()
    assert all(abs(got[p.c][1] - p.lod) < 1e-9 for p in pairs)
    assert maps.contig_edges(table.limit(0)).count() == 0


def test_slots_and_their_ties(spark):
    r = random.Random(5)
    for cells, scale in ((4, False), (9, True)):
        pattern = lambda n=cells: "".join(r.choice("PMU") for _ in range(n))
        gmap = [(f"g{k % 5}", k // 5, f"c{k // 10}" if k % 3 else f"d{k}", pattern()) for k in range(90)]
        markers = [(k, pattern()) for k in range(60)] + [(60, "U" * cells), (61, "P" * (cells + 1))]
        places = maps.slots(spark.createDataFrame(gmap, "group_id string, ord int, contig string, pattern string"))
        want = {}
        for k, p in markers:
            want[k] = (None, None, False, 0)
            for g in sorted({row[0] for row in gmap}):
                line = sorted((row for row in gmap if row[0] == g), key=lambda row: row[1])
                for swap, q in ((False, p), (True, turned(p))):
                    for x, y in zip(line, line[1:], strict=False):
                        if len(q) == cells and x[2] != y[2] and (n := score(q, x[3], scale) + score(q, y[3], scale)) > want[k][3]:
                            want[k] = (g, x[1], swap, n)
        table = spark.createDataFrame(markers, "marker int, marker_pattern string")
        for block in (2048, 10):
            got = {x.marker: (x.group_id, x.ord, x.swap, x.score) for x in maps.best_slots(table, places, scale=scale, block_rows=block).collect()}
            assert got == want


def test_slots_meet_patterns_once(spark, monkeypatch):
    r = random.Random(8)
    pattern = lambda: "".join(r.choice("PMU") for _ in range(3))
    gmap = [(f"g{k % 4}", k // 4, f"c{k}", pattern()) for k in range(1200)]
    markers = [(k, pattern(), f"g{r.randint(0, 3)}" if k % 2 else None) for k in range(90)]
    seen = []
    whole = maps.in_blocks

    def counted(left, right, *args, **kwargs):
        seen.append((left.count(), right.count()))
        return whole(left, right, *args, **kwargs)

    monkeypatch.setattr(maps, "in_blocks", counted)
    places = maps.slots(spark.createDataFrame(gmap, "group_id string, ord int, contig string, pattern string"))
    got = {x.marker: (x.group_id, x.ord, x.swap, x.score) for x in maps.best_slots(spark.createDataFrame(markers, "marker int, marker_pattern string, own string"), places, own_group="own").collect()}
    # without a group: 27 patterns, and pairs of them in any order; with one, those of each group
    assert seen[0][0] <= 27 and seen[0][1] <= 27 * 28 // 2 and seen[1][0] <= 4 * 27 and seen[1][1] <= 4 * 27 * 28 // 2
    lines = {g: sorted((row for row in gmap if row[0] == g), key=lambda row: row[1]) for g in sorted({row[0] for row in gmap})}
    for k, p, own in markers:
        best = (None, None, False, 0)
        for g, line in lines.items():
            for swap, q in ((False, p), (True, turned(p))):
                for x, y in zip(line, line[1:], strict=False):
                    if own in (None, g) and (n := score(q, x[3], False) + score(q, y[3], False)) > best[3]:
                        best = (g, x[1], swap, n)
        assert got[k] == best


def test_rounds_do_not_grow_with_gates(spark, monkeypatch):
    gmap, gates = random_maps(31, 5, 60, 1500, loose=0.3)
    rounds = []
    placed = map_completion._placed
    monkeypatch.setattr(map_completion, "_placed", lambda state, batch, compat: rounds.append(len(batch)) or placed(state, batch, compat))
    done = completed_maps(spark.createDataFrame(gmap, MAP), spark.createDataFrame(gates, GATES))
    want, left = fold(gmap, gates)
    assert set(map(tuple, done.maps.collect())) == want
    assert {(x.contig, x.side) for x in done.unplaced.collect()} == left
    assert len(rounds) <= 2  # one for each 512 gates before


@pytest.mark.parametrize("kept", [1, 2])
def test_gates_that_need_more_slots_than_listed(spark, monkeypatch, kept):
    monkeypatch.setattr(map_completion, "KEPT", kept)
    for seed, cells in enumerate((3, 30)):
        gmap, gates = random_maps(70 + seed, cells, 12, 25)
        done = completed_maps(spark.createDataFrame(gmap, MAP), spark.createDataFrame(gates, GATES))
        want, left = fold(gmap, gates)
        assert set(map(tuple, done.maps.collect())) == want
        assert {(x.contig, x.side) for x in done.unplaced.collect()} == left


def test_many_gates_in_one_round(spark, monkeypatch):
    gmap, gates = random_maps(90, 6, 300, 9000, loose=0.3)
    rounds = []
    placed = map_completion._placed
    monkeypatch.setattr(map_completion, "_placed", lambda state, batch, compat: rounds.append(len(batch)) or placed(state, batch, compat))
    tables = spark.createDataFrame(gmap, MAP), spark.createDataFrame(gates, GATES)
    whole = completed_maps(*tables).maps.toPandas().sort_values(["group_id", "ord"])
    assert len(rounds) == 1  # 8,192 gates a round before
    parts = completed_maps(*tables, batch_rows=4000).maps.toPandas().sort_values(["group_id", "ord"])
    assert whole.astype(str).values.tolist() == parts.astype(str).values.tolist()


@pytest.mark.parametrize("places, bits", [(3, 18), (1000, 15)])
def test_short_heads_and_positions_that_run_out(spark, monkeypatch, places, bits):
    monkeypatch.setattr(map_completion, "PLACES", places)
    monkeypatch.setattr(map_completion, "BITS", bits)
    gmap, gates = random_maps(places, 4, 40, 300)
    done = completed_maps(spark.createDataFrame(gmap, MAP), spark.createDataFrame(gates, GATES))
    want, left = fold(gmap, gates)
    assert set(map(tuple, done.maps.collect())) == want
    assert {(x.contig, x.side) for x in done.unplaced.collect()} == left
