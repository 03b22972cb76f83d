import random
from collections import defaultdict

import pytest

from phasewright.operators.checked import checked_join
from phasewright.operators.deletions import map_contigs, placed_deletions, status_counts

from .test_map_completion import score, turned

NONE = "gmap.file.unavailable"


def by_hand(regions, gmap, gates, groups, matched):
    """Each region by the three cases, then contig by contig."""
    lines = defaultdict(list)
    for g, _, c, s, p in sorted(gmap, key=lambda r: r[:2]):
        lines[g].append((c, s, p))
    at = {(c, s): g for g, _, c, s, _ in gmap}
    phases, patterns = {(c, s): f for c, s, f in groups}, {(c, s): p for c, s, p in gates}
    to_map = dict(matched)
    rows, votes, marks = [], defaultdict(list), defaultdict(list)

    def best(p, names):
        top = (0, None, None, False)
        for g in names:
            for swap, q in ((False, p), (True, turned(p))):
                for x, y in zip(lines[g], lines[g][1:], strict=False):
                    if x[0] != y[0] and (n := score(q, x[2], False) + score(q, y[2], False)) > top[0]:
                        top = (n, g, f"{y[0]}\t{y[1]}", swap)
        return top

    for c, start, end, klass, p in sorted(regions):
        own = at.get((c, "left"), at.get((c, "right")))
        phase = phases.get((c, "left"), phases.get((c, "right")))
        case = 3 if own is not None else 2 if phase is not None else 1
        where = own if case == 3 else to_map.get(phase)
        n, marker, swap = 0, None, False
        if "hom" in klass:
            status, n = f"unphased.hom.case{case}.1", 0 if case == 1 else 2 * len(p)
        elif case == 1 and "P" not in p:
            status = "unphased.hap.case1.2.1"
        elif case == 3:
            status, marker = "phased.hap.case3.2", f"{c}\tright"
            keep, flip = (sum(score(q, patterns[c, s], False) for s in ("left", "right")) for q in (p, turned(p)))
            n, swap = max(keep, flip, 0), flip > max(keep, 0)
        else:
            status = "phased.hap.case1.2.2" if case == 1 else "phased.hap.case2.2"
            n, found, marker, swap = best(p, sorted(lines) if case == 1 else [where])
            where = found if case == 1 else where
        q = turned(p) if swap else p
        where = where or NONE
        votes[c].append((where, n if case == 1 else 2 * len(p)))
        if case < 3 and marker:
            marks[c, where].append((marker, n, q))
        rows.append([c, start, end, klass, "P" if "P" in q else "M", n, q, case, status, where, marker])
    chosen, goes = set(), {}
    for c, given in votes.items():
        count, high = defaultdict(int), defaultdict(int)
        for g, n in given:
            count[g] += 1
            high[g] = max(high[g], n)
        real = [g for g in count if g != NONE]
        goes[c] = min(real or [NONE], key=lambda g: (-count[g], -high[g], g))
        if found := marks.get((c, goes[c])):
            top = {}
            for marker, n, q in found:
                if n > top.get(marker, (0, None))[0]:
                    top[marker] = (n, q)
            marker = min(top, key=lambda m: (-top[m][0], m))
            chosen.add((c, goes[c], marker, *top[marker]))
    names = {g: f for f, g in matched}
    return {(*r[:6], names.get(goes[r[0]], "unphased.txt"), goes[r[0]], *r[6:]) for r in rows}, chosen


@pytest.mark.parametrize("seed", [1, 2])
def test_three_cases(spark, seed):
    r = random.Random(seed)
    pattern = lambda: "".join(r.choice("PMU" if r.random() < 0.8 else "MU") for _ in range(6))
    ends = [(f"c{k:02d}", s) for k in range(30) for s in ("left", "right")]
    gates = [(c, s, pattern()) for c, s in ends]
    kept = {f"c{k:02d}" for k in range(0, 30, 2)}
    gmap = [(f"m{r.randrange(3)}", i, c, s, p) for i, (c, s, p) in enumerate(gates) if c in kept and r.random() < 0.8]
    groups = [(c, s, f"p{r.randrange(3)}") for c, s in ends if c >= "c15" and r.random() < 0.6]
    matched = [("p0", "m0"), ("p1", "m1"), ("p2", "m2")]
    regions = [(f"c{r.randrange(40):02d}", 10 * k, 10 * k + 5, r.choice(["hom_high", "hap_low", "hap_high", "hap_low"]), r.choice(["MMUMUM", pattern(), pattern()])) for k in range(120)]
    frames = (spark.createDataFrame(regions, "contig string, start int, end int, klass string, pattern string"), spark.createDataFrame(gmap, "group_id string, ord int, contig string, side string, pattern string"), spark.createDataFrame(gates, "contig string, side string, pattern string"), spark.createDataFrame(groups, "contig string, side string, phase_group string"), spark.createDataFrame(matched, "phase_group string, map_group string"))
    got = placed_deletions(*frames)
    rows, chosen = by_hand(regions, gmap, gates, groups, matched)
    assert set(map(tuple, got.regions.collect())) == rows and len({x[10] for x in rows}) == 7
    assert set(map(tuple, got.chosen.collect())) == chosen and chosen
    lines = defaultdict(list)
    for g, _, c, s, _ in sorted(gmap, key=lambda x: x[:2]):
        for name in sorted(x[0] for x in chosen if x[1:3] == (g, f"{c}\t{s}")):
            lines[g] += [(name, "left_del"), (name, "right_del")]
        lines[g].append((c, s))
    assert {(x.group_id, x.ord, x.contig, x.side) for x in got.maps.collect()} == {(g, i, *m) for g, line in lines.items() for i, m in enumerate(line, 1)}
    counts = {(x.case, x.status): (x.regions, x.contigs) for x in status_counts(got.regions).collect()}
    assert counts == {k: (sum(x[9:11] == k for x in rows), len({x[0] for x in rows if x[9:11] == k})) for k in {x[9:11] for x in rows}}
    assert tuple(map_contigs(frames[1]).first()) == (len(gmap), len({x[2] for x in gmap}))


def test_missing_keys_fail(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", 9)], "k string, w int")
    assert checked_join(left.where("k = 'a'"), right, ["k"], what="no size").collect() == [("a", 1, 9)]
    assert checked_join(left, right, ["k"], what="no size", only=left.v < 2).count() == 3
    for rows in (left.where("v < 3"), left.where("v = 3")):
        with pytest.raises(Exception, match="no size: (b|null)"):
            checked_join(rows, right, ["k"], what="no size").select("v").collect()
        with pytest.raises(Exception, match="no size"):
            checked_join(rows, right, ["k"], what="no size").count()
