import random
from itertools import product

from pyspark.sql import functions as F

from phasewright.operators import sequences as S


def table(spark, strings):
    rows = [(k, i + 1, (i + 1) * 10, c) for k, s in enumerate(strings) for i, c in enumerate(s)]
    return spark.createDataFrame(rows, "contig int, idx int, pos int, sym string").withColumn("cell_id", F.lit(1))


def literal_segments(s):
    known = [i for i, c in enumerate(s) if c in "PM"]
    if not known:
        return []
    out, start = [], 1
    for a, b in zip(known, known[1:]):
        if s[a] != s[b]:
            cut = (a + b) // 2 + 1
            out.append((start, cut, s[a]))
            start = cut + 1
    return [*out, (start, len(s), s[known[-1]])]


def test_segments(spark):
    strings = ["".join(x) for n in range(1, 7) for x in product("PMu", repeat=n)] + ["PPuPPMMuMMuuuMMPuuuPuuMuM"]
    got = {}
    for r in S.segments(table(spark, strings)).collect():
        got.setdefault(r.contig, []).append((r.start_idx, r.end_idx, r.sym))
    for k, s in enumerate(strings):
        assert sorted(got.get(k, [])) == literal_segments(s), s
    compat = S.segments(table(spark, ["PPM", "PMM"]), compat=True).collect()
    assert sorted((r.contig, r.start_idx, r.end_idx, r.sym) for r in compat) == [(0, 1, 2, "P"), (1, 1, 1, "P"), (1, 2, 3, "M")]


def literal_change(s):
    best = None
    for cut in range(1, len(s)):
        l, r = s[:cut], s[cut:]
        pl, ml, pr, mr = l.count("P"), l.count("M"), r.count("P"), r.count("M")
        if pl + ml and pr + mr:
            pm, mp = pl / (pl + ml) * (mr / (pr + mr)), ml / (pl + ml) * (pr / (pr + mr))
            if best is None or max(pm, mp) >= best[0]:
                best = (max(pm, mp), cut, "PM" if pm >= mp else "MP")
    return best


def test_change_points(spark):
    r = random.Random(2)
    strings = ["".join(r.choice("PMu") for _ in range(r.randint(1, 14))) for _ in range(300)]
    got = {x.contig: (x.score, x.split, x.call) for x in S.change_points(table(spark, strings)).collect()}
    for k, s in enumerate(strings):
        want = literal_change(s)
        assert (got.get(k) is None) == (want is None)
        if want:
            assert got[k][1:] == want[1:] and abs(got[k][0] - want[0]) < 1e-12, s


def test_breaks_and_gates(spark):
    strings = ["MMMMMMMMPPPPPP", "MMMMMMMMMMMMMP", "uuu", "uPu", "PPPMMMM", "PPPPPMMMMM"]
    t = table(spark, strings)
    clusters = spark.createDataFrame([(k, 1, "M" if s.count("M") > s.count("P") else "P") for k, s in enumerate(strings)], "contig int, cell_id int, cluster string")
    got = {r.contig: r for r in S.accepted_breaks(t, clusters, min_score=0.64).collect()}
    assert [got[k].call for k in range(6)] == ["MP", "MM", "UU", "PP", "PM", "PP"]
    assert {r.contig: r.call for r in S.accepted_breaks(t, clusters, compat=False).collect()}[5] == "PM"
    w = {r.contig: (r.left_pos, r.right_pos, r.size) for r in S.widened(S.accepted_breaks(t, clusters), t).collect()}
    assert w[0] == (80, 90, 11)
    gates = {(r.contig, r.kind): r.pattern for r in S.gates(S.accepted_breaks(t, clusters)).collect()}
    assert (gates[0, "left-sequence"], gates[0, "right-sequence"], gates[0, "CO-info"]) == ("M", "P", "R")


def literal_gaps(markers, sizes, least, compat):
    out, has = [], {}
    names = sorted(markers)
    for c in names:
        prev, own, tail = 1, [], []
        for i, p in enumerate(sorted(set(markers[c]))):
            if p - prev >= least:
                own.append((c, prev, p))
            prev = p
        if c in sizes and sizes[c] - prev >= least:
            tail.append((c, prev, sizes[c]))
        out += own + tail
        has[c] = (bool(own), bool(tail))
    for c in sizes:
        if c not in markers:
            seen = False
        elif not compat:
            seen = any(has[c])
        else:
            i = names.index(c)
            seen = has[c][0] or (i > 0 and has[names[i - 1]][1]) or (i == len(names) - 1 and has[c][1])
        if not seen:
            out.append((c, 1, sizes[c]))
    return sorted(out)


def test_gap_regions(spark):
    r = random.Random(3)
    for compat in (False, True):
        markers = {f"c{i:02d}": [r.randint(1, 100) for _ in range(r.randint(1, 6))] for i in range(40)}
        sizes = {c: 100 + r.randint(0, 40) for c in markers} | {"z1": 77}
        m = spark.createDataFrame([(c, p) for c, ps in markers.items() for p in ps], "contig string, pos int")
        z = spark.createDataFrame(list(sizes.items()), "contig string, size int")
        got = sorted(tuple(x) for x in S.gap_regions(m, z, min_gap=30, compat=compat).select("contig", "start", "end").collect())
        assert got == literal_gaps(markers, sizes, 30, compat)


def test_runs_pairs_and_scaffolds(spark):
    rows = spark.createDataFrame([("g", i, c, s) for i, (c, s) in enumerate([("a", "left"), ("a", "right"), ("b", "right"), ("b", "left"), ("c", "left"), ("d", "left")])], "group string, ord int, contig string, side string")
    assert [(r.contig, r.length) for r in S.run_lengths(rows, keys="group", order="ord", value="contig").orderBy("run").collect()] == [("a", 2), ("b", 2), ("c", 1), ("d", 1)]
    assert [(r["rank"], r.contig, r.reverse, r.paired) for r in S.scaffold_pairs(rows).orderBy("rank").collect()] == [(1, "a", False, True), (2, "b", True, True), (3, "c", False, False)]
    p = spark.createDataFrame([(1, "PMu")], "k int, pattern string")
    assert S.packed(S.unpacked(p), keys="k", order="idx").first().pattern == "PMu"
    assert S.switch_counts(table(spark, ["PuMMP", "uP"]), by="cell_id").first()[1:] == (2, 5)


def test_letters_of_a_key_over_several_batches(spark):
    # rows sorted in tasks and laid together; before, lists of rows were gathered and sorted for each key
    r = random.Random(4)
    rows = [(r.choice([None, 1, 2, 2, 3, -7, 1 << 60, (1 << 60) + 1, *range(20, 40)]), r.choice([None, 1, 2, 3]), r.random(), r.choice("PMU")) for _ in range(400)] + [(2, k, 0.5, "P") for k in range(50)]
    rows = spark.createDataFrame(rows, "key long, a int, b double, sym string")
    want = S.packed(rows.withColumn("o", F.struct("a", "b")), keys="key", order="o").collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 3, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = S.packed_letters(rows, key="key", order=["a", "b"])
            assert sorted(map(str, got.collect())) == sorted(map(str, want))
            assert S.packed_letters(rows.limit(0), key="key", order=["a"]).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
