import random

import pytest
from pyspark.sql import functions as F

from phasewright.operators import cells, intervals, map_completion, maps, phasing, reads, recombination
from phasewright.plans import chains


def test_phasing_recovers_haplotypes(spark):
    r = random.Random(5)
    n = 30
    mat = [r.choice("AC") for _ in range(n)]
    markers = [("k", (i + 1) * 100, "A", "C") for i in range(n)]
    counts = []
    for cell in range(1, 25):
        side = r.random() < 0.5
        for i in range(n):
            if r.random() < 0.8:
                base = mat[i] if side else {"A": "C", "C": "A"}[mat[i]]
                counts.append(("k", (i + 1) * 100, cell, int(base == "A"), int(base == "C"), 0, 0, 0, 0))
    m = spark.createDataFrame(markers, "contig string, pos int, ref string, alt string")
    c = spark.createDataFrame(counts, "contig string, pos int, cell_id int, A int, C int, G int, T int, `-` int, N int")
    z = spark.createDataFrame([("k", 5000)], "contig string, size int")
    out = chains.phase_markers(m, c.select("cell_id"), c, z)
    got = [x.mat for x in out.haplotypes.orderBy("idx").collect()]
    assert got == mat or got == [{"A": "C", "C": "A"}[b] for b in mat]
    assert {x.call for x in out.calls.collect()} <= {"MM", "PP"}
    regions = out.regions.collect()
    assert len(regions) == 24 and all((x.start, x.end) == (1, 5000) for x in regions)
    s = {x.cluster: x for x in out.statistics.collect()}
    assert s["P&M"].cells == 24 and s["P&M"].confusing == 0


def test_markers_and_alleles(spark):
    m = spark.createDataFrame([("k", 5, "AC", "TA"), ("k", 9, "A", "AT")], "contig string, pos int, ref string, alt string")
    assert [tuple(x) for x in phasing.exploded_markers(m).orderBy("pos").collect()] == [("k", 5, "A", "T"), ("k", 6, "C", "A")]
    t = spark.createDataFrame([("A", "C", 1, 1), ("A", "C", 2, 0), ("A", "C", 0, 2), ("A", "C", 0, 0)], "ref string, alt string, a int, c int")
    assert [x[0] for x in t.select(phasing.allele_call(F.col("ref"), F.col("alt"), {"A": F.col("a"), "C": F.col("c")})).collect()] == ["U", "A", "C", "N"]


def test_intervals_against_all_pairs(spark):
    r = random.Random(6)
    spans = lambda n: [(r.choice("ab"), s, s + r.randint(0, 5000)) for s in (r.randint(1, 60000) for _ in range(n))]
    a, b = spans(80), spans(80)
    left, right = spark.createDataFrame(a, "contig string, start int, end int"), spark.createDataFrame(b, "contig string, rstart int, rend int")
    got = sorted(tuple(x) for x in intervals.overlap_join(left, right, least=100).select("contig", "start", "end", "rstart", "rend", "overlap").collect())
    assert got == sorted((*x, y[1], y[2], min(x[2], y[2]) - max(x[1], y[1]) + 1) for x in a for y in b if x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) + 1 >= 100)
    p = left.select("contig", F.col("start").alias("pos"))
    hits = intervals.point_join(p, right, start="rstart", end="rend").count()
    assert hits == sum(x[0] == y[0] and y[1] <= x[1] <= y[2] for x in a for y in b)


def test_rows_of_interval_joins_do_not_grow_with_lengths(spark):
    r = random.Random(11)
    spans = [(r.randint(1, 10**12), r.choice([1, 60, 10**4, 10**7, 10**12])) for _ in range(120)]
    a, b = ([(k, "c", s, s + n - 1) for k, (s, n) in enumerate(part)] for part in (spans[:60], spans[60:]))
    left, right = spark.createDataFrame(a, "i int, contig string, start long, end long"), spark.createDataFrame(b, "j int, contig string, rstart long, rend long")
    got = [(x.i, x.j, x.overlap) for x in intervals.overlap_join(left, right).select("i", "j", "overlap").collect()]
    assert sorted(got) == [(i, j, min(e, v) - max(s, u) + 1) for i, _, s, e in a for j, _, u, v in b if s <= v and u <= e]
    points = [(k, "c", x) for k, x in enumerate([x for _, _, s, e in a[:20] for x in (s - 1, s, e, e + 1)])]
    for half in (False, True):
        hits = intervals.point_join(spark.createDataFrame(points, "k int, contig string, pos long"), left, half_open=half)
        assert sorted((x.k, x.i) for x in hits.select("k", "i").collect()) == [(k, i) for k, _, x in points for i, _, s, e in a if s + half <= x <= e]


def test_long_reads(spark):
    sam = [
        (1, "r1", 0, "k", 1, "10M", "MMMMMMMMMM"), (2, "r2", 0, "k", 1, "10M", "PPPPPPPPPP"), (3, "r3", 0, "z", 1, "10M", "XXXXXXXXXX"), (4, "r4", 0, "k", 1, "*", "AAAA"),
        (5, "r5", 256, "k", 1, "5M", "AAAAA"), (6, "r6", 0, "k", 1, "5M", "*"), (7, "r7", 0, "k", 1, "10M", "MMMMMPPPPP"), (8, "r8", 0, "h", 1, "600M", "A" * 600),
    ]
    a = spark.createDataFrame(sam, "aln_id int, qname string, flag int, rname string, pos int, cigar string, seq string")
    m = spark.createDataFrame([("k", i, "M", "P") for i in range(1, 11)], "contig string, pos int, mat string, pat string")
    g = spark.createDataFrame([("h", 1, 700, "hap_low", "P")], "contig string, start int, end int, klass string, geno string")
    groups = spark.createDataFrame([("k", "g1"), ("h", "g2")], "contig string, group_id string")
    got = {x.aln_id: x.routes for x in reads.routed(a, m, g, groups).collect()}
    assert got[1] == ["g1_MMM_pbreads"] and got[2] == ["g1_PPP_pbreads"] and got[3] == ["mapped_no_lg"] and got[4] == ["unmapped_starcigar"]
    assert 5 not in got and 6 not in got and got[7][1] == "crossover" and got[8] == ["g2_PPP_pbreads"]
    totals = {x.route: x.alignments for x in reads.route_totals(reads.routed(a, m, g, groups)).collect()}
    assert sum(totals.values()) == 7


def test_scaffolds(spark):
    pairs = spark.createDataFrame([("g", 1, "a", False), ("g", 2, "b", True), ("g", 3, "csB", False), ("h", 7, "csA", True)], "group string, rank int, contig string, reverse boolean")
    s = spark.createDataFrame([("a", 0, "AAC"), ("b", 0, "GG"), ("b", 2, "TN"), ("c", 0, "ACG"), ("c", 3, "TACGT")], "id string, start long, bases string")
    cut = spark.createDataFrame([("c", 5)], "contig string, break_pos int")
    line = lambda rows, g: [r.bases for r in sorted(rows, key=lambda r: (r.rank, r.part)) if r.group == g]
    n = "N" * 80
    got = reads.scaffold_chunks(pairs, s, cut).collect()
    assert line(got, "g") == ["AAC", n, n, "nA", "CC", n, n, "CGT"] and line(got, "h") == ["TA", "CGT"]
    assert line(reads.scaffold_chunks(pairs, s, cut, compat=True).collect(), "h") == ["ACG", "TA"]
    for some, what in ((s.where("id <> 'b'"), "contig without sequence: b"), (s, "split contig without a break: c")):
        with pytest.raises(Exception, match=what):
            reads.scaffold_chunks(pairs, some, cut if what[0] == "c" else None).collect()


def test_maps(spark):
    gmap = spark.createDataFrame([("g", 1, "a", "left", "PPPPMMMM"), ("g", 2, "a", "right", "PPPPMMMM"), ("g", 3, "b", "left", "MMMMPPPP"), ("g", 4, "b", "right", "MMMMPPPP")], "group_id string, ord int, contig string, side string, pattern string")
    new = spark.createDataFrame([("g", "c", "left", "PPMMMMPP"), ("g", "b", "right", "MMMMPPPP")], "group_id string, contig string, side string, pattern string")
    got = [(x.contig, x.side) for x in map_completion.completed_maps(gmap, new).maps.orderBy("ord").collect()]
    assert got == [("a", "left"), ("a", "right"), ("c", "left"), ("b", "left"), ("b", "right")]
    chosen = spark.createDataFrame([("g", 3, "d")], "group_id string, ord int, contig string")
    assert [x.side for x in maps.with_deletions(gmap, chosen).orderBy("ord").collect()] == ["left", "right", "left_del", "right_del", "left", "right"]
    un = spark.createDataFrame([("g", "q", "right")], "group_id string, contig string, side string")
    have = spark.createDataFrame([("g", 1, "q", "left", 0.5), ("g", 2, "w", "left", 1.5)], "group_id string, ord int, contig string, side string, distance double")
    assert [(x.contig, x.side, x.distance) for x in maps.placed_mates(have, un).orderBy("ord").collect()] == [("q", "left", 0.5), ("q", "right", 0.5), ("w", "left", 1.5)]
    votes = spark.createDataFrame([("c", "map.unavailable", 9)] * 3 + [("c", "m2", 1), ("c", "m1", 1)], "contig string, map_file string, score int")
    assert maps.group_votes(votes).first().map_file == "m1"


def test_crossovers(spark):
    rows = [("c", p * 10, *((5, 0) if p <= 40 else (0, 5))) for p in range(1, 81)]
    t = spark.createDataFrame(rows, "cell_id string, pos int, count_a int, count_b int")
    s = recombination.smoothed(t, keys=["cell_id"])
    b = recombination.blocks(s, keys=["cell_id"])
    assert [(x.start, x.end, x.genotype, x.markers) for x in b.orderBy("start").collect()] == [(10, 400, 1, 40), (410, 800, 0, 40)]
    points = recombination.breakpoints(b, keys=["cell_id"])
    assert [tuple(x) for x in points.select("start", "end", "before", "after", "markers").collect()] == [(400, 410, 1, 0, 40)]
    fine = recombination.refined_breakpoints(points, s, keys=["cell_id"])
    assert (fine.first().start, fine.first().end) == (400, 410)
    sizes = spark.createDataFrame([("c", 1000)], "cell_id string, size int")
    final = recombination.final_blocks(b, sizes, keys=["cell_id"], chromosome="cell_id")
    out = recombination.adjusted_blocks(final, fine, keys=["cell_id"])
    assert [(x.start, x.end) for x in out.orderBy("rank").collect()] == [(1, 400), (410, 1000)]


def test_breakpoints_meet_their_own_markers_only(spark):
    r = random.Random(3)
    line = [(1, 10 * k, float(r.random() < 0.5)) for k in range(400)]
    cuts = sorted(r.sample(range(400), 60))
    points = [(1, n, line[i][1], line[j][1], 0, 1) for n, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))] + [(1, 99, 0, 3990, 1, 0)]
    marks = spark.createDataFrame(line, "cell_id int, pos long, smooth double")
    out = recombination.refined_breakpoints(spark.createDataFrame(points, "cell_id int, bp int, start long, end long, before int, after int"), marks, keys=["cell_id"])
    share = lambda part, v: sum(x == v for x in part) / len(part)
    for x in out.collect():
        _, _, s, e, _, _ = next(p for p in points if p[1] == x.bp)
        inside = [(pos, v) for _, pos, v in line if s <= pos <= e]
        v = [y for _, y in inside]
        split = [max(share(v[:i], 0) * share(v[i:], 1), share(v[:i], 1) * share(v[i:], 0)) for i in range(1, len(v))]
        i = max(range(len(split)), key=lambda k: (round(split[k], 12), -k))
        assert abs(x.score - split[i]) < 1e-12 and (x.start, x.end) == (inside[i][0], inside[i + 1][0])
    assert out.count() == len(points)
    # bins stand beside the cell in the join, so that not each breakpoint meets each marker
    assert "_bin" in out._jdf.queryExecution().optimizedPlan().toString()


def test_cells(spark):
    t = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 50, 51)], "v double")
    assert [r.group for r in cells.two_groups(t, "v").orderBy("v").collect()] == [0, 0, 0, 1, 1]
    p = spark.createDataFrame([("n", 1), ("n", 2), ("m", 1)], "name string, end int")
    assert [r.name for r in cells.unpaired(p).collect()] == ["m"]
    k = cells.kmers(spark.createDataFrame([("AACGTT",)], "sequence string"), k=3)
    assert {r.kmer: r.n for r in k.collect()} == {"AAC": 2, "ACG": 2}
    cell = spark.createDataFrame([(1, 0.01, 10), (2, 0.2, 10), (3, 0.01, 9999)], "c int, r double, n int")
    assert [r.c for r in cells.cell_filter(cell, ratio="r", count="n").collect()] == [1]


def test_counts_in_the_same_pass(spark):
    routes = spark.createDataFrame([(1, "a", 10, ["x"]), (2, "a", 5, ["mapped_no_lg", "crossover"]), (3, "b", 7, ["unmapped_starcigar"]), (4, "c", 1, ["mapped_no_lg"])], "aln_id long, qname string, span long, routes array<string>")
    out, seen = reads.counted(routes)
    assert out.count() == 4
    assert seen.get == {"alignments": 4, "bases": 23, "crossovers": 1, "no_group": 2, "no_place": 1}
