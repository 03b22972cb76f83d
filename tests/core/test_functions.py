import random

import pytest
from pyspark.sql import functions as F

from phasewright import functions as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, X.split_tokens("v"), v="\ta\t\tb\t") == ["a", "b"]
    assert one(spark, X.complement_reverse("v"), v="acgtuN") == "NAACGT"
    assert one(spark, X.complement_reverse_lower("v"), v="ACGTN") == "nACGT"
    assert one(spark, X.half_away(F.col("v")), v=2.5) == 3 and one(spark, X.half_away(F.col("v")), v=-2.5) == -3
    assert one(spark, X.path_part("v", 2), v="/a//b/c") == "b" and one(spark, X.path_part("v", 9), v="/a") is None
    assert one(spark, X.even_hash("v"), v="r") in (0, 1)


def test_reads(spark):
    got = one(spark, X.barcode_parts("s", "q"), s="A" * 16 + "C" * 6 + "GT", q="I" * 22 + "JK")
    assert tuple(got) == ("A" * 16, "C" * 6, "GT", "JK")
    line = "r\t77\t*\tCR:Z:AAAA\tCB:Z:CCCC-1\tCY:Z:IIII"
    assert one(spark, X.corrected_barcode(X.sam_tag("v", "CB"), X.sam_tag("v", "CR")), v=line) == "CCCC"
    assert one(spark, X.corrected_barcode(X.sam_tag("v", "CB"), X.sam_tag("v", "CR")), v="r\tCR:Z:AAAA\tx") == "AAAA"
    assert [one(spark, X.read_end("v"), v=f) for f in (64, 128, 192, 0)] == [1, 2, None, None]
    assert one(spark, X.canonical_locus("v"), v="tig7_le") == "tig7_pilon"


@pytest.mark.parametrize(("cigar", "pad", "want"), [("3M", True, "ACG"), ("1S2M1I2M", True, "CGAC"), ("2M2D2M", True, "AC--GT"), ("2M3N2M", True, "AC---GT"), ("2M3N2M", False, "ACGT"), ("2H2=1X", True, "ACG")])
def test_realigned(spark, cigar, pad, want):
    assert one(spark, X.realigned("s", "c", pad_skipped=pad), s="ACGTACGT" if "S" not in cigar else "ACGTACGT", c=cigar) == want


def test_spans(spark):
    assert one(spark, X.reference_span("c"), c="5S10M2I3D4N1X2=7H") == 20
    assert one(spark, X.cigar_counts("c", "M"), c="5M2I7M") == 12


def test_depth(spark):
    cls = lambda v: one(spark, X.depth_class("v"), v=v)
    assert [cls(v) for v in (200, 250, 300, 301)] == ["hap_high", "hap_low", "hom_low", "hom_high"]
    assert [one(spark, X.depth_code("v"), v=v) for v in (9, 10, 99, 100, 5000)] == ["9", "a", "i", "j", "j"]
    assert one(spark, X.presence("v"), v="01a9j") == "UUPPP"
    assert one(spark, X.support_class("k", "s", "n"), k="hap_low", s=504, n=1000) == "hom_low"
    assert one(spark, X.reads_per_kilobase("c", "s", "e", "a"), c=5, s=1, e=1000, a=0) is None


def _score(a, b, scale):
    a, b = a.upper(), b.upper()
    pts = sum(2 if x == y and x in "PM" else -1 if {x, y} == {"P", "M"} else 0 for x, y in zip(a, b))
    if scale:
        n = sum(x != "U" and y != "U" for x, y in zip(a, b)) or 1
    else:
        n, m = a.count("P") or a.count("M"), len(b) - b.count("U")
        n = (m if n > m and m >= len(a) // 4 else n) or 1
    v = pts / n * len(a)
    return int(abs(v) + 0.5) * (1 if v >= 0 else -1)


def test_patterns(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("PMUu") for _ in range(n)), "".join(r.choice("PMU") for _ in range(n))) for n in (1, 2, 5, 9, 20) for _ in range(20)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", X.match_score("a", "b").alias("s"), X.match_score("a", "b", scale=False).alias("o"), X.flip("a").alias("f")).collect()
    for g in got:
        assert (g.s, g.o) == (_score(g.a, g.b, True), _score(g.a, g.b, False)), (g.a, g.b)
        assert g.f == "".join({"P": "M", "M": "P"}.get(c, "u") for c in g.a)
    assert tuple(one(spark, X.genotype_difference("a", "b"), a="PMUUP", b="PPUMU")) == (2, 1, 2, "+-|**")
    assert tuple(one(spark, X.match_report("a", "b"), a="PMMPU", b="PMPMU")) == (1, 1, 1, 1, 1)
    assert one(spark, X.match_report("a", "b", compat=True), a="PMMPU", b="PMPMU").ot == 2
    assert one(spark, X.lod_score("a", "b"), a="", b="") == -1000.0
    assert abs(one(spark, X.lod_score("a", "b"), a="PPPP", b="PPPM") - (__import__("math").log10(0.25 * 0.75**3 / 0.5**4))) < 1e-12
    assert one(spark, X.recombination_percent("a", "b"), a="PPU", b="PMP") == 50.0 and one(spark, X.recombination_percent("a", "b"), a="U", b="P") is None
    assert one(spark, X.flip_strict("a"), a="pMx") == "MPU"
