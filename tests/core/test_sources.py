import gzip
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from phasewright.sources import readers, writers
from phasewright.streaming import barcoded_pairs, write_parts


def write(path, text):
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables(spark, tmp_path):
    p = write(tmp_path / "m.txt", "#c\np\tk\t5\tAC\tTA\t200\t80\t0.5\tok\n\np\tk\t\t9\tA\tC\tx\n")
    got = readers.markers(spark, p).select("contig", "pos", "ref", "alt", "qual").collect()
    assert tuple(got[0]) == ("k", 5, "AC", "TA", 200.0) and (got[1].pos, got[1].qual) == (9, None)
    p = write(tmp_path / "s.txt", "k\t10\nk\t20\nz\t5\n")
    assert rows(readers.contig_sizes(spark, p)) == [("k", 10), ("z", 5)]
    p = write(tmp_path / "r.txt", "k\t1\t9\t7\thap_low\nk\t1\t8\t6\thom_low\n")
    assert rows(readers.region_depths(spark, p)) == [("k", 1, 9, 7, "hap_low")]
    p = write(tmp_path / "a.log", "100000 reads; of these:\nx\n91.21% overall alignment rate\n")
    assert readers.aligner_logs(spark, p).select("reads", "rate", "aligned").first() == (100000, 91.21, 91210)
    p = write(tmp_path / "c.txt", "k\t1\tA\t9\t1\t2\t3\t4\t5\t6\tx\ty\nshort\t1\n")
    assert readers.base_counts(spark, p).select("contig", "pos", "A", "N").collect()[0] == ("k", 1, 1, 6)
    p = write(tmp_path / "del.txt", "01a\tk\t1\t9\thap_low\t2/3\traw_cnt\n01j\tk\t1\t9\thap_low\t2/3\trpkm\n")
    assert rows(readers.deletion_gates(spark, p)) == [("01j", "k", 1, 9, "hap_low", 2, 3)]
    p = write(tmp_path / "ph.txt", "corr\tk\t1\tA\tC\tA\tC\ncorr\tk\t1\tG\tT\tG\tT\ncorr\tz\t1\tA\tC\tA\tC\n")
    flags = spark.createDataFrame([("z", True)], "contig string, swap boolean")
    assert rows(readers.phased_markers(spark, p, flags)) == [("k", 1, "A", "C"), ("z", 1, "C", "A")]


def test_groups_and_maps(spark, tmp_path):
    g = write(tmp_path / "group1.txt", "(Individual:)\t1\t2\n1\ttig1_le\t{0}\ta\n2\ttig1_ri\t{1}\tb\n3\tx\ty\n")
    assert rows(readers.phase_groups(spark, g)) == [("group1", "tig1_le", "left", "{0}"), ("group1", "tig1_ri", "right", "{1}")]
    assert [r.individual for r in readers.individuals(spark, g).orderBy("column").collect()] == ["(Individual:)", "1", "2"]
    m = write(tmp_path / "map1.txt", "group 1\ntig2_ri   0.0\ntig1_le 1.5 x\ntig1_ri unmapped\n")
    assert [(r.ord, r.locus, r.distance) for r in readers.genetic_maps(spark, m).orderBy("ord").collect()] == [(1, "tig2_ri", 0.0), (2, "tig1_le", 1.5), (3, "tig1_ri", None)]
    u = write(tmp_path / "upd.txt", "k\tleft\t0.5\tNA\nk\tright\tNA\t3\n")
    assert rows(readers.updated_maps(spark, u)) == [("upd", 1, "k", "left", 0.5, None), ("upd", 2, "k", "right", None, 3.0)]
    lst = write(tmp_path / "list.txt", f"{g}\n#x\n{m}\n")
    assert [(r.cell_id, r.path) for r in readers.manifest(spark, lst).orderBy("cell_id").collect()] == [(1, g), (2, m)]
    s = write(tmp_path / "gates.txt", "PMU\tk\tleft-sequence\nPM|\tk\tCO-info\nPPU\tk\tright-sequence\n")
    assert rows(readers.gates(spark, s)) == [("PMU", "k", "left"), ("PPU", "k", "right")]
    pat = write(tmp_path / "tig1_s1.txt", "ACGT\t1_x\t0_m\nPMuu\t1_x\t0_m\nuuuP\t2_x\t0_u\n")
    assert rows(readers.cell_patterns(spark, pat).select("pattern", "cell")) == [("PMuu", "1_x")]


def test_sequences(spark, tmp_path):
    one, two = tmp_path / "a_R1.fq.gz", tmp_path / "a_R2.fq.gz"
    with gzip.open(one, "wt") as f:
        f.write("".join(f"@r{i}\n{'ACGT' * 4}{'TTTTTT'}G{i}\n+\n{'I' * 24}\n" for i in range(5)))
    with gzip.open(two, "wt") as f:
        f.write("".join(f"@r{i}\nCC{i}\n+\nJJJ\n" for i in range(5)))
    pairs = readers.fastq_pairs(readers.fastq(spark, str(one)), readers.fastq(spark, str(two)))
    assert sorted(r.sequence[22:] + r.sequence2 for r in pairs.collect()) == [f"G{i}CC{i}" for i in range(5)]
    fa = write(tmp_path / "x.fa", ">a desc\nACG\nT\n>b\nGG\n>c\nTT\n")
    want = spark.createDataFrame([("asA",), ("c",)], "contig string")
    assert rows(readers.fasta(spark, fa, want)) == [("a", "ACGT"), ("c", "TT")]
    out = str(tmp_path / "out")
    writers.write_fastq_pairs(pairs.withColumn("barcode", F.substring("sequence", 1, 16)), out, by=["barcode"])
    assert spark.read.text(f"{out}/R1").count() == 20 and spark.read.text(f"{out}/R2").where("value = '+'").count() == 5
    writers.write_fasta(readers.fasta(spark, fa), str(tmp_path / "fa"))
    assert rows(readers.fasta(spark, str(tmp_path / "fa"))) == [("a", "ACGT"), ("b", "GG"), ("c", "TT")]
    t = spark.createDataFrame([("k", 2, None), ("k", 1, "x")], "contig string, pos int, v string")
    writers.write_tables(t, str(tmp_path / "t"), columns=["contig", "pos", "v"], order=["pos"])
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["k\t1\tx", "k\t2\tNA"]
    writers.write_dot(spark.createDataFrame([("a", "b", 1.5)], "from_contig string, to_contig string, lod double"), str(tmp_path / "dot"))
    assert [r.value for r in spark.read.text(str(tmp_path / "dot")).collect()] == ["digraph contigs {", '\t"a" -> "b" [label="1.50"];', "}"]


SAM = ["@HD", "r1\t77\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\tCR:Z:AAAA\tCY:Z:JJJJ\tCB:Z:CCCC-1", "r1\t157\t*\t0\t0\t*\t*\t0\t0\tAACC\tABCD\tCR:Z:AAAA", "r2\t77\t*\t0\t0\t*\t*\t0\t0\tA\tI\tCR:Z:AAAA\tCY:Z:JJJJ", "quit"]


def test_reads_from_lines_and_stream(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in SAM], "value string")
    want = [("r1", "CCCCACGT", "JJJJIIII", "GGTT", "DCBA")]
    assert rows(barcoded_pairs(lines).select("name", "sequence", "quality", "sequence2", "quality2")) == want
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.sam", "\n".join(SAM[:-1]) + "\n")
    stream = spark.readStream.text(str(tmp_path / "in")).withColumn("arrived", F.current_timestamp())
    q = write_parts(barcoded_pairs(stream), str(tmp_path / "parts"), str(tmp_path / "ck"), barcode=4)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "parts")).select("name", "sequence", "quality", "sequence2", "quality2")
    assert rows(got) == want
    assert readers.sam(spark, str(tmp_path / "in")).count() == 3


def test_splits_of_plain_files(spark, tmp_path):
    """Files cut into splits of a few dozen bytes read as line by line."""
    r = random.Random(3)
    records = [(f"@r{i} x>y", "".join(r.choice("ACGT") for _ in range(r.randrange(1, 60)))) for i in range(120)]
    for name in ("a", "b"):
        write(tmp_path / f"{name}.fq", "".join(f"{n}{name}\n{s}\n+{'@' if i % 3 == 0 else ''}\n{'@' * len(s)}\n" for i, (n, s) in enumerate(records)))
    genome = [(f"k{i}", "".join(r.choice("ACGTN") for _ in range(r.randrange(0, 300)))) for i in range(40)]
    fa = write(tmp_path / "x.fa", "".join(f">{n} text > more\n" + "".join(s[i : i + 17] + "\n" for i in range(0, len(s), 17)) for n, s in genome) + ">last\n" + "A" * 95)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "50")
    try:
        assert readers.ordered_lines(spark, fa).rdd.getNumPartitions() > 20
        got = sorted((x.file[-4:], x.record, x.name, x.sequence) for x in readers.fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")]).collect())
        assert got == [(f"{f}.fq", i, n + f, s) for f in "ab" for i, (n, s) in enumerate(records)]
        for most in (10_000, 7):
            parts = defaultdict(dict)
            for x in readers.fasta_lines(spark, fa, most=most).collect():
                parts[x.id][x.start] = x.bases
            want = {n: s for n, s in genome if s} | {"last": "A" * 95}
            assert {k: "".join(v[i] for i in sorted(v)) for k, v in parts.items()} == want
            assert all(sum(len(v[j]) for j in v if j < i) == i for v in parts.values() for i in v)
        assert dict(rows(readers.fasta(spark, fa))) == want
    finally:
        spark.conf.set(key, before)


def test_unreadable_files(spark, tmp_path):
    good = [write(tmp_path / f"g{i}.txt", f"k\t{i}\n" * 2000) for i in range(2)]
    whole = gzip.compress(("x\t1\n" * 50_000).encode())
    (tmp_path / "cut.gz").write_bytes(whole[: len(whole) // 2])
    lst = write(tmp_path / "list.txt", f"{good[0]}\n{tmp_path}/none.txt\n# no file\n{tmp_path}/cut.gz\n{good[1]}\n")
    got = readers.probed(readers.manifest(spark, lst)).orderBy("cell_id").collect()
    assert [(x.cell_id, x.readable, x.id_readable) for x in got] == [(1, True, 1), (2, False, None), (3, False, None), (4, True, 2)]
    with pytest.raises(ValueError, match="no files"):
        readers.manifest(spark, write(tmp_path / "empty.txt", "# nothing\n\n"))


def test_hot_keys_are_many_files(spark, tmp_path):
    t = spark.range(20_000).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold").alias("route"), F.col("id").cast("string").alias("id"), F.lit("ACGT").alias("sequence"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        deal = writers.dealt(t, ["route"], rows_a_file=500).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset(key)
    assert len(deal) == 4 and max(x["count"] for x in deal) < 7_000
    writers.write_fasta(t, str(tmp_path / "fa"), by=["route"])
    back = spark.read.text(str(tmp_path / "fa"))
    assert back.groupBy("route").count().collect().__len__() == 3 and back.count() == 40_000
    same = lambda: {(x.route, x.id): x.f for x in writers.dealt(t, ["route"], rows_a_file=500).withColumn("f", F.spark_partition_id()).collect()}
    assert same() == same()


def test_scaffolds_in_order(spark, tmp_path):
    chunks = spark.createDataFrame([("g", k, p, f"{k}{p}") for k in range(30) for p in (2, 0, 1)] + [("f", 0, 0, "x")], "group string, rank int, part long, bases string")
    writers.write_scaffolds(chunks, str(tmp_path / "s"))
    text = "".join(x.read_text() for x in sorted((tmp_path / "s").glob("part-*")))
    assert text.split() == [">f", "x", ">g", *(f"{k}{p}" for k in range(30) for p in range(3))]
