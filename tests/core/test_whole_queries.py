import os

import pytest

from phasewright.plans import file_queries, map_queries, more_queries, queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_row_of_the_tables_takes_part(spark):
    run = lambda name: queries.queries()[name](spark, DATA)
    orders = {r.o_orderkey for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").collect()}
    assert {r.aln_id for r in run("routed_reads").collect()} == orders
    mapped = {r.l_orderkey for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    ends = {(str(k // 2), "right" if k % 2 else "left") for k in mapped}
    done = run("completed_maps").collect()
    assert {(r.contig, r.side) for r in done} == ends and len(done) == len(ends) and len({len(r.pattern) for r in done}) == 1
    assert len(done[0].pattern) > 6 and {r.group_id for r in done if int(r.contig) % 8 != 1 or r.side == "left"} == {str(k) for k in range(10)}
    assert {r.marker for r in run("best_map_slots").collect()} == mapped
