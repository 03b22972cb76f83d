from pyspark.sql import functions as F

from phasewright.llm.common import settled
from phasewright.llm.graph import components


def guess(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_guesses_of_size_stay_small_round_after_round(spark):
    rows = spark.range(200).select(F.col("id").alias("node"), F.col("id").alias("comp"))
    for _ in range(4):
        above = rows.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        rows = settled(rows.join(above, "comp").select("node", F.least("comp", "up").alias("comp")))
        assert guess(rows) < 100
    assert sorted(map(tuple, rows.collect())) == [(i, i) for i in range(200)]


def test_path_is_one_component(spark):
    places = [(i * 7) % 31 for i in range(31)]
    edges = spark.createDataFrame(list(zip(places, places[1:], strict=False)), "a long, b long")
    found = components(edges)
    assert guess(found) < 100
    assert [tuple(r) for r in found.groupBy("comp").count().collect()] == [(0, 31)]
