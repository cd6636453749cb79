"""Places in an order over a whole table."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.ordering import numbered


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_places_go_on_over_partitions(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(50), f"t{i}") for i in range(n)]  # ties, and one value in many rows
    rows += [(7, f"same{i}") for i in range(n // 2)]
    df = spark.createDataFrame(rows, "v int, t string").repartition(7)
    got = numbered(df, F.desc("v"), "t")
    assert "Window" not in got._jdf.queryExecution().toString()
    found = sorted((r["pos"], r["v"], r["t"]) for r in got.collect())
    assert [x[1:] for x in found] == sorted(rows, key=lambda r: (-r[0], r[1])) and [x[0] for x in found] == list(range(len(rows)))


def test_ties_have_places_of_their_own(spark):
    df = spark.createDataFrame([(1,)] * 300 + [(None,)] * 20, "v int").withColumn("_part", F.lit("x")).repartition(9)
    got = numbered(df, "v", name="place")
    assert sorted(r["place"] for r in got.collect()) == list(range(320)) and got.where("v is null").agg(F.max("place")).first()[0] == 19
