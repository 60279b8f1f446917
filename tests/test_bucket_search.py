"""The Arrow search of ``row_index`` against Spark's own order, over every plain key type."""

from __future__ import annotations

import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.plans import indexing

RNG = random.Random(11)
VALUES = {
    "bigint": [None, -5, 0, 3, 1 << 62, -(1 << 62)],
    "int": [-2, 7, 0, 7],
    "string": [None, "", "a", "B", "é", "\U0001f389", "\uffff", "a\x00"],
    "boolean": [True, False, None],
    "double": [None, float("nan"), -0.0, 0.0, float("inf"), -1.5, float("-inf")],
    "decimal(10,2)": [Decimal("1.50"), None, Decimal("-3.00")],
    "binary": [b"", b"\xff", b"a", None],
}


@pytest.mark.parametrize("types", [["bigint"], ["int"], ["string"], ["double"], ["int", "string"], ["string", "double", "bigint"], ["boolean", "decimal(10,2)"], ["binary", "int"]])
def test_buckets_follow_the_order_of_spark(spark, types):
    rows = [tuple(RNG.choice(VALUES[t]) for t in types) + (i,) for i in range(400)]
    kinds = ", ".join(f"k{i} {t}" for i, t in enumerate(types))
    df = spark.createDataFrame(rows, f"{kinds}, id bigint").repartition(4)
    keys = [f"k{i}" for i in range(len(types))]
    got = indexing.row_index(df, [*keys, "id"], num_buckets=23).orderBy("rn").collect()
    want = df.orderBy(*keys, "id").select("id").collect()
    assert [r.rn for r in got] == list(range(1, 401))
    assert [r.id for r in got] == [r.id for r in want]
    grouped = indexing.row_index(df, [*keys[1:], "id"], partition_by=[keys[0]], num_buckets=11)
    from pyspark.sql import Window
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:], "id")).cast("long"))
    assert {r.id: r.rn for r in grouped.collect()} == {r.id: r.rn for r in plain.collect()}


def test_search_counts_the_cuts():
    assert indexing.search([(1,), (3,), (3,)], [pa.array([0, 1, 2, 3, 9])]).tolist() == [0, 1, 1, 3, 3]
    assert indexing.search([(None, "b"), (2, "a")], [pa.array([None, None, 2, 5]), pa.array(["a", "b", None, "z"])]).tolist() == [0, 1, 1, 2]


def test_other_types_are_left_to_spark(spark):
    df = spark.range(300).select("id", F.timestamp_seconds(F.col("id") % 17).alias("t"), F.array(F.col("id") % 5).alias("a"))
    got = indexing.row_index(df, ["t", "a", "id"], num_buckets=9).orderBy("rn").collect()
    assert [r.id for r in got] == [r.id for r in df.orderBy("t", "a", "id").collect()]
