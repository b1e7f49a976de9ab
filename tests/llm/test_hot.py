"""Joins that leave the rows of hot keys where they are."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opskpi.llm import hot


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0, 0, 0, 0, 1, 2, 3, None]), max_size=30), st.sampled_from([2, 5, 1000]))
def test_equals_the_plain_join(spark, keys, share):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    facts = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m")).where("n > 1")
    old, hot.SHARE = hot.SHARE, share
    try:
        for how in ("inner", "left", "left_semi"):
            got = hot.hot_join(rows, facts, "k", len(keys), how)
            want = rows.join(facts.drop("n"), "k", how)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    finally:
        hot.SHARE = old


@pytest.mark.parametrize("share", [1000])
def test_rows_of_a_hot_key_stay_in_their_tasks(spark, share):
    rows = spark.range(0, 30_000, 1, 10).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = hot.hot_join(rows, facts, "k", 30_000).groupBy(F.spark_partition_id().alias("p"), "k").count().where("k = -1")
    counts = [r["count"] for r in out.collect()]
    assert sum(counts) == 10_000 and max(counts) <= 1_001
