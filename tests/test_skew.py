"""The join of hot keys on both sides: whole output, spread over tasks."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opskpi.operators.skew import product_join

ON = [("k", "r"), ("l", "s")]


def frames(spark, left, right):
    return (spark.createDataFrame(left, "k long, l int, a string"), spark.createDataFrame(right, "r long, s int, b string"))


def plain(left, right):
    return sorted(((*x, *y) for x in left for y in right if None not in x[:2] and x[:2] == y[:2]), key=repr)


row = st.tuples(st.sampled_from([1, 1, 1, 2, None]), st.sampled_from([0, 0, None]), st.sampled_from(["x", "y", None]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, max_size=12), st.lists(row, max_size=12), st.sampled_from([1, 2, 512]))
def test_equals_the_plain_join(spark, left, right, cell):
    got = product_join(*frames(spark, left, right), ON, cell=cell).collect()
    assert sorted(map(tuple, got), key=repr) == plain(left, right)


def test_where_is_applied_to_met_rows(spark):
    left, right = [(1, 0, "x")] * 3, [(1, 0, "x")] * 2 + [(1, 0, "y")]
    got = product_join(*frames(spark, left, right), ON, where=F.col("a") == F.col("b"), cell=1).collect()
    assert [tuple(r) for r in got] == [(1, 0, "x", 1, 0, "x")] * 6


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([], "k long")
    with pytest.raises(ValueError, match="k"):
        product_join(df, df.withColumnRenamed("k", "K"), [("k", "K")])


def test_a_key_of_a_third_of_both_sides_is_spread(spark):
    """Key 0 has 1000 of 3000 rows on both sides, half of them copies of one row: a million rows of output, of
    which no task makes more than twice its share (a plain join makes all in one)."""
    def side(names):
        n = F.col("id")
        return spark.range(3000).select(F.when(n < 1000, 0).otherwise(n).cast("long").alias(names[0]), F.lit(0).alias(names[1]),
                                        F.when(n < 500, -1).otherwise(n).cast("string").alias(names[2]))

    old = {c: spark.conf.get(c, None) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions",
                                                "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(old, ("false", "16", "-1")):
            spark.conf.set(c, v)
        left, right = side("kla"), side("rsb")
        out = product_join(left, right, ON, cell=32)
        tasks = out.groupBy(F.spark_partition_id()).count().collect()
        total = sum(r["count"] for r in tasks)
        assert total == 1000 * 1000 + 2000
        assert max(r["count"] for r in tasks) <= 2 * total / 16
        copies = out.where("a = '-1' and b = '-1'").count()
        assert copies == 500 * 500
        alone = left.join(right, [F.col("k") == F.col("r"), F.col("l") == F.col("s")])
        assert max(r["count"] for r in alone.groupBy(F.spark_partition_id()).count().collect()) >= 1000 * 1000
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
