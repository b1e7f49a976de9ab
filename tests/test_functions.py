from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opskpi.functions import dates as S
from opskpi.functions import params as P
from opskpi.functions.clock import AsOf
from opskpi.functions.text import label, left, text_eq, text_like, text_ne


def test_age_and_due_are_day_boundaries(spark, clock):
    df = spark.createDataFrame([(date(2000, 6, 29),), (date(2000, 7, 2),), (None,)], "c date")
    got = df.select(clock.age(F.col("c")).alias("a"), clock.due(F.col("c")).alias("d")).collect()
    assert [(r.a, r.d) for r in got] == [(1, -1), (-2, 2), (None, None)]


def test_timestamp_day_boundary(spark):
    clock = AsOf.parse("2000-06-30 00:01:00")
    df = spark.createDataFrame([(datetime(2000, 6, 29, 23, 59),)], "c timestamp_ntz")
    assert df.select(clock.age(F.col("c"))).first()[0] == 1


@settings(max_examples=25, deadline=None)
@given(n=st.integers(min_value=-40, max_value=40),
       hour=st.sampled_from([0, 13]))
def test_pushable_forms_equal_day_count_forms(spark, n, hour):
    clock = AsOf(datetime(2000, 6, 30, hour))
    days = [date(2000, 6, 30) + timedelta(days=k) for k in range(-60, 61)]
    df = spark.createDataFrame([(x,) for x in days] + [(None,)], "c date")
    c = F.col("c")
    age, due = clock.age(c), clock.due(c)
    checks = [
        (clock.age_gt(c, n), age > n), (clock.age_ge(c, n), age >= n),
        (clock.due_le(c, n), due <= n), (clock.due_lt(c, n), due < n), (clock.due_ge(c, n), due >= n),
        (clock.date_ge_now(c, n), c.cast("timestamp_ntz") >= clock.now_plus(n)),
        (clock.date_gt_now(c, n), c.cast("timestamp_ntz") > clock.now_plus(n)),
        (clock.date_le_now(c, n), c.cast("timestamp_ntz") <= clock.now_plus(n)),
        (clock.date_lt_now(c, n), c.cast("timestamp_ntz") < clock.now_plus(n)),
    ]
    cols = []
    for i, (a, b) in enumerate(checks):
        cols += [F.coalesce(a, F.lit(False)).alias(f"a{i}"), F.coalesce(b, F.lit(False)).alias(f"b{i}")]
    for r in df.select(*cols).collect():
        for i in range(len(checks)):
            assert r[f"a{i}"] == r[f"b{i}"], (i, n, hour)


def test_text_comparisons_fold_case_and_trailing_blanks(spark):
    df = spark.createDataFrame([("open",), ("Open ",), ("OPEN",), (" open",), (None,)], "s string")
    got = df.select(text_eq(F.col("s"), "Open").alias("eq"), text_ne(F.col("s"), "open").alias("ne"),
                    text_like(F.col("s"), "%PEN").alias("lk")).collect()
    assert [r.eq for r in got] == [True, True, True, False, None]
    assert [r.ne for r in got] == [False, False, False, True, None]
    assert [r.lk for r in got] == [True, True, True, True, None]


def test_label_treats_null_as_empty(spark):
    from decimal import Decimal
    df = spark.createDataFrame([(1, None, Decimal("2.50"))], "a bigint, b string, c decimal(18,2)")
    assert df.select(label(F.col("a"), " / ", F.col("b"), " / ", F.col("c"))).first()[0] == "1 /  / 2.50"
    assert df.select(left(label(F.col("a"), "xyz"), 2)).first()[0] == "1x"


def test_sentinels_and_earliest(spark):
    df = spark.createDataFrame([(date(2008, 8, 8), None), (None, date(2000, 1, 1)), (date(2001, 5, 5), date(2001, 5, 1)),
                                (None, None)], "a date, b date")
    got = df.select(S.sentinel_in(F.col("a"), S.SHIPPED).alias("i"), S.sentinel_free(F.col("a"), S.SHIPPED).alias("f"),
                    S.earliest_of(F.col("a"), F.col("b")).alias("e"),
                    S.month_differs(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.i for r in got] == [True, None, False, None]
    assert [r.f for r in got] == [False, True, True, True]
    assert [r.e for r in got] == [date(2008, 8, 8), date(2000, 1, 1), date(2001, 5, 1), None]
    assert [r.m for r in got] == [None, None, False, None]


@pytest.mark.parametrize("args,expected", [
    ({}, "MR%"), ({"location": "  "}, "MR%"), ({"location": "REWORK"}, "%REWORK%"), ({"location": "50%"}, "%50\\%%"),
])
def test_q2_binder(args, expected):
    assert P.q2_location(args) == {"location_pattern": expected}


def test_other_binders():
    assert P.q1_type({"type": " return "}) == {"part_pattern": "%-RETURN%"}
    assert P.q1_type({"type": "x"}) == {"part_pattern": "%"}
    assert P.q7_type({}) == {"type_pattern": "%"}
    assert P.q7_type({"type": "Follow"}) == {"type_pattern": "%Follow%"}
    assert P.p12_training({"area": "A_B"}) == {"area_pattern": "A\\_B"}
    assert P.p12_training({}) == {"area_pattern": "%"}
    assert P.month_window({}, date(2000, 6, 30)) == (date(2000, 6, 1), date(2000, 6, 30))
