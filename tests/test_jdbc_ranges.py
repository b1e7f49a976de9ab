"""Balanced ranges of a sampled column.  No database runs here: conditions are tested on DataFrames, reading is not."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from opskpi.sources.jdbc import balanced_cuts, range_predicates, reader_options, sampled_predicates

MAPPING = {"options": {"url": "jdbc:x"}, "relations": {"AllLivePO": {
    "table": "erp.po", "partition": {"column": "PONum", "parts": 8, "sample": "SELECT PONum FROM erp.po"}}}}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3), st.integers(-10**9, 10**9)), max_size=30),
       st.lists(st.one_of(st.none(), st.integers(-10**9, 10**9)), max_size=10), st.integers(1, 6))
def test_each_row_is_in_one_range_whatever_the_sample(spark, rows, sample, parts):
    cuts = balanced_cuts(spark.createDataFrame([(x,) for x in sample], "n long"), parts)
    conditions = range_predicates("n", cuts)
    assert len(conditions) <= parts
    df = spark.createDataFrame([(x,) for x in rows], "n long")
    got = df.selectExpr("n", "+".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions) + " AS k").collect()
    assert all(r.k == 1 for r in got)


def test_ranges_are_balanced_where_values_are_not(spark):
    """Most keys are small, a few are huge: ranges even in value would leave one with nearly all rows."""
    df = spark.range(10_000).selectExpr("CASE WHEN id < 9900 THEN id ELSE id * 1000000 END AS PONum")
    conditions = sampled_predicates(MAPPING, "AllLivePO", lambda options: df)
    counts = [df.where(c).count() for c in conditions]
    assert len(counts) == 8 and sum(counts) == 10_000 and max(counts) < 1.1 * 10_000 / 8


def test_the_sample_is_read_by_the_users_query(spark):
    seen = []
    sampled_predicates(MAPPING, "AllLivePO", lambda options: (seen.append(options), spark.range(10))[1])
    assert seen == [{"fetchsize": "10000", "url": "jdbc:x", "query": "SELECT PONum FROM erp.po"}]
    assert "partitionColumn" not in reader_options(MAPPING, "AllLivePO")


@pytest.mark.parametrize("kind, values, literal", [
    ("date", [date(2000, 1, 1), date(2000, 1, 2)], "'2000-01-01'"),
    ("timestamp_ntz", [datetime(2000, 1, 1, 5), datetime(2000, 1, 2)], "'2000-01-01 05:00:00'"),
    ("decimal(10,2)", [Decimal("1.50"), Decimal("2.50")], "1.50")])
def test_types(spark, kind, values, literal):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"c {kind}")
    conditions = range_predicates("c", balanced_cuts(df, 2))
    assert conditions == [f"c < {literal} OR c IS NULL", f"c >= {literal}"]
    assert [df.where(c).count() for c in conditions] == [1, 2]


def test_awkward_samples(spark):
    assert range_predicates("n", balanced_cuts(spark.createDataFrame([], "n long"), 4)) == ["1 = 1"]
    assert balanced_cuts(spark.range(100), 1) == []
    assert balanced_cuts(spark.range(100).selectExpr("7 AS n"), 4) == [7]
    with pytest.raises(ValueError, match="order"):
        balanced_cuts(spark.createDataFrame([("a",)], "s string"), 2)
    with pytest.raises(ValueError, match="table"):
        reader_options({"options": {"url": "u", "query": "SELECT 1"}, **{"relations": MAPPING["relations"]}}, "AllLivePO")
