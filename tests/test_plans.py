"""Plan checks: JVM-only expressions, no cartesian products, top-N as
TakeOrderedAndProject, date predicates pushed into the Parquet scan."""

import os
import tempfile
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from opskpi.functions.clock import AsOf
from opskpi.plans.metric import all_metrics
from opskpi.plans.queries import AS_OF, DRIVER_PARAMS
from opskpi.sources.driver import driver_tables

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    qs = entry.queries()
    return {k: executed(fn(spark, SF)) for k, fn in qs.items() if k not in ("op_sort_label_numeric",)}


def test_no_python_udf_or_cartesian_anywhere(plans):
    bad = {k: [f for f in FORBIDDEN if f in p] for k, p in plans.items()}
    assert {k: v for k, v in bad.items() if v} == {}


def test_top_n_metrics_use_take_ordered(plans):
    capped = [m.key for m in all_metrics().values() if m.limit is not None]
    assert len(capped) == 8
    for key in capped:
        assert "TakeOrderedAndProject" in plans[key], key


def test_date_predicate_reaches_parquet_scan(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="opskpi-push-"), "t")
    spark.createDataFrame([(date(2000, 6, 1), "a"), (date(2000, 7, 1), "b")], "d date, s string") \
        .write.parquet(path)
    clock = AsOf.parse("2000-06-30 00:00:00")
    df = spark.read.parquet(path).where(clock.age_gt(F.col("d"), 7)).select("s")
    plan = executed(df)
    assert "PushedFilters: [IsNotNull(d), LessThan(d,2000-06-23)]" in plan
    assert "ReadSchema: struct<d:date,s:string>" in plan
    assert [r.s for r in df.collect()] == ["a"]


def test_scan_prunes_columns(spark):
    t = driver_tables(spark, SF)
    df = all_metrics()["kpi_I2b_wip"].frame(t, AS_OF, **DRIVER_PARAMS)
    plan = executed(df)
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_plans_without_broadcast_stay_equi_joins_and_results_hold(spark):
    """At scale the dimensions may be too big to broadcast: with every size-based
    broadcast switched off, all joins must still be equi-joins (sort-merge) and
    the join-heavy results unchanged."""
    keys = ["kpi_D3a", "kpi_D8", "kpi_I14", "kpi_Q1", "kpi_I11", "export_D9", "kpi_D2", "kpi_P1", "kpi_I9"]
    qs = entry.queries()
    before = {k: sorted(map(tuple, qs[k](spark, SF).collect())) for k in keys}
    old = (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"),
           spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for k in keys:
            df = qs[k](spark, SF)
            got = sorted(map(tuple, df.collect()))
            plan = executed(df)
            assert not [f for f in FORBIDDEN if f in plan], k
            assert "BroadcastHashJoin" not in plan, k
            assert got == before[k], k
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        if old[1] is None:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        else:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old[1])


def test_small_dimension_joins_broadcast_by_size(plans):
    for key in ("kpi_P6", "kpi_Q7", "kpi_D4", "export_D1b"):
        assert "BroadcastHashJoin" in plans[key], key
        assert "SortMergeJoin" not in plans[key], key
