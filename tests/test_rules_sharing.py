from __future__ import annotations

import re
import time

import pytest

from opskpi.operators.payload import to_kpi_rows
from opskpi.plans.metric import all_metrics
from opskpi.plans.queries import AS_OF, DRIVER_PARAMS
from opskpi.plans.rules import SORT_KEY_COLUMNS, shared_rows, sharing, sort_keys
from opskpi.plans.snapshot import kpi_union
from opskpi.sources.driver import driver_tables
from opskpi.staging import Staging

SF = "/root/testdata/sf0.001"


def groups():
    return sharing(sorted((m for m in all_metrics().values() if m.kind == "chart"), key=lambda m: m.id))


def test_which_charts_share_a_pass():
    assert sorted([m.id for m in g] for g in groups()) == [
        ["D1a1", "D1b", "D1c", "D1d"], ["D3a", "D3b"], ["I2b_wip", "Q3_customer"], ["P1", "P2"], ["Q8", "Q8b"]]


@pytest.mark.parametrize("n", range(5))
def test_a_shared_pass_gives_the_rows_of_its_charts(spark, n):
    t, group = driver_tables(spark, SF), groups()[n]
    want = []
    for m in group:
        df = m.rows(t, AS_OF, **DRIVER_PARAMS)
        keyed = df.select(*m.columns, *sort_keys(dict(df.dtypes), m.order))
        want += map(tuple, to_kpi_rows(keyed, m.id, keep=SORT_KEY_COLUMNS).collect())
    got = shared_rows(t, AS_OF, DRIVER_PARAMS, group)
    assert got.columns[0] == "metric_id" and got.columns[-len(SORT_KEY_COLUMNS):] == SORT_KEY_COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_shared_pass_reads_no_more_than_one_of_its_charts(spark):
    def scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return sorted(re.findall(r"FileScan parquet .*?/(\w+)\.parquet", plan))

    t = driver_tables(spark, SF)
    for group in groups():
        assert scans(shared_rows(t, AS_OF, DRIVER_PARAMS, group)) == scans(group[0].rows(t, AS_OF, **DRIVER_PARAMS))


def test_an_unmatched_and_a_repeated_partner(make_tables, clock):
    from datetime import date
    wo = [dict(WONo=i, WOPartNo="Pa ", WOQtyOS=1, WOStatusDescription="WIP", WOSchedStartDate=date(2000, 6, 1),
               WOEarliestStartDate=date(2000, 6, 1)) for i in (1, 2, 3)] + [
        dict(WONo=4, WOPartNo="none", WOQtyOS=1, WOStatusDescription="wip", WOSchedStartDate=date(2000, 6, 1),
             WOEarliestStartDate=date(2000, 6, 1))]
    t = make_tables({"worksOrder": wo,
                     "AllItems": [dict(PartNo="pA", StatusDescription="NPI"), dict(PartNo="PA", StatusDescription="npi "),
                                  dict(PartNo="pa", StatusDescription="Active")],
                     "PV601": [dict(WorksOrder=2, PrintedBy="x"), dict(WorksOrder=3, PrintedBy="x"), dict(WorksOrder=3, PrintedBy=None)]})
    group = next(g for g in groups() if g[0].id == "P1")
    got = sorted((r["metric_id"], r["label"].split(" ")[0]) for r in shared_rows(t, clock, {}, group).collect())
    alone = sorted((m.id, r["label"].split(" ")[0]) for m in group for r in m.frame(t, clock).collect())
    assert got == alone == [("P1", "1"), ("P1", "1"), ("P1", "3"), ("P1", "3"), ("P2", "1"), ("P2", "3")]


def _held(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def _passes(monkeypatch, spark):
    """Shuffle files that are left when each pass has been written."""
    before, left, put = _held(spark), [], Staging.put

    def counted(self, df, label="t"):
        out = put(self, df, label)
        for _ in range(100):
            if _held(spark) <= before:
                break
            time.sleep(0.1)
        left.append(len(_held(spark) - before))
        return out

    monkeypatch.setattr(Staging, "put", counted)
    return left


def test_the_union_keeps_shuffles_of_one_pass_at_a_time(spark, monkeypatch):
    from opskpi.plans.operator_queries import op_snapshot_union
    left = _passes(monkeypatch, spark)
    out = op_snapshot_union(spark, SF)
    charts = [m for m in all_metrics().values() if m.kind == "chart"]
    assert left == [0] * (len(charts) - sum(len(g) - 1 for g in groups()))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    plain = kpi_union(driver_tables(spark, SF), AS_OF, DRIVER_PARAMS).select(out.columns)
    assert out.schema == plain.schema
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_the_department_keeps_shuffles_of_one_pass_at_a_time(spark, monkeypatch):
    from opskpi.plans.catalog import department_charts, department_kpi_rows
    from opskpi.plans.operator_queries import op_department_scope
    left = _passes(monkeypatch, spark)
    out = op_department_scope(spark, SF)
    charts = sorted(department_charts("purchasing"), key=lambda m: m.id)
    assert left == [0] * (len(charts) - sum(len(g) - 1 for g in sharing(charts)))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = department_kpi_rows(driver_tables(spark, SF), AS_OF, DRIVER_PARAMS, "purchasing")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.groupBy("metric_id").count().collect()))
