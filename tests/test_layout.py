"""Laid-out relations: same rows, no shuffle per lot, days pruned, a cut-off write leaves the old ones."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opskpi.plans.metric import all_metrics
from opskpi.plans.queries import AS_OF, DRIVER_PARAMS
from opskpi.sources import layout as L
from opskpi.sources.driver import driver_tables
from opskpi.sources.tables import Tables

SF = "/root/testdata/sf0.001"
NAMES = ("AllLiveGRN", "AllGRN_Transfer", "AllLostStock", "StockIssue", "Accident", "AllItems", "AllLivePO")
CONF = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false", "spark.sql.maxMetadataStringLength": "5000"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("layout"))
    source = driver_tables(spark, SF)
    L.write_layout(spark, source, root, buckets=4, names=NAMES)
    return source, L.laid_out(spark, root)


@pytest.fixture
def plain_plans(spark):
    old = {c: spark.conf.get(c, None) for c in CONF}
    for c, v in CONF.items():
        spark.conf.set(c, v)
    yield
    for c, v in old.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def plan(t, key) -> str:
    df = all_metrics()[key].frame(t, AS_OF, **DRIVER_PARAMS)
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("name", NAMES)
def test_rows_and_types_stay(stored, name):
    source, t = stored
    assert t[name].dtypes == source[name].dtypes
    assert same(t[name], source[name])


@pytest.mark.parametrize("key", ["kpi_Q2_grn", "kpi_Q9", "kpi_I7"])
def test_lot_charts_need_no_shuffle(stored, plain_plans, key):
    source, t = stored
    assert "Exchange" in plan(source, key)
    assert "Exchange" not in plan(t, key)
    metric = all_metrics()[key]
    assert same(metric.frame(t, AS_OF, **DRIVER_PARAMS), metric.frame(source, AS_OF, **DRIVER_PARAMS))


@pytest.mark.parametrize("key, day", [("table_I3", "IssueDate"), ("kpi_S1", "Date")])
def test_log_windows_prune_days(stored, plain_plans, key, day):
    source, t = stored
    scans = [line.split("PartitionFilters: ")[1].split("PushedFilters")[0] for line in plan(t, key).split("\n")
             if "PartitionFilters: " in line]
    assert any(f"({day}#" in s and ">" in s for s in scans), scans
    metric = all_metrics()[key]
    assert same(metric.frame(t, AS_OF, **DRIVER_PARAMS), metric.frame(source, AS_OF, **DRIVER_PARAMS))


def test_promise_date_is_sorted_over_files(spark, plain_plans, tmp_path):
    L.write_layout(spark, driver_tables(spark, SF), str(tmp_path), buckets=4, names=("AllLivePO",))
    spans = (L.laid_out(spark, str(tmp_path))["AllLivePO"].groupBy(F.input_file_name())
             .agg(F.min("PODetDatePromised").alias("a"), F.max("PODetDatePromised").alias("b")).collect())
    spans = sorted((r.a, r.b) for r in spans if r.a is not None)
    assert len(spans) > 1 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_awkward_relations(spark, tmp_path):
    hot = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("GRNNo"))
    frames = {"AllLiveGRN": hot, "AllLostStock": spark.createDataFrame([(None, "a")], "GRNNo long, x string"),
              "StockIssue": spark.createDataFrame([(datetime(2000, 1, 1, 5), 1), (None, 2)], "IssueDate timestamp_ntz, n int"),
              "Accident": spark.createDataFrame([(datetime(2000, 1, 1), 1), (None, 2), (None, 2)], "Date timestamp_ntz, n int"),
              "PV658": spark.createDataFrame([], "DateRaised date, `a b` int")}
    used = L.write_layout(spark, Tables.from_frames(frames), str(tmp_path), buckets=4)
    assert used["AllLiveGRN"]["bucket"] == [] and used["AllLostStock"]["bucket"] == ["GRNNo"]   # a hot lot: no buckets
    assert used["StockIssue"]["day"] is None and used["Accident"]["day"] == "Date"              # times of day: sorted
    t = L.laid_out(spark, str(tmp_path))
    for name, df in frames.items():
        assert t[name].dtypes == df.dtypes
        assert same(t[name], df), name


def test_a_cut_off_write_leaves_the_old_relations(spark, tmp_path, monkeypatch):
    one, two = (Tables.from_frames({"AllLiveGRN": spark.createDataFrame([(i,)], "GRNNo long")}) for i in (1, 2))
    L.write_layout(spark, one, str(tmp_path), buckets=2)

    def fail(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(L, "publish", fail)
        with pytest.raises(OSError):
            L.write_layout(spark, two, str(tmp_path), buckets=2)
    assert [r.GRNNo for r in L.laid_out(spark, str(tmp_path))["AllLiveGRN"].collect()] == [1]
    L.write_layout(spark, two, str(tmp_path), buckets=2)
    assert L.sweep(spark, str(tmp_path)) == 2
    assert [r.GRNNo for r in L.laid_out(spark, str(tmp_path))["AllLiveGRN"].collect()] == [2]
