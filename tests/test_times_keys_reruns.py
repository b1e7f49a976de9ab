"""Timestamps with a time of day, text keys in mixed case, reruns, headers and hot keys."""

import glob
import os
import tempfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from opskpi.functions.clock import AsOf
from opskpi.operators.payload import to_kpi_rows
from opskpi.operators.rank import ranked
from opskpi.operators.relational import left_join_split, repeat_by_matches
from opskpi.plans.metric import all_metrics
from opskpi.plans.queries import AS_OF, DRIVER_PARAMS
from opskpi.plans.snapshot import as_of_folder, run_snapshot
from opskpi.sources.driver import RELATIONS, driver_tables

SF = "/root/testdata/sf0.001"
AFTERNOON = AsOf.parse("2000-06-30 14:00:00")


def metric(key, t, clock, **kw):
    return all_metrics()[key].frame(t, clock, **kw)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_comparisons_with_the_moment(spark, kind):
    days = [datetime(2000, 6, 29, 23), datetime(2000, 6, 30), datetime(2000, 6, 30, 9), datetime(2000, 6, 30, 14),
            datetime(2000, 6, 30, 20), datetime(2000, 7, 1), None]
    df = spark.createDataFrame([(str(d) if d else None,) for d in days], "s string").select(F.col("s").cast(kind).alias("c"))
    values = [r["c"] for r in df.collect()]
    for clock in (AFTERNOON, AsOf.parse("2000-06-30")):
        for name, test in (("date_ge_now", lambda a, b: a >= b), ("date_gt_now", lambda a, b: a > b),
                           ("date_le_now", lambda a, b: a <= b), ("date_lt_now", lambda a, b: a < b)):
            got = [r["c"] for r in df.where(getattr(clock, name)(F.col("c"))).collect()]
            whole = [v if isinstance(v, datetime) or v is None else datetime(v.year, v.month, v.day) for v in values]
            assert got == [v for v, w in zip(values, whole) if w is not None and test(w, clock.ts)], (kind, name)


def test_moment_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(10).selectExpr("date '2000-06-25' + cast(id as int) as c").write.parquet(path)
    plan = spark.read.parquet(path).where(AFTERNOON.date_lt_now(F.col("c"))).\
        _jdf.queryExecution().executedPlan().toString()
    assert "LessThan(c,2000-07-01)" in plan


def rows_with(spark, relation_schemas, name, **columns):
    """One row of a relation: NULL but for the given columns, which may have types of their own."""
    schema = relation_schemas[name]
    return spark.range(1).select(*[(columns[f.name] if f.name in columns else F.lit(None).cast(f.dataType)).alias(f.name)
                                   for f in schema.fields])


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_same_day_finish_is_not_late(spark, relation_schemas):
    def frames(finish):
        wo = rows_with(spark, relation_schemas, "worksOrder", WONo=F.lit(1).cast("bigint"), WOPartNo=F.lit("P1"),
                       WOStatusDescription=F.lit("WIP"), WOSchedFinishDate=ts(finish), WOSalesOrder=F.lit(5).cast("bigint"),
                       WOLineNo=F.lit(1).cast("bigint"))
        so = rows_with(spark, relation_schemas, "AllSO", SONo=F.lit(5).cast("bigint"), SOLineNo=F.lit(1).cast("bigint"),
                       SOLineQty=F.lit(9).cast("bigint"), SOLineShipQty=F.lit(1).cast("bigint"),
                       SOLinePromisedDate=ts("2000-07-01 09:00:00"))
        return driver_tables(spark, SF).with_frames({"worksOrder": wo, "AllSO": so})

    assert metric("kpi_I11", frames("2000-07-01 15:00:00"), AFTERNOON).count() == 0
    assert [r["value"] for r in metric("kpi_I11", frames("2000-07-02 01:00:00"), AFTERNOON).collect()] == [1]


@pytest.mark.parametrize("promised,due", [("2000-07-14 00:00:00", True), ("2000-07-14 13:59:00", True),
                                          ("2000-07-14 14:00:00", False)])
def test_export_due_soon_keeps_the_last_day(spark, relation_schemas, promised, due):
    po = rows_with(spark, relation_schemas, "AllLivePO", PONum=F.lit(1).cast("bigint"), PODetItemNum=F.lit(1).cast("bigint"),
                   PODetPart=F.lit("x1 "), POBuyer=F.lit(7).cast("bigint"), POSuppAddressName=F.lit("SUP-1"),
                   PODetQtyReq=F.lit(5).cast("bigint"), PODetQtyRec=F.lit(0).cast("bigint"), PODetDatePromised=ts(promised))
    t = driver_tables(spark, SF).with_frames({
        "AllLivePO": po, "AllItems": rows_with(spark, relation_schemas, "AllItems", PartNo=F.lit("X1")),
        "OOB_TRACKER_RECEIVED": rows_with(spark, relation_schemas, "OOB_TRACKER_RECEIVED", SuppName=F.lit("sup-1"),
                                          RECEIVED=F.lit("N")),
        "employees": rows_with(spark, relation_schemas, "employees", BadgeNo=F.lit(7).cast("bigint"), Name=F.lit("N"))})
    assert metric("export_D9", t, AFTERNOON).count() == int(due)


def test_overdue_action_counts_to_the_minute(spark, relation_schemas):
    def count(target):
        cr = rows_with(spark, relation_schemas, "AllCR", AssignedName=F.lit("A"), CRStatusDescription=F.lit("open "),
                       ContRevDetailTargetDate=target)
        return metric("kpi_P3a", driver_tables(spark, SF).with_frames({"AllCR": cr}), AFTERNOON).count()

    assert count(ts("2000-06-30 20:00:00")) == 0 and count(ts("2000-06-30 09:00:00")) == 1
    assert count(F.lit(date(2000, 6, 30))) == 1 and count(F.lit(date(2000, 7, 1))) == 0


def test_part_numbers_join_without_case_and_trailing_blanks(spark, relation_schemas):
    grn = rows_with(spark, relation_schemas, "AllLiveGRN", GRNNo=F.lit(1).cast("bigint"), GRNPartNo=F.lit("p1 "),
                    GRNLocation=F.lit("STORES"), GRNExpiryDate=F.lit(date(2000, 7, 5)), GRNQtyLeft=F.lit(1).cast("bigint"))
    t = driver_tables(spark, SF).with_frames(
        {"AllLiveGRN": grn, "AllItems": rows_with(spark, relation_schemas, "AllItems", PartNo=F.lit("P1"))})
    assert metric("kpi_I12", t, AS_OF).count() == 1


def test_unparseable_values_drop_their_row(spark):
    df = spark.createDataFrame([("a", "abc"), ("b", None), ("c", "2.5"), ("d", "NaN")], "label string, value string")
    assert {(r["label"], r["value"]) for r in to_kpi_rows(df, "m").collect()} == {("b", None), ("c", 2.5)}
    zero = to_kpi_rows(df, "m", null_value_policy="zero").collect()
    assert {(r["label"], r["value"]) for r in zero} == {("b", 0.0), ("c", 2.5)}


def test_labels_are_whole(spark):
    t = driver_tables(spark, SF)
    po = t["AllLivePO"].withColumn("POSuppAddressName", F.lit("S" * 80))
    labels = [r["label"] for r in metric("kpi_D1a1", t.with_frames({"AllLivePO": po}), AS_OF, **{
        k: v for k, v in DRIVER_PARAMS.items() if k == "promised_after"}).take(3)]
    assert labels and all(x.endswith("S" * 80) for x in labels)


def test_rerun_replaces_all_of_its_time_only(spark):
    out = tempfile.mkdtemp(prefix="opskpi-rerun-")
    t = driver_tables(spark, SF)
    path = run_snapshot(spark, t, AS_OF, out, DRIVER_PARAMS, write_exports=False)["kpi_snapshot"]
    later = AsOf.parse("2000-06-30 14:00:00")
    again = run_snapshot(spark, t, later, out, DRIVER_PARAMS, write_exports=False)
    count = lambda stamp: spark.read.parquet(path).where(
        (F.col("as_of").cast("string") == stamp) & (F.col("metric_id") == "S1")).count()
    assert count("2000-06-30 00:00:00") > 0 and count("2000-06-30 14:00:00") > 0
    emptied = t.with_frames({"Accident": t["Accident"].limit(0)})
    run_snapshot(spark, emptied, AS_OF, out, DRIVER_PARAMS, write_exports=False)
    spark.catalog.refreshByPath(path)
    assert count("2000-06-30 00:00:00") == 0 and count("2000-06-30 14:00:00") > 0
    tables = [p for k, p in again.items() if k.startswith("tables/")]
    assert all(as_of_folder(later) in p for p in tables)


def test_csv_headers_are_the_labels(spark):
    from opskpi.plans.snapshot import _write_ordered_csv

    t, m = driver_tables(spark, SF), all_metrics()["export_Q7"]
    for key in ("export_Q7", "export_D3b"):
        m = all_metrics()[key]
        path = os.path.join(tempfile.mkdtemp(prefix="opskpi-csv-"), "x")
        _write_ordered_csv(m, t, AS_OF, DRIVER_PARAMS, path)
        with open(glob.glob(os.path.join(path, "part-*.csv"))[0]) as fh:
            header = fh.readline().strip().replace('"', "").split(",")
        assert header == [m.headers.get(c, c) for c in m.columns]
        assert key != "export_D3b" or "Demand WO/SO" in header


def test_hot_and_missing_keys_repeat_as_a_left_join(spark):
    df = spark.createDataFrame([(1, "Hot"), (2, "hot "), (3, "x"), (4, None)], "i int, k string")
    other = spark.range(3000).select(F.lit("HOT").alias("p")).union(spark.createDataFrame([(None,)], "p string"))
    got = {r["i"]: r["count"] for r in repeat_by_matches(df, other, "k", "p").groupBy("i").count().collect()}
    assert got == {1: 3000, 2: 3000, 3: 1, 4: 1}
    exact = left_join_split(df, other, [("k", "p")], ["p"])
    assert exact.count() == 4 and exact.where("p is not null").count() == 0


def test_ranks_are_bigint_and_join_without_a_hint(spark):
    df = spark.createDataFrame([(g, v) for g in ("a", "b") for v in (3, 1, 2)], "g string, v int")
    r = ranked(df, "g", [F.col("v").asc()])
    assert dict(r.dtypes)["row_rank"] == "bigint"
    assert sorted(map(tuple, r.select("g", "v", "row_rank").collect())) == [(g, v, v) for g in ("a", "b") for v in (1, 2, 3)]


def test_relations_keep_every_row(spark):
    t = driver_tables(spark, SF)
    for rel in RELATIONS:
        assert t[rel.name].count() == spark.read.parquet(f"{SF}/{rel.source}.parquet").count(), rel.name
