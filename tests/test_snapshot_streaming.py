import glob
import json
import os
import tempfile
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from opskpi.plans.queries import AS_OF, DRIVER_PARAMS
from opskpi.plans.snapshot import run_snapshot
from opskpi.sources.driver import driver_tables
from opskpi.streaming.refresh import start_refresh

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "value", "target"]
    assert df.count() > 0


def test_snapshot_job_outputs(spark):
    out = tempfile.mkdtemp(prefix="opskpi-snap-")
    paths = run_snapshot(spark, driver_tables(spark, SF), AS_OF, out, DRIVER_PARAMS)
    snap = spark.read.parquet(paths["kpi_snapshot"])
    assert snap.select("metric_id").distinct().count() == 48
    # ranks are 1..n without gaps within every metric
    bad = (snap.groupBy("metric_id").agg(F.min("row_rank").alias("lo"), F.max("row_rank").alias("hi"),
                                         F.count("*").alias("n"), F.countDistinct("row_rank").alias("d"))
           .where("lo <> 1 OR hi <> n OR d <> n"))
    assert bad.count() == 0
    # presentation order of a descending chart: values never increase with rank
    d1d = [r.value for r in snap.where("metric_id = 'D1d'").orderBy("row_rank").collect()]
    assert d1d == sorted(d1d, reverse=True)
    exports = [k for k in paths if k.startswith("exports/")]
    assert len(exports) == 14
    header = open(glob.glob(os.path.join(paths["exports/Qry_Exp_D1d_OverduePO"], "part-*.csv"))[0]).readline()
    assert header.strip() == "PONum,PODetItemNum,POSuppAddressName,Name,DaysLate"
    # a rerun overwrites the same partition instead of appending
    n = snap.count()
    run_snapshot(spark, driver_tables(spark, SF), AS_OF, out, DRIVER_PARAMS, write_exports=False)
    assert spark.read.parquet(paths["kpi_snapshot"]).count() == n


def test_refresh_stream_runs_requested_snapshot(spark):
    req = tempfile.mkdtemp(prefix="opskpi-req-")
    out = tempfile.mkdtemp(prefix="opskpi-out-")
    with open(os.path.join(req, "r1.json"), "w") as fh:
        fh.write(json.dumps({"as_of": "2000-06-30 00:00:00"}) + "\n")
    q = start_refresh(spark, lambda: driver_tables(spark, SF), out, req, DRIVER_PARAMS, available_now=True,
                      name=f"refresh_test_{int(time.time())}")
    q.awaitTermination(600)
    snap = spark.read.parquet(os.path.join(out, "kpi_snapshot"))
    assert str(snap.select("as_of").distinct().first()[0]) == "2000-06-30 00:00:00"
