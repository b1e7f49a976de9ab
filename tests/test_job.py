"""The batch entry point on relations stored as their own Parquet datasets
(the production layout), including filter pushdown on raw columns."""

import os
import tempfile

from opskpi import job
from opskpi.plans.metric import all_metrics
from opskpi.plans.queries import AS_OF, DRIVER_PARAMS
from opskpi.sources.driver import RELATIONS, driver_tables
from opskpi.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_job_on_parquet_relations(spark):
    lake = tempfile.mkdtemp(prefix="opskpi-lake-")
    t = driver_tables(spark, SF)
    for r in RELATIONS:
        t[r.name].write.parquet(os.path.join(lake, r.name))
    tables = Tables.from_parquet(spark, lake, [r.name for r in RELATIONS])

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    d1d = all_metrics()["kpi_D1d"].frame(tables, AS_OF, **DRIVER_PARAMS)
    plan = d1d._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(PODetDatePromised,2000-06-30)" in plan
    assert "GreaterThan(PODetDatePromised,1996-01-01)" in plan
    same = all_metrics()["kpi_D1d"].frame(t, AS_OF, **DRIVER_PARAMS)
    assert sorted(map(tuple, d1d.collect())) == sorted(map(tuple, same.collect()))

    out = tempfile.mkdtemp(prefix="opskpi-job-")
    paths = job.main(["--tables", lake, "--out", out, "--as-of", "2000-06-30T00:00:00", "--params",
                      '{"promised_after": "1996-01-01", "enquiry_from": "1996-01-01", "raised_after": "1999-07-31"}'])
    snap = spark.read.parquet(paths["kpi_snapshot"])
    assert snap.where("metric_id = 'D1d'").count() == same.count()
