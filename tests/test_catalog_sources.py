import json

from pyspark.sql import functions as F
import pytest

from opskpi.plans.catalog import (DEPARTMENT_ITEMS, department_metric, item_crosswalk, metric_catalog,
                                  normalise_department, normalise_department_name, scope_to_department)
from opskpi.plans.filters import q1_type, q7_type
from opskpi.plans.metric import all_metrics
from opskpi.sources import jdbc
from opskpi.sources.tables import Tables


def test_department_matrix_sizes(spark):
    sizes = {k: len(v) for k, v in DEPARTMENT_ITEMS.items()}
    assert sizes == {"all": 52, "com": 5, "eng": 18, "man": 16, "pur": 22, "qa": 8}
    listed = set().union(*[set(v) for k, v in DEPARTMENT_ITEMS.items() if k != "all"])
    assert set(DEPARTMENT_ITEMS["all"]) - listed == {"Q6", "D3a", "D5", "D12", "I10", "I11"}
    assert department_metric(spark).count() == 52 + 5 + 18 + 16 + 22 + 8


def test_crosswalk_points_at_registered_queries(spark):
    reg = all_metrics()
    for r in item_crosswalk(spark).collect():
        prefix = "kpi" if r.kind == "chart" else "table"
        assert f"{prefix}_{r.query_id}" in reg, r


def test_department_names_normalise(spark):
    df = spark.createDataFrame([(" Purchasing ",), ("QA",), ("quality",), ("nonsense",), (None,)], "d string")
    assert [r[0] for r in df.select(normalise_department(F.col("d"))).collect()] == ["pur", "qa", "qa", "all", "all"]
    assert normalise_department_name("Man") == "man"


def test_catalog_and_scope(spark):
    cat = metric_catalog(spark)
    kinds = {r.kind: r.n for r in cat.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"chart": 48, "table": 5, "export": 14, "filter": 2}
    q1 = cat.where("key = 'kpi_Q1'").first()
    assert (q1.band_start, q1.band_end, q1.item_id) == (0.0, 30.0, "Q1")
    i12 = cat.where("key = 'export_I12'").first()
    assert i12.departments == ["man", "pur"]
    rows = spark.createDataFrame([("D4", 1.0), ("Q8", 2.0), ("p13_coshh", 3.0), ("S1_days_since_accident", 4.0)],
                                 "metric_id string, value double")
    assert sorted(r.metric_id for r in scope_to_department(rows, "purchasing").collect()) == \
        ["D4", "S1_days_since_accident"]
    assert sorted(r.metric_id for r in scope_to_department(rows, "eng").collect()) == \
        ["S1_days_since_accident", "p13_coshh"]
    assert scope_to_department(rows, "bogus").count() == 4


def test_constant_filter_lists(spark):
    assert [tuple(r) for r in q1_type(spark).collect()] == [("RETURN", "RETURN"), ("REPAIR", "REPAIR")]
    assert [r.label for r in q7_type(spark).collect()] == ["Corrective", "preventative", "Follow Up"]


def test_tables_are_case_insensitive(spark):
    df = spark.range(1)
    t = Tables.from_frames({"AllItems": df})
    assert t["allItems"] is t["ALLITEMS"] and "allitems" in t
    with pytest.raises(KeyError):
        t["missing"]


def test_jdbc_options_file(spark, tmp_path):
    mapping = {"options": {"url": "jdbc:x://db1", "driver": "x.Driver", "user": "u", "fetchsize": 5},
               "relations": {
                   "AllLivePO": {"table": "erp.po_lines", "columns": {"PODetPart": "part_number"},
                                 "partition": {"column": "PONum", "lower": 1, "upper": 1000, "parts": 16},
                                 "options": {"sessionInitStatement": "SET X"}},
                   "employees": {"options": {"query": "select 1"}}}}
    path = tmp_path / "jdbc.json"
    path.write_text(json.dumps(mapping, indent=1))
    read = jdbc.load_mapping(spark, str(path))
    assert read == mapping
    opts = jdbc.reader_options(read, "AllLivePO")
    assert opts == {"url": "jdbc:x://db1", "driver": "x.Driver", "user": "u", "fetchsize": "5", "dbtable": "erp.po_lines",
                    "partitionColumn": "PONum", "lowerBound": "1", "upperBound": "1000", "numPartitions": "16",
                    "sessionInitStatement": "SET X"}
    assert jdbc.renames(read, "AllLivePO") == {"part_number": "PODetPart"}
    assert "dbtable" not in jdbc.reader_options(read, "employees")
    assert jdbc.reader_options(read, "AllItems")["dbtable"] == "AllItems" and jdbc.renames(read, "AllItems") == {}
    for name in jdbc.FACTS[1:]:
        with pytest.raises(ValueError, match="partition"):
            jdbc.reader_options(read, name)
    with pytest.raises(ValueError, match="url"):
        jdbc.reader_options({}, "AllItems")
    tables = jdbc.jdbc_tables(spark, read, ["AllLivePO", "employees"])
    assert "alllivepo" in tables and tables.names() == ["AllLivePO", "employees"]


def test_tables_keep_their_own_plans(spark, tmp_path):
    path = str(tmp_path / "Rel.parquet")
    spark.range(3).write.parquet(path)
    t = Tables.from_parquet(spark, str(tmp_path), ["Rel"])
    a = t.plan(("k",), lambda: t["rel"].where("id > 0"))
    assert t.plan(("k",), lambda: None) is a and a.count() == 2
    spark.range(3, 9).write.mode("append").parquet(path)
    again = t.fresh()
    assert again["REL"].count() == 9 and again.plan(("k",), lambda: again["rel"]) is not a


def test_export_header_labels_in_metadata(spark):
    from opskpi.plans.queries import AS_OF
    from opskpi.sources.driver import driver_tables
    df = all_metrics()["export_D3b"].frame(driver_tables(spark, "/root/testdata/sf0.001"), AS_OF)
    labels = {f.name: f.metadata.get("label") for f in df.schema}
    assert labels["DemandWOSO"] == "Demand WO/SO" and labels["PO"] == "PO"


def test_every_chart_is_visible_to_all_departments():
    from opskpi.plans.catalog import visible_query_ids
    charts = {m.id for m in all_metrics().values() if m.kind == "chart"}
    assert charts <= set(visible_query_ids("all"))
    assert charts - set(visible_query_ids("pur")) >= {"Q6", "D3a", "D5", "D12", "I10_material", "I11"}


def test_department_rows_plan_only_visible_metrics(spark):
    from opskpi.plans.catalog import department_kpi_rows, scope_to_department
    from opskpi.plans.queries import AS_OF, DRIVER_PARAMS
    from opskpi.plans.snapshot import kpi_union
    from opskpi.sources.driver import driver_tables
    t = driver_tables(spark, "/root/testdata/sf0.001")
    a = department_kpi_rows(t, AS_OF, DRIVER_PARAMS, "qa")
    b = scope_to_department(kpi_union(t, AS_OF, DRIVER_PARAMS), "qa")
    cols = ["metric_id", "label", "value"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    assert {r.metric_id for r in a.select("metric_id").distinct().collect()} == \
        {"S1", "S1_days_since_accident", "Q2_grn", "Q7", "Q8", "Q9", "I2b_wip", "P3a"}


def test_tables_from_catalog_and_paths(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    df.createOrReplaceTempView("opskpi_test_rel")
    t = Tables.from_catalog(spark, ["opskpi_test_rel"])
    assert [tuple(r) for r in t["OPSKPI_TEST_REL"].collect()] == [(1, "a")]
    path = str(tmp_path / "rel")
    df.write.parquet(path)
    t2 = Tables.from_paths(spark, {"Rel": path})
    assert t2["rel"].count() == 1
