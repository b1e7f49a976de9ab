"""Metric catalogue, dashboard item crosswalk and department scoping.

* ``metric_catalog``: one row per chart/table/export/filter with its display
  metadata (title, axis, formatter, meta map) and entitlement.
* ``department_metric``: which dashboard items each department sees.
* ``scope_to_department``: keep the KPI rows of a department's items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opskpi.plans.metric import Metric, all_metrics

# --- fixed values: dashboard items per department -------------------------
DEPARTMENT_ITEMS: dict[str, tuple[str, ...]] = {
    "all": ("S1", "Q1", "Q2", "Q3", "Q6", "Q7", "Q8", "Q8b", "Q9", "D1a1", "D1a2", "D1b", "D1c", "D1d",
            "D2", "D3a", "D3b", "D4", "D5", "D7", "D8", "D9", "D10", "D11", "D12", "I2a", "I2b", "I3",
            "I4", "I6", "I7", "I8", "I9", "I10", "I11", "I12", "I13", "I14", "I15", "P1", "P2", "P3a",
            "P3b", "P4", "P5", "P6", "P8", "P9", "P10", "P11", "P12", "P13"),
    "com": ("S1", "Q7", "P3a", "P5", "P8"),
    "eng": ("S1", "Q1", "Q3", "Q7", "Q8b", "I8", "I15", "P1", "P2", "P3a", "P3b", "P4", "P8", "P9", "P10",
            "P11", "P12", "P13"),
    "man": ("S1", "Q2", "Q7", "D1c", "D10", "I2a", "I3", "I4", "I6", "I7", "I9", "I12", "I13", "P3a", "P3b",
            "P8"),
    "pur": ("S1", "Q2", "Q7", "D1a1", "D1a2", "D1b", "D1d", "D2", "D3b", "D4", "D7", "D8", "D9", "D10",
            "D11", "I12", "I14", "I15", "P3a", "P3b", "P6", "P8"),
    "qa": ("S1", "Q2", "Q7", "Q8", "Q9", "I2b", "P3a", "P8"),
}
DEPARTMENT_NAMES = {"all": "ALL DEPARTMENTS", "com": "COMMERCIAL", "eng": "ENGINEERING",
                    "man": "MANUFACTURING", "pur": "PURCHASING", "qa": "QUALITY"}
DEPARTMENT_SYNONYMS = {"all": "all", "com": "com", "commercial": "com", "eng": "eng", "engineering": "eng",
                       "man": "man", "manufacturing": "man", "pur": "pur", "purchasing": "pur", "qa": "qa",
                       "quality": "qa"}

# --- fixed values: dashboard item -> query id where they differ ------------
ITEM_QUERY = {"Q2": "Q2_grn", "Q3": "Q3_customer", "I2a": "I2a_wip", "I2b": "I2b_wip", "I6": "I6_location",
              "I10": "I10_material", "P13": "p13_coshh"}
TABLE_ITEMS = ("D10", "D11", "I3", "I15", "P8")
ALWAYS_VISIBLE = ("S1_days_since_accident",)   # shown on its page, not controlled by the filter
EXPORTABLE_ITEMS = ("Q7", "D1b", "D1d", "D2", "D3b", "D4", "D7", "D8", "D9", "D11", "I12", "I15", "P3a", "P6")
ITEM_PAGE = {"S": "safety", "Q": "quality", "D": "deliverables", "I": "inventory", "P": "productivity"}


def normalise_department(c: Column) -> Column:
    """Trim, lower-case, map synonyms; anything unknown means 'all'."""
    mapping = F.create_map(*[F.lit(x) for kv in DEPARTMENT_SYNONYMS.items() for x in kv])
    return F.coalesce(mapping[F.lower(F.trim(c))], F.lit("all"))


def normalise_department_name(value: str | None) -> str:
    return DEPARTMENT_SYNONYMS.get((value or "").strip().lower(), "all")


def item_crosswalk(spark: SparkSession) -> DataFrame:
    """Dashboard item -> (kind, query id, exportable, page)."""
    rows = []
    for item in DEPARTMENT_ITEMS["all"]:
        kind = "table" if item in TABLE_ITEMS else "chart"
        rows.append((item, kind, ITEM_QUERY.get(item, item), item in EXPORTABLE_ITEMS, ITEM_PAGE[item[0]]))
    return spark.createDataFrame(rows, "item_id string, kind string, query_id string, exportable boolean, page string")


def department_metric(spark: SparkSession) -> DataFrame:
    rows = [(dept, item) for dept, items in DEPARTMENT_ITEMS.items() for item in items]
    return spark.createDataFrame(rows, "department string, item_id string")


CATALOG_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("item_id", T.StringType(), True),
    T.StructField("page", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("x_label", T.StringType(), True),
    T.StructField("axis", T.StringType(), True),
    T.StructField("formatter", T.StringType(), True),
    T.StructField("row_limit", T.IntegerType(), True),
    T.StructField("exportable", T.BooleanType(), True),
    T.StructField("export_name", T.StringType(), True),
    T.StructField("departments", T.ArrayType(T.StringType()), True),
    T.StructField("band_start", T.DoubleType(), True),
    T.StructField("band_end", T.DoubleType(), True),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("note", T.StringType(), True),
])


def _item_of(m: Metric) -> str | None:
    reverse = {v: k for k, v in ITEM_QUERY.items()}
    item = reverse.get(m.id, m.id)
    return item if item in DEPARTMENT_ITEMS["all"] else None


def metric_catalog(spark: SparkSession) -> DataFrame:
    rows = []
    for m in all_metrics().values():
        item = _item_of(m) if m.kind in ("chart", "table") else None
        meta = {k: str(v) for k, v in m.meta.items()}
        band = (m.meta.get("targetBandStart"), m.meta.get("targetBandEnd"))
        depts = sorted({normalise_department_name(d) for d in m.departments}) if m.departments else None
        rows.append((m.id, m.kind, m.key, item, m.page or None, m.title, m.x_label or None, m.axis,
                     m.formatter, m.limit, item in EXPORTABLE_ITEMS if item else None, m.export_name, depts,
                     float(band[0]) if band[0] is not None else None,
                     float(band[1]) if band[1] is not None else None, meta, m.note or None))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def visible_query_ids(department: str | None) -> list[str]:
    """Query ids on a department's dashboard (unknown names mean 'all')."""
    items = DEPARTMENT_ITEMS[normalise_department_name(department)]
    return sorted({ITEM_QUERY.get(i, i) for i in items} | set(ALWAYS_VISIBLE))


def scope_to_department(kpi_rows: DataFrame, department: str | None) -> DataFrame:
    """Keep KPI rows whose metric is on the department's dashboard.

    The matrix is a fixed list, so scoping is an ``IN`` filter on
    ``metric_id``: on a union of per-metric plans (where ``metric_id`` is a
    literal) Catalyst folds it and drops the hidden metrics' branches before
    anything runs.
    """
    return kpi_rows.where(F.col("metric_id").isin(visible_query_ids(department)))


def department_kpi_rows(t, clock, params=None, department: str | None = None) -> DataFrame:
    """KPI rows of one department's dashboard, planning only its metrics
    (same rows as ``scope_to_department(kpi_union(...))``)."""
    from opskpi.plans.snapshot import kpi_union
    return kpi_union(t, clock, params, metrics=department_charts(department))


def department_charts(department: str | None = None) -> list:
    """The chart metrics of a department's dashboard."""
    visible = set(visible_query_ids(department))
    return [m for m in all_metrics().values() if m.kind == "chart" and m.id in visible]
