"""Generic operators registered as queries on relations derived from the driver tables.

Each ``op_*`` query exercises one reusable operator on whole tables, next to
an independent DuckDB statement in ``OP_ORACLE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opskpi.functions import dates as S
from opskpi.functions.clock import AsOf
from opskpi.functions.text import key_eq
from opskpi.operators.classify import (first_nonzero_class, in_band, rag_class, sign_state, target_interval,
                                       threshold_class)
from opskpi.operators.payload import (LABEL_KEYS, axis_domain, display_format, sanitize_class, sort_rows, to_kpi_rows,
                                      truncate_label, with_label_keys)
from opskpi.operators.rank import ranked
from opskpi.operators.relational import anti_exception, dedupe_then_project, latest_per_key, top_n
from opskpi.functions.numbers import try_decimal
from opskpi.plans import oracle_sql as O
from opskpi.plans.catalog import (DEPARTMENT_ITEMS, ITEM_PAGE, ITEM_QUERY, department_charts, department_metric,
                                  item_crosswalk, metric_catalog, normalise_department)
from opskpi.plans.metric import all_metrics
from opskpi.plans.queries import AS_OF, DRIVER_PARAMS
from opskpi.plans.snapshot import kpi_union, rank_kpi_rows, staged_kpi_rows
from opskpi.sources.driver import driver_tables

C = F.col
AXIS_METRICS = ("D1d", "D3a", "Q1", "P10")
RANKED_METRICS = ("D1d", "P3a", "Q8", "D9")   # the first two descend by value, the others ascend
ENTITLED_METRICS = ("Q8", "Q8b", "P10", "D12", "Q3_customer")
AFTERNOON = AsOf.parse("2000-06-30 14:00:00")
# department names as users type them, picked by the tool number
TYPED_DEPARTMENTS = (" Purchasing ", "QA", "eng", "Manufacturing", "warehouse", "ALL")


def _chart(t, mid: str) -> DataFrame:
    return all_metrics()[f"kpi_{mid}"].frame(t, AS_OF, **DRIVER_PARAMS)


def op_latest_event_per_key(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    return latest_per_key(t["AllGRN_Transfer"], ["TransferGRNNo", "TranferGRNLineNo"], "TransferDate",
                          "LastTransfer").withColumn("LastTransfer", C("LastTransfer").cast("string"))


def op_anti_exception_list(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    po = t["AllLivePO"].select("PONum", "PODetItemNum", "PODetPart")
    return anti_exception(po, t["PONoDemandOK"], [("PONum", "PO"), ("PODetItemNum", "Line")])


def op_dedupe_then_project(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    return dedupe_then_project(t["AllCR"], ["ContractReviewNo", "ContRevDetailTaskNo", "AssignedName",
                                            "CRStatusDescription"], "ContractReviewNo", "AssignedName")


def op_top_n_tiebroken(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    po = t["AllLivePO"].select("PONum", "PODetItemNum", "PODetPart",
                               (C("PODetUnitPrice") * C("PODetQtyReq")).cast("double").alias("LineValue"))
    return top_n(po, [("LineValue", "desc")], 25, tiebreak=["PONum", "PODetItemNum", "PODetPart"])


def op_sentinel_partition(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    latest = C("PODetDateLatest")
    status = (F.when(latest.isNull(), "no-date")
              .when(S.sentinel_in(latest, S.UNKNOWN_DELIVERY), "unknown-delivery")
              .when(S.sentinel_in(latest, S.SHIPPED), "shipped")
              .when(S.sentinel_in(latest, S.D1A2_LATEST_EXCLUDED), "other-sentinel")
              .otherwise("dated"))
    return t["AllLivePO"].groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("lines"))


def op_age_buckets(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    wo = t["worksOrder"].select("WONo", AS_OF.due(C("WOSchedStartDate")).alias("value"))
    lo, hi, gap = target_interval(C("value"), F.lit(7).cast("bigint"), F.lit(0).cast("bigint"))
    return wo.select("WONo", "value", sign_state(C("value")).alias("sign"), lo.alias("target_from"),
                     hi.alias("target_to"), gap.alias("gap"))


def op_monthly_count(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    acc = t["Accident"]
    return acc.groupBy(F.date_format(C("Date"), "yy/MM").alias("month")).agg(
        F.count("Accident_Description").alias("accidents"), F.count(F.lit(1)).alias("rows"))


def op_two_level_value(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    lots = t["AllLiveGRN"].groupBy("GRNPartNo", "GRNNo").agg(
        F.sum(try_decimal(C("GRNQtyLeft"), 18, 4)).alias("qty"), F.max(try_decimal(C("GRNUnitCost"), 18, 4)).alias("cost"))
    lots = lots.withColumn("lot_value", F.round(C("qty") * C("cost"), 0))
    return lots.groupBy("GRNPartNo").agg(F.count(F.lit(1)).alias("lots"),
                                         F.sum("lot_value").cast("double").alias("part_value"))


def op_rag_class(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    value, cls = first_nonzero_class(
        [(try_decimal(C("LOST_STOCK_RED")), "lost-stock-red"), (try_decimal(C("LOST_STOCK_AMBER")), "lost-stock-amber"),
         (try_decimal(C("LOST_STOCK_GREEN")), "lost-stock-green")], F.lit(0), "lost-stock-unknown")
    return t["AllLostStock"].select("GRNNo", "GRNLineNo", value.cast("double").alias("value"),
                                    cls.alias("class_name"))


def op_axis_domain(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    rows = None
    for mid in AXIS_METRICS:
        r = to_kpi_rows(_chart(t, mid), mid)
        rows = r if rows is None else rows.unionByName(r)
    meta = (metric_catalog(spark).where(C("kind") == "chart")
            .select(C("query_id").alias("metric_id"), "axis", "band_start", "band_end"))
    dom = axis_domain(rows, meta)
    return dom.select("metric_id", "axis_min", "axis_max", "step", F.size("ticks").cast("bigint").alias("ticks"))


def op_department_scope(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    return staged_kpi_rows(t, AS_OF, DRIVER_PARAMS, department_charts(" Purchasing "),
                           lambda rows: rows.groupBy("metric_id").agg(F.count(F.lit(1)).alias("rows")))


def op_display_format(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    d4 = _chart(t, "D4")
    return d4.select("label", display_format(C("value"), "integer").alias("value_text"),
                     display_format(C("right_value"), "currency").alias("right_value_text"))


def op_snapshot_union(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    return staged_kpi_rows(t, AS_OF, DRIVER_PARAMS,
                           shape=lambda rows: rows.drop(*[c for c in rows.columns if c.startswith("_k")]))


def op_snapshot_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """KPI rows with their place in each metric's presentation order."""
    t = driver_tables(spark, sf)
    metrics = [all_metrics()[f"kpi_{m}"] for m in RANKED_METRICS]
    return rank_kpi_rows(kpi_union(t, AS_OF, DRIVER_PARAMS, metrics)).select("metric_id", "label", "value", "row_rank")


def op_label_truncate(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    q1 = _chart(t, "Q1")
    return q1.select(truncate_label(C("label"), 40).alias("label"), "value")


def op_sort_label_numeric(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    d12 = with_label_keys(_chart(t, "D12").select("label").withColumn("_one", F.lit(1)))
    return ranked(d12, "_one", sort_rows(d12, "label"), checkpoint_input=False, sort_only=LABEL_KEYS).drop("_one")


def op_value_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Text that is no number drops its row; NULL becomes 0 under the ``zero`` policy."""
    t = driver_tables(spark, sf)
    text = F.when(C("GRNLineNo") % 3 == 0, F.lit(None).cast("string")).otherwise(C("LOST_STOCK_GREEN"))
    rows = t["AllLostStock"].select(C("GRNNo").alias("label"), text.alias("value"))
    return to_kpi_rows(rows, "LOST", null_value_policy="zero").select("metric_id", "label", "value")


def op_value_label_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    return to_kpi_rows(t["worksOrder"], "WO", value_key="WOQtyOS", label_key="WONo").select("metric_id", "label", "value")


def op_sanitize_class(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    return t["AllItems"].select("PartNo", sanitize_class(C("PartGroupCode")).alias("class_name"))


def op_sort_modes(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    rows = t["worksOrder"].select(C("WONo").cast("string").alias("label"), C("WOQtyOS").alias("value"), F.lit(1).alias("_one"))
    rows = with_label_keys(rows)
    return ranked(rows, "_one", [*sort_rows(rows, "descending"), *sort_rows(rows, "label")], sort_only=LABEL_KEYS).drop("_one")


def op_in_band(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    due = AS_OF.due(C("WOSchedStartDate"))
    end = F.when(C("WONo") % 5 == 0, F.lit(None)).otherwise(F.lit(-30)).cast("bigint")
    return t["worksOrder"].select("WONo", in_band(due, F.lit(30), end).alias("in_band"))


def op_threshold_classes(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    age = AS_OF.age(C("WOSchedStartDate"))
    return t["worksOrder"].select(
        "WONo", rag_class(age, 30, 365).alias("by_age"), rag_class(C("WOQtyOS"), 9, 3, higher_is_worse=False).alias("by_qty"),
        threshold_class(C("WOQtyOS"), 5, otherwise="fine").alias("by_threshold"))


def op_item_entitlement(spark: SparkSession, sf: str) -> DataFrame:
    """KPI rows by dashboard item and department (crosswalk and entitlement matrix)."""
    t = driver_tables(spark, sf)
    counts = None
    for mid in ENTITLED_METRICS:
        r = to_kpi_rows(_chart(t, mid), mid).groupBy("metric_id").agg(F.count(F.lit(1)).alias("rows"))
        counts = r if counts is None else counts.unionByName(r)
    items = item_crosswalk(spark).where(C("kind") == "chart")
    return (counts.join(items, counts["metric_id"] == items["query_id"]).join(department_metric(spark), "item_id")
            .select("department", "item_id", "page", "exportable", "rows"))


def op_normalise_department(spark: SparkSession, sf: str) -> DataFrame:
    t = driver_tables(spark, sf)
    typed = F.element_at(F.array(*map(F.lit, TYPED_DEPARTMENTS)), (C("ToolNo") % len(TYPED_DEPARTMENTS)).cast("int") + 1)
    typed = F.when(C("ToolNo") % 11 == 0, F.lit(None).cast("string")).otherwise(typed)
    return t["AllCalibration"].select("ToolNo", normalise_department(typed).alias("department"))


def op_folded_part_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lots whose part numbers come in mixed case with trailing blanks, joined to the part master."""
    t = driver_tables(spark, sf)
    part = F.when(C("GRNLineNo") % 2 == 0, F.concat(F.lower("GRNPartNo"), F.lit("  "))).otherwise(C("GRNPartNo"))
    lots = t["AllLiveGRN"].select("GRNNo", "GRNLineNo", part.alias("GRNPartNo"))
    items = t["AllItems"].select("PartNo", "PartDescription")
    return lots.join(items, key_eq(lots["GRNPartNo"], items["PartNo"])).select(
        "GRNNo", "GRNLineNo", "GRNPartNo", "PartDescription")


def op_timestamp_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Comparisons of a timestamp column with an afternoon as-of, to the hour."""
    t = driver_tables(spark, sf)
    at = C("WOSchedStartDate").cast("timestamp_ntz") + F.make_dt_interval(hours=(C("WONo") % 24).cast("int"))
    return t["worksOrder"].select("WONo", at.alias("at")).select(
        "WONo", AFTERNOON.date_ge_now(C("at"), -360).alias("ge"), AFTERNOON.date_gt_now(C("at"), -360).alias("gt"),
        AFTERNOON.date_le_now(C("at"), 28).alias("le"), AFTERNOON.date_lt_now(C("at")).alias("lt"))


def operator_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op_") and callable(fn)}


# ---------------------------------------------------------------- oracle SQL
def _contract_select(mid: str) -> str:
    m = all_metrics()[f"kpi_{mid}"]
    cols = []
    for name in ("label", "value", "target", "target_start", "right_value", "secondary_value"):
        src = name if name in m.columns else "NULL"
        cols.append(f"CAST({src} AS DOUBLE) AS {name}" if name != "label"
                    else "COALESCE(CAST(label AS VARCHAR), '') AS label")
    cls = "class_name" if "class_name" in m.columns else "CAST(NULL AS VARCHAR)"
    cols += [f"{cls} AS class_name", "CAST(NULL AS VARCHAR) AS tooltip", "CAST(NULL AS VARCHAR) AS row_id"]
    return f"SELECT '{mid}' AS metric_id, {', '.join(cols)} FROM ({O.BODIES['kpi_' + mid].strip()})"


def _chart_ids() -> list[str]:
    return sorted(m.id for m in all_metrics().values() if m.kind == "chart")


def _union_sql(ids) -> str:
    return "\nUNION ALL\n".join(_contract_select(i) for i in ids)


_PUR = ("S1_days_since_accident", "Q2_grn", "Q7", "S1", "D1a1", "D1a2", "D1b", "D1d", "D2", "D3b", "D4", "D7", "D8", "D9", "I12", "I14",
        "P3a", "P3b", "P6")

def _item_values() -> str:
    from opskpi.plans.catalog import EXPORTABLE_ITEMS
    return ", ".join(f"('{i}', '{ITEM_QUERY.get(i, i)}', '{ITEM_PAGE[i[0]]}', {i in EXPORTABLE_ITEMS})"
                     for i in DEPARTMENT_ITEMS["all"])


def _department_values() -> str:
    return ", ".join(f"('{d}', '{i}')" for d, items in DEPARTMENT_ITEMS.items() for i in items)


OP_ORACLE: dict[str, Callable[[], str]] = {
    "op_latest_event_per_key": lambda: """
SELECT TransferGRNNo, TranferGRNLineNo, CAST(MAX(TransferDate) AS VARCHAR) AS LastTransfer
FROM AllGRN_Transfer GROUP BY TransferGRNNo, TranferGRNLineNo""",
    "op_anti_exception_list": lambda: """
SELECT po.PONum, po.PODetItemNum, po.PODetPart FROM AllLivePO po
WHERE NOT EXISTS (SELECT 1 FROM PONoDemandOK ok WHERE ok.PO = po.PONum AND ok.Line = po.PODetItemNum)""",
    "op_dedupe_then_project": lambda: """
SELECT ContractReviewNo, AssignedName FROM AllCR
GROUP BY ContractReviewNo, ContRevDetailTaskNo, AssignedName, CRStatusDescription""",
    "op_top_n_tiebroken": lambda: """
SELECT PONum, PODetItemNum, PODetPart, CAST(PODetUnitPrice * PODetQtyReq AS DOUBLE) AS LineValue FROM AllLivePO
ORDER BY LineValue DESC NULLS LAST, PONum ASC NULLS FIRST, PODetItemNum ASC NULLS FIRST, PODetPart ASC NULLS FIRST
LIMIT 25""",
    "op_sentinel_partition": lambda: """
SELECT CASE WHEN PODetDateLatest IS NULL THEN 'no-date'
            WHEN PODetDateLatest = DATE '2081-12-25' THEN 'unknown-delivery'
            WHEN PODetDateLatest IN (DATE '2008-08-08', DATE '2009-09-09', DATE '2010-10-10') THEN 'shipped'
            WHEN PODetDateLatest IN (DATE '2001-01-01', DATE '2002-02-02', DATE '2018-12-31') THEN 'other-sentinel'
            ELSE 'dated' END AS status, COUNT(*) AS lines
FROM AllLivePO GROUP BY 1""",
    "op_age_buckets": lambda: f"""
SELECT WONo, v AS value, CASE WHEN v < 0 THEN 'negative' WHEN v = 0 THEN 'zero' WHEN v > 0 THEN 'positive' END AS sign,
       CAST(least(0, 7) AS BIGINT) AS target_from, CAST(greatest(0, 7) AS BIGINT) AS target_to, v - 7 AS gap
FROM (SELECT WONo, {O.due('WOSchedStartDate')} AS v FROM worksOrder)""",
    "op_monthly_count": lambda: """
SELECT strftime("Date", '%y/%m') AS month, COUNT(Accident_Description) AS accidents, COUNT(*) AS rows
FROM Accident GROUP BY 1""",
    "op_two_level_value": lambda: """
SELECT GRNPartNo, COUNT(*) AS lots, CAST(SUM(ROUND(qty * cost, 0)) AS DOUBLE) AS part_value FROM (
  SELECT GRNPartNo, GRNNo, SUM(TRY_CAST(GRNQtyLeft AS DECIMAL(18,4))) AS qty,
         MAX(TRY_CAST(GRNUnitCost AS DECIMAL(18,4))) AS cost
  FROM AllLiveGRN GROUP BY GRNPartNo, GRNNo) GROUP BY GRNPartNo""",
    "op_rag_class": lambda: """
SELECT GRNNo, GRNLineNo,
       CAST(CASE WHEN r <> 0 THEN r WHEN a <> 0 THEN a WHEN g <> 0 THEN g ELSE 0 END AS DOUBLE) AS value,
       CASE WHEN r <> 0 THEN 'lost-stock-red' WHEN a <> 0 THEN 'lost-stock-amber' WHEN g <> 0 THEN 'lost-stock-green'
            ELSE 'lost-stock-unknown' END AS class_name
FROM (SELECT GRNNo, GRNLineNo, TRY_CAST(LOST_STOCK_RED AS DECIMAL(18,2)) AS r,
             TRY_CAST(LOST_STOCK_AMBER AS DECIMAL(18,2)) AS a, TRY_CAST(LOST_STOCK_GREEN AS DECIMAL(18,2)) AS g
      FROM AllLostStock)""",
    "op_axis_domain": lambda: f"""
WITH rows AS ({_union_sql(AXIS_METRICS)}),
ext AS (
  SELECT metric_id,
         least(0.0, MIN(least(value, target, target_start, secondary_value)),
               CASE WHEN metric_id = 'Q1' THEN 0.0 END, CASE WHEN metric_id = 'Q1' THEN 30.0 END) AS mn,
         greatest(0.0, MAX(greatest(value, target, target_start, secondary_value)),
                  CASE WHEN metric_id = 'Q1' THEN 0.0 END, CASE WHEN metric_id = 'Q1' THEN 30.0 END) AS mx
  FROM rows GROUP BY metric_id),
flat AS (
  SELECT metric_id,
         CASE WHEN mn = mx AND mn <> 0 THEN mn - CASE WHEN abs(mn) * 0.1 = 0 THEN 1.0 ELSE abs(mn) * 0.1 END ELSE mn END AS lo,
         CASE WHEN mn = mx AND mn = 0 THEN 1.0
              WHEN mn = mx THEN mx + CASE WHEN abs(mn) * 0.1 = 0 THEN 1.0 ELSE abs(mn) * 0.1 END ELSE mx END AS hi
  FROM ext),
st AS (
  SELECT metric_id, lo, hi, (hi - lo) / 5.0 AS raw FROM flat),
nice AS (
  SELECT metric_id, lo, hi,
         CASE WHEN raw > 0 THEN
           (CASE WHEN raw / pow(10.0, floor(log10(raw))) <= 1 THEN 1.0
                 WHEN raw / pow(10.0, floor(log10(raw))) <= 2 THEN 2.0
                 WHEN raw / pow(10.0, floor(log10(raw))) <= 5 THEN 5.0 ELSE 10.0 END) * pow(10.0, floor(log10(raw)))
         ELSE 1.0 END AS step
  FROM st)
SELECT metric_id, floor(lo / step) * step AS axis_min, ceil(hi / step) * step AS axis_max, step,
       CAST(least(CAST(floor((ceil(hi / step) * step - floor(lo / step) * step) / step + 0.5) AS INTEGER) + 1, 100)
            AS BIGINT) AS ticks
FROM nice""",
    "op_department_scope": lambda: f"""
SELECT metric_id, COUNT(*) AS rows FROM ({_union_sql(_PUR)}) GROUP BY metric_id""",
    "op_display_format": lambda: f"""
SELECT label, format('{{:,}}', CAST(ROUND(value, 0) AS BIGINT)) AS value_text,
       CASE WHEN right_value < 0 THEN '-£' ELSE '£' END
         || format('{{:,.2f}}', ROUND(CAST(abs(right_value) AS DECIMAL(38,10)), 2)) AS right_value_text
FROM ({O.BODIES['kpi_D4'].strip()})""",
    "op_snapshot_union": lambda: _union_sql(_chart_ids()),
    "op_label_truncate": lambda: f"""
SELECT CASE WHEN length(label) > 40 THEN left(label, 39) || '…' ELSE label END AS label, value
FROM ({O.BODIES['kpi_Q1'].strip()})""",
    "op_sort_label_numeric": lambda: f"""
SELECT label, CAST(row_number() OVER (
         ORDER BY regexp_replace(regexp_replace(lower(label), '(\\d+)', repeat('0', 64) || '\\1', 'g'),
                                 '\\d*(\\d{{64}})', '\\1', 'g') NULLS FIRST,
                  lower(label) NULLS FIRST, label NULLS FIRST) AS BIGINT) AS row_rank
FROM ({O.BODIES['kpi_D12'].strip()})""",
    "op_snapshot_ranked": lambda: f"""
SELECT metric_id, label, value,
       row_number() OVER (PARTITION BY metric_id ORDER BY CASE WHEN metric_id IN ('D1d', 'P3a') THEN -value ELSE value END,
                          label) AS row_rank
FROM ({_union_sql(RANKED_METRICS)})""",
    "op_value_policy": lambda: """
SELECT 'LOST' AS metric_id, CAST(GRNNo AS VARCHAR) AS label, COALESCE(TRY_CAST(v AS DOUBLE), 0) AS value
FROM (SELECT GRNNo, CASE WHEN GRNLineNo % 3 <> 0 THEN LOST_STOCK_GREEN END AS v FROM AllLostStock)
WHERE v IS NULL OR TRY_CAST(v AS DOUBLE) IS NOT NULL""",
    "op_value_label_keys": lambda: """
SELECT 'WO' AS metric_id, CAST(WONo AS VARCHAR) AS label, CAST(WOQtyOS AS DOUBLE) AS value FROM worksOrder""",
    "op_sanitize_class": lambda: """
SELECT PartNo, regexp_replace(regexp_replace(trim(COALESCE(PartGroupCode, '')), '\\s+', ' ', 'g'),
                              '[^A-Za-z0-9_ -]', '-', 'g') AS class_name FROM AllItems""",
    "op_sort_modes": lambda: """
SELECT CAST(WONo AS VARCHAR) AS label, WOQtyOS AS value,
       row_number() OVER (ORDER BY WOQtyOS DESC NULLS LAST, WONo) AS row_rank FROM worksOrder""",
    "op_in_band": lambda: f"""
SELECT WONo, CASE WHEN WONo % 5 <> 0 THEN {O.due('WOSchedStartDate')} BETWEEN -30 AND 30 END AS in_band FROM worksOrder""",
    "op_threshold_classes": lambda: f"""
SELECT WONo, CASE WHEN a >= 365 THEN 'red' WHEN a >= 30 THEN 'amber' WHEN a IS NOT NULL THEN 'green' END AS by_age,
       CASE WHEN q <= 3 THEN 'red' WHEN q <= 9 THEN 'amber' WHEN q IS NOT NULL THEN 'green' END AS by_qty,
       CASE WHEN q < 5 THEN 'warning' ELSE 'fine' END AS by_threshold
FROM (SELECT WONo, WOQtyOS AS q, {O.age('WOSchedStartDate')} AS a FROM worksOrder)""",
    "op_item_entitlement": lambda: f"""
SELECT department, item_id, page, exportable, rows
FROM (SELECT metric_id, COUNT(*) AS rows FROM ({_union_sql(ENTITLED_METRICS)}) GROUP BY metric_id)
JOIN (VALUES {_item_values()}) AS x(item_id, query_id, page, exportable) ON query_id = metric_id
JOIN (VALUES {_department_values()}) AS d(department, item) ON item = item_id""",
    "op_normalise_department": lambda: """
SELECT ToolNo, CASE WHEN ToolNo % 11 = 0 THEN 'all' WHEN ToolNo % 6 = 0 THEN 'pur' WHEN ToolNo % 6 = 1 THEN 'qa'
                    WHEN ToolNo % 6 = 2 THEN 'eng' WHEN ToolNo % 6 = 3 THEN 'man' ELSE 'all' END AS department
FROM AllCalibration""",
    "op_folded_part_join": lambda: """
SELECT GRNNo, GRNLineNo, part AS GRNPartNo, PartDescription
FROM (SELECT GRNNo, GRNLineNo, CASE WHEN GRNLineNo % 2 = 0 THEN lower(GRNPartNo) || '  ' ELSE GRNPartNo END AS part
      FROM AllLiveGRN) JOIN AllItems ON lower(rtrim(part)) = lower(rtrim(PartNo))""",
    "op_timestamp_bounds": lambda: """
SELECT WONo, m >= n - INTERVAL 360 DAY AS ge, m > n - INTERVAL 360 DAY AS gt, m <= n + INTERVAL 28 DAY AS le, m < n AS lt
FROM (SELECT WONo, CAST(WOSchedStartDate AS TIMESTAMP) + to_hours(WONo % 24) AS m,
             TIMESTAMP '2000-06-30 14:00:00' AS n FROM worksOrder)""",
}
