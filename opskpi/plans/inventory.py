"""Inventory page: works orders in progress and stock-lot KPIs (I2a ... I14).

Plan notes
* Stock-lot transfers are a log (fact).  "Latest transfer per lot" is
  aggregated before it is joined to the lots, so the join sees one row per
  lot instead of every movement.
* Left joins that only add fan-out and whose rows a later GROUP BY merges
  again are dropped (noted per metric); left joins that can *add* rows the
  output keeps are preserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.functions import dates as S
from opskpi.functions.clock import AsOf, days_between
from opskpi.functions.numbers import qty_day_diff, try_decimal
from opskpi.functions.text import fold, key_eq, label, left, none_like, text_eq, text_like, text_ne, text_not_in, text_not_like
from opskpi.operators.classify import first_nonzero_class
from opskpi.operators.relational import repeat_by_matches
from opskpi.operators.skew import product_join
from opskpi.plans.metric import chart, ruled
from opskpi.plans.rules import Lookup, Rule
from opskpi.sources.tables import Tables

PAGE = "inventory"
C = F.col
XY = ("label", "value")

# --- fixed values: production locations / pseudo-parts excluded by I6 ------
I6_JOB_TYPES_EXCLUDED = ("SMT", "TEST", "QA", "CONCOAT", "SUB CONTRACTOR", "ENGINEERING WIP",
                         "KITTING ON HOLD", "MATERIAL SALES", "SUB CON - TO BE SENT",
                         "PENDING CUSTOMER")
I6_PARTS_EXCLUDED = ("SMT ATTRITION", "ADDITIONAL CHARGE", "EXCESS MATERIAL", "CONSUMABLE ISSUES")
I6_PART_PATTERNS_EXCLUDED = ("%FAI REPORT", "%FAIR%", "%WRITE-OFF", "%-RETURN", "%-REPAIR")


def big(n: int):
    return F.lit(n).cast("bigint")


ruled(Rule("worksOrder",
           where=lambda clock: ((C("WOQtyOS") > 0) & text_eq(C("WOStatusDescription"), "WIP")
                                & none_like(C("WOPartNo"), ("%-REPAIR", "%-RETURN"))),
           out=lambda clock: {"label": label(C("WONo"), " | ", C("WOQtyOS"), " | ", F.coalesce(C("WOPartNo"), F.lit(""))),
                              "value": clock.age(C("WOSchedStartDate")), "_start": C("WOSchedStartDate")}),
      "I2a_wip", "WIP - Days since WO Start Date (Oldest 10)", XY, (("_start", "asc"),), PAGE,
      limit=10, x_label="Days Since WO Start Date (Scheduled)", formatter="integer",
      note="ordered by scheduled start; a NULL start sorts first and enters the top 10")

ruled(Rule("worksOrder", where=lambda clock: text_eq(C("WOStatusDescription"), "On Hold"),
           out=lambda clock: {"label": C("WOPartNo"), "value": clock.due(C("WOSchedStartDate")),
                              "_start": C("WOSchedStartDate")}),
      "I2b_wip", "WIP - Works Orders ON-HOLD", XY, (("_start", "asc"),), PAGE, x_label="Days", formatter="integer")

ruled(Rule("worksOrder",
           where=lambda clock: (
               C("WOSchedStartDate").isNotNull() & clock.age_gt(C("WOSchedStartDate"), 0)
               & (C("WOJobType").isNull() | (text_not_like(C("WOJobType"), "PR%")
                                             & text_not_in(C("WOJobType"), I6_JOB_TYPES_EXCLUDED)))
               & text_not_in(C("WOStatusDescription"), ("Completed", "Total Qty Received", "On Hold"))
               & text_not_in(C("WOPartNo"), I6_PARTS_EXCLUDED) & none_like(C("WOPartNo"), I6_PART_PATTERNS_EXCLUDED)),
           out=lambda clock: {"label": left(label(C("WONo"), " | ", F.coalesce(C("WOJobType"), F.lit("")), " | ",
                                                  F.coalesce(C("WOPartNo"), F.lit(""))), 80),
                              "value": clock.age(C("WOSchedStartDate"))}),
      "I6_location", "Works Orders not in Prod Location (Top 20)", XY, (("value", "desc"),), PAGE,
      limit=20, x_label="Days Since WO Start Date (Scheduled)", formatter="integer")


@chart("I10_material", "Material Only WO (Start Date 12/12/12)", XY, (("value", "desc"),), PAGE,
       x_label="Days Until Scheduled Start", formatter="integer",
       note="the left join to the part master adds no column but can repeat rows; kept, as a "
            "an inner join plus an anti-join, whose hot keys AQE can split")
def i10(t: Tables, clock: AsOf) -> DataFrame:
    wo = t["worksOrder"].where(
        text_ne(C("WOPartNo"), "PROCEDURES") & S.sentinel_in(C("WOEarliestStartDate"), S.MATERIAL_ONLY_START)
        & text_ne(C("WOStatusDescription"), "Completed"))
    rows = repeat_by_matches(wo, t["AllItems"], "WOPartNo", "PartNo")
    return rows.select(label(C("WONo"), "|", C("WOPartNo")).alias("label"),
                       clock.due(C("WOSchedStartDate")).alias("value"))


# --------------------------------------------------------------------------
def lots_with_last_transfer(t: Tables, location_pattern: str) -> DataFrame:
    """Lots in matching locations with their latest transfer date (NULL if none)."""
    grn = t["AllLiveGRN"].where(text_like(C("GRNLocation"), location_pattern))
    tr = (t["AllGRN_Transfer"].groupBy("TransferGRNNo", "TranferGRNLineNo")
          .agg(F.max("TransferDate").alias("LastTransfer")))
    j = grn.join(tr, (grn["GRNNo"] == tr["TransferGRNNo"]) & (grn["GRNLineNo"] == tr["TranferGRNLineNo"]),
                 "left")
    return j.groupBy("GRNNo", "GRNLocation", "GRNPartNo").agg(F.max("LastTransfer").alias("LastTransfer"))


ruled(Rule("AllLiveGRN", where=lambda clock: text_eq(C("GRNLocation"), "GREY MARKET INSPECTION"),
           out=lambda clock: {"label": label(C("GRNNo"), " (X", C("GRNQtyLeft"), ") ", C("GRNPartNo")),
                              "value": clock.age(C("GRNDateReceived")), "target": big(5)}),
      "I8", "Grey Market Inspection", XY + ("target",), (("value", "desc"),), PAGE, x_label="Days", formatter="integer")

ruled(Rule("AllLiveGRN",
           where=lambda clock: ((C("GRNRequiresRelease") == 1) & text_not_like(C("GRNLocation"), "MRB%")
                                & text_ne(C("GRNLocation"), "GREY MARKET INSPECTION")),
           lookups=(Lookup("AllItems", (("GRNPartNo", "PartNo"),), ("PartDescription",), "left", folded=True),),
           keys=("GRNNo", "GRNPartNo", "PartDescription", "GRNDateReceived"),
           out=lambda clock: {"label": left(label(C("GRNNo"), " <", C("GRNPartNo"), "> ", C("PartDescription")), 25),
                              "value": clock.age(C("GRNDateReceived")), "target": big(5)}),
      "I4", "Stock Awaiting Release (Days since parts Received)", XY + ("target",), (("value", "desc"),),
      PAGE, x_label="Days In WIP", formatter="integer",
      note="target 5 is emitted (the source's 'Target' alias is lost by the case-sensitive "
           "payload). The join to the WO part-demand list only decides a grouping key that is "
           "a function of the part, so it cannot change the rows and is not performed.")


@chart("I7", "LOST STOCK Location (Days)", XY + ("class_name", "target"), (("_last", "asc"),), PAGE,
       x_label="Days Lost", formatter="integer",
       note="value/class = first non-zero of the RED, AMBER, GREEN columns; the join to the "
            "transfer log only repeats rows the GROUP BY merges, so it is not performed. "
            "Lot value in the label is printed as a whole number.")
def i7(t: Tables, clock: AsOf) -> DataFrame:
    als = t["AllLostStock"]
    # the lots are the non-preserved side of the outer join; only their
    # distinct (lot, line, qty, cost, part) values can reach the deduped
    # output, so collapse them first (map-side) — a hot lot cannot swamp a task
    grn = t["AllLiveGRN"].select(C("GRNNo").alias("_g_no"), C("GRNLineNo").alias("_g_line"),
                                 "GRNQtyLeft", "GRNUnitCost", "GRNPartNo").distinct()
    j = als.join(grn, (als["GRNNo"] == grn["_g_no"]) & (als["GRNLineNo"] == grn["_g_line"]), "left")
    keys = j.select("GRNNo", "GRNQtyLeft", "GRNUnitCost", "GRNPartNo", "LOST_STOCK_AMBER",
                    "LOST_STOCK_GREEN", "LOST_STOCK_RED", "MaxOfTransferDate").distinct()
    value, cls = first_nonzero_class(
        [(try_decimal(C("LOST_STOCK_RED")), "lost-stock-red"),
         (try_decimal(C("LOST_STOCK_AMBER")), "lost-stock-amber"),
         (try_decimal(C("LOST_STOCK_GREEN")), "lost-stock-green")],
        F.lit(0), "lost-stock-unknown")
    lot_value = F.round(try_decimal(C("GRNQtyLeft")) * try_decimal(C("GRNUnitCost")), 0)
    return keys.select(
        label(C("GRNNo"), "(X", C("GRNQtyLeft"), " <> £", lot_value, ") ", C("GRNPartNo")).alias("label"),
        value.cast("double").alias("value"), cls.alias("class_name"), big(30).alias("target"),
        C("MaxOfTransferDate").alias("_last"))


@chart("I9", "WIP - Open Works Orders with Zero O/S Qty", XY, (("value", "desc"),), PAGE,
       x_label="Days Since Last Receipt", formatter="integer")
def i9(t: Tables, clock: AsOf) -> DataFrame:
    wo = t["worksOrder"]
    # latest receipt per WO, aggregated before the join; one row per distinct
    # WO quantity, as the per-(WO, qty) grouping of the receipts gives
    rec = t["AllWORec"].groupBy("GRNWO").agg(F.max("GRNDateReceived").alias("LastReceipt"))
    qty = wo.select(C("WONo").alias("_q_wo"), "WOQty").distinct()
    rec = rec.join(qty, rec["GRNWO"] == qty["_q_wo"], "left").select("GRNWO", "LastReceipt")
    open_wo = wo.where((C("WOQtyOS") == 0) & text_ne(C("WOStatusDescription"), "Completed")
                       & text_ne(C("WOPartNo"), "PROCEDURES"))
    open_wo = repeat_by_matches(open_wo, t["AllItems"], "WOPartNo", "PartNo")
    j = open_wo.join(rec, open_wo["WONo"] == rec["GRNWO"], "inner")
    return j.select(label(C("WONo"), " # ", C("WOPartNo")).alias("label"),
                    clock.age(C("LastReceipt")).alias("value"))


@chart("I11", "WO Schedule Finish > SO Promised", XY, (("value", "desc"),), PAGE,
       x_label="Days Late", formatter="integer")
def i11(t: Tables, clock: AsOf) -> DataFrame:
    wo = t["worksOrder"].where(text_ne(C("WOStatusDescription"), "Completed"))
    wo = repeat_by_matches(wo, t["AllItems"], "WOPartNo", "PartNo")
    wo = wo.select("WONo", "WOSalesOrder", "WOLineNo", "WOPartNo", "WOSchedFinishDate")
    so = (t["AllSO"].where(qty_day_diff(C("SOLineShipQty"), C("SOLineQty")) > 0)
          .select("SONo", "SOLineNo", "SOLinePromisedDate"))
    # the source defines this join as a product per (sales order, line)
    j = product_join(wo, so, [("WOLineNo", "SOLineNo"), ("WOSalesOrder", "SONo")],
                     where=days_between(C("SOLinePromisedDate"), C("WOSchedFinishDate")) > 0)
    return j.select(
        label(C("WONo"), " <", C("WOSalesOrder"), "/", C("WOLineNo"), "> ", C("WOPartNo")).alias("label"),
        days_between(C("SOLinePromisedDate"), C("WOSchedFinishDate")).alias("value"))


# --------------------------------------------------------------------------
#: Lots expiring in < 60 days (incl. expired) outside quarantine, deduped on lot, part and part attributes.
EXPIRING = Rule(
    "AllLiveGRN",
    where=lambda clock: clock.due_lt(C("GRNExpiryDate"), 60) & text_not_like(C("GRNLocation"), "%QUARANTINE%"),
    lookups=(Lookup("AllItems", (("GRNPartNo", "PartNo"),),
                    ("PartDescription", "PartLeadTime", "PartGroupCode", "DemandSO", "DemandWO", "PartStockActive"), folded=True),),
    derived=lambda: {"Demand": C("DemandSO") + C("DemandWO")},
    keys=("GRNNo", "GRNPartNo", "PartDescription", "GRNQtyLeft", "PartLeadTime", "GRNExpiryDate", "PartGroupCode",
          "GRNLocation", "Demand", "PartStockActive"),
    out=lambda clock: {"label": label(C("GRNNo"), " <", C("GRNPartNo"), ">"), "value": clock.due(C("GRNExpiryDate"))})


def expiring_lots(t: Tables, clock: AsOf) -> DataFrame:
    return EXPIRING.grouped(t, clock).withColumn("DaysTillExpiry", clock.due(C("GRNExpiryDate")))


ruled(EXPIRING, "I12", "Material and PCB Shelf Life Expiry Within 60 Days", XY, (("value", "asc"),), PAGE,
      x_label="Days Until Expiry", formatter="integer")


@chart("I13", "WO Completed with OS Material Issues", XY, (("value", "desc"),), PAGE,
       x_label="QTY", formatter="integer")
def i13(t: Tables, clock: AsOf) -> DataFrame:
    bom = t["worksOrderBOM"].where((C("WOBOMTotalRequired") > 0)
                                   & (C("WOQtyIssuedToDate") < C("WOBOMTotalRequired"))
                                   & (C("WOQtyIssuedToDate") >= 0))
    items = t["AllItems"].where(text_not_like(C("PartGroupCode"), "CONSUMABLE%")).select("PartNo")
    partial = (bom.join(items, key_eq(bom["WOBOMChildPartNo"], items["PartNo"]), "inner")
               .groupBy("WONo", "WOPartNo").agg(F.count("WOBOMChildPartNo").alias("QtyItemsPartialKit")))
    done = t["worksOrder"].where(text_eq(C("WOStatusDescription"), "Completed")).select(C("WONo").alias("_wo"))
    j = partial.join(done, partial["WONo"] == done["_wo"], "inner").where(C("QtyItemsPartialKit") > 0)
    return j.select(C("WONo").cast("string").alias("label"), C("QtyItemsPartialKit").alias("value"))


@chart("I14", "Zero Qty WO Items with current stock > £20 (Top 20 by value)", XY, (("value", "desc"),),
       PAGE, limit=20, x_label="value (£)", formatter="integer",
       note="BOM lines are counted per part before meeting the stock lots, so the join does "
            "not multiply BOM lines by lots")
def i14(t: Tables, clock: AsOf) -> DataFrame:
    grn = t["AllLiveGRN"].where(C("GRNPartNo").isNotNull())
    lots = grn.groupBy(fold(C("GRNPartNo")).alias("_lot_part"), "GRNNo").agg(
        F.sum(try_decimal(C("GRNQtyLeft"), 18, 4)).alias("GRNSumQtyLeft"),
        F.max(try_decimal(C("GRNUnitCost"), 18, 4)).alias("GRNMaxUnitCost"))
    wob = t["worksOrderBOM"].where((C("WOBOMQty") == 0) & text_ne(C("WOBOMChildPartNo"), "DNF"))
    items = t["AllItems"].where((C("PartMainlyPurchased") == 1)
                                & text_not_like(C("PartGroupCode"), "CONSUMABLE%")) \
        .select("PartNo", "PartDescription", "PartDefLocation", "PartGroupCode")
    wo = t["worksOrder"].where(text_ne(C("WOStatusDescription"), "Completed")
                               & ((C("WOQty") - C("WOQtyOS")) == 0)).select(C("WONo").alias("_wo"))
    bom = wob.join(items, key_eq(wob["WOBOMChildPartNo"], items["PartNo"]), "inner") \
        .join(wo, wob["WONo"] == wo["_wo"], "inner")
    per_part = bom.groupBy(fold(C("WOBOMChildPartNo")).alias("_part"), "PartDescription", "PartDefLocation",
                           "PartGroupCode") \
        .agg(F.min("WOBOMChildPartNo").alias("WOBOMChildPartNo"), F.count("WONo").alias("CountOfWONo"))
    stock = per_part.join(lots, per_part["_part"] == lots["_lot_part"], "inner") \
        .where(C("GRNSumQtyLeft") > 0) \
        .withColumn("ApproxSurplusCost", F.round(C("GRNSumQtyLeft") * C("GRNMaxUnitCost"), 0)) \
        .where(C("ApproxSurplusCost") > 20)
    per_item = stock.groupBy("WOBOMChildPartNo", "PartDescription", "CountOfWONo").agg(
        F.sum("GRNSumQtyLeft").alias("SumOfGRNSumQtyLeft"),
        F.sum("ApproxSurplusCost").alias("SumOfApproxSurplusCost"))
    return per_item.select(C("WOBOMChildPartNo").alias("label"),
                           C("SumOfApproxSurplusCost").cast("double").alias("value"))
