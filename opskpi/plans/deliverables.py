"""Deliverables page: purchase-order and sales-order KPIs (D1a1 ... D12).

Plan notes that apply to all of them
* PO lines (``AllLivePO``) are the fact; ``employees``/``AllItems`` are
  dimensions.  No join here carries a broadcast hint: AQE turns a join into a
  broadcast only when the measured side is below the threshold, otherwise it
  stays a shuffle join — the size check the catalogue relies on.
* Day-count predicates are written on the raw date column (pushable).
* Inner joins whose fan-out a later DISTINCT/GROUP BY removes are written as
  semi-joins; aggregates are computed before joins when that is exact.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.functions import dates as S
from opskpi.functions.clock import AsOf
from opskpi.functions.text import fold, label, left, text_eq, text_ne
from opskpi.operators.relational import semi_filter
from opskpi.plans.metric import chart, ruled
from opskpi.plans.rules import Lookup, Rule
from opskpi.sources.tables import Tables

PAGE = "deliverables"
C = F.col
XY = ("label", "value")


def big(n: int):
    return F.lit(n).cast("bigint")


def po_label(cut: int | None = 50):
    """'PO/line : part : supplier', cut to ``cut`` characters if given."""
    full = label(C("PONum"), "/", C("PODetItemNum"), " : ", C("PODetPart"), " : ", C("POSuppAddressName"))
    return full if cut is None else left(full, cut)


# --------------------------------------------------------------------------
BUYER = Lookup("employees", (("POBuyer", "BadgeNo"),), ("Name",))
BUYER_IF_KNOWN = replace(BUYER, how="left")

ruled(Rule("AllLivePO", params={"promised_after": S.PROMISED_CUTOFF},
           where=lambda clock, promised_after: (
               clock.age_gt(C("PODetDatePromised"), 0) & (C("PODetDatePromised") > F.lit(promised_after))
               & S.sentinel_not_in(C("PODetDateLatest"), S.D1A1_LATEST_EXCLUDED)),
           out=lambda clock: {"label": po_label(None), "value": clock.age(C("PODetDatePromised"))}),
      "D1a1", "Overdue Purchase Orders (Promised)", XY, (("value", "desc"),), PAGE,
      x_label="Days Late", formatter="integer",
      note="latest-date sentinels written as slash text in the source; built as an exclusion "
           "of the sentinel dates (NULL latest drops out). The label is kept whole.")

ruled(Rule("AllLivePO",
           where=lambda clock: (S.sentinel_in(C("PODetDatePromised"), S.UNKNOWN_DELIVERY)
                                | S.sentinel_in(C("PODetDateLatest"), S.UNKNOWN_DELIVERY)),
           out=lambda clock: {"label": po_label(), "value": clock.due(C("PODetDateReq"))}),
      "D1b", "Unknown Delivery Date Purchase Orders", XY, (("value", "asc"),), PAGE,
      x_label="Days Until PO Required Date", formatter="integer")

ruled(Rule("AllLivePO", params={"promised_after": S.PROMISED_CUTOFF},
           where=lambda clock, promised_after: (
               clock.age_gt(C("PODetDatePromised"), 1) & (C("PODetDatePromised") > F.lit(promised_after))
               & S.sentinel_in(C("PODetDateLatest"), S.RECEIVED_NOT_BOOKED)),
           out=lambda clock: {"label": po_label(), "value": clock.age(C("PODetDatePromised"))}),
      "D1c", "Overdue Purchase Orders (Received not Booked In)", XY, (("value", "desc"),), PAGE,
      x_label="Days Since PO Promised Date", formatter="integer")

ruled(Rule("AllLivePO", params={"promised_after": S.PROMISED_CUTOFF},
           where=lambda clock, promised_after: (
               clock.age_gt(C("PODetDatePromised"), 0) & (C("PODetDatePromised") > F.lit(promised_after))
               & S.sentinel_in(C("PODetDateLatest"), S.SHIPPED)),
           out=lambda clock: {"label": po_label(), "value": clock.age(C("PODetDatePromised")), "target": big(5)}),
      "D1d", "Overdue Purchase Orders - Confirmed Shipped", XY + ("target",), (("value", "desc"),),
      PAGE, x_label="Days Late", formatter="integer")

ruled(Rule("AllLivePO", lookups=(BUYER_IF_KNOWN,),
           where=lambda clock: (C("PODetPart").isNotNull() & clock.age_gt(C("PODetDateReq"), 7)
                                & S.sentinel_not_in(C("PODetDateLatest"), S.D1A2_LATEST_EXCLUDED)),
           keys=("PONum", "PODetItemNum", "PODetPart", "PODetPartDescr", "POSuppAddressName", "Name", "PODetDateReq",
                 "PODetDateLatest"),
           measures=lambda: {"max_promised": ("max", C("PODetDatePromised"))},
           late_having=lambda clock: S.sentinel_not_in(C("max_promised"), S.D1A2_PROMISED_EXCLUDED),
           out=lambda clock: {"label": po_label(), "value": clock.age(C("PODetDateReq"))}),
      "D1a2", "Overdue Purchase Orders (Requested) > 7 Days", XY, (("value", "desc"),), PAGE,
      x_label="Days Late", formatter="integer")


# --------------------------------------------------------------------------
def queried_pos(t: Tables, clock: AsOf, raised_after: date, numeric_fallback: bool) -> DataFrame:
    """Open PO queries (not released, raised after the cut-off) with the PO's
    supplier/promise and the buyer.  Chart: the line text must be present and
    only numeric text matches a PO line; export: any PO, non-numeric line -> 0."""
    q = t["PV658"]
    cond = C("PO").isNotNull() & (C("DateRaised") > F.lit(raised_after)) & C("DateReleased").isNull()
    if numeric_fallback:
        q = q.where(cond).withColumn("POline", F.coalesce(C("PO_Line").try_cast("bigint"), big(0)))
        line_key = C("POline")
    else:
        q = q.where(cond & C("PO_Line").isNotNull()).withColumn("_line", C("PO_Line").try_cast("bigint"))
        line_key = C("_line")
    # PO lines are the non-preserved side; both the chart and the export group
    # by these columns, so distinct values are all that can reach the output —
    # collapse them map-side before the join (exact, and a hot PO line cannot
    # swamp one task)
    # Only PO lines named by an open query can match: a semi-join against the
    # queries' distinct (PO, line) keys (small, broadcast by size) cuts the
    # fact down before the dedupe and the outer join.
    wanted = q.select(C("PO").alias("_q_po"), line_key.alias("_q_line")).distinct()
    po = t["AllLivePO"].select("PONum", "PODetItemNum", "POSuppAddressName", "PODetDatePromised")
    po = po.join(wanted, (po["PONum"] == wanted["_q_po"]) & (po["PODetItemNum"] == wanted["_q_line"]),
                 "left_semi").distinct()
    joined = q.join(po, (po["PONum"] == q["PO"]) & (po["PODetItemNum"] == line_key), "left")
    be = t["PV658_BuyerEngineer"].select(C("PO").alias("_be_po"), C("FirstOfBuyer").alias("Buyer"))
    joined = joined.join(be, joined["PONum"] == be["_be_po"], "left")
    return joined.withColumn("DaysInQuery", clock.age(C("DateRaised")))


@chart("D2", "Purchase Orders In Query", XY + ("target_start", "target"), (("value", "desc"),), PAGE,
       x_label="Days in Query", formatter="integer", window_on=("PV658", "DateRaised"))
def d2(t: Tables, clock: AsOf, raised_after: date = S.QUERY_RAISED_CUTOFF) -> DataFrame:
    rows = queried_pos(t, clock, raised_after, numeric_fallback=False)
    # two nested GROUP BYs without aggregates == DISTINCT over the outer keys
    rows = rows.select("PO", "PO_Line", "Buyer", "POSuppAddressName", "DaysInQuery").distinct()
    return rows.select(
        label(C("PO"), "/", C("PO_Line"), " # ", C("Buyer"), " # ", C("POSuppAddressName")).alias("label"),
        C("DaysInQuery").alias("value"), big(0).alias("target_start"), big(5).alias("target"))


# --------------------------------------------------------------------------
def required_date():
    """Earlier of the part's first WO start and first SO promise (either may be NULL)."""
    return S.earliest_of(C("MinOfWOSchedStartDate"), C("MinOfSOLinePromisedDate"))


def po_value():
    return C("PODetUnitPrice") * C("PODetQtyReq")


def demand_label():
    return label(C("PONum"), "/", C("PODetItemNum"), " # ", C("PartNo"), " # £", po_value(), " (", C("Name"), ")")


def _ahead_of_demand(clock: AsOf):
    # the promise keeps its time of day
    promised = C("PODetDatePromised").cast("timestamp_ntz") + F.expr("interval 28 days")
    return required_date().cast("timestamp_ntz") > promised


def _other_month(clock: AsOf):
    return (required_date() > C("PODetDatePromised")) & S.month_differs(required_date(), C("PODetDatePromised"))


#: PO lines > £100 whose part has demand at least 28 days out.  The allow-list
#: anti-join only reads PO columns, so it comes before the dimension joins.
DEMAND = Rule(
    "AllLivePO",
    where=lambda clock: (po_value() > 100) & S.sentinel_not_in(C("PODetDatePromised"), S.D3_PROMISED_EXCLUDED),
    lookups=(Lookup("PONoDemandOK", (("PONum", "PO"), ("PODetItemNum", "Line")), how="anti"),
             Lookup("AllItems", (("PODetPart", "PartNo"),),
                    ("PartNo", "MinOfWOSchedStartDate", "MinOfSOLinePromisedDate", "DemandSO", "DemandWO"), "left", folded=True),
             BUYER_IF_KNOWN),
    having=lambda clock: (clock.due_ge(required_date(), 28)
                          & ((F.coalesce(C("DemandSO"), big(0)) + F.coalesce(C("DemandWO"), big(0))) > 0)),
    out=lambda clock: {"label": demand_label(), "value": clock.due(required_date())})


def demand_lines(t: Tables, clock: AsOf) -> DataFrame:
    """The demand lines with ``RequiredDate``, ``DemandType`` (which of the two dates won) and ``POValue``."""
    wo, so = C("MinOfWOSchedStartDate"), C("MinOfSOLinePromisedDate")
    return (DEMAND.joined(t, clock).withColumn("RequiredDate", required_date())
            .withColumn("DemandType", F.when(wo.isNull(), "SO").when(so < wo, "SO").otherwise("WO"))
            .withColumn("POValue", po_value()))


ruled(replace(DEMAND, having=lambda clock: DEMAND.having(clock) & _ahead_of_demand(clock),
              out=lambda clock: {**DEMAND.out(clock), "target": clock.due(C("PODetDatePromised")), "target_start": big(0)}),
      "D3a", "PO's With Promised Date over 4 Weeks before Demand > £100",
      XY + ("target", "target_start"), (("value", "desc"),), PAGE, x_label="Days", formatter="integer")

ruled(replace(DEMAND, having=lambda clock: DEMAND.having(clock) & _other_month(clock),
              out=lambda clock: {**DEMAND.out(clock), "secondary_value": clock.due(C("PODetDatePromised"))}),
      "D3b", "PO Demand Date Review", XY + ("secondary_value",), (("value", "desc"),), PAGE,
      x_label="Days", formatter="integer",
      meta={"secondaryValueFormatter": "integer", "secondaryValueLabel": "Days Till Due",
            "subtitle": "Days Till Required | Days Till Due"})


# --------------------------------------------------------------------------
#: PO lines promised on the 'pending approval' sentinel, per PO line and buyer.
PENDING = Rule(
    "AllLivePO", lookups=(BUYER,),
    where=lambda clock: S.sentinel_in(C("PODetDatePromised"), S.PENDING_APPROVAL),
    keys=("PONum", "PODetItemNum", "POSuppAddressName", "PODetDatePromised", "Name"),
    measures=lambda: {"FirstOfPODetDateReq": ("min", C("PODetDateReq")),
                      "PoValue": ("sum", C("PODetQtyReq") * C("PODetUnitPrice"))},
    out=lambda clock: {"label": left(label(C("PONum"), "/", C("PODetItemNum"), " # ", C("Name"), " # ",
                                           C("POSuppAddressName")), 50)},
    late=lambda clock: {"value": clock.due(C("FirstOfPODetDateReq")), "right_value": C("PoValue").cast("double")})


def pending_approval(t: Tables, clock: AsOf) -> DataFrame:
    return PENDING.grouped(t, clock)


ruled(PENDING, "D4", "Risk Orders Pending Approval", XY + ("right_value",), (("value", "asc"),), PAGE,
      x_label="Days Until PO Required Date", formatter="integer",
      meta={"rightValueFormatter": "currency", "rightValueLabel": "PO Value", "showRowSeparators": True})


ruled(Rule("AllEnq", where=lambda clock: text_eq(C("EnqStatus"), "#Received"),
           keys=("EnquiryNo", "EnqCustID", "EnqDepartment", "EnqRequiredDate", "EnqStatus"),
           out=lambda clock: {"label": label(C("EnquiryNo"), " ", C("EnqCustID"), " # ", C("EnqDepartment")),
                              "value": clock.due(C("EnqRequiredDate"))}),
      "D5", "Enquiry Status - Received", XY, (("value", "asc"),), PAGE,
      x_label="Days Until Enq Response Required", formatter="integer")

ruled(Rule("AllLivePO",
           where=lambda clock: S.sentinel_not_in(C("PODetDatePromised"), S.PENDING_APPROVAL) & (C("POSubmitted") == 0),
           keys=("PONum", "POOrderDate", "POSuppAddressName", "POSubmitted"),
           out=lambda clock: {"label": left(label(C("PONum"), " # ", C("POSuppAddressName")), 14),
                              "value": clock.age(C("POOrderDate")), "target": big(7)}),
      "D7", "PO Not Submitted", XY + ("target",), (("value", "desc"),), PAGE,
      x_label="Days Since PO Entered", formatter="integer")


# --------------------------------------------------------------------------
def excess_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts without a minimum stock that have an excess on order (``ExcessQty``), and the PO lines of those parts.

    The quantity reads part columns only, so lines of other parts, which cannot
    reach the result, go before anything is grouped.

    qty   = on-order if on-order < (active + on-order - SO demand - WO demand)
            else that balance (NULL comparison -> the balance)
    """
    balance = C("PartStockActive") + C("PartStockOnOrderPO") - C("DemandSO") - C("DemandWO")
    qty = F.when(C("PartStockOnOrderPO") < balance, C("PartStockOnOrderPO")).otherwise(balance)
    items = t["AllItems"].where(C("PartMinStockLev") == 0).withColumn("ExcessQty", qty).where(C("ExcessQty") > 0)
    return items, semi_filter(t["AllLivePO"], items, [("PODetPart", "PartNo")], folded=True)


def excess_cost(df: DataFrame) -> DataFrame:
    """The excess at the part's highest PO price: max price * qty / purchase-unit conversion (zero divisor -> NULL)."""
    return df.withColumn(
        "ExcessCost",
        C("MaxOfPODetUnitPrice").cast("double")
        * F.try_divide(C("ExcessQty").cast("double"), C("PartUOMUOPConv").cast("double")))


@chart("D8", "Excess PO Qty (Top 20 by Excess Value > £20)", XY, (("value", "desc"),), PAGE,
       limit=20, x_label="Excess PO Qty Value £", formatter="integer")
def d8(t: Tables, clock: AsOf) -> DataFrame:
    items, po = excess_parts(t)
    badges = t["employees"].select(C("BadgeNo").alias("_badge")).distinct()
    flagged = po.join(badges, po["POBuyer"] == badges["_badge"], "left") \
        .withColumn("_has_buyer", C("_badge").isNotNull())
    # one pass over the PO lines: highest price over all lines, earliest
    # promise over lines with a known buyer (the inner-join rows)
    per_part = (flagged.groupBy(fold(C("PODetPart")).alias("_part"))
                .agg(F.min("PODetPart").alias("PODetPart"), F.max("PODetUnitPrice").alias("MaxOfPODetUnitPrice"),
                     F.min(F.when(C("_has_buyer"), C("PODetDatePromised"))).alias("MinPromised"),
                     F.max(C("_has_buyer").cast("int")).alias("_any_buyer"))
                .where(C("_any_buyer") == 1))
    j = excess_cost(per_part.join(items, per_part["_part"] == fold(items["PartNo"]), "inner"))
    j = j.where((C("ExcessCost") > 20)
                & S.sentinel_not_in(C("MinPromised"), S.D8_MIN_PROMISED_EXCLUDED))
    return (j.select("PODetPart", "ExcessCost", "ExcessQty").distinct()
            .select(C("PODetPart").alias("label"), C("ExcessCost").alias("value")))


# --------------------------------------------------------------------------
def _due_soon(window, tracker: str) -> Rule:
    """PO lines promised within 14 days (incl. overdue), quantity still to
    come, no sentinel in promised/latest (NULL allowed), part known and the
    supplier not yet confirmed on the tracker."""
    return Rule(
        "AllLivePO",
        where=lambda clock: (window(clock, C("PODetDatePromised")) & ((C("PODetQtyReq") - C("PODetQtyRec")) > 0)
                             & S.sentinel_free(C("PODetDateLatest"), S.D9_EXCLUDED)
                             & S.sentinel_free(C("PODetDatePromised"), S.D9_EXCLUDED)),
        lookups=(Lookup("AllItems", (("PODetPart", "PartNo"),), how="semi", folded=True),
                 Lookup("OOB_TRACKER_RECEIVED", (("POSuppAddressName", "SuppName"),),
                        ("SuppName", "RECEIVED") if tracker == "inner" else (), tracker,
                        lambda: text_eq(C("RECEIVED"), "N"), folded=True),
                 BUYER),
        distinct=True,
        out=lambda clock: {"label": label(C("PONum"), "/", C("PODetItemNum"), " <", C("Name"), ">"),
                           "value": clock.due(C("PODetDatePromised"))})


#: For the export: strictly before the day, with the tracker's columns.
DUE_SOON_TRACKED = _due_soon(lambda clock, p: clock.date_lt_now(p, 14), "inner")

ruled(_due_soon(lambda clock, p: clock.due_le(p, 14), "semi"),
      "D9", "PO's due in next 2 weeks inc overdue (Not confirmed)", XY, (("value", "asc"),), PAGE,
      x_label="Days until PO promised", formatter="integer")


@chart("D12", "SO On Hold (Exc. MEG-VMI)", XY, (("value", "asc"),), PAGE,
       x_label="Days Until Promised Delivery", formatter="integer")
def d12(t: Tables, clock: AsOf) -> DataFrame:
    so = t["AllSO"]
    keys = (so.where(text_ne(C("SOCustID"), "MEG-VMI") & text_eq(C("SODescription"), "On Hold"))
            .select("SONo", "SOCustID", "SOLineNo", "SOLinePromisedDate").distinct())
    return keys.select(label(C("SONo"), " (", C("SOCustID"), ") - ", C("SOLineNo")).alias("label"),
                       clock.due(C("SOLinePromisedDate")).alias("value"))
