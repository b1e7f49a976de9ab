"""Detail exports: the row grain behind a chart, written as CSV by the batch job.

Each reuses its chart's builder where the filters agree and differs where the
source's export query differs (noted per export).  Dates are ISO text, money
is double.  ``departments`` is the declared entitlement (normalised names).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.functions import dates as S
from opskpi.functions.clock import AsOf
from opskpi.functions.text import fold, label, text_eq
from opskpi.plans.deliverables import (DUE_SOON_TRACKED, demand_lines, excess_cost, excess_parts,
                                       pending_approval, queried_pos)
from opskpi.plans.inventory import expiring_lots
from opskpi.plans.metric import table
from opskpi.plans.tables import PARTS_HEADERS, parts_to_purchase
from opskpi.sources.tables import Tables

C = F.col
ALL_DEPARTMENTS = ("pur", "com", "eng", "man", "qa")


def export(id: str, title: str, filename: str, columns, order, departments=("pur",), **kw):
    return table(id, title, tuple(columns), tuple(order), kind="export", export_name=filename,
                 departments=tuple(departments), **kw)


def iso(c):
    return c.cast("string")


@export("D1d", "Overdue Purchase Orders", "Qry_Exp_D1d_OverduePO",
        ("PONum", "PODetItemNum", "POSuppAddressName", "Name", "DaysLate"), (("DaysLate", "desc"),),
        note="shipped-sentinel test written as slash text in the source; built as inclusion")
def d1d(t: Tables, clock: AsOf, promised_after: date = S.PROMISED_CUTOFF) -> DataFrame:
    po = t["AllLivePO"]
    p = C("PODetDatePromised")
    po = po.where(clock.age_gt(p, 0) & (p > F.lit(promised_after)) & S.sentinel_in(C("PODetDateLatest"), S.SHIPPED))
    emp = t["employees"].select("BadgeNo", "Name")
    j = po.join(emp, po["POBuyer"] == emp["BadgeNo"], "inner")
    return j.select("PONum", "PODetItemNum", "POSuppAddressName", "Name", clock.age(p).alias("DaysLate"))


@export("I12", "Material & PCB shelf life expiry within 60 days", "Qry_Exp_I12_MatExp",
        ("GRNNo", "GRNPartNo", "PartDescription", "GRNQtyLeft", "PartLeadTime", "DaysTillExpiry", "GRNExpiryDate",
         "PartGroupCode", "GRNLocation", "Demand", "PartStockActive"),
        (("GRNPartNo", "asc"), ("DaysTillExpiry", "asc")), departments=("pur", "man"))
def i12(t: Tables, clock: AsOf) -> DataFrame:
    return expiring_lots(t, clock).withColumn("GRNExpiryDate", iso(C("GRNExpiryDate")))


@export("D9", "PO's due in next 2 weeks inc overdue", "Qry_Exp_D9_PO2Week",
        ("PONum", "PODetItemNum", "DaysDue", "PODetDatePromised", "QtyRemain", "Name", "PODetPart",
         "POSuppAddressName", "RECEIVED"), (("DaysDue", "asc"),),
        note="promised strictly before as-of + 14 days (the chart is inclusive); sentinels read dd/mm")
def d9(t: Tables, clock: AsOf) -> DataFrame:
    rows = DUE_SOON_TRACKED.joined(t, clock)
    keys = rows.select("PONum", "PODetItemNum", "PODetDatePromised", "PODetQtyReq", "PODetQtyRec", "Name",
                       "PODetPart", "POSuppAddressName", "RECEIVED", "PODetDateLatest").distinct()
    return keys.select("PONum", "PODetItemNum", clock.due(C("PODetDatePromised")).alias("DaysDue"),
                       iso(C("PODetDatePromised")).alias("PODetDatePromised"),
                       (C("PODetQtyReq") - C("PODetQtyRec")).alias("QtyRemain"), "Name", "PODetPart",
                       "POSuppAddressName", "RECEIVED")


@export("D11", "Parts to be purchased", "Qry_Exp_D11_PartsToPurchase",
        ("PartNo", "PartDescription", "PartDefLocation", "FinalStockBalance"), (), headers=PARTS_HEADERS)
def d11(t: Tables, clock: AsOf) -> DataFrame:
    return parts_to_purchase(t)


@export("I15", "Part Detail Changes not checked", "Qry_Exp_I15_TransAltEdit",
        ("TransID", "DateTime", "TransObjectType", "TransObjectID", "TransUser", "TransMemo"), (("TransID", "asc"),))
def i15(t: Tables, clock: AsOf) -> DataFrame:
    te = t["TransAltEdit"]
    return te.select("TransID", F.substring(C("TransTime"), 1, 10).alias("DateTime"), "TransObjectType",
                     "TransObjectID", "TransUser", "TransMemo")


@export("D8", "Excess PO Qty", "Qry_Exp_D8_ExcessPO",
        ("PODetPart", "Name", "ExcessCost", "ExcessQty", "PartStockActive", "DemandWO", "DemandSO", "PartUOMUOPConv",
         "PONum"), (("ExcessCost", "desc"),),
        note="grain adds buyer and PO; no top 20")
def d8(t: Tables, clock: AsOf) -> DataFrame:
    items, po = excess_parts(t)
    emp = t["employees"].select("BadgeNo", "Name")
    # one pass over the PO lines: per (part, buyer, PO) the earliest promise and
    # the highest price; the part's highest price (over lines of any buyer,
    # known or not) comes from that result
    grain = po.groupBy(fold(C("PODetPart")).alias("_part"), "POBuyer", "PONum").agg(
        F.min("PODetPart").alias("PODetPart"), F.min("PODetDatePromised").alias("_promised"),
        F.max("PODetUnitPrice").alias("_price"))
    top = grain.groupBy(C("_part").alias("_top_part")).agg(F.max("_price").alias("MaxOfPODetUnitPrice"))
    per = grain.join(emp, C("POBuyer") == emp["BadgeNo"], "inner").groupBy("_part", "Name", "PONum").agg(
        F.min("PODetPart").alias("PODetPart"), F.min("_promised").alias("MinPromised"))
    j = per.join(items, per["_part"] == fold(items["PartNo"]), "inner")
    j = excess_cost(j.join(top, C("_part") == C("_top_part"), "inner"))
    j = j.where((C("ExcessCost") > 20)
                & S.sentinel_not_in(C("MinPromised"), S.D8_MIN_PROMISED_EXCLUDED))
    return j.select("PODetPart", "Name", "ExcessCost", "ExcessQty", "PartStockActive", "DemandWO", "DemandSO",
                    "PartUOMUOPConv", "PONum").distinct()


@export("P6", "PO's waiting Confirmation", "Qry_Exp_P6_UnconfirmedPO",
        ("PONum", "POSuppAddressName", "Name", "POSentDate", "POOrderDate"), (("POSentDate", "asc"),),
        note="deduped per PO incl. order date; only the pending-approval sentinel is excluded; sent date may be NULL")
def p6(t: Tables, clock: AsOf) -> DataFrame:
    po = t["AllLivePO"].where(S.sentinel_not_in(C("PODetDatePromised"), S.PENDING_APPROVAL)
                              & (C("POConfirmation") == 0) & (C("POSubmitted") == 1))
    emp = t["employees"].select("BadgeNo", "Name")
    j = po.join(emp, po["POBuyer"] == emp["BadgeNo"], "inner")
    keys = j.select("PONum", "POSuppAddressName", "Name", "POSentDate", "POOrderDate", "POConfirmation",
                    "POSubmitted").distinct()
    return keys.select("PONum", "POSuppAddressName", "Name", iso(C("POSentDate")).alias("POSentDate"),
                       iso(C("POOrderDate")).alias("POOrderDate"))


@export("Q7", "NCR Actions", "Qry_Exp_Q7_NCR", ("NCR", "Type", "DaysDue", "Name"), (("DaysDue", "desc"),),
        departments=ALL_DEPARTMENTS, headers={"DaysDue": "Days Due"},
        note="no 7-day window and no type filter, unlike the chart")
def q7(t: Tables, clock: AsOf) -> DataFrame:
    act = t["AllOpenNCRActions"]
    emp = t["employees"].select("BadgeNo", "Name")
    j = act.join(emp, act["Who"] == emp["BadgeNo"], "inner")
    return j.select("NCR", "Type", clock.due(C("Target")).alias("DaysDue"), "Name")


@export("P3a", "Overdue CR actions", "Qry_Exp_P3A_CrActions",
        ("ContractReviewNo", "ContRevDetailTaskNo", "ContRevDetailTask", "AssignedName", "DaysTillDue",
         "ContRevDetailLeadTime"), (("DaysTillDue", "asc"), ("_review", "asc")), departments=ALL_DEPARTMENTS,
        note="tasks joined to employees by name (case/trailing-blank folded)")
def p3a(t: Tables, clock: AsOf) -> DataFrame:
    cr = t["AllCR"].where(clock.due_lt(C("ContRevDetailTargetDate"), 0) & text_eq(C("CRStatusDescription"), "Open"))
    names = t["employees"].select(fold(C("Name")).alias("_name")).distinct()
    cr = cr.join(names, fold(cr["AssignedName"]) == names["_name"], "left_semi")
    keys = cr.select("ContractReviewNo", "ContRevDetailTaskNo", "ContRevDetailTask", "AssignedName",
                     "ContRevDetailTargetDate", "CRStatusDescription", "ContractReviewDate",
                     "ContRevDetailLeadTime").distinct()
    return keys.select("ContractReviewNo", "ContRevDetailTaskNo", "ContRevDetailTask", "AssignedName",
                       clock.due(C("ContRevDetailTargetDate")).alias("DaysTillDue"), "ContRevDetailLeadTime",
                       C("ContractReviewDate").alias("_review"))


@export("D4", "Risk Orders Pending Approval", "Qry_Exp_D4_RiskPendingPO",
        ("PONum", "PODetItemNum", "PoValue", "Buyer", "POSuppAddressName", "DaysTillReq"),
        (("PONum", "asc"), ("PODetItemNum", "asc")))
def d4(t: Tables, clock: AsOf) -> DataFrame:
    g = pending_approval(t, clock)
    return g.select("PONum", "PODetItemNum", C("PoValue").cast("double").alias("PoValue"), C("Name").alias("Buyer"),
                    "POSuppAddressName", clock.due(C("FirstOfPODetDateReq")).alias("DaysTillReq"))


@export("D7", "PO Not Submitted", "Qry_Exp_D7_PONotSubmit", ("Details", "PODetItemNum", "Days", "Target", "Name"),
        (("Days", "desc"),), note="adds line and buyer to the grain; buyer is a left join")
def d7(t: Tables, clock: AsOf) -> DataFrame:
    po = t["AllLivePO"].where(S.sentinel_not_in(C("PODetDatePromised"), S.PENDING_APPROVAL)
                              & (C("POSubmitted") == 0))
    emp = t["employees"].select("BadgeNo", "Name")
    j = po.join(emp, po["POBuyer"] == emp["BadgeNo"], "left")
    keys = j.select("PONum", "POSuppAddressName", "PODetItemNum", "POOrderDate", "Name", "POSubmitted").distinct()
    return keys.select(label(C("PONum"), " # ", C("POSuppAddressName")).alias("Details"), "PODetItemNum",
                       clock.age(C("POOrderDate")).alias("Days"), F.lit(7).cast("bigint").alias("Target"), "Name")


@export("D1b", "Unknown Delivery Date Purchase Orders", "Qry_Exp_D1b_UnknownPO",
        ("PO", "PODetItemNum", "PODetPart", "PODetPartDescr", "POSuppAddressName", "Buyer", "DaysTillReq",
         "PODetDatePromised", "PODetDateLatest"), (("DaysTillReq", "desc"),),
        note="buyer is an inner join: lines without a known buyer are not exported")
def d1b(t: Tables, clock: AsOf) -> DataFrame:
    po = t["AllLivePO"].where(S.sentinel_in(C("PODetDatePromised"), S.UNKNOWN_DELIVERY)
                              | S.sentinel_in(C("PODetDateLatest"), S.UNKNOWN_DELIVERY))
    emp = t["employees"].select("BadgeNo", "Name")
    j = po.join(emp, po["POBuyer"] == emp["BadgeNo"], "inner")
    return j.select(C("PONum").alias("PO"), "PODetItemNum", "PODetPart", "PODetPartDescr", "POSuppAddressName",
                    C("Name").alias("Buyer"), clock.due(C("PODetDateReq")).alias("DaysTillReq"),
                    iso(C("PODetDatePromised")).alias("PODetDatePromised"),
                    iso(C("PODetDateLatest")).alias("PODetDateLatest"))


@export("D2", "Purchase Orders in Query", "Qry_Exp_D2_QueryPO",
        ("PO", "POline", "Buyer", "POSuppAddressName", "DateRaised", "DaysInQuery", "DateReleased",
         "PODetDatePromised"), (("DaysInQuery", "desc"),),
        note="non-numeric PO line text becomes line 0 (the chart drops NULL lines instead)")
def d2(t: Tables, clock: AsOf, raised_after: date = S.QUERY_RAISED_CUTOFF) -> DataFrame:
    rows = queried_pos(t, clock, raised_after, numeric_fallback=True)
    keys = rows.select("PO", "POline", "Buyer", "POSuppAddressName", "DateRaised", "DateReleased",
                       "PODetDatePromised", "DaysInQuery").distinct()
    return keys.select("PO", "POline", "Buyer", "POSuppAddressName", iso(C("DateRaised")).alias("DateRaised"),
                       "DaysInQuery", iso(C("DateReleased")).alias("DateReleased"),
                       iso(C("PODetDatePromised")).alias("PODetDatePromised"))


@export("D3b", "PO's With Promised Date in Month Prior to Demand", "Qry_Exp_D3b_PO_DemandMonthPrior",
        ("PO", "PODetItemNum", "PartNo", "Buyer", "Value", "PODetDatePromised", "DemandWOSO", "DemandDate",
         "DaysTillDue", "DaysTillRequired", "POMonth", "WOSOMonth", "POSuppAddressName"),
        (("Buyer", "asc"), ("_promised", "asc"), ("DaysTillRequired", "asc")),
        headers={"DemandWOSO": "Demand WO/SO", "DemandDate": "Demand Date", "DaysTillDue": "Days Till Due",
                 "DaysTillRequired": "Days Till Required", "POMonth": "PO Month", "WOSOMonth": "WO/SO Month"})
def d3b(t: Tables, clock: AsOf) -> DataFrame:
    rows = demand_lines(t, clock)
    rows = rows.where((C("RequiredDate") > C("PODetDatePromised"))
                      & S.month_differs(C("RequiredDate"), C("PODetDatePromised")))
    return rows.select(
        C("PONum").alias("PO"), "PODetItemNum", "PartNo", C("Name").alias("Buyer"),
        C("POValue").cast("double").alias("Value"), iso(C("PODetDatePromised")).alias("PODetDatePromised"),
        C("DemandType").alias("DemandWOSO"), iso(C("RequiredDate")).alias("DemandDate"),
        clock.due(C("PODetDatePromised")).alias("DaysTillDue"), clock.due(C("RequiredDate")).alias("DaysTillRequired"),
        F.date_format(C("PODetDatePromised"), "yyyy MM").alias("POMonth"),
        F.date_format(C("RequiredDate"), "yyyy MM").alias("WOSOMonth"), "POSuppAddressName",
        C("PODetDatePromised").alias("_promised"))
