"""Productivity page: print queue, contract reviews, enquiries, engineering logs,
training and CoSHH reviews (P1 ... P13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.functions import dates as S
from opskpi.functions import params as P
from opskpi.functions.clock import AsOf
from opskpi.functions.text import (any_like, label, left, none_like, text_eq, text_in, text_like,
                                   text_not_in)
from opskpi.plans.metric import chart, ruled
from opskpi.plans.rules import Lookup, Rule
from opskpi.sources.tables import Tables

PAGE = "productivity"
C = F.col
XY = ("label", "value")

# --- fixed values: item statuses meaning "not ready to build" -------------
NOT_READY_STATUSES = ("TO BE REVIEWED", "IN DEV", "ENGINEERING HOLD", "NPI", "CAUTION", "DORMANT")
P1_PART_PATTERNS_EXCLUDED = ("SMT ATTRITION", "%REPAIR", "%RETURN")
P2_PART_PATTERNS_EXCLUDED = ("%FAI%", "CONSUMABLE ISSUES", "MONTHLY-LOST-STOCK-WRITE-OFF",
                             "PHOENIX-DELTA-FAIR-SUB", "%DELTA FAIR%", "%PHOENIX FAIR%", "SMT ATTRITION",
                             "%RETURN", "%REPAIR")
CR_TASK_PATTERNS = ("%LONG LEAD%", "%BOM%", "%WORK ORDER%")
CPP_CLOSED_PATTERNS = ("%APPROVED%", "%REJECTED%", "%CANCELLED%", "%NOT REQ%", "%EXPIRED%")


def big(n: int):
    return F.lit(n).cast("bigint")


def print_queue(ready: bool) -> Rule:
    """WIP/Created WOs starting between 360 days ago and 28 days ahead, with
    outstanding quantity, not printed yet, not material-only.  ``ready``
    selects items whose status is outside the not-ready list (NULL status
    drops out of both lists).

    "Not printed" is a left join + PrintedBy IS NULL: a WO with a NULL-printer
    row still passes even when another row names a printer.  Only distinct
    (WO, printer) pairs can reach the deduped output."""
    patterns = P2_PART_PATTERNS_EXCLUDED if ready else P1_PART_PATTERNS_EXCLUDED
    status_in = text_not_in if ready else text_in
    return Rule(
        "worksOrder",
        where=lambda clock: (
            clock.date_ge_now(C("WOSchedStartDate"), -360) & clock.date_le_now(C("WOSchedStartDate"), 28)
            & (C("WOQtyOS") > 0) & text_in(C("WOStatusDescription"), ("WIP", "Created"))
            & S.sentinel_not_in(C("WOEarliestStartDate"), S.MATERIAL_ONLY_START) & none_like(C("WOPartNo"), patterns)),
        lookups=(Lookup("AllItems", (("WOPartNo", "PartNo"),), ("StatusDescription",), folded=True),
                 Lookup("PV601", (("WONo", "WorksOrder"),), ("PrintedBy",), "left", distinct=True)),
        having=lambda clock: status_in(C("StatusDescription"), NOT_READY_STATUSES) & C("PrintedBy").isNull(),
        keys=("WOSchedStartDate", "StatusDescription", "WOQtyOS", "WOStatusDescription", "PrintedBy", "WOPartNo",
              "WOEarliestStartDate", "WONo"),
        out=lambda clock: {"label": label(C("WONo"), " (", C("WOSchedStartDate"), ") : ", C("WOPartNo")),
                           "value": clock.due(C("WOSchedStartDate")), "target": big(7), "target_start": big(0),
                           "_start": C("WOSchedStartDate")})


ruled(print_queue(ready=False), "P1", "TBR / IN-DEV / ENG-HOLD / NPI / CAUTION / DORMANT WO's",
      XY + ("target", "target_start"), (("value", "asc"),), PAGE, x_label="Days Until Start Date", formatter="integer",
      note="'*REPAIR'/'*RETURN' read as '%REPAIR'/'%RETURN'; the label is kept whole")

ruled(print_queue(ready=True), "P2", "WO's ready to Print - Due Within 28 Days", XY + ("target", "target_start"),
      (("_start", "asc"),), PAGE, x_label="Days Until Start Date", formatter="integer")


@chart("P3a", "Overdue CR Actions", XY, (("value", "desc"),), PAGE, x_label="QTY Overdue Actions",
       formatter="integer")
def p3a(t: Tables, clock: AsOf) -> DataFrame:
    cr = t["AllCR"].where(text_eq(C("CRStatusDescription"), "Open")
                          & clock.date_lt_now(C("ContRevDetailTargetDate")))
    g = cr.groupBy("AssignedName").agg(F.count(F.lit(1)).alias("value"))
    return g.select(C("AssignedName").alias("label"), C("value"))


@chart("P3b", "Open 'Long Lead', 'BOM' and 'WO' related CR Actions", XY, (("value", "desc"),), PAGE,
       x_label="Days Until Due", formatter="integer")
def p3b(t: Tables, clock: AsOf) -> DataFrame:
    cr = t["AllCR"].where(any_like(C("ContRevDetailTask"), CR_TASK_PATTERNS)
                          & text_eq(C("CRStatusDescription"), "open"))
    keys = cr.select("ContractReviewNo", "ContRevDetailTaskNo", "AssignedName", "ContRevDetailTask",
                     "ContRevDetailTargetDate", "CRStatusDescription", "ContractReviewDate").distinct()
    return keys.select(
        left(label(C("ContractReviewNo"), "/", C("ContRevDetailTaskNo"), " - ", C("AssignedName"), " # ",
                   C("ContRevDetailTask")), 50).alias("label"),
        clock.due(C("ContRevDetailTargetDate")).alias("value"))


@chart("P4", "RFC's Open > 45 Days", XY + ("target_start", "target"), (("value", "desc"),), PAGE,
       limit=20, x_label="Days Open", formatter="integer")
def p4(t: Tables, clock: AsOf) -> DataFrame:
    rfc = t["PV547_RFC"].where(clock.age_ge(C("DateRaised"), 45)
                               & (text_eq(C("Status"), "open") | C("Status").isNull())
                               & C("Customer").isNotNull())
    keys = rfc.select("RFC", "Actionee", "Document", "DateRaised", "Status", "Customer").distinct()
    return keys.select(label(C("RFC"), " (", C("Actionee"), ") - ", C("Document")).alias("label"),
                       clock.age(C("DateRaised")).alias("value"), big(0).alias("target_start"),
                       big(90).alias("target"))


ruled(Rule("AllEnq", params={"enquiry_from": S.ENQUIRY_CUTOFF},
           where=lambda clock, enquiry_from: (
               clock.due_le(C("EnqDecisionDate"), 7) & (C("EnqDecisionDate") >= F.lit(enquiry_from))
               & text_eq(C("EnqStatus"), "#Submitted")),
           lookups=(Lookup("employees", (("EnqFollowUpBy", "BadgeNo"),), ("Name",), "left"),), distinct=True,
           out=lambda clock: {"label": label(C("EnquiryNo"), " ", C("EnqCustID"), " (S-)", C("Name")),
                              "value": clock.due(C("EnqDecisionDate"))}),
      "P5", "Enquiry Status - Submitted", XY, (("value", "asc"),), PAGE,
      x_label="Days Until Follow-Up Required", formatter="integer",
      note="estimator and sales-rep joins only repeat rows the DISTINCT removes; not performed")

ruled(Rule("AllLivePO",
           where=lambda clock: (S.sentinel_not_in(C("PODetDatePromised"), S.P6_PROMISED_EXCLUDED)
                                & (C("POSubmitted") == 1) & (C("POConfirmation") == 0) & C("POSentDate").isNotNull()),
           lookups=(Lookup("employees", (("POBuyer", "BadgeNo"),), ("Name",)),), distinct=True,
           out=lambda clock: {"label": label(C("PONum"), " / ", C("Name"), " / ", left(C("POSuppAddressName"), 15)),
                              "value": clock.age(C("POSentDate")), "target_start": big(0), "target": big(7)}),
      "P6", "PO's waiting Confirmation (Top 20)", XY + ("target_start", "target"), (("value", "desc"),),
      PAGE, limit=20, x_label="Days Since PO Submitted", formatter="integer")


@chart("P9", "Obsolescence Log Open Items (PV718) Top 25 by Days Open", XY + ("target_start", "target"),
       (("value", "desc"),), PAGE, limit=25, x_label="Days Open", formatter="integer",
       meta={"subtitle": "Red target = days until LTB date"})
def p9(t: Tables, clock: AsOf) -> DataFrame:
    log = t["PV718_ObLog"].where(C("Complete").isNull())
    keys = log.select("Log", "Buyer", "Progress_Part", "Date_Added", "LTB_DATE").distinct()
    return keys.select(label(C("Log"), " / ", C("Buyer"), " / ", left(C("Progress_Part"), 15)).alias("label"),
                       clock.age(C("Date_Added")).alias("value"), big(0).alias("target_start"),
                       clock.due(C("LTB_DATE")).alias("target"))


@chart("P10", "CPP Open Items", XY + ("secondary_value", "class_name"), (("value", "desc"),), PAGE,
       x_label="Days", formatter="integer",
       meta={"secondaryValueFormatter": "integer", "secondaryValueLabel": "Days Till Required",
             "subtitle": "DaysTillReq | DaysOpen | Pending"})
def p10(t: Tables, clock: AsOf) -> DataFrame:
    cpp = t["CPP_Log"].where(C("DateRaised").isNotNull()
                             & (C("Status").isNull() | none_like(C("Status"), CPP_CLOSED_PATTERNS)))
    pending = text_like(F.coalesce(C("Status"), F.lit("")), "%PENDING%")
    return cpp.select(
        label(C("CPP"), " ", C("Customer"), " (", F.coalesce(C("Status"), F.lit("")), ")").alias("label"),
        clock.age(C("DateRaised")).alias("value"), clock.due(C("RequiredDate")).alias("secondary_value"),
        F.when(pending, "p10-pending").otherwise("p10-days-open").alias("class_name"))


@chart("P11", "Open DFM (> 30 Days)", XY, (("value", "desc"),), PAGE, x_label="Days Open",
       formatter="integer")
def p11(t: Tables, clock: AsOf) -> DataFrame:
    dfm = t["PV760_DFM"].where(C("DateCreated").isNotNull() & C("DateComplete").isNull()
                               & clock.age_gt(C("DateCreated"), 30))
    keys = dfm.select("DocNo", "Type", "PartNo", "Who", "DateCreated", "Customer", "DateComplete").distinct()
    return keys.select(label(C("DocNo"), " ", C("Type"), " ", C("PartNo"), " (", C("Who"), ")").alias("label"),
                       clock.age(C("DateCreated")).alias("value"))


@chart("P12", "Training Over 180 Days", XY, (("_area", "asc"), ("value", "desc")), PAGE,
       x_label="Days Since Training", formatter="integer", binder=P.p12_training,
       meta={"leftLabelWidth": "auto"},
       note="unfiltered ('%') still excludes NULL areas, as LIKE '%' does")
def p12(t: Tables, clock: AsOf, area_pattern: str = "%") -> DataFrame:
    tr = t["AllTraining"].where(text_like(C("Areas_of_Experience"), area_pattern) & (C("Result") == 1)
                                & clock.age_gt(C("Course_Date"), 180))
    emp = t["employees"].where(C("EmployeeStatusID") != 15).select("BadgeNo", "EmployeeStatusID")
    j = tr.join(emp, tr["BadgeNo_IDFK"] == emp["BadgeNo"], "inner")
    keys = j.select("Training_Course", "Name", "Course_Date", "Areas_of_Experience", "Result",
                    "EmployeeStatusID").distinct()
    return keys.select(label(C("Training_Course"), " (", C("Name"), ")").alias("label"),
                       clock.age(C("Course_Date")).alias("value"), C("Areas_of_Experience").alias("_area"))


@chart("p13_coshh", "CoSHH Reviews Over 700 Days Old", XY, (("value", "desc"), ("label", "asc")), PAGE,
       x_label="Days Over 700-Day Limit", formatter="integer",
       note="review date held as text; only ISO dates parse, anything else is NULL and drops out")
def p13(t: Tables, clock: AsOf) -> DataFrame:
    items = t["AllItems"].withColumn("_review", C("coshh_DATE").try_cast("date"))
    rows = items.where(clock.age_gt(C("_review"), 700) & ~text_eq(C("StatusDescription"), "OBSOLETE"))
    return rows.select(C("PartNo").cast("string").alias("label"),
                       (clock.age(C("_review")) - 700).alias("value"))
