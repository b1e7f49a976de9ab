"""Quality page: returns/repairs, MRB and quarantine stock, NCRs, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.functions import params as P
from opskpi.functions.clock import AsOf
from opskpi.functions.text import key_eq, any_like, label, text_eq, text_like, text_ne, text_not_in
from opskpi.operators.relational import left_join_split
from opskpi.plans.inventory import lots_with_last_transfer
from opskpi.plans.metric import chart, ruled
from opskpi.plans.rules import Lookup, Rule
from opskpi.sources.tables import Tables

PAGE = "quality"
C = F.col
XY = ("label", "value")

# --- fixed values: calibration locations that are not "in service" --------
OUT_OF_SERVICE_LOCATIONS = ("QUARANTINE", "AWAITING REPAIR / CALIBRATION", "SENT FOR CALIBRATION",
                            "RETURNED TO SUPPLIER", "ARCHIVE", "RETURNED TO CUSTOMER")
RETURN_REPAIR = ("%-RETURN", "%-REPAIR")


def big(n: int):
    return F.lit(n).cast("bigint")


@chart("Q1", "Return And Repair WO's (Excl. SO On Hold)", XY + ("secondary_value",), (("value", "desc"),),
       PAGE, x_label="Days", formatter="integer", binder=P.q1_type,
       meta={"secondaryValueFormatter": "integer", "secondaryValueLabel": "SO Due (Days)",
             "targetBandStart": 0, "targetBandEnd": 30})
def q1(t: Tables, clock: AsOf, part_pattern: str = "%") -> DataFrame:
    so = t["AllSO"].where(
        any_like(C("SOLinePartNo"), RETURN_REPAIR) & (C("SOLineStatus") != 50)
        & (C("SOLineShipQty") < C("SOLineQty"))
        & (text_ne(C("SODescription"), "On Hold") | C("SODescription").isNull())
        & text_like(C("SOLinePartNo"), part_pattern))
    # WOs can only match a line whose part passed the same pattern: filter them
    # before the shuffle.  The PENDING CUSTOMER test must stay after the join
    # (an SO line whose only WO is pending drops out; one without a WO stays).
    wo = t["worksOrder"].where(any_like(C("WOPartNo"), RETURN_REPAIR)).select(
        "WONo", C("WOJobType").alias("Location"), "WOLineNo", "WOPartNo", "WOSalesOrder")
    # left join written as inner join + anti-join: a hot sales line on the
    # works-order side is split by AQE instead of buffered by one task
    j = left_join_split(so, wo, [("SOLineNo", "WOLineNo"), ("SOLinePartNo", "WOPartNo"), ("SONo", "WOSalesOrder")],
                        ["WONo", "Location"], folded=("SOLinePartNo",))
    items = t["AllItems"].select("PartNo", C("PartDefCust").alias("Customer"))
    j = j.join(items, key_eq(items["PartNo"], j["SOLinePartNo"]), "left")
    j = j.where(text_ne(C("Location"), "PENDING CUSTOMER") | C("Location").isNull())
    cust = F.trim(C("Customer"))
    cust_part = F.when(F.nullif(cust, F.lit("")).isNotNull(), F.concat(F.lit(" - "), cust)).otherwise(F.lit(""))
    return j.select(
        label(C("SONo"), "/", C("SOLineNo"), " : (WO-", F.coalesce(C("WONo").cast("string"), F.lit("")), ") ",
              F.trim(C("SOLinePartNo")), cust_part, " : ", C("SOLineQty") - C("SOLineShipQty")).alias("label"),
        clock.age(C("SODate")).alias("value"),
        clock.due(C("SOLinePromisedDate")).alias("secondary_value"))


@chart("Q2_grn", "Stock in MRB Locations", XY + ("target_start", "target"), (("value", "desc"),), PAGE,
       x_label="Days", formatter="integer", binder=P.q2_location,
       note="age since the latest transfer; NULL when a lot was never transferred")
def q2(t: Tables, clock: AsOf, location_pattern: str = "MR%") -> DataFrame:
    lots = lots_with_last_transfer(t, location_pattern)
    return lots.select(label(C("GRNNo"), " <", C("GRNLocation"), "> ", C("GRNPartNo")).alias("label"),
                       clock.age(C("LastTransfer")).alias("value"), big(0).alias("target_start"),
                       big(7).alias("target"))


ruled(Rule("worksOrder", where=lambda clock: (C("WOQtyOS") > 0) & text_eq(C("WOJobType"), "PENDING CUSTOMER"),
           out=lambda clock: {"label": label(C("WONo"), " (", C("WOPartNo"), ")"), "value": clock.age(C("WOSchedFinishDate"))}),
      "Q3_customer", "WO's Pending Customer Query", XY, (("value", "asc"),), PAGE,
      x_label="Days Since Scheduled Finish", formatter="integer")


@chart("Q6", "Open NCR (Days) Top 20 With Open Actions (Pre/Cor)", XY + ("target_start", "target"),
       (("value", "desc"),), PAGE, limit=20, x_label="Days Open", formatter="integer")
def q6(t: Tables, clock: AsOf) -> DataFrame:
    ncr = t["AllOpenNCR"]
    act = t["AllOpenNCRActions"].where(any_like(C("Type"), ("C%", "P%"))).select("NCR", "Who")
    emp = t["employees"].select("BadgeNo", "Name")
    j = ncr.join(act, ncr["NonCNo"] == act["NCR"], "inner").join(emp, C("Who") == emp["BadgeNo"], "left")
    return j.select(label(C("NonCNo"), " # ", C("NonCPartNo"), " ~ ", C("Name")).alias("label"),
                    clock.age(C("NonCDate")).alias("value"), big(0).alias("target_start"),
                    big(30).alias("target"))


@chart("Q7", "NCR Actions Due within 7 Days", XY, (("value", "desc"),), PAGE,
       x_label="Days Until Due", formatter="integer", binder=P.q7_type)
def q7(t: Tables, clock: AsOf, type_pattern: str = "%") -> DataFrame:
    act = t["AllOpenNCRActions"].where(clock.due_le(C("Target"), 7) & text_like(C("Type"), type_pattern))
    emp = t["employees"].select("BadgeNo", "Name")
    j = act.join(emp, act["Who"] == emp["BadgeNo"], "inner")
    return j.select(label(C("Type"), " ", C("NCR"), " # ", C("Name")).alias("label"),
                    clock.due(C("Target")).alias("value"))


def calibration_due(group) -> Rule:
    return Rule(
        "AllCalibration",
        where=lambda clock: (
            clock.due_le(C("ToolNextCalibration"), 7) & text_ne(C("CalibrationStatusDesc"), "closed")
            & (C("ToolRequiresCalibration") == 1) & group(C("GroupName"))
            & (C("ToolLocation").isNull() | text_not_in(C("ToolLocation"), OUT_OF_SERVICE_LOCATIONS))),
        lookups=(Lookup("employees", (("ToolResponsible", "BadgeNo"),), ("Name",), "left"),),
        out=lambda clock: {"label": label(C("ToolCompanySerialNo"), " (", C("ToolNo"), ") ", " # ", C("Name"), " # ",
                                          C("ToolLocation")),
                           "value": clock.due(C("ToolNextCalibration"))})


ruled(calibration_due(lambda g: text_eq(g, "CALIBRATED")), "Q8", "Calibration Due in Next 7 Days", XY,
      (("value", "asc"),), PAGE, x_label="Days Until Due", formatter="integer")

ruled(calibration_due(lambda g: g.isNull()), "Q8b", "Tooling Checks Due in Next 7 Days", XY, (("value", "asc"),), PAGE,
      x_label="Days Until Due", formatter="integer")


@chart("Q9", "Stock in QUARANTINE", XY, (("value", "desc"),), PAGE,
       x_label="Days in Quarantine", formatter="integer", window_on=("AllGRN_Transfer", "TransferDate"),
       note="latest transfer *into* quarantine; the left join is inner by its WHERE clause")
def q9(t: Tables, clock: AsOf) -> DataFrame:
    grn = t["AllLiveGRN"].where(text_eq(C("GRNLocation"), "QUARANTINE"))
    tr = (t["AllGRN_Transfer"].where(text_eq(C("TransferLocation"), "QUARANTINE"))
          .groupBy("TransferGRNNo", "TranferGRNLineNo").agg(F.max("TransferDate").alias("LastIn")))
    j = grn.join(tr, (grn["GRNLineNo"] == tr["TranferGRNLineNo"]) & (grn["GRNNo"] == tr["TransferGRNNo"]),
                 "inner")
    g = j.groupBy("GRNNo", "GRNLineNo", "GRNQtyLeft", "GRNPartNo").agg(F.max("LastIn").alias("LastIn"))
    return g.select(label(C("GRNNo"), "/", C("GRNLineNo"), " (X", C("GRNQtyLeft"), ") ", C("GRNPartNo"))
                    .alias("label"), clock.age(C("LastIn")).alias("value"))
