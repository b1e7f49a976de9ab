"""Dashboard tables (I3, D10, D11, I15, P8): row lists with header labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.functions.clock import AsOf
from opskpi.functions.text import key_eq, label, left, text_eq
from opskpi.plans.metric import table
from opskpi.sources.tables import Tables

C = F.col

# --- fixed values: header texts of the tables and exports -------------------
PARTS_HEADERS = {"PartNo": "Part Number", "PartDescription": "Part Description",
                 "PartDefLocation": "Stock Location", "FinalStockBalance": "Final Balance"}
CHANGES_HEADERS = {"When": "When", "TransObjectID": "PartNumber", "TransUser": "Who", "TransMemo": "What"}
ISSUES_HEADERS = {"Details": "Details (Last 4 Days, Value > £100)", "IssueNotes": "Notes", "Value": "Value"}
NEW_PARTS_HEADERS = {"PartNo": "PartNo", "PartDesc": "Description", "Cust": "Customer", "UsedIn": "Used In"}
REVIEWS_HEADERS = {"What": "What", "When": "When", "Who": "Who"}


@table("I3", "Stock Write Offs", ("Details", "IssueNotes", "Value"), (("_issued", "desc"),), page="inventory",
       headers=ISSUES_HEADERS, window_on=("StockIssue", "IssueDate"))
def i3(t: Tables, clock: AsOf) -> DataFrame:
    si = t["StockIssue"].where((C("IssueUnitCost") * C("IssueQty") > 100) & (C("IssueDate") > clock.now_plus(-4))
                               & text_eq(C("IssueType"), "WRITE_OFF"))
    items = t["AllItems"].select("PartNo", "PartDescription")
    j = si.join(items, key_eq(si["IssuePartNo"], items["PartNo"]), "left")
    return j.select(
        left(label(F.date_format(C("IssueDate"), "dd/MM/yyyy"), " - ", C("IssueQty"), " x ", C("IssuePartNo"),
                   " : ", C("PartDescription")), 50).alias("Details"),
        C("IssueNotes"),
        label("£", F.round(C("IssueUnitCost") * C("IssueQty"), 2)).alias("Value"),
        C("IssueDate").alias("_issued"))


@table("D10", "Critical Parts", ("PartNo", "PartDesc", "Cust", "UsedIn"), (), page="deliverables",
       headers=NEW_PARTS_HEADERS)
def d10(t: Tables, clock: AsOf) -> DataFrame:
    return t["PV755"].select("PartNo", "PartDesc", "Cust", "UsedIn")


def parts_to_purchase(t: Tables) -> DataFrame:
    items = t["AllItems"]
    balance = (C("PartStockActive") - C("DemandSO") - C("DemandWO") + C("PartStockOnOrderPO")
               + C("PartStockOnOrderWO"))
    return items.where((balance < 0) & (C("PartMainlyPurchased") == 1)).select(
        "PartNo", "PartDescription", "PartDefLocation", balance.alias("FinalStockBalance"))


@table("D11", "Parts to be purchased", ("PartNo", "PartDescription", "PartDefLocation", "FinalStockBalance"),
       (), page="deliverables", headers=PARTS_HEADERS)
def d11(t: Tables, clock: AsOf) -> DataFrame:
    return parts_to_purchase(t)


@table("I15", "Part Detail Changes not checked",
       ("When", "TransObjectType", "TransObjectID", "TransUser", "TransMemo"), (("When", "desc"),),
       page="inventory",
       headers=CHANGES_HEADERS,
       note="TransObjectType has no header label; the column name is used")
def i15(t: Tables, clock: AsOf) -> DataFrame:
    te = t["TransAltEdit"]
    return te.select(left(C("TransTime"), 10).alias("When"), "TransObjectType", "TransObjectID", "TransUser",
                     "TransMemo")


@table("P8", "Procedures to be reviewed", ("What", "Who", "When"), (("_review", "asc"),), page="productivity",
       headers=REVIEWS_HEADERS)
def p8(t: Tables, clock: AsOf) -> DataFrame:
    pr = t["AllProcedures"].where(clock.date_lt_now(C("DocNextReview"), 30) & text_eq(C("Status"), "Published"))
    return pr.select(label(C("DocNumber"), " - ", C("DocName")).alias("What"), C("DocOwner").alias("Who"),
                     C("DocNextReview").cast("string").alias("When"), C("DocNextReview").alias("_review"))
