"""Adapters from the bench/test tables to the ERP relations the KPIs read.

The KPI catalogue is written against 31 ERP relations (purchase-order lines,
works orders, stock lots, ...).  The test and bench data are TPC-H-like
tables (``lineitem``, ``orders``, ``part`` ...).  Each relation below is a
projection of one driver table (or one join) with plain SQL expressions that
Spark and DuckDB evaluate identically, so the Spark plans and the DuckDB
oracle read the very same relation contents.

Every relation keeps every row of the driver table it derives from, so every
KPI's work scales with the data; rows without a partner come from a shifted
key (its negative), rows without a value from a NULL attribute.

Fixed values: the column expressions below are the fixture mapping of the
project's FIXTURES.md (section 2), kept verbatim so both engines agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opskpi.sources.tables import Tables

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def _part_no(key: str) -> str:
    """Part-number rule: 'P<key>' plus a '-RETURN'/'-REPAIR' suffix by key."""
    return (f"concat('P',cast({key} as string),case when {key}%10=0 then '-RETURN' "
            f"when {key}%10=1 then '-REPAIR' else '' end)")


_WO_PART = _part_no("(o_orderkey%200)")
_BOM_WO_PART = _part_no("(l_orderkey%200)")


@dataclass(frozen=True)
class Relation:
    name: str
    source: str                      # driver table
    columns: tuple[tuple[str, str], ...]
    join: tuple[str, str] | None = None   # (other driver table, ON condition)


# --- fixed values: fixture mapping (FIXTURES.md section 2) -----------------
RELATIONS: tuple[Relation, ...] = (
    Relation("AllLivePO", "lineitem", (
        ("PONum", "l_orderkey"),
        ("PODetItemNum", "l_linenumber"),
        ("PODetPart", _part_no("l_partkey")),
        ("PODetPartDescr", "l_returnflag"),
        ("POSuppAddressName", "concat('SUP-',cast(l_suppkey as string))"),
        ("POBuyer", "l_suppkey"),
        ("PODetQtyReq", "cast(l_quantity as bigint)"),
        ("PODetQtyRec", "case when l_linestatus='F' then cast(floor(l_quantity/2) as bigint) else 0 end"),
        ("PODetUnitPrice", "cast(l_extendedprice as decimal(18,2))"),
        ("POOrderDate", "cast(o_orderdate as date)"),
        ("POSentDate", "case when l_orderkey%7=0 then null else cast(o_orderdate as date)+3 end"),
        ("POSubmitted", "case when o_orderstatus='P' then 0 else 1 end"),
        ("POConfirmation", "case when l_linestatus='O' then 0 else 1 end"),
        ("PODetDateReq", "cast(l_shipdate as date)"),
        ("PODetDatePromised", "case when l_orderkey%23=0 then date '2081-12-25' when l_orderkey%23=1 then date '2081-04-01' when l_orderkey%23=2 then date '2001-01-01' when l_orderkey%23=3 then date '2081-01-04' when l_orderkey%23=4 then null else cast(l_shipdate as date)+7 end"),
        ("PODetDateLatest", "case when l_orderkey%19=0 then date '2008-08-08' when l_orderkey%19=1 then date '2009-09-09' when l_orderkey%19=2 then date '2010-10-10' when l_orderkey%19=3 then date '2001-01-01' when l_orderkey%19=4 then date '2081-12-25' when l_orderkey%19=5 then null else cast(l_shipdate as date)+10 end"),
    ), join=("orders", "l_orderkey = o_orderkey")),
    Relation("employees", "supplier", (
        ("BadgeNo", "s_suppkey"),
        ("Name", "s_name"),
        ("EmployeeStatusID", "s_nationkey"),
    )),
    Relation("AllItems", "part", (
        ("PartNo", _part_no("p_partkey")),
        ("PartDescription", "p_name"),
        ("PartDefLocation", "p_brand"),
        ("PartDefCust", "case when p_partkey%4=0 then ' ' else p_brand end"),
        ("PartGroupCode", "case when p_partkey%15=0 then 'CONSUMABLE - A' else p_type end"),
        ("StatusDescription", "case when p_partkey%11=0 then 'OBSOLETE' when p_partkey%11=1 then 'NPI' when p_partkey%11=2 then 'IN DEV' when p_partkey%11=3 then 'To be reviewed' when p_partkey%11=4 then 'DORMANT' else 'ACTIVE' end"),
        ("coshh_DATE", "case when p_partkey%9=0 then 'n/a' when p_partkey%9=1 then null else cast(date '2000-06-30' - cast((p_partkey*7)%1500 as int) as string) end"),
        ("PartMainlyPurchased", "p_partkey%2"),
        ("PartMinStockLev", "p_size%3"),
        ("PartStockActive", "p_size"),
        ("DemandSO", "p_partkey%40"),
        ("DemandWO", "p_partkey%13"),
        ("PartStockOnOrderPO", "p_partkey%29"),
        ("PartStockOnOrderWO", "p_partkey%5"),
        ("PartUOMUOPConv", "1+(p_partkey%4)"),
        ("PartLeadTime", "p_partkey%60"),
        ("MinOfWOSchedStartDate", "case when p_partkey%6=0 then null else date '2000-06-30' + cast(p_partkey%200 as int) end"),
        ("MinOfSOLinePromisedDate", "case when p_partkey%5=0 then null else date '2000-06-30' + cast(p_partkey%170 as int) end"),
    )),
    Relation("worksOrder", "orders", (
        ("WONo", "o_orderkey"),
        ("WOPartNo", _WO_PART),
        ("WOQty", "10+(o_orderkey%20)"),
        ("WOQtyOS", "case when o_orderkey%4=0 then 0 when o_orderkey%4=1 then 10+(o_orderkey%20) else o_orderkey%10 end"),
        ("WOStatusDescription", "case when o_orderkey%7=0 then 'WIP' when o_orderkey%7=1 then 'Created' when o_orderkey%7=2 then 'On Hold' when o_orderkey%7=3 then 'Completed' when o_orderkey%7=4 then 'Total Qty Received' else 'WIP' end"),
        ("WOJobType", "case when o_orderkey%9=0 then null when o_orderkey%9=1 then 'SMT' when o_orderkey%9=2 then 'PENDING CUSTOMER' when o_orderkey%9=3 then 'PROD LINE' when o_orderkey%9=4 then 'TEST' else 'STORES' end"),
        ("WOSchedStartDate", "cast(o_orderdate as date)"),
        ("WOSchedFinishDate", "cast(o_orderdate as date)+45"),
        ("WOEarliestStartDate", "case when o_orderkey%31=0 then date '2012-12-12' else cast(o_orderdate as date)-5 end"),
        ("WOSalesOrder", "o_custkey"),
        ("WOLineNo", "1+(o_orderkey%7)"),
        ("WONotes", "o_orderpriority"),
    )),
    Relation("worksOrderBOM", "lineitem", (
        ("WONo", "l_orderkey"),
        ("WOPartNo", _BOM_WO_PART),
        ("WOBOMChildPartNo", _part_no("l_partkey")),
        ("WOBOMQty", "case when l_linenumber%5=0 then 0 else l_linenumber end"),
        ("WOBOMTotalRequired", "cast(l_quantity as bigint)"),
        ("WOQtyIssuedToDate", "case when l_linestatus='F' then cast(l_quantity as bigint) else cast(floor(l_quantity/3) as bigint) end"),
    )),
    Relation("AllLiveGRN", "lineitem", (
        ("GRNNo", "l_orderkey"),
        ("GRNLineNo", "l_linenumber"),
        ("GRNPartNo", _part_no("l_partkey")),
        ("GRNQtyLeft", "cast(l_quantity as bigint)"),
        ("GRNUnitCost", "cast(l_extendedprice as decimal(18,2))"),
        ("GRNDateReceived", "cast(l_shipdate as date)"),
        ("GRNExpiryDate", "cast(l_shipdate as date)+180"),
        ("GRNRequiresRelease", "case when l_returnflag='R' then 1 else 0 end"),
        ("GRNLocation", "case when l_suppkey%9=0 then 'QUARANTINE' when l_suppkey%9=1 then 'MRB OTHER' when l_suppkey%9=2 then 'MRB REWORK' when l_suppkey%9=3 then 'GREY MARKET INSPECTION' else 'STORES' end"),
    )),
    Relation("AllGRN_Transfer", "lineitem", (
        ("TransferGRNNo", "case when l_orderkey%4=0 then -l_orderkey else l_orderkey end"),
        ("TranferGRNLineNo", "l_linenumber"),
        ("TransferDate", "cast(l_shipdate as date)+cast(l_suppkey%15 as int)"),
        ("TransferLocation", "case when l_suppkey%9=0 then 'QUARANTINE' else 'STORES' end"),
    )),
    Relation("AllSO", "orders", (
        ("SONo", "o_custkey"),
        ("SOLineNo", "1+(o_orderkey%7)"),
        ("SOLinePartNo", _WO_PART),
        ("SOCustID", "case when o_custkey%20=0 then 'MEG-VMI' else concat('C',cast(o_custkey as string)) end"),
        ("SODate", "cast(o_orderdate as date)"),
        ("SOLinePromisedDate", "cast(o_orderdate as date)+30"),
        ("SOLineQty", "10+(o_orderkey%20)"),
        ("SOLineShipQty", "case when o_orderkey%3=0 then 10+(o_orderkey%20) else o_orderkey%10 end"),
        ("SOLineStatus", "case when o_orderkey%8=0 then 50 else 10 end"),
        ("SODescription", "case when o_orderkey%12=0 then 'On Hold' when o_orderkey%12=1 then null else 'Open' end"),
    )),
    Relation("AllWORec", "lineitem", (
        ("GRNWO", "l_orderkey"),
        ("GRNQtyReceived", "cast(l_quantity as bigint)"),
        ("GRNDateReceived", "cast(l_shipdate as date)"),
    )),
    Relation("StockIssue", "lineitem", (
        ("IssueDate", "l_shipdate"),
        ("IssueQty", "cast(l_quantity as bigint)"),
        ("IssuePartNo", _part_no("l_partkey")),
        ("IssueNotes", "l_returnflag"),
        ("IssueUnitCost", "cast(l_extendedprice as decimal(18,2))"),
        ("IssueType", "case when l_returnflag='R' then 'WRITE_OFF' else 'ISSUE' end"),
    )),
    Relation("AllLostStock", "lineitem", (
        ("GRNNo", "case when l_orderkey%50=0 then l_orderkey else -l_orderkey end"),
        ("GRNLineNo", "l_linenumber"),
        ("LOST_STOCK_RED", "case when l_suppkey%4=0 then cast(l_linenumber*10 as string) else '0' end"),
        ("LOST_STOCK_AMBER", "case when l_suppkey%4=1 then cast(l_linenumber*5 as string) else '0' end"),
        ("LOST_STOCK_GREEN", "case when l_suppkey%4=2 then cast(l_linenumber as string) else 'n/a' end"),
        ("MaxOfTransferDate", "cast(l_shipdate as date)+20"),
    )),
    Relation("Accident", "orders", (
        ("Date", "case when o_orderkey%8=3 then o_orderdate end"),
        ("Accident_Description", "case when o_orderkey%10=1 then null else o_orderpriority end"),
    )),
    Relation("AllWOPartDemand", "part", (
        ("PartNo", f"case when p_partkey%2=0 then {_part_no('p_partkey')} end"),
    )),
    Relation("AllOpenNCR", "orders", (
        ("NonCNo", "o_orderkey"),
        ("NonCPartNo", _WO_PART),
        ("NonCDate", "cast(o_orderdate as date)"),
    )),
    Relation("AllOpenNCRActions", "orders", (
        ("NCR", "case when o_orderkey%25 in (0,5) then o_orderkey else -o_orderkey end"),
        ("Type", "case when o_orderkey%3=0 then 'Corrective' when o_orderkey%3=1 then 'Preventative' when o_orderkey%3=2 then 'Follow Up' end"),
        ("Who", "o_custkey%10"),
        ("Target", "cast(o_orderdate as date)+14"),
    )),
    Relation("AllCalibration", "customer", (
        ("ToolCompanySerialNo", "concat('T',cast(c_custkey as string))"),
        ("ToolNo", "c_custkey"),
        ("ToolLocation", "case when c_custkey%6=0 then null when c_custkey%6=1 then 'QUARANTINE' when c_custkey%6=2 then 'ARCHIVE' else 'BENCH' end"),
        ("ToolNextCalibration", "date '2000-06-30' + cast(c_custkey%40 as int) - 20"),
        ("CalibrationStatusDesc", "case when c_custkey%5=0 then 'closed' else 'open' end"),
        ("ToolRequiresCalibration", "case when c_custkey%7=0 then 0 else 1 end"),
        ("GroupName", "case when c_custkey%3=0 then null else 'CALIBRATED' end"),
        ("ToolResponsible", "c_custkey%10"),
    )),
    Relation("AllCR", "orders", (
        ("ContractReviewNo", "o_custkey"),
        ("ContRevDetailTaskNo", "o_orderkey%9"),
        ("ContRevDetailTask", "case when o_orderkey%5=0 then 'LONG LEAD check' when o_orderkey%5=1 then 'BOM review' when o_orderkey%5=2 then 'Work Order issue' when o_orderkey%5=3 then 'Price' else 'Other' end"),
        ("AssignedName", "concat('Supplier#00000000',cast(o_orderkey%10 as string))"),
        ("ContRevDetailTargetDate", "cast(o_orderdate as date)+60"),
        ("CRStatusDescription", "case when o_orderkey%2=0 then 'Open' else 'Closed' end"),
        ("ContractReviewDate", "cast(o_orderdate as date)"),
        ("ContRevDetailLeadTime", "o_orderkey%30"),
    )),
    Relation("AllEnq", "orders", (
        ("EnquiryNo", "o_orderkey"),
        ("EnqCustID", "concat('C',cast(o_custkey as string))"),
        ("EnqDepartment", "o_orderpriority"),
        ("EnqDecisionDate", "cast(o_orderdate as date)+30"),
        ("EnqRequiredDate", "cast(o_orderdate as date)+20"),
        ("EnqStatus", "case when o_orderkey%2=0 then '#Submitted' else '#Received' end"),
        ("EnqEstimator", "o_custkey%10"),
        ("EnqFollowUpBy", "(o_custkey+3)%10"),
        ("EnqSalesRep", "(o_custkey+5)%10"),
    )),
    Relation("AllTraining", "customer", (
        ("Training_Course", "c_mktsegment"),
        ("Name", "c_name"),
        ("BadgeNo_IDFK", "c_custkey%10"),
        ("Areas_of_Experience", "case when c_custkey%8=0 then null else c_mktsegment end"),
        ("Course_Date", "date '2000-06-30' - cast((c_custkey*3)%400 as int)"),
        ("Result", "case when c_custkey%5=0 then 0 else 1 end"),
    )),
    Relation("AllProcedures", "part", (
        ("DocNumber", "p_partkey"),
        ("DocName", "p_name"),
        ("DocOwner", "p_brand"),
        ("DocNextReview", "date '2000-06-30' + cast(p_partkey%120 as int) - 40"),
        ("Status", "case when p_partkey%3=0 then 'Draft' else 'Published' end"),
    )),
    Relation("PV601", "orders", (
        ("WorksOrder", "case when o_orderkey%4=0 then o_orderkey else -o_orderkey end"),
        ("PrintedBy", "case when o_orderkey%8=0 then null else 'USER' end"),
    )),
    Relation("PV658", "lineitem", (
        ("PO", "l_orderkey"),
        ("PO_Line", "case when l_partkey%9=0 then 'n/a' when l_partkey%9=1 then null else cast(l_linenumber as string) end"),
        ("DateRaised", "cast(l_shipdate as date)"),
        ("DateReleased", "case when l_suppkey%3=0 then cast(l_shipdate as date)+5 else null end"),
    )),
    Relation("PV658_BuyerEngineer", "orders", (
        ("PO", "case when o_orderkey%2=0 then o_orderkey else -o_orderkey end"),
        ("FirstOfBuyer", "o_orderpriority"),
    )),
    Relation("PV718_ObLog", "part", (
        ("Log", "p_partkey"),
        ("Date_Added", "date '2000-06-30' - cast(p_partkey%500 as int)"),
        ("Buyer", "p_brand"),
        ("Progress_Part", "p_name"),
        ("PCN_or_EOL", "p_type"),
        ("LTB_DATE", "case when p_partkey%4=0 then null else date '2000-06-30' + cast(p_partkey%300 as int) end"),
        ("Complete", "case when p_partkey%3=0 then 'Y' else null end"),
    )),
    Relation("PV755", "part", (
        ("PartNo", _part_no("p_partkey")),
        ("PartDesc", "p_name"),
        ("Cust", "p_brand"),
        ("UsedIn", "p_type"),
    )),
    Relation("PV760_DFM", "part", (
        ("DocNo", "p_partkey"),
        ("Type", "p_type"),
        ("PartNo", _part_no("p_partkey")),
        ("Who", "p_brand"),
        ("Customer", "p_brand"),
        ("DateCreated", "case when p_partkey%10=0 then null else date '2000-06-30' - cast(p_partkey%90 as int) end"),
        ("DateComplete", "case when p_partkey%4=0 then date '2000-06-30' else null end"),
    )),
    Relation("PV547_RFC", "part", (
        ("RFC", "p_partkey"),
        ("Actionee", "p_brand"),
        ("Document", "p_name"),
        ("DateRaised", "date '2000-06-30' - cast(p_partkey%200 as int)"),
        ("Status", "case when p_partkey%3=0 then null when p_partkey%3=1 then 'Open' else 'closed' end"),
        ("Customer", "case when p_partkey%7=0 then null else p_type end"),
    )),
    Relation("CPP_Log", "customer", (
        ("CPP", "c_custkey"),
        ("Customer", "c_name"),
        ("Status", "case when c_custkey%6=0 then null when c_custkey%6=1 then 'Approved' when c_custkey%6=2 then 'PENDING CUSTOMER' when c_custkey%6=3 then 'REJECTED' else 'IN PROGRESS' end"),
        ("DateRaised", "case when c_custkey%11=0 then null else date '2000-06-30' - cast(c_custkey%300 as int) end"),
        ("RequiredDate", "date '2000-06-30' + cast(c_custkey%60 as int)"),
    )),
    Relation("PONoDemandOK", "lineitem", (
        ("PO", "case when l_orderkey%13=0 then l_orderkey else -l_orderkey end"),
        ("Line", "l_linenumber"),
    )),
    Relation("OOB_TRACKER_RECEIVED", "supplier", (
        ("SuppName", "concat('SUP-',cast(s_suppkey as string))"),
        ("RECEIVED", "case when s_suppkey%3=0 then 'Y' else 'N' end"),
    )),
    Relation("TransAltEdit", "events", (
        ("TransID", "event_id"),
        ("TransTime", "cast(ts as string)"),
        ("TransObjectType", "event_type"),
        ("TransObjectID", "user_id"),
        ("TransUser", "concat('U',cast(user_id as string))"),
        ("TransMemo", "props"),
    )),
)

RELATION_BY_NAME = {r.name.lower(): r for r in RELATIONS}


def _spark_relation(scan: Callable[[str], DataFrame], rel: Relation) -> DataFrame:
    df = scan(rel.source)
    if rel.join is not None:
        other, cond = rel.join
        df = df.join(scan(other), F.expr(cond), "inner")
    return df.selectExpr(*[f"{expr} AS {col}" for col, expr in rel.columns])


_TABLES: dict[tuple[int, str], Tables] = {}


def driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """``Tables`` holding the 31 ERP relations derived from ``sf_dir``
    (one lazily built set per session and folder)."""
    key = (id(spark), sf_dir)
    if key not in _TABLES:
        # one scan definition per table: footers are read once, Catalyst still
        # prunes columns and pushes filters per query
        scan = lru_cache(maxsize=None)(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        _TABLES[key] = Tables({rel.name: (lambda r=rel: _spark_relation(scan, r)) for rel in RELATIONS})
    return _TABLES[key]


def duckdb_ctes(names: list[str] | None = None) -> str:
    """``name AS (SELECT ...)`` clauses for a DuckDB ``WITH`` over the driver views."""
    rels = RELATIONS if names is None else [RELATION_BY_NAME[n.lower()] for n in names]
    parts = []
    for rel in rels:
        cols = ", ".join(f"{expr} AS {col}" for col, expr in rel.columns)
        src = rel.source
        if rel.join is not None:
            src = f"{rel.source} JOIN {rel.join[0]} ON {rel.join[1]}"
        parts.append(f"{rel.name} AS (SELECT {cols} FROM {src})")
    return ",\n".join(parts)
