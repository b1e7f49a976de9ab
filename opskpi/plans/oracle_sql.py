"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each body is written directly in SQL against the ERP relations, which are
supplied as CTEs over the driver views (see ``opskpi.sources.driver``).  The
SQL uses the plain day-difference form of every predicate, case-insensitive
comparisons (``lower``/``ILIKE``) and explicit NULL ordering inside top-N, so
it checks the Spark plans' rewrites rather than repeating them.

Evaluation time: 2000-06-30 00:00:00.  Cut-offs use the driver-data values
(promised after 1996-01-01, enquiries from 1996-01-01, queries raised after
1999-07-31).
"""

from __future__ import annotations

import re

from opskpi.sources.driver import RELATIONS, duckdb_ctes

D0 = "DATE '2000-06-30'"
TS = "TIMESTAMP '2000-06-30 00:00:00'"


def age(c: str) -> str:
    return f"date_diff('day', CAST({c} AS DATE), {D0})"


def due(c: str) -> str:
    return f"date_diff('day', {D0}, CAST({c} AS DATE))"


def ci(c: str) -> str:
    return f"lower(rtrim({c}))"


def dates(*isos: str) -> str:
    return "(" + ", ".join(f"DATE '{d}'" for d in isos) + ")"


POLBL_FULL = "concat(PONum, '/', PODetItemNum, ' : ', PODetPart, ' : ', POSuppAddressName)"
POLBL = f"left({POLBL_FULL}, 50)"

D9_SET = dates("2001-01-01", "2018-12-31", "2081-12-25", "2111-01-01", "2081-01-04",
               "2010-10-10", "2009-09-09", "2008-08-08", "2002-02-02")

BODIES: dict[str, str] = {}

# ---------------------------------------------------------------- deliverables
BODIES["kpi_D1a1"] = f"""
SELECT {POLBL_FULL} AS label, {age('PODetDatePromised')} AS value
FROM AllLivePO
WHERE {age('PODetDatePromised')} > 0 AND PODetDatePromised > DATE '1996-01-01'
  AND PODetDateLatest NOT IN {dates('2001-01-01', '2008-08-08', '2009-09-09', '2010-10-10')}
"""

BODIES["kpi_D1b"] = f"""
SELECT {POLBL} AS label, {due('PODetDateReq')} AS value
FROM AllLivePO
WHERE PODetDatePromised = DATE '2081-12-25' OR PODetDateLatest = DATE '2081-12-25'
"""

BODIES["kpi_D1c"] = f"""
SELECT {POLBL} AS label, {age('PODetDatePromised')} AS value
FROM AllLivePO
WHERE {age('PODetDatePromised')} > 1 AND PODetDatePromised > DATE '1996-01-01'
  AND PODetDateLatest = DATE '2008-08-08'
"""

BODIES["kpi_D1d"] = f"""
SELECT {POLBL} AS label, {age('PODetDatePromised')} AS value, CAST(5 AS BIGINT) AS target
FROM AllLivePO
WHERE {age('PODetDatePromised')} > 0 AND PODetDatePromised > DATE '1996-01-01'
  AND PODetDateLatest IN {dates('2008-08-08', '2009-09-09', '2010-10-10')}
"""

BODIES["kpi_D1a2"] = f"""
WITH g AS (
  SELECT po.PONum, po.PODetItemNum, po.PODetPart, po.POSuppAddressName, po.PODetDateReq,
         MAX(po.PODetDatePromised) AS maxp
  FROM AllLivePO po LEFT JOIN employees e ON po.POBuyer = e.BadgeNo
  WHERE po.PODetPart IS NOT NULL AND {age('po.PODetDateReq')} > 7
    AND po.PODetDateLatest NOT IN {dates('2001-01-01', '2008-08-08', '2009-09-09', '2010-10-10', '2002-02-02', '2018-12-31')}
  GROUP BY po.PONum, po.PODetItemNum, po.PODetPart, po.PODetPartDescr, po.POSuppAddressName,
           e.Name, po.PODetDateReq, po.PODetDateLatest
  HAVING MAX(po.PODetDatePromised) NOT IN {dates('2081-12-31', '2002-02-02')})
SELECT {POLBL} AS label, {age('PODetDateReq')} AS value FROM g
"""

_D2_CORE = f"""
  SELECT q.PO, q.PO_Line, b.FirstOfBuyer AS Buyer, po.POSuppAddressName, q.DateRaised,
         q.DateReleased, po.PODetDatePromised, {age('q.DateRaised')} AS DaysInQuery
  FROM AllLivePO po
  RIGHT JOIN (SELECT * FROM PV658 WHERE PO IS NOT NULL AND PO_Line IS NOT NULL) q
     ON po.PODetItemNum = TRY_CAST(q.PO_Line AS BIGINT) AND po.PONum = q.PO
  LEFT JOIN PV658_BuyerEngineer b ON po.PONum = b.PO
  GROUP BY q.PO, q.PO_Line, b.FirstOfBuyer, po.POSuppAddressName, q.DateRaised, q.DateReleased,
           po.PODetDatePromised
  HAVING q.DateRaised > DATE '1999-07-31' AND q.DateReleased IS NULL
"""

BODIES["kpi_D2"] = f"""
WITH s AS ({_D2_CORE})
SELECT concat(PO, '/', PO_Line, ' # ', Buyer, ' # ', POSuppAddressName) AS label, DaysInQuery AS value,
       CAST(0 AS BIGINT) AS target_start, CAST(5 AS BIGINT) AS target
FROM s GROUP BY PO, PO_Line, Buyer, POSuppAddressName, DaysInQuery
"""

_DEMAND = f"""
  SELECT po.*, i.PartNo, e.Name, po.PODetUnitPrice * po.PODetQtyReq AS POValue,
         CASE WHEN i.MinOfWOSchedStartDate IS NULL THEN i.MinOfSOLinePromisedDate
              WHEN i.MinOfSOLinePromisedDate < i.MinOfWOSchedStartDate THEN i.MinOfSOLinePromisedDate
              ELSE i.MinOfWOSchedStartDate END AS RequiredDate,
         CASE WHEN i.MinOfWOSchedStartDate IS NULL THEN 'SO'
              WHEN i.MinOfSOLinePromisedDate < i.MinOfWOSchedStartDate THEN 'SO' ELSE 'WO' END AS DemandType,
         COALESCE(i.DemandSO, 0) + COALESCE(i.DemandWO, 0) AS Demand
  FROM AllLivePO po
  LEFT JOIN AllItems i ON po.PODetPart = i.PartNo
  LEFT JOIN employees e ON po.POBuyer = e.BadgeNo
  LEFT JOIN PONoDemandOK ok ON po.PONum = ok.PO AND po.PODetItemNum = ok.Line
  WHERE ok.PO IS NULL AND po.PODetUnitPrice * po.PODetQtyReq > 100
    AND po.PODetDatePromised NOT IN {dates('2008-08-08', '2018-12-25', '2018-12-31', '2018-04-01', '2001-01-01')}
"""

_DEMAND_LABEL = "concat(PONum, '/', PODetItemNum, ' # ', PartNo, ' # £', POValue, ' (', Name, ')')"

BODIES["kpi_D3a"] = f"""
WITH d AS ({_DEMAND})
SELECT {_DEMAND_LABEL} AS label, {due('RequiredDate')} AS value, {due('PODetDatePromised')} AS target,
       CAST(0 AS BIGINT) AS target_start
FROM d
WHERE {due('RequiredDate')} >= 28 AND Demand > 0 AND RequiredDate > PODetDatePromised + INTERVAL 28 DAY
"""

BODIES["kpi_D3b"] = f"""
WITH d AS ({_DEMAND})
SELECT {_DEMAND_LABEL} AS label, {due('RequiredDate')} AS value, {due('PODetDatePromised')} AS secondary_value
FROM d
WHERE {due('RequiredDate')} >= 28 AND Demand > 0 AND RequiredDate > PODetDatePromised
  AND (year(RequiredDate) <> year(PODetDatePromised) OR month(RequiredDate) <> month(PODetDatePromised))
"""

_D4 = """
  SELECT po.PONum, po.PODetItemNum, po.POSuppAddressName, MIN(po.PODetDateReq) AS FirstReq,
         po.PODetDatePromised, SUM(po.PODetQtyReq * po.PODetUnitPrice) AS PoValue, e.Name
  FROM AllLivePO po JOIN employees e ON po.POBuyer = e.BadgeNo
  WHERE po.PODetDatePromised = DATE '2081-04-01'
  GROUP BY po.PONum, po.PODetItemNum, po.POSuppAddressName, po.PODetDatePromised, e.Name
"""

BODIES["kpi_D4"] = f"""
WITH r AS ({_D4})
SELECT left(concat(PONum, '/', PODetItemNum, ' # ', Name, ' # ', POSuppAddressName), 50) AS label,
       {due('FirstReq')} AS value, CAST(PoValue AS DOUBLE) AS right_value
FROM r
"""

BODIES["kpi_D5"] = f"""
SELECT concat(EnquiryNo, ' ', EnqCustID, ' # ', EnqDepartment) AS label, {due('EnqRequiredDate')} AS value
FROM AllEnq
GROUP BY EnquiryNo, EnqCustID, EnqDepartment, EnqRequiredDate, EnqStatus
HAVING {ci('EnqStatus')} = '#received'
"""

BODIES["kpi_D7"] = f"""
SELECT left(concat(PONum, ' # ', POSuppAddressName), 14) AS label, {age('POOrderDate')} AS value,
       CAST(7 AS BIGINT) AS target
FROM AllLivePO
WHERE PODetDatePromised <> DATE '2081-04-01' AND POSubmitted = 0
GROUP BY PONum, POOrderDate, POSuppAddressName, POSubmitted
"""

_EXCESS_QTY = ("CASE WHEN i.PartStockOnOrderPO < i.PartStockActive + i.PartStockOnOrderPO - i.DemandSO - i.DemandWO "
               "THEN i.PartStockOnOrderPO ELSE i.PartStockActive + i.PartStockOnOrderPO - i.DemandSO - i.DemandWO END")
_EXCESS_COST = (f"CAST(m.MaxPrice AS DOUBLE) * (CAST({_EXCESS_QTY} AS DOUBLE) / "
                "CAST(NULLIF(i.PartUOMUOPConv, 0) AS DOUBLE))")

BODIES["kpi_D8"] = f"""
WITH m AS (SELECT PODetPart AS POPartNo, MAX(PODetUnitPrice) AS MaxPrice FROM AllLivePO GROUP BY PODetPart),
g AS (
  SELECT po.PODetPart, {_EXCESS_COST} AS ExcessCost, {_EXCESS_QTY} AS ExcessQty
  FROM AllLivePO po
  JOIN AllItems i ON po.PODetPart = i.PartNo
  JOIN employees e ON po.POBuyer = e.BadgeNo
  JOIN m ON po.PODetPart = m.POPartNo
  WHERE i.PartMinStockLev = 0
  GROUP BY po.PODetPart, {_EXCESS_COST}, {_EXCESS_QTY}
  HAVING {_EXCESS_COST} > 20 AND {_EXCESS_QTY} > 0
     AND MIN(po.PODetDatePromised) NOT IN {dates('2001-01-01', '2081-04-01', '2002-01-01')})
SELECT PODetPart AS label, ExcessCost AS value FROM g
ORDER BY value DESC NULLS LAST, label ASC NULLS FIRST LIMIT 20
"""

BODIES["kpi_D9"] = f"""
SELECT DISTINCT concat(po.PONum, '/', po.PODetItemNum, ' <', e.Name, '>') AS label,
       {due('po.PODetDatePromised')} AS value
FROM AllLivePO po
JOIN AllItems i ON po.PODetPart = i.PartNo
JOIN employees e ON po.POBuyer = e.BadgeNo
JOIN OOB_TRACKER_RECEIVED o ON {ci('po.POSuppAddressName')} = {ci('o.SuppName')}
WHERE {due('po.PODetDatePromised')} <= 14 AND po.PODetQtyReq - po.PODetQtyRec > 0
  AND (po.PODetDateLatest IS NULL OR po.PODetDateLatest NOT IN {D9_SET})
  AND (po.PODetDatePromised IS NULL OR po.PODetDatePromised NOT IN {D9_SET})
  AND {ci('o.RECEIVED')} = 'n'
"""

BODIES["kpi_D12"] = f"""
SELECT concat(so, ' (', cust, ') - ', line) AS label, days AS value
FROM (SELECT DISTINCT SONo AS so, SOCustID AS cust, SOLineNo AS line, SOLinePromisedDate AS promised,
             {due('SOLinePromisedDate')} AS days
      FROM AllSO WHERE {ci('SODescription')} = 'on hold' AND {ci('SOCustID')} <> 'meg-vmi')
"""


# ---------------------------------------------------------------- inventory
BODIES["kpi_I2a_wip"] = f"""
SELECT label, value FROM (
  SELECT concat(WONo, ' | ', WOQtyOS, ' | ', COALESCE(WOPartNo, '')) AS label,
         {age('WOSchedStartDate')} AS value, WOSchedStartDate
  FROM worksOrder
  WHERE WOQtyOS > 0 AND {ci('WOStatusDescription')} = 'wip'
    AND NOT (rtrim(WOPartNo) ILIKE '%-REPAIR') AND NOT (rtrim(WOPartNo) ILIKE '%-RETURN')
  ORDER BY WOSchedStartDate ASC NULLS FIRST, label ASC NULLS FIRST, value ASC NULLS FIRST
  LIMIT 10)
"""

BODIES["kpi_I2b_wip"] = f"""
SELECT WOPartNo AS label, {due('WOSchedStartDate')} AS value
FROM worksOrder WHERE {ci('WOStatusDescription')} = 'on hold'
"""

BODIES["kpi_I6_location"] = f"""
SELECT left(concat(WONo, ' | ', COALESCE(WOJobType, ''), ' | ', COALESCE(WOPartNo, '')), 80) AS label,
       {age('WOSchedStartDate')} AS value
FROM worksOrder
WHERE WOSchedStartDate IS NOT NULL AND {age('WOSchedStartDate')} > 0
  AND (WOJobType IS NULL OR (NOT (rtrim(WOJobType) ILIKE 'PR%')
       AND {ci('WOJobType')} NOT IN ('smt', 'test', 'qa', 'concoat', 'sub contractor', 'engineering wip',
                                     'kitting on hold', 'material sales', 'sub con - to be sent',
                                     'pending customer')))
  AND {ci('WOStatusDescription')} NOT IN ('completed', 'total qty received', 'on hold')
  AND NOT (rtrim(WOPartNo) ILIKE '%FAI REPORT')
  AND {ci('WOPartNo')} <> 'smt attrition' AND {ci('WOPartNo')} <> 'additional charge'
  AND {ci('WOPartNo')} <> 'excess material' AND NOT (rtrim(WOPartNo) ILIKE '%FAIR%')
  AND {ci('WOPartNo')} <> 'consumable issues' AND NOT (rtrim(WOPartNo) ILIKE '%WRITE-OFF')
  AND NOT (rtrim(WOPartNo) ILIKE '%-RETURN') AND NOT (rtrim(WOPartNo) ILIKE '%-REPAIR')
ORDER BY value DESC NULLS LAST, label ASC NULLS FIRST LIMIT 20
"""

BODIES["kpi_I10_material"] = f"""
SELECT concat(w.WONo, '|', w.WOPartNo) AS label, {due('w.WOSchedStartDate')} AS value
FROM worksOrder w LEFT JOIN AllItems i ON w.WOPartNo = i.PartNo
WHERE {ci('w.WOPartNo')} <> 'procedures' AND w.WOEarliestStartDate = DATE '2012-12-12'
  AND {ci('w.WOStatusDescription')} <> 'completed'
"""

BODIES["kpi_I8"] = f"""
SELECT concat(GRNNo, ' (X', GRNQtyLeft, ') ', GRNPartNo) AS label, {age('GRNDateReceived')} AS value,
       CAST(5 AS BIGINT) AS target
FROM AllLiveGRN WHERE {ci('GRNLocation')} = 'grey market inspection'
"""

BODIES["kpi_I4"] = f"""
WITH waiting AS (
  SELECT DISTINCT GRNNo AS lot, GRNPartNo AS part, GRNDateReceived AS received FROM AllLiveGRN
  WHERE GRNRequiresRelease = 1 AND {ci('GRNLocation')} NOT LIKE 'mrb%'
    AND {ci('GRNLocation')} <> 'grey market inspection'),
named AS (
  SELECT DISTINCT lot, part, received, PartDescription AS what FROM waiting LEFT JOIN AllItems ON PartNo = part)
SELECT left(concat(lot, ' <', part, '> ', what), 25) AS label, {age('received')} AS value,
       CAST(5 AS BIGINT) AS target
FROM named
"""

_I7_RED = "TRY_CAST(s.LOST_STOCK_RED AS DECIMAL(18,2))"
_I7_AMBER = "TRY_CAST(s.LOST_STOCK_AMBER AS DECIMAL(18,2))"
_I7_GREEN = "TRY_CAST(s.LOST_STOCK_GREEN AS DECIMAL(18,2))"
BODIES["kpi_I7"] = f"""
SELECT concat(s.GRNNo, '(X', g.GRNQtyLeft, ' <> £',
              ROUND(TRY_CAST(g.GRNQtyLeft AS DECIMAL(18,2)) * TRY_CAST(g.GRNUnitCost AS DECIMAL(18,2)), 0),
              ') ', g.GRNPartNo) AS label,
       CAST(CASE WHEN {_I7_RED} <> 0 THEN {_I7_RED} WHEN {_I7_AMBER} <> 0 THEN {_I7_AMBER}
                 WHEN {_I7_GREEN} <> 0 THEN {_I7_GREEN} ELSE 0 END AS DOUBLE) AS value,
       CASE WHEN {_I7_RED} <> 0 THEN 'lost-stock-red' WHEN {_I7_AMBER} <> 0 THEN 'lost-stock-amber'
            WHEN {_I7_GREEN} <> 0 THEN 'lost-stock-green' ELSE 'lost-stock-unknown' END AS class_name,
       CAST(30 AS BIGINT) AS target
FROM AllLostStock s
LEFT JOIN AllLiveGRN g ON s.GRNNo = g.GRNNo AND s.GRNLineNo = g.GRNLineNo
LEFT JOIN AllGRN_Transfer tr ON s.GRNNo = tr.TransferGRNNo AND s.GRNLineNo = tr.TranferGRNLineNo
GROUP BY s.GRNNo, g.GRNQtyLeft, g.GRNUnitCost, g.GRNPartNo, s.LOST_STOCK_AMBER, s.LOST_STOCK_GREEN,
         s.LOST_STOCK_RED, s.MaxOfTransferDate
"""

BODIES["kpi_I9"] = f"""
WITH r AS (
  SELECT rec.GRNWO, w.WOQty, MAX(rec.GRNDateReceived) AS LastReceipt
  FROM AllWORec rec LEFT JOIN worksOrder w ON rec.GRNWO = w.WONo
  GROUP BY rec.GRNWO, w.WOQty)
SELECT concat(w.WONo, ' # ', w.WOPartNo) AS label, {age('r.LastReceipt')} AS value
FROM worksOrder w
LEFT JOIN AllItems i ON w.WOPartNo = i.PartNo
JOIN r ON w.WONo = r.GRNWO
WHERE w.WOQtyOS = 0 AND {ci('w.WOStatusDescription')} <> 'completed' AND {ci('w.WOPartNo')} <> 'procedures'
"""

BODIES["kpi_I11"] = f"""
SELECT concat(w.WONo, ' <', w.WOSalesOrder, '/', w.WOLineNo, '> ', w.WOPartNo) AS label,
       date_diff('day', s.SOLinePromisedDate, w.WOSchedFinishDate) AS value
FROM worksOrder w
LEFT JOIN AllItems i ON w.WOPartNo = i.PartNo
JOIN AllSO s ON w.WOLineNo = s.SOLineNo AND w.WOSalesOrder = s.SONo
WHERE date_diff('day', s.SOLinePromisedDate, w.WOSchedFinishDate) > 0
  AND (floor(s.SOLineQty) - floor(s.SOLineShipQty)) > 0
  AND {ci('w.WOStatusDescription')} <> 'completed'
"""

_I12 = f"""
  SELECT g.GRNNo, g.GRNPartNo, i.PartDescription, g.GRNQtyLeft, i.PartLeadTime,
         {due('g.GRNExpiryDate')} AS DaysTillExpiry, g.GRNExpiryDate, i.PartGroupCode, g.GRNLocation,
         i.DemandSO + i.DemandWO AS Demand, i.PartStockActive
  FROM AllLiveGRN g JOIN AllItems i ON g.GRNPartNo = i.PartNo
  GROUP BY g.GRNNo, g.GRNPartNo, i.PartDescription, g.GRNQtyLeft, i.PartLeadTime, {due('g.GRNExpiryDate')},
           g.GRNExpiryDate, i.PartGroupCode, g.GRNLocation, i.DemandSO + i.DemandWO, i.PartStockActive,
           g.GRNExpiryDate - CAST(i.PartLeadTime AS INTEGER) - 7
  HAVING {due('g.GRNExpiryDate')} < 60 AND NOT (rtrim(g.GRNLocation) ILIKE '%QUARANTINE%')
"""

BODIES["kpi_I12"] = f"""
WITH e AS ({_I12})
SELECT concat(GRNNo, ' <', GRNPartNo, '>') AS label, DaysTillExpiry AS value FROM e
"""

BODIES["kpi_I13"] = f"""
WITH p AS (
  SELECT b.WONo, b.WOPartNo, COUNT(b.WOBOMChildPartNo) AS QtyItemsPartialKit
  FROM worksOrderBOM b JOIN AllItems i ON b.WOBOMChildPartNo = i.PartNo
  WHERE b.WOBOMTotalRequired > 0 AND b.WOQtyIssuedToDate < b.WOBOMTotalRequired AND b.WOQtyIssuedToDate >= 0
    AND NOT (rtrim(i.PartGroupCode) ILIKE 'CONSUMABLE%')
  GROUP BY b.WONo, b.WOPartNo)
SELECT CAST(p.WONo AS VARCHAR) AS label, p.QtyItemsPartialKit AS value
FROM p JOIN worksOrder w ON p.WONo = w.WONo
WHERE {ci('w.WOStatusDescription')} = 'completed' AND p.QtyItemsPartialKit > 0
"""

BODIES["kpi_I14"] = f"""
WITH lots AS (
  SELECT GRNPartNo, GRNNo, SUM(TRY_CAST(GRNQtyLeft AS DECIMAL(18,4))) AS SumQty,
         MAX(TRY_CAST(GRNUnitCost AS DECIMAL(18,4))) AS MaxCost
  FROM AllLiveGRN WHERE GRNPartNo IS NOT NULL GROUP BY GRNPartNo, GRNNo),
stock AS (
  SELECT b.WOBOMChildPartNo, i.PartDescription, COUNT(b.WONo) AS CountOfWONo, l.SumQty,
         ROUND(l.SumQty * l.MaxCost, 0) AS Approx
  FROM worksOrderBOM b
  JOIN AllItems i ON b.WOBOMChildPartNo = i.PartNo
  JOIN worksOrder w ON b.WONo = w.WONo
  JOIN lots l ON b.WOBOMChildPartNo = l.GRNPartNo
  WHERE {ci('w.WOStatusDescription')} <> 'completed' AND i.PartMainlyPurchased = 1
    AND (w.WOQty - w.WOQtyOS) = 0 AND NOT (rtrim(i.PartGroupCode) ILIKE 'CONSUMABLE%')
    AND l.SumQty > 0 AND b.WOBOMQty = 0 AND {ci('b.WOBOMChildPartNo')} <> 'dnf'
    AND ROUND(l.SumQty * l.MaxCost, 0) > 20
  GROUP BY b.WOBOMChildPartNo, i.PartDescription, i.PartDefLocation, i.PartGroupCode, l.GRNNo, l.SumQty,
           l.MaxCost, b.WOBOMQty),
per AS (
  SELECT WOBOMChildPartNo, SUM(Approx) AS SumApprox FROM stock
  GROUP BY WOBOMChildPartNo, PartDescription, CountOfWONo)
SELECT WOBOMChildPartNo AS label, CAST(SumApprox AS DOUBLE) AS value FROM per
ORDER BY value DESC NULLS LAST, label ASC NULLS FIRST LIMIT 20
"""

# ---------------------------------------------------------------- quality
def _q1(pattern: str) -> str:
    return f"""
WITH base AS (
  SELECT RIGHT(s.SOLinePartNo, 6) AS Type, s.SOLinePartNo, i.PartDefCust AS Customer, w.WONo,
         w.WOJobType AS Location, s.SONo, s.SOLineNo, s.SOLineQty - s.SOLineShipQty AS SOOSQty,
         {age('s.SODate')} AS SOOpenDays, {due('s.SOLinePromisedDate')} AS SODueDays
  FROM AllSO s
  LEFT JOIN worksOrder w ON s.SOLineNo = w.WOLineNo AND s.SOLinePartNo = w.WOPartNo AND s.SONo = w.WOSalesOrder
  LEFT JOIN AllItems i ON i.PartNo = s.SOLinePartNo
  WHERE (rtrim(s.SOLinePartNo) ILIKE '%-RETURN' OR rtrim(s.SOLinePartNo) ILIKE '%-REPAIR')
    AND s.SOLineStatus <> 50 AND s.SOLineShipQty < s.SOLineQty
    AND ({ci('s.SODescription')} <> 'on hold' OR s.SODescription IS NULL))
SELECT concat(SONo, '/', SOLineNo, ' : (WO-', COALESCE(CAST(WONo AS VARCHAR), ''), ') ', trim(SOLinePartNo),
              CASE WHEN NULLIF(trim(Customer), '') IS NOT NULL THEN concat(' - ', trim(Customer)) ELSE '' END,
              ' : ', SOOSQty) AS label,
       SOOpenDays AS value, SODueDays AS secondary_value
FROM base
WHERE ({ci('Location')} <> 'pending customer' OR Location IS NULL) AND rtrim(SOLinePartNo) ILIKE '{pattern}'
"""


BODIES["kpi_Q1"] = _q1("%")
BODIES["kpi_Q1_RETURN"] = _q1("%-RETURN%")
BODIES["kpi_Q1_REPAIR"] = _q1("%-REPAIR%")


def _q2(pattern: str) -> str:
    return f"""
SELECT concat(g.GRNNo, ' <', g.GRNLocation, '> ', g.GRNPartNo) AS label,
       {age('MAX(tr.TransferDate)')} AS value, CAST(0 AS BIGINT) AS target_start, CAST(7 AS BIGINT) AS target
FROM AllLiveGRN g
LEFT JOIN AllGRN_Transfer tr ON g.GRNNo = tr.TransferGRNNo AND g.GRNLineNo = tr.TranferGRNLineNo
WHERE rtrim(g.GRNLocation) ILIKE '{pattern}'
GROUP BY g.GRNNo, g.GRNLocation, g.GRNPartNo
"""


BODIES["kpi_Q2_grn"] = _q2("MR%")
BODIES["kpi_Q2_grn_REWORK"] = _q2("%REWORK%")

BODIES["kpi_Q3_customer"] = f"""
SELECT concat(WONo, ' (', WOPartNo, ')') AS label, {age('WOSchedFinishDate')} AS value
FROM worksOrder WHERE WOQtyOS > 0 AND {ci('WOJobType')} = 'pending customer'
"""

BODIES["kpi_Q6"] = f"""
SELECT concat(n.NonCNo, ' # ', n.NonCPartNo, ' ~ ', e.Name) AS label, {age('n.NonCDate')} AS value,
       CAST(0 AS BIGINT) AS target_start, CAST(30 AS BIGINT) AS target
FROM AllOpenNCR n
LEFT JOIN AllOpenNCRActions a ON n.NonCNo = a.NCR
LEFT JOIN employees e ON a.Who = e.BadgeNo
WHERE rtrim(a.Type) ILIKE 'C%' OR rtrim(a.Type) ILIKE 'P%'
ORDER BY value DESC NULLS LAST, label ASC NULLS FIRST, target_start ASC, target ASC LIMIT 20
"""


def _q7(pattern: str) -> str:
    return f"""
SELECT concat(a.Type, ' ', a.NCR, ' # ', e.Name) AS label, {due('a.Target')} AS value
FROM AllOpenNCRActions a JOIN employees e ON a.Who = e.BadgeNo
WHERE {due('a.Target')} <= 7 AND rtrim(a.Type) ILIKE '{pattern}'
"""


BODIES["kpi_Q7"] = _q7("%")
BODIES["kpi_Q7_Corrective"] = _q7("%Corrective%")
BODIES["kpi_Q7_prevent"] = _q7("%prevent%")

_OUT_OF_SERVICE = ("('quarantine', 'awaiting repair / calibration', 'sent for calibration', "
                   "'returned to supplier', 'archive', 'returned to customer')")


def _q8(group_cond: str) -> str:
    return f"""
SELECT concat(c.ToolCompanySerialNo, ' (', c.ToolNo, ') ', ' # ', e.Name, ' # ', c.ToolLocation) AS label,
       {due('c.ToolNextCalibration')} AS value
FROM AllCalibration c LEFT JOIN employees e ON c.ToolResponsible = e.BadgeNo
WHERE ({due('c.ToolNextCalibration')} <= 7 AND {ci('c.ToolLocation')} NOT IN {_OUT_OF_SERVICE}
       AND {ci('c.CalibrationStatusDesc')} <> 'closed' AND c.ToolRequiresCalibration = 1 AND {group_cond})
   OR ({due('c.ToolNextCalibration')} <= 7 AND c.ToolLocation IS NULL
       AND {ci('c.CalibrationStatusDesc')} <> 'closed' AND c.ToolRequiresCalibration = 1 AND {group_cond})
"""


BODIES["kpi_Q8"] = _q8(f"{ci('c.GroupName')} = 'calibrated'")
BODIES["kpi_Q8b"] = _q8("c.GroupName IS NULL")

BODIES["kpi_Q9"] = f"""
SELECT concat(g.GRNNo, '/', g.GRNLineNo, ' (X', g.GRNQtyLeft, ') ', g.GRNPartNo) AS label,
       {age('MAX(tr.TransferDate)')} AS value
FROM AllLiveGRN g
LEFT JOIN AllGRN_Transfer tr ON g.GRNLineNo = tr.TranferGRNLineNo AND g.GRNNo = tr.TransferGRNNo
WHERE {ci('g.GRNLocation')} = 'quarantine' AND {ci('tr.TransferLocation')} = 'quarantine'
GROUP BY g.GRNNo, g.GRNLineNo, g.GRNQtyLeft, g.GRNPartNo
"""

# ---------------------------------------------------------------- safety
BODIES["kpi_S1"] = f"""
SELECT concat(' ', strftime("Date", '%y/%m'), ' ') AS label, COUNT(Accident_Description) AS value
FROM Accident WHERE "Date" > {TS} - INTERVAL 365 DAY
GROUP BY strftime("Date", '%y/%m')
"""

BODIES["kpi_S1_days_since_accident"] = f"""
SELECT 'Days Since Last Accident' AS label, {age('MAX("Date")')} AS value FROM Accident
"""

# ---------------------------------------------------------------- charts of a log in a reporting window
BODIES["kpi_S1_window"] = f"""
SELECT concat(' ', strftime("Date", '%y/%m'), ' ') AS label, COUNT(Accident_Description) AS value
FROM Accident
WHERE "Date" > {TS} - INTERVAL 365 DAY AND CAST("Date" AS DATE) BETWEEN DATE '1999-10-15' AND DATE '2000-01-31'
GROUP BY strftime("Date", '%y/%m')
"""

BODIES["kpi_Q9_window"] = f"""
SELECT concat(g.GRNNo, '/', g.GRNLineNo, ' (X', g.GRNQtyLeft, ') ', g.GRNPartNo) AS label,
       {age('MAX(tr.TransferDate)')} AS value
FROM AllLiveGRN g
JOIN AllGRN_Transfer tr ON g.GRNLineNo = tr.TranferGRNLineNo AND g.GRNNo = tr.TransferGRNNo
WHERE {ci('g.GRNLocation')} = 'quarantine' AND {ci('tr.TransferLocation')} = 'quarantine'
  AND tr.TransferDate BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'
GROUP BY g.GRNNo, g.GRNLineNo, g.GRNQtyLeft, g.GRNPartNo
"""

BODIES["kpi_D2_window"] = f"""
WITH s AS ({_D2_CORE} AND q.DateRaised BETWEEN DATE '1999-09-01' AND DATE '1999-12-31')
SELECT concat(PO, '/', PO_Line, ' # ', Buyer, ' # ', POSuppAddressName) AS label, DaysInQuery AS value,
       CAST(0 AS BIGINT) AS target_start, CAST(5 AS BIGINT) AS target
FROM s GROUP BY PO, PO_Line, Buyer, POSuppAddressName, DaysInQuery
"""

BODIES["table_I3_window"] = f"""
SELECT left(concat(strftime(si.IssueDate, '%d/%m/%Y'), ' - ', si.IssueQty, ' x ', si.IssuePartNo, ' : ',
                   i.PartDescription), 50) AS Details,
       si.IssueNotes AS IssueNotes, concat('£', ROUND(si.IssueUnitCost * si.IssueQty, 2)) AS Value
FROM StockIssue si LEFT JOIN AllItems i ON si.IssuePartNo = i.PartNo
WHERE si.IssueUnitCost * si.IssueQty > 100 AND si.IssueDate > {TS} - INTERVAL 4 DAY
  AND {ci('si.IssueType')} = 'write_off' AND CAST(si.IssueDate AS DATE) BETWEEN DATE '2000-06-28' AND {D0}
"""

# ---------------------------------------------------------------- productivity
_NOT_READY = "('to be reviewed', 'in dev', 'engineering hold', 'npi', 'caution', 'dormant')"


def _print_queue(status_cond: str, part_cond: str) -> str:
    return f"""
SELECT concat(w.WONo, ' (', w.WOSchedStartDate, ') : ', w.WOPartNo) AS label,
       {due('w.WOSchedStartDate')} AS value, CAST(7 AS BIGINT) AS target, CAST(0 AS BIGINT) AS target_start
FROM worksOrder w JOIN AllItems i ON w.WOPartNo = i.PartNo LEFT JOIN PV601 p ON w.WONo = p.WorksOrder
GROUP BY w.WOSchedStartDate, i.StatusDescription, w.WOQtyOS, w.WOStatusDescription, p.PrintedBy, w.WOPartNo,
         w.WOEarliestStartDate, w.WONo
HAVING w.WOSchedStartDate >= {TS} - INTERVAL 360 DAY AND w.WOSchedStartDate <= {TS} + INTERVAL 28 DAY
   AND {status_cond} AND w.WOQtyOS > 0 AND {ci('w.WOStatusDescription')} IN ('wip', 'created')
   AND p.PrintedBy IS NULL AND {part_cond} AND w.WOEarliestStartDate <> DATE '2012-12-12'
"""


def _not_like_all(col: str, pats: list[str]) -> str:
    return " AND ".join(f"NOT (rtrim({col}) ILIKE '{p}')" for p in pats)


BODIES["kpi_P1"] = _print_queue(
    f"{ci('i.StatusDescription')} IN {_NOT_READY}",
    _not_like_all("w.WOPartNo", ["SMT ATTRITION", "%REPAIR", "%RETURN"]))
BODIES["kpi_P2"] = _print_queue(
    f"{ci('i.StatusDescription')} NOT IN {_NOT_READY}",
    _not_like_all("w.WOPartNo", ["%FAI%", "CONSUMABLE ISSUES", "MONTHLY-LOST-STOCK-WRITE-OFF",
                                 "PHOENIX-DELTA-FAIR-SUB", "%DELTA FAIR%", "%PHOENIX FAIR%", "SMT ATTRITION",
                                 "%RETURN", "%REPAIR"]))

BODIES["kpi_P3a"] = f"""
SELECT AssignedName AS label, COUNT(concat(ContractReviewNo, ' ', ContRevDetailTaskNo)) AS value
FROM AllCR WHERE {ci('CRStatusDescription')} = 'open' AND ContRevDetailTargetDate < {TS}
GROUP BY AssignedName
"""

BODIES["kpi_P3b"] = f"""
SELECT left(concat(ContractReviewNo, '/', ContRevDetailTaskNo, ' - ', AssignedName, ' # ', ContRevDetailTask), 50)
         AS label, {due('ContRevDetailTargetDate')} AS value
FROM AllCR
GROUP BY ContractReviewNo, ContRevDetailTaskNo, AssignedName, ContRevDetailTask, ContRevDetailTargetDate,
         CRStatusDescription, ContractReviewDate
HAVING (rtrim(ContRevDetailTask) ILIKE '%LONG LEAD%' OR rtrim(ContRevDetailTask) ILIKE '%BOM%'
        OR rtrim(ContRevDetailTask) ILIKE '%WORK ORDER%') AND {ci('CRStatusDescription')} = 'open'
"""

BODIES["kpi_P4"] = f"""
SELECT label, value, target_start, target FROM (
  SELECT concat(RFC, ' (', Actionee, ') - ', Document) AS label, {age('DateRaised')} AS value,
         CAST(0 AS BIGINT) AS target_start, CAST(90 AS BIGINT) AS target
  FROM PV547_RFC
  GROUP BY RFC, Actionee, Document, DateRaised, Status, Customer
  HAVING {age('DateRaised')} >= 45 AND ({ci('Status')} = 'open' OR Status IS NULL) AND Customer IS NOT NULL)
ORDER BY value DESC NULLS LAST, label ASC NULLS FIRST LIMIT 20
"""

BODIES["kpi_P5"] = f"""
SELECT DISTINCT concat(q.EnquiryNo, ' ', q.EnqCustID, ' (S-)', f.Name) AS label, {due('q.EnqDecisionDate')} AS value
FROM AllEnq q
LEFT JOIN employees es ON q.EnqEstimator = es.BadgeNo
LEFT JOIN employees f ON q.EnqFollowUpBy = f.BadgeNo
LEFT JOIN employees sr ON q.EnqSalesRep = sr.BadgeNo
WHERE {due('q.EnqDecisionDate')} <= 7 AND q.EnqDecisionDate >= DATE '1996-01-01'
  AND {ci('q.EnqStatus')} = '#submitted'
"""

BODIES["kpi_P6"] = f"""
SELECT label, value, target_start, target FROM (
  SELECT DISTINCT concat(po.PONum, ' / ', e.Name, ' / ', left(po.POSuppAddressName, 15)) AS label,
         {age('po.POSentDate')} AS value, CAST(0 AS BIGINT) AS target_start, CAST(7 AS BIGINT) AS target
  FROM AllLivePO po JOIN employees e ON po.POBuyer = e.BadgeNo
  WHERE po.PODetDatePromised NOT IN {dates('2081-01-04', '2081-12-25')} AND po.POSubmitted = 1
    AND po.POConfirmation = 0 AND po.POSentDate IS NOT NULL)
ORDER BY value DESC NULLS LAST, label ASC NULLS FIRST LIMIT 20
"""

BODIES["kpi_P9"] = f"""
WITH o AS (SELECT DISTINCT Log, Buyer, Progress_Part, Date_Added, LTB_DATE FROM PV718_ObLog WHERE Complete IS NULL)
SELECT label, value, target_start, target FROM (
  SELECT concat(Log, ' / ', Buyer, ' / ', left(Progress_Part, 15)) AS label, {age('Date_Added')} AS value,
         CAST(0 AS BIGINT) AS target_start, {due('LTB_DATE')} AS target
  FROM o)
ORDER BY value DESC NULLS LAST, label ASC NULLS FIRST, target_start ASC NULLS FIRST, target ASC NULLS FIRST
LIMIT 25
"""

BODIES["kpi_P10"] = f"""
SELECT concat(CPP, ' ', Customer, ' (', COALESCE(Status, ''), ')') AS label, {age('DateRaised')} AS value,
       {due('RequiredDate')} AS secondary_value,
       CASE WHEN upper(COALESCE(Status, '')) LIKE '%PENDING%' THEN 'p10-pending' ELSE 'p10-days-open' END
         AS class_name
FROM CPP_Log
WHERE DateRaised IS NOT NULL AND (Status IS NULL OR (
      NOT (rtrim(Status) ILIKE '%APPROVED%') AND NOT (rtrim(Status) ILIKE '%REJECTED%')
  AND NOT (rtrim(Status) ILIKE '%CANCELLED%') AND NOT (rtrim(Status) ILIKE '%NOT REQ%')
  AND NOT (rtrim(Status) ILIKE '%EXPIRED%')))
"""

BODIES["kpi_P11"] = f"""
WITH d AS (
  SELECT concat(DocNo, ' ', Type, ' ', PartNo, ' (', Who, ')') AS label, {age('DateCreated')} AS value
  FROM PV760_DFM WHERE DateCreated IS NOT NULL AND DateComplete IS NULL
  GROUP BY DocNo, Type, PartNo, Who, DateCreated, Customer, DateComplete)
SELECT label, value FROM d WHERE value > 30
"""


def _p12(pattern: str) -> str:
    return f"""
SELECT concat(t.Training_Course, ' (', t.Name, ')') AS label, {age('t.Course_Date')} AS value
FROM AllTraining t JOIN employees e ON t.BadgeNo_IDFK = e.BadgeNo
WHERE rtrim(t.Areas_of_Experience) ILIKE '{pattern}' AND t.Result = 1 AND e.EmployeeStatusID <> 15
  AND {age('t.Course_Date')} > 180
GROUP BY t.Training_Course, t.Name, t.Course_Date, t.Areas_of_Experience, t.Result, e.EmployeeStatusID
"""


BODIES["kpi_P12"] = _p12("%")
BODIES["kpi_P12_AUTOMOBILE"] = _p12("AUTOMOBILE")

BODIES["kpi_p13_coshh"] = f"""
SELECT CAST(PartNo AS VARCHAR) AS label, {age('TRY_CAST(coshh_DATE AS DATE)')} - 700 AS value
FROM AllItems
WHERE TRY_CAST(coshh_DATE AS DATE) < {D0} - INTERVAL 700 DAY AND {ci('StatusDescription')} <> 'obsolete'
"""

# ---------------------------------------------------------------- tables
BODIES["table_I3"] = f"""
SELECT left(concat(strftime(si.IssueDate, '%d/%m/%Y'), ' - ', si.IssueQty, ' x ', si.IssuePartNo, ' : ',
                   i.PartDescription), 50) AS Details,
       si.IssueNotes AS IssueNotes, concat('£', ROUND(si.IssueUnitCost * si.IssueQty, 2)) AS Value
FROM StockIssue si LEFT JOIN AllItems i ON si.IssuePartNo = i.PartNo
WHERE si.IssueUnitCost * si.IssueQty > 100 AND si.IssueDate > {TS} - INTERVAL 4 DAY
  AND {ci('si.IssueType')} = 'write_off'
"""

BODIES["table_D10"] = "SELECT PartNo, PartDesc, Cust, UsedIn FROM PV755"

_D11 = """
SELECT PartNo, PartDescription, PartDefLocation,
       PartStockActive - DemandSO - DemandWO + PartStockOnOrderPO + PartStockOnOrderWO AS FinalStockBalance
FROM AllItems
WHERE PartStockActive - DemandSO - DemandWO + PartStockOnOrderPO + PartStockOnOrderWO < 0
  AND PartMainlyPurchased = 1
"""
BODIES["table_D11"] = _D11
BODIES["export_D11"] = _D11

BODIES["table_I15"] = """
SELECT left(TransTime, 10) AS "When", TransObjectType, TransObjectID, TransUser, TransMemo FROM TransAltEdit
"""

BODIES["table_P8"] = f"""
SELECT concat(DocNumber, ' - ', DocName) AS What, DocOwner AS Who, CAST(DocNextReview AS VARCHAR) AS "When"
FROM AllProcedures
WHERE DocNextReview < {TS} + INTERVAL 30 DAY AND {ci('Status')} = 'published'
"""

# ---------------------------------------------------------------- exports
BODIES["export_D1d"] = f"""
SELECT po.PONum, po.PODetItemNum, po.POSuppAddressName, e.Name, {age('po.PODetDatePromised')} AS DaysLate
FROM AllLivePO po JOIN employees e ON po.POBuyer = e.BadgeNo
WHERE {age('po.PODetDatePromised')} > 0 AND po.PODetDatePromised > DATE '1996-01-01'
  AND po.PODetDateLatest IN {dates('2008-08-08', '2009-09-09', '2010-10-10')}
"""

BODIES["export_I12"] = f"""
WITH e AS ({_I12})
SELECT GRNNo, GRNPartNo, PartDescription, GRNQtyLeft, PartLeadTime, DaysTillExpiry,
       CAST(GRNExpiryDate AS VARCHAR) AS GRNExpiryDate, PartGroupCode, GRNLocation, Demand, PartStockActive
FROM e
"""

_D9X = ("('%01/01/2001%', '%31/12/2018%', '%25/12/2081%', '%01/01/2111%', '%04/01/2081%', "
        "'%10/10/2010%', '%09/09/2009%', '%08/08/2008%', '%02/02/2002%')")
BODIES["export_D9"] = f"""
WITH g AS (
  SELECT po.PONum, po.PODetItemNum, po.PODetDatePromised, po.PODetQtyReq, po.PODetQtyRec, e.Name,
         po.PODetPart, po.POSuppAddressName, o.RECEIVED, po.PODetDateLatest
  FROM AllLivePO po
  JOIN AllItems i ON po.PODetPart = i.PartNo
  JOIN employees e ON po.POBuyer = e.BadgeNo
  JOIN OOB_TRACKER_RECEIVED o ON {ci('po.POSuppAddressName')} = {ci('o.SuppName')}
  GROUP BY po.PONum, po.PODetItemNum, po.PODetDatePromised, po.PODetQtyReq, po.PODetQtyRec, e.Name,
           po.PODetPart, po.POSuppAddressName, o.RECEIVED, po.PODetDateLatest
  HAVING po.PODetDatePromised < {TS} + INTERVAL 14 DAY AND floor(po.PODetQtyReq) - floor(po.PODetQtyRec) > 0
     AND {ci('o.RECEIVED')} = 'n'
     AND NOT list_has_any(
           [strftime(po.PODetDatePromised, '%d/%m/%Y'), strftime(po.PODetDateLatest, '%d/%m/%Y')],
           ['01/01/2001', '31/12/2018', '25/12/2081', '01/01/2111', '04/01/2081', '10/10/2010', '09/09/2009',
            '08/08/2008', '02/02/2002']))
SELECT PONum, PODetItemNum, {due('PODetDatePromised')} AS DaysDue, CAST(PODetDatePromised AS VARCHAR) AS PODetDatePromised,
       PODetQtyReq - PODetQtyRec AS QtyRemain, Name, PODetPart, POSuppAddressName, RECEIVED
FROM g
"""

BODIES["export_I15"] = """
SELECT TransID, left(TransTime, 10) AS DateTime, TransObjectType, TransObjectID, TransUser, TransMemo
FROM TransAltEdit
"""

BODIES["export_D8"] = f"""
WITH m AS (SELECT PODetPart AS POPartNo, MAX(PODetUnitPrice) AS MaxPrice FROM AllLivePO GROUP BY PODetPart)
SELECT po.PODetPart, e.Name, {_EXCESS_COST} AS ExcessCost, {_EXCESS_QTY} AS ExcessQty, i.PartStockActive,
       i.DemandWO, i.DemandSO, i.PartUOMUOPConv, po.PONum
FROM AllLivePO po
JOIN AllItems i ON po.PODetPart = i.PartNo
JOIN employees e ON po.POBuyer = e.BadgeNo
JOIN m ON po.PODetPart = m.POPartNo
WHERE i.PartMinStockLev = 0
GROUP BY po.PODetPart, e.Name, {_EXCESS_COST}, {_EXCESS_QTY}, i.PartStockActive, i.DemandWO, i.DemandSO,
         i.PartUOMUOPConv, po.PONum
HAVING {_EXCESS_COST} > 20 AND {_EXCESS_QTY} > 0
   AND MIN(po.PODetDatePromised) NOT IN {dates('2001-01-01', '2081-04-01', '2002-01-01')}
"""

BODIES["export_P6"] = """
SELECT PONum, POSuppAddressName, Name, CAST(POSentDate AS VARCHAR) AS POSentDate,
       CAST(POOrderDate AS VARCHAR) AS POOrderDate
FROM (
  SELECT po.PONum, po.POSuppAddressName, e.Name, po.POSentDate, po.POOrderDate
  FROM AllLivePO po JOIN employees e ON po.POBuyer = e.BadgeNo
  WHERE po.PODetDatePromised <> DATE '2081-04-01'
  GROUP BY po.PONum, po.POSuppAddressName, e.Name, po.POSentDate, po.POOrderDate, po.POConfirmation,
           po.POSubmitted
  HAVING po.POConfirmation = 0 AND po.POSubmitted = 1)
"""

BODIES["export_Q7"] = f"""
SELECT a.NCR, a.Type, {due('a.Target')} AS DaysDue, e.Name
FROM AllOpenNCRActions a JOIN employees e ON a.Who = e.BadgeNo
"""

BODIES["export_P3a"] = f"""
SELECT c.ContractReviewNo, c.ContRevDetailTaskNo, c.ContRevDetailTask, c.AssignedName,
       {due('c.ContRevDetailTargetDate')} AS DaysTillDue, c.ContRevDetailLeadTime
FROM AllCR c JOIN employees e ON {ci('c.AssignedName')} = {ci('e.Name')}
GROUP BY c.ContractReviewNo, c.ContRevDetailTaskNo, c.ContRevDetailTask, c.AssignedName, c.ContRevDetailTargetDate,
         c.CRStatusDescription, c.ContractReviewDate, c.ContRevDetailLeadTime
HAVING {due('c.ContRevDetailTargetDate')} < 0 AND {ci('c.CRStatusDescription')} = 'open'
"""

BODIES["export_D4"] = f"""
WITH r AS ({_D4})
SELECT PONum, PODetItemNum, CAST(PoValue AS DOUBLE) AS PoValue, Name AS Buyer, POSuppAddressName,
       {due('FirstReq')} AS DaysTillReq
FROM r
"""

BODIES["export_D7"] = f"""
SELECT concat(po.PONum, ' # ', po.POSuppAddressName) AS Details, po.PODetItemNum, {age('po.POOrderDate')} AS Days,
       CAST(7 AS BIGINT) AS Target, e.Name
FROM AllLivePO po LEFT JOIN employees e ON po.POBuyer = e.BadgeNo
WHERE po.PODetDatePromised <> DATE '2081-04-01'
GROUP BY po.PONum, po.POSuppAddressName, po.PODetItemNum, po.POOrderDate, e.Name, po.POSubmitted
HAVING po.POSubmitted = 0
"""

BODIES["export_D1b"] = f"""
SELECT po.PONum AS PO, po.PODetItemNum, po.PODetPart, po.PODetPartDescr, po.POSuppAddressName, e.Name AS Buyer,
       {due('po.PODetDateReq')} AS DaysTillReq, CAST(po.PODetDatePromised AS VARCHAR) AS PODetDatePromised,
       CAST(po.PODetDateLatest AS VARCHAR) AS PODetDateLatest
FROM AllLivePO po JOIN employees e ON po.POBuyer = e.BadgeNo
WHERE po.PODetDatePromised = DATE '2081-12-25' OR po.PODetDateLatest = DATE '2081-12-25'
"""

BODIES["export_D2"] = f"""
WITH q AS (SELECT PO, COALESCE(TRY_CAST(PO_Line AS BIGINT), 0) AS POline, DateRaised, DateReleased
           FROM PV658 WHERE PO IS NOT NULL)
SELECT q.PO, q.POline, b.FirstOfBuyer AS Buyer, po.POSuppAddressName, CAST(q.DateRaised AS VARCHAR) AS DateRaised,
       {age('MAX(q.DateRaised)')} AS DaysInQuery, CAST(q.DateReleased AS VARCHAR) AS DateReleased,
       CAST(po.PODetDatePromised AS VARCHAR) AS PODetDatePromised
FROM AllLivePO po
RIGHT JOIN q ON po.PODetItemNum = q.POline AND po.PONum = q.PO
LEFT JOIN PV658_BuyerEngineer b ON po.PONum = b.PO
GROUP BY q.PO, q.POline, b.FirstOfBuyer, po.POSuppAddressName, q.DateRaised, q.DateReleased, po.PODetDatePromised
HAVING q.DateRaised > DATE '1999-07-31' AND q.DateReleased IS NULL
"""

BODIES["export_D3b"] = f"""
WITH d AS ({_DEMAND})
SELECT PONum AS PO, PODetItemNum, PartNo, Name AS Buyer, CAST(POValue AS DOUBLE) AS Value,
       CAST(PODetDatePromised AS VARCHAR) AS PODetDatePromised, DemandType AS DemandWOSO,
       CAST(RequiredDate AS VARCHAR) AS DemandDate, {due('PODetDatePromised')} AS DaysTillDue,
       {due('RequiredDate')} AS DaysTillRequired, strftime(PODetDatePromised, '%Y %m') AS POMonth,
       strftime(RequiredDate, '%Y %m') AS WOSOMonth, POSuppAddressName
FROM d
WHERE RequiredDate > PODetDatePromised AND {due('RequiredDate')} >= 28
  AND strftime(RequiredDate, '%Y %m') <> strftime(PODetDatePromised, '%Y %m') AND Demand > 0
"""

# ---------------------------------------------------------------- filter lists
BODIES["filter_grn_location"] = """
SELECT DISTINCT CAST(GRNLocation AS VARCHAR) AS value, CAST(GRNLocation AS VARCHAR) AS label
FROM AllLiveGRN
WHERE GRNLocation IS NOT NULL AND trim(GRNLocation) <> '' AND rtrim(GRNLocation) ILIKE 'MRB%'
"""

BODIES["filter_p12_training"] = f"""
SELECT DISTINCT trim(CAST(t.Areas_of_Experience AS VARCHAR)) AS value,
       trim(CAST(t.Areas_of_Experience AS VARCHAR)) AS label
FROM AllTraining t JOIN employees e ON t.BadgeNo_IDFK = e.BadgeNo
WHERE t.Areas_of_Experience IS NOT NULL AND trim(CAST(t.Areas_of_Experience AS VARCHAR)) <> ''
  AND t.Result = 1 AND e.EmployeeStatusID <> 15 AND {age('t.Course_Date')} > 180
"""

# ---------------------------------------------------------------- assembly
_REL_NAMES = [r.name for r in RELATIONS]


def full_sql(body: str) -> str:
    """Prefix the relations a body mentions as CTEs over the driver views."""
    used = [n for n in _REL_NAMES if re.search(rf"\b{n}\b", body, flags=re.IGNORECASE)]
    return f"WITH {duckdb_ctes(used)}\nSELECT * FROM (\n{body.strip()}\n) AS oracle_result"


def oracle_queries() -> dict[str, str]:
    from opskpi.plans.operator_queries import OP_ORACLE

    out = {k: full_sql(v) for k, v in BODIES.items()}
    out.update({k: full_sql(make()) for k, make in OP_ORACLE.items()})
    return out
