"""opskpi — operational KPIs (safety, quality, deliverables, inventory,
productivity) expressed as lazy Spark DataFrame plans.

Layout
------
sources/    where relations come from (Parquet, JDBC, in-memory, driver adapters)
functions/  Column-level helpers: the as-of clock, text folding, sentinel dates
operators/  reusable DataFrame operators (dedupe, tie-broken top-N, anti-joins,
            payload shaping, distributed ranking)
plans/      the KPI catalogue: every chart, table, export and filter list, the
            department matrix and the snapshot job
streaming/  incremental refresh of the snapshot with Structured Streaming
"""

from opskpi.functions.clock import AsOf
from opskpi.sources.tables import Tables

__all__ = ["AsOf", "Tables"]
