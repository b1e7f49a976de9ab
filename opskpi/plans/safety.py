"""Safety page: accidents per month and days since the last accident."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.functions.clock import AsOf
from opskpi.functions.text import label
from opskpi.plans.metric import chart
from opskpi.sources.tables import Tables

PAGE = "safety"
C = F.col


@chart("S1", "Accidents Per Month (Last 12 Months)", ("label", "value"), (("_month", "asc"),), PAGE,
       x_label="Year / Month", formatter="integer", window_on=("Accident", "Date"),
       meta={"orientation": "vertical", "valueKey": "y", "labelKey": "x", "yLabel": "Number of Accidents"},
       note="vertical chart: the month is the label, the count (non-NULL descriptions) the value")
def s1(t: Tables, clock: AsOf) -> DataFrame:
    acc = t["Accident"].where(C("Date") > clock.now_plus(-365))
    month = F.date_format(C("Date"), "yy/MM")
    g = acc.groupBy(month.alias("_month")).agg(F.count("Accident_Description").alias("value"))
    return g.select(label(" ", C("_month"), " ").alias("label"), C("value"), C("_month"))


@chart("S1_days_since_accident", "Days Since Last Accident", ("label", "value"), (), PAGE,
       x_label="Days", formatter="integer",
       note="global aggregate: exactly one row, value NULL when there are no accidents")
def s1_days(t: Tables, clock: AsOf) -> DataFrame:
    last = t["Accident"].agg(F.max("Date").alias("_last"))
    return last.select(F.lit("Days Since Last Accident").alias("label"), clock.age(C("_last")).alias("value"))
