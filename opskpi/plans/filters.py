"""Filter-option lists: ``value, label`` string pairs offered to the user.

``grn_location`` and ``p12_training`` are read from the data.  ``q1_type``
and ``q7_type`` are fixed lists (an inline VALUES source); they read no table
and are therefore exposed as plain functions rather than registered queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opskpi.functions.clock import AsOf
from opskpi.functions.text import text_like
from opskpi.plans.metric import table
from opskpi.sources.tables import Tables

C = F.col

# --- fixed values: the two constant option lists (value, label) -----------
Q1_TYPE_OPTIONS = (("RETURN", "RETURN"), ("REPAIR", "REPAIR"))
Q7_TYPE_OPTIONS = (("Corrective", "Corrective"), ("prevent", "preventative"), ("Follow", "Follow Up"))


@table("grn_location", "MRB stock locations", ("value", "label"), (("label", "asc"),), kind="filter",
       note="narrower than Q2's default 'MR%'")
def grn_location(t: Tables, clock: AsOf) -> DataFrame:
    grn = t["AllLiveGRN"]
    loc = C("GRNLocation")
    rows = grn.where(loc.isNotNull() & (F.trim(loc) != "") & text_like(loc, "MRB%"))
    return rows.select(loc.cast("string").alias("value"), loc.cast("string").alias("label")).distinct()


@table("p12_training", "Training areas", ("value", "label"), (("label", "asc"),), kind="filter",
       note="areas with at least one row that qualifies for P12; trimmed here while P12 matches the raw text")
def p12_training(t: Tables, clock: AsOf) -> DataFrame:
    tr = t["AllTraining"]
    area = C("Areas_of_Experience")
    tr = tr.where(area.isNotNull() & (F.trim(area.cast("string")) != "") & (C("Result") == 1)
                  & clock.age_gt(C("Course_Date"), 180))
    emp = t["employees"].where(C("EmployeeStatusID") != 15).select("BadgeNo")
    j = tr.join(emp, tr["BadgeNo_IDFK"] == emp["BadgeNo"], "left_semi")
    trimmed = F.trim(area.cast("string"))
    return j.select(trimmed.alias("value"), trimmed.alias("label")).distinct()


def constant_options(spark: SparkSession, options: tuple[tuple[str, str], ...]) -> DataFrame:
    return spark.createDataFrame(list(options), "value string, label string")


def q1_type(spark: SparkSession) -> DataFrame:
    return constant_options(spark, Q1_TYPE_OPTIONS)


def q7_type(spark: SparkSession) -> DataFrame:
    return constant_options(spark, Q7_TYPE_OPTIONS)
