"""Registered queries on the driver tables: key -> (spark, sf_dir) -> DataFrame.

Keys: ``kpi_<id>`` charts, ``table_<id>``, ``export_<id>``, ``filter_<id>``;
parameterised metrics get one key per branch (``kpi_Q1_RETURN`` ...), and
``op_*`` keys run the generic operators on relations derived from the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from opskpi.functions.clock import AsOf
from opskpi.plans.metric import Metric, all_metrics
from opskpi.sources.driver import driver_tables

# --- fixed values: evaluation time and cut-offs for the driver data --------
AS_OF = AsOf.parse("2000-06-30 00:00:00")
DRIVER_PARAMS = {
    "promised_after": date(1996, 1, 1),
    "enquiry_from": date(1996, 1, 1),
    "raised_after": date(1999, 7, 31),
}

# parameter branches registered as their own keys: key suffix -> request args
BRANCHES: dict[str, dict[str, dict[str, str]]] = {
    "kpi_Q1": {"RETURN": {"type": "RETURN"}, "REPAIR": {"type": "REPAIR"}},
    "kpi_Q2_grn": {"REWORK": {"location": "REWORK"}},
    "kpi_Q7": {"Corrective": {"type": "Corrective"}, "prevent": {"type": "prevent"}},
    "kpi_P12": {"AUTOMOBILE": {"area": "AUTOMOBILE"}},
    # reporting windows of the logs
    "kpi_S1": {"window": {"start": "1999-10-15", "end": "2000-01-31"}},
    "kpi_Q9": {"window": {"start": "1997-03-01", "end": "1998-02-28"}},
    "kpi_D2": {"window": {"start": "1999-09-01", "end": "1999-12-31"}},
    "table_I3": {"window": {"start": "2000-06-28"}},   # to the as-of day
}


def _runner(metric: Metric, args: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        params = dict(DRIVER_PARAMS)
        if args:
            params.update(metric.from_args(args, AS_OF))
        return metric.frame(driver_tables(spark, sf_dir), AS_OF, **params)
    return run


def metric_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for key, metric in sorted(all_metrics().items()):
        out[key] = _runner(metric)
        for suffix, args in BRANCHES.get(key, {}).items():
            out[f"{key}_{suffix}"] = _runner(metric, args)
    return out
