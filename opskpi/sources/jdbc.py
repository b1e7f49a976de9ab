"""ERP relations through Spark's JDBC source, described by a user-supplied file.

The file (JSON) holds what only the user knows - where the database is, what
its tables and columns are called and how to cut a large table into ranges:

    {
      "options": {"url": "jdbc:...", "driver": "...", "user": "...", "password": "..."},
      "relations": {
        "AllLivePO": {
          "table": "erp.po_lines",
          "columns": {"PODetPart": "part_number"},
          "partition": {"column": "PONum", "lower": 1, "upper": 90000000, "parts": 200},
          "options": {"sessionInitStatement": "SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED"}
        }
      }
    }

``options`` are Spark's own JDBC options; those of a relation win over the
common ones.  ``columns`` maps a relation's column to the source's (others
keep their names).  Relations in ``FACTS`` grow without bound and must say how
they are partitioned: one connection must not read them whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opskpi.sources.tables import Tables

#: Relations that are logs, ledgers or order lines.
FACTS = ("AllLivePO", "worksOrder", "worksOrderBOM", "AllLiveGRN", "AllGRN_Transfer", "AllSO", "AllWORec", "StockIssue",
         "AllLostStock", "AllCR", "AllEnq", "PV601", "PV658", "TransAltEdit")
FETCH_ROWS = 10_000


def load_mapping(spark: SparkSession, path: str) -> dict[str, Any]:
    """Reads the file through Spark, so it may lie wherever Spark can read."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return json.loads(text)


def reader_options(mapping: Mapping[str, Any], relation: str) -> dict[str, str]:
    """Options of ``spark.read.format('jdbc')`` for one relation."""
    entry = mapping.get("relations", {}).get(relation, {})
    out = {"fetchsize": str(FETCH_ROWS), **mapping.get("options", {}), **entry.get("options", {})}
    if "url" not in out:
        raise ValueError(f"{relation}: no url in the JDBC options file")
    if "dbtable" not in out and "query" not in out:
        out["dbtable"] = entry.get("table", relation)
    cut = entry.get("partition")
    if cut and "sample" in cut:
        if "query" in out:
            raise ValueError(f"{relation}: a sampled partition needs a table, not a query")
        return {k: str(v) for k, v in out.items()}
    if cut:
        out |= {"partitionColumn": cut["column"], "lowerBound": str(cut["lower"]), "upperBound": str(cut["upper"]),
                "numPartitions": str(cut["parts"])}
    if relation in FACTS and "partitionColumn" not in out:
        raise ValueError(f"{relation} is a growing relation: its entry needs a partition (column, parts and lower, upper or sample)")
    return {k: str(v) for k, v in out.items()}


def renames(mapping: Mapping[str, Any], relation: str) -> dict[str, str]:
    """Source column -> relation column."""
    named = mapping.get("relations", {}).get(relation, {}).get("columns", {})
    return {source: own for own, source in named.items()}


def balanced_cuts(sample: DataFrame, parts: int) -> list:
    """At most ``parts - 1`` increasing values that cut the sample's first column into ranges of about equal size.

    The quantiles come from a mergeable sketch, so the sample may be large;
    only the cuts reach the driver.  A value that holds more than a range's
    share is a cut once, so it is read by one range; an empty sample, or one
    of nulls, gives no cuts.
    """
    column = sample.columns[0]
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    kind = sample.schema[column].dataType.simpleString()
    value = F.col(f"`{column}`")
    if kind == "string":
        raise ValueError(f"{column}: text has no order that the source surely shares; partition by a number or date")
    cuts = sample.agg(F.percentile_approx(value, shares, max(10_000, 100 * parts))).first()[0]
    return sorted(set(cuts or []))


def _literal(value) -> str:
    if isinstance(value, (date, datetime)):
        return f"'{value.isoformat(sep=' ') if isinstance(value, datetime) else value.isoformat()}'"
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return str(value)
    raise ValueError(f"cannot cut by {value!r}")


def range_predicates(column: str, cuts: list) -> list[str]:
    """Conditions, one for each range between the cuts; each row, with a null too, fulfils exactly one."""
    if not cuts:
        return ["1 = 1"]
    ends = [_literal(c) for c in cuts]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(ends, ends[1:])]
    return [f"{column} < {ends[0]} OR {column} IS NULL", *inner, f"{column} >= {ends[-1]}"]


def sampled_predicates(mapping: Mapping[str, Any], relation: str, read: Callable[[dict[str, str]], DataFrame]) -> list[str]:
    """Balanced range conditions of a relation whose partition names a sample; ``read`` runs a query by its options."""
    cut = mapping["relations"][relation]["partition"]
    options = {k: v for k, v in reader_options(mapping, relation).items() if k != "dbtable"}
    return range_predicates(cut["column"], balanced_cuts(read({**options, "query": cut["sample"]}), int(cut["parts"])))


def jdbc_tables(spark: SparkSession, mapping: Mapping[str, Any], relations: Iterable[str]) -> Tables:
    """``Tables`` over JDBC for the named relations."""
    def read(options: dict[str, str]) -> DataFrame:
        return spark.read.format("jdbc").options(**options).load()

    def ranges(name: str, options: dict[str, str]) -> DataFrame:
        rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(options["url"], options["dbtable"], predicates=sampled_predicates(mapping, name, read),
                               properties=rest)

    def loader(name: str):
        options, columns = reader_options(mapping, name), renames(mapping, name)
        sampled = "sample" in mapping.get("relations", {}).get(name, {}).get("partition", {})
        return lambda: (ranges(name, options) if sampled else read(options)).withColumnsRenamed(columns)

    return Tables({n: loader(n) for n in relations})
