"""Relations written the way the KPIs read them.

``write_layout`` stores relations under one root: lot tables bucketed by the
lot number (the per-lot aggregate of the transfers and its joins to the lots
then need no shuffle), logs partitioned by day (a time window then reads only
its days), long tables sorted by the date that most KPIs filter on (row-group
statistics then skip most of the table).  ``laid_out`` reads them back as a
``Tables``.

Every write goes to a new folder; the list ``layout`` under the root names the
current folder of each relation and is published last, so a write that dies
leaves the old relations in use.  ``sweep`` removes folders that no list names.

Bucketed joins on the lot alone also serve keys of lot and line where the
session has ``spark.sql.requireAllClusterKeysForCoPartition`` off
(``build_session`` sets it).

Defined cases: a relation without rows keeps its columns; rows without a date
stand in a partition of their own; rows without a lot share a bucket.
* A bucket is one task's work, so a relation with a lot that holds more than
  ``HOT`` times a bucket's fair share is stored unbucketed (its joins are
  shuffled, and AQE splits them).
* A log whose times are not whole days is sorted by time instead of
  partitioned: a partition per second would be a file per row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opskpi.plans.publish import publish
from opskpi.sources.tables import Tables

C = F.col
HOT = 2
LIST = "layout"


@dataclass(frozen=True)
class Layout:
    bucket: tuple[str, ...] = ()
    day: str | None = None          # partition column
    sort: tuple[str, ...] = ()


LAYOUTS: Mapping[str, Layout] = {
    "AllLiveGRN": Layout(bucket=("GRNNo",)),
    "AllGRN_Transfer": Layout(bucket=("TransferGRNNo",)),
    "AllLostStock": Layout(bucket=("GRNNo",)),
    "StockIssue": Layout(day="IssueDate"),
    "Accident": Layout(day="Date"),
    "PV658": Layout(day="DateRaised"),
    "AllLivePO": Layout(sort=("PODetDatePromised",)),
}


def _fits(df: DataFrame, keys: tuple[str, ...], buckets: int) -> bool:
    """Whether no key has more than ``HOT`` times the rows of an even bucket (one row reaches the driver)."""
    most, rows = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return rows is None or most <= max(HOT * rows / buckets, 1024)


def _whole_days(df: DataFrame, day: str) -> bool:
    kind = df.schema[day].dataType.simpleString()
    return kind == "date" or df.where(C(day).cast("date").cast(kind) != C(day)).limit(1).isEmpty()


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Range-partitioned by the columns and, within equal ones, by the row, so that no value must fit one task."""
    return df.repartitionByRange(*by, F.xxhash64(*(f"`{c}`" for c in df.columns))).sortWithinPartitions(*by)


def write_layout(spark: SparkSession, t: Tables, root: str, buckets: int, layouts: Mapping[str, Layout] = LAYOUTS,
                 names: tuple[str, ...] = ()) -> dict[str, dict]:
    """Stores the relations ``names`` (all of ``t`` if none); relations without a layout as they are.

    Returns what is now in use: relation -> folder, columns and layout.  Relations stored before and not named stay.
    """
    root = root.rstrip("/")
    now = current(spark, root)
    for name in names or t.names():
        df, layout = t[name], layouts.get(name, Layout())
        folder = f"{root}/{name}/{uuid.uuid4().hex}"
        entry = {"folder": folder, "schema": df.schema.jsonValue(), "bucket": [], "buckets": 0, "day": None}
        if layout.bucket and _fits(df, layout.bucket, buckets):
            entry |= {"bucket": list(layout.bucket), "buckets": buckets}
            keys = list(layout.bucket)
            table = _table(entry)
            try:
                (df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
                 .option("path", folder).saveAsTable(table))
            finally:
                spark.sql(f"DROP TABLE IF EXISTS {table}")  # an external table: its files stay
        elif layout.day and _whole_days(df, layout.day):
            entry["day"] = layout.day
            _spread(df, layout.day).write.partitionBy(layout.day).parquet(folder)
        else:
            by = layout.sort or ((layout.day,) if layout.day else ())
            (_spread(df, *by) if by else df).write.parquet(folder)
        now[name] = entry
    publish(spark, f"{root}/{LIST}", lambda at: spark.createDataFrame([(json.dumps(now),)], "value string").write.text(at))
    return now


def current(spark: SparkSession, root: str) -> dict[str, dict]:
    """The list of relations in use under the root; empty where nothing was stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{LIST}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    return json.loads(spark.read.text(path.toString()).first()["value"])


def _table(entry: Mapping) -> str:
    return "layout_" + entry["folder"].rsplit("/", 1)[-1]


def _load(spark: SparkSession, entry: Mapping) -> DataFrame:
    schema = StructType.fromJson(entry["schema"])
    if not entry["bucket"]:
        stored = spark.read.schema(schema).parquet(entry["folder"])
        return stored.select(*(f"`{c}`" for c in schema.names))  # partition columns stand last in the files' schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    keys = ", ".join(f"`{k}`" for k in entry["bucket"])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_table(entry)} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
              f"INTO {entry['buckets']} BUCKETS LOCATION '{entry['folder']}'")
    return spark.table(_table(entry))


def laid_out(spark: SparkSession, root: str) -> Tables:
    """The relations in use under the root.  Bucketed ones are registered in the session's catalogue by their folder's name."""
    return Tables({n: (lambda e=e: _load(spark, e)) for n, e in current(spark, root).items()})


def sweep(spark: SparkSession, root: str) -> int:
    """Removes stored folders that are not in use any more; how many.  Call it when no job reads them."""
    root, gone = root.rstrip("/"), 0
    for name, entry in current(spark, root).items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(path):
            if status.getPath().getName() != entry["folder"].rsplit("/", 1)[-1]:
                fs.delete(status.getPath(), True)
                gone += 1
    return gone
