"""Snapshot refresh driven by a stream of refresh requests.

Drop a JSON line ``{"as_of": "2000-06-30 00:00:00"}`` into ``request_dir``
and the next micro-batch materialises every KPI for that time with the batch
job.  The stream's progress lives in the shared checkpoint folder, so a
restarted driver resumes without repeating or skipping requests; each
snapshot write overwrites its own ``as_of`` partition, so a replayed batch is
harmless.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from opskpi.functions.clock import AsOf
from opskpi.plans.snapshot import run_snapshot
from opskpi.session import ensure_checkpoint_dir
from opskpi.sources.tables import Tables

REQUEST_SCHEMA = "as_of string"


def start_refresh(spark: SparkSession, tables: Callable[[], Tables], out_dir: str, request_dir: str,
                  params: Mapping | None = None, available_now: bool = False,
                  name: str = "opskpi_refresh") -> StreamingQuery:
    requests = spark.readStream.schema(REQUEST_SCHEMA).json(request_dir)

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        # one request at a time; the rest of the batch stays with Spark
        for row in batch.where("as_of IS NOT NULL").select("as_of").distinct().toLocalIterator():
            run_snapshot(spark, tables(), AsOf.parse(row["as_of"]), out_dir, params)

    checkpoint = os.path.join(ensure_checkpoint_dir(spark), name)
    writer = (requests.writeStream.queryName(name).foreachBatch(run_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
