"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A staged table cuts the lineage like ``checkpoint()`` does, survives the loss
of any executor, and is compressed and column-pruned because it is Parquet.
The shuffles that made it are freed as soon as it is written: no later job
reads them, and an operator of many steps would else hold those of all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from opskpi.session import ensure_checkpoint_dir


#: Frees a query's shuffle files at its end, not when the driver's garbage is collected.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders begun inside each open ``scratch`` block.
_BLOCKS: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class scratch:
    """``with scratch(spark):`` - tables staged inside are removed at its end.

    For callers that write an operator's result inside the block; a result
    that is still to be read needs its tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        _BLOCKS.append([])

    def __exit__(self, *exc) -> None:
        for root in _BLOCKS.pop():
            _delete(self.spark, root)


class Staging:
    """Tables of one operator run; ``drop`` frees those that later steps no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        for block in _BLOCKS:
            block.append(self.root)

    def put(self, df: DataFrame, label: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        before = self.spark.conf.get(_FREE_SHUFFLES, None)
        self.spark.conf.set(_FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_FREE_SHUFFLES)
            else:
                self.spark.conf.set(_FREE_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            _delete(self.spark, f._staged_at)
