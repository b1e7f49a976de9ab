"""Consecutive row ranks over a global sort without a single-task window.

``row_number().over(Window.partitionBy(metric).orderBy(...))`` would pull a
whole metric into one task.  Instead:

1. optionally checkpoint the input to the shared checkpoint folder, so an
   expensive input plan runs once (the range sort reads its input twice:
   once to sample bounds, once to sort);
2. sort globally (range partitioning, every task sorts its own range; the
   input position is the last key, so even a hot group of identical rows is
   split across ranges) and
   tag rows with ``monotonically_increasing_id`` — within a sorted partition
   ids are consecutive and ordered, the partition index sits in the high bits;
3. checkpoint the tagged rows, so the sort runs once and the ids are fixed;
4. count rows per (group, partition) — at most #partitions + #groups rows —
   turn the counts into offsets and join them back on (group, partition).

The checkpoint files of finished ranks are removed by Spark's context cleaner
(``spark.cleaner.referenceTracking.cleanCheckpoints``, set by the session
builder).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opskpi.session import ensure_checkpoint_dir


def ranked(df: DataFrame, group: str, order: Sequence[Column], rank_col: str = "row_rank",
           checkpoint_input: bool = True, sort_only: Sequence[str] = ()) -> DataFrame:
    """``df`` with the place of each row in its group.

    A sort evaluates its expressions in every comparison, so costly ones should
    be columns of ``df`` that ``order`` names; ``sort_only`` names those that
    the result leaves out.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if checkpoint_input:
        df = df.checkpoint(eager=True)
    # last sort key: the row's position in the (checkpointed) input, so rows
    # that tie on every key can still be split across range partitions
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    tagged = (df.orderBy(F.col(group).asc_nulls_first(), *order, F.col("_tie"))
              .drop("_tie", *sort_only)
              .withColumn("_rid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    part = F.shiftright(F.col("_rid"), 33)
    stats = (tagged.groupBy(F.col(group).alias("_g"), part.alias("_p"))
             .agg(F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    joined = tagged.join(
        offsets,
        (F.col(group).eqNullSafe(F.col("_g"))) & (part == F.col("_p")),
        "inner",
    )
    return joined.withColumn(
        rank_col, (F.col("_before") + F.col("_rid") - F.col("_first") + 1).cast("bigint")
    ).drop("_g", "_p", "_first", "_n", "_before", "_rid")
