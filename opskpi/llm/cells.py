"""Groups dealt out as square cells, so that a group of any size is compared in bounded tasks.

A group of ``n`` members has ``k = ceil(n / size)`` blocks (by a hash of the
member); cell ``(x, y)`` compares block ``x`` with block ``y``.  Each pair of
members meets in exactly one cell and no cell holds more than two blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def with_cells(members: DataFrame, sizes: DataFrame, size: int, group: str = "comp",
               member: str = "node") -> DataFrame:
    """Adds ``blocks`` (of the group), ``blk`` (of the member), ``cx`` and ``cy``; one row per cell.

    ``sizes(group, n)`` has the group sizes.  Call it after the payload is
    joined on, so that copies of a row are only made right before the shuffle.
    """
    k = F.ceil(C("n") / F.lit(size)).cast("int")
    return (members.join(sizes, group)
            .withColumn("blocks", k)
            .withColumn("blk", F.pmod(F.xxhash64(member), C("blocks").cast("long")).cast("int"))
            .withColumn("_x", F.explode(F.sequence(F.lit(0), C("blocks") - 1)))
            .withColumn("cx", F.least("blk", "_x")).withColumn("cy", F.greatest("blk", "_x"))
            .drop("_x", "n"))


def by_cell(rows: DataFrame, group: str = "comp", extra: tuple[str, ...] = ()) -> DataFrame:
    """Shuffles cells to tasks, many small ones to each, sorted so that ``key_runs`` can read them."""
    keys = [group, "cx", "cy"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *extra)
