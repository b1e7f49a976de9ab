"""Inner joins whose output for one key is a product that no task should make alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Rows of either side that meet in one cell, on average; a cell makes some ``CELL ** 2`` rows.
CELL = 512


def _weighed(df: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Each different row once, with how often it is there; rows without a key have no partner."""
    return df.dropna(subset=list(keys)).groupBy(*(f"`{c}`" for c in df.columns)).agg(F.count(F.lit(1)).alias(n))


def _dealt(rows: DataFrame, columns: Sequence[str], n: str, own: str, cells: str, other: str, others: str, cell: int) -> DataFrame:
    """Rows in chunks of at most ``cell`` copies, each in its own line of cells and in every one across."""
    chunk = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((C(n) - 1) / cell))))
    return (chunk.withColumn(n, F.least(F.lit(cell).cast("long"), C(n) - C("_chunk") * cell))
            .withColumn(own, F.pmod(F.xxhash64(*(C(f"`{c}`") for c in columns), C("_chunk")), C(cells)))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), C(others) - 1)))
            .drop("_chunk"))


def product_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], where: Column | None = None,
                 cell: int = CELL) -> DataFrame:
    """``left JOIN right ON keys [WHERE ...]`` with every repeated row, hot keys of both sides included.

    Equal rows are counted first, so that a key's rows are counted, never
    gathered.  A key whose rows on both sides make more than ``cell ** 2`` is
    laid over a grid: its left rows are dealt over lines of cells, its right
    rows over columns, by a hash of the row (a row with many copies in chunks),
    and each is repeated across the grid once per cell.  Any two rows meet in
    exactly one cell.  Salts are hashes of rows, so a recomputed task gives the
    same ones.  Repeated across the grid are about ``output / cell`` rows.
    Column names of the sides must differ.  An empty side gives no rows.
    """
    clash = set(map(str.lower, left.columns)) & set(map(str.lower, right.columns))
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    lk, rk = [k for k, _ in on], [k for _, k in on]
    a, b = _weighed(left, lk, "_ln"), _weighed(right, rk, "_rn")
    keys = [f"_h{i}" for i in range(len(on))]
    size_a = a.groupBy(*(C(k).alias(h) for k, h in zip(lk, keys))).agg(F.sum("_ln").alias("_la"))
    size_b = b.groupBy(*(C(k).alias(h) for k, h in zip(rk, keys))).agg(F.sum("_rn").alias("_rb"))
    hot = (size_a.join(size_b, keys).where(C("_la").cast("double") * C("_rb") > float(cell) ** 2)
           .select(*keys, F.ceil(C("_la") / cell).alias("_lines"), F.ceil(C("_rb") / cell).alias("_cols")))

    def gridded(rows: DataFrame, own: Sequence[str]) -> DataFrame:
        same = reduce(and_, (C(k) == C(h) for k, h in zip(own, keys)))
        one = F.lit(1).cast("long")
        return rows.join(hot, same, "left").drop(*keys).withColumns(
            {"_lines": F.coalesce("_lines", one), "_cols": F.coalesce("_cols", one)})

    la = _dealt(gridded(a, lk), left.columns, "_ln", "_lx", "_lines", "_ly", "_cols", cell).drop("_lines", "_cols")
    rb = _dealt(gridded(b, rk), right.columns, "_rn", "_ry", "_cols", "_rx", "_lines", cell).drop("_lines", "_cols")
    met = reduce(and_, (C(x) == C(y) for x, y in [*on, ("_lx", "_rx"), ("_ly", "_ry")]))
    out = la.join(rb, met)
    out = out if where is None else out.where(where)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), C("_ln") * C("_rn")))
    return out.withColumn("_copy", copies).select(*(f"`{c}`" for c in [*left.columns, *right.columns]))
