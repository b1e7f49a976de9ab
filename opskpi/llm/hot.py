"""Joins of rows to one fact per key, where a key may hold a third of all rows.

Of ``total`` rows fewer than ``SHARE`` keys can have more than ``total /
SHARE`` each.  Their facts are broadcast, so rows of hot keys stay where they
are; all others are shuffled, and no key brings more than its share to a task.
The bound on what is broadcast does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
SHARE = 1000


def hot_join(rows: DataFrame, facts: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows JOIN facts USING (key)`` (inner, left or left_semi).

    ``facts`` has one row per key, with ``n``, the rows of the key among all
    ``total`` rows; ``n`` is not handed on.  Null keys match nothing.
    """
    hot = F.broadcast(facts.where(C("n") * SHARE > total).drop("n"))
    rest = facts.where(C("n") * SHARE <= total).drop("n")
    met = rows.join(hot, key, "left_semi" if how == "left_semi" else "inner")
    return met.unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key, how))
