"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (pre-aggregated before its shuffle) and a join
to it that leaves the edges of hubs where they are (``hot.py``), so a hub
vertex is never gathered into one task; edges are staged after each round and
nothing but two checksums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.llm.hot import hot_join
from opskpi.llm.staging import Staging

C = F.col


def _checksum(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"] or 0


def connected_components(edges: DataFrame, staging: Staging, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` (longs) -> ``(node, comp)``; ``comp`` is the smallest node reachable.

    Only nodes that have an edge are returned.  Self-links, repeated and
    reversed edges are allowed; nulls are ignored.
    """
    e = staging.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "edges")
    seen = _checksum(e)
    if seen[0] == 0:
        return e.select(C("a").alias("node"), C("b").alias("comp"))
    for _ in range(rounds):
        both = e.select(C("a").alias("u"), C("b").alias("v")).union(e.select("b", "a"))
        low = (both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
               .select("u", F.least("u", "m").alias("m"), "n"))
        large = (hot_join(both.where("v > u"), low, "u", 2 * seen[0]).select(C("v").alias("a"), C("m").alias("b"))
                 .where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(C("b").alias("a"), C("m").alias("b"))
                 .union(least.select("a", C("m").alias("b"))).distinct())
        nxt = staging.put(small, "edges")
        now = _checksum(nxt)
        staging.drop(e)
        e = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not stable after {rounds} rounds")
    return (e.select(C("a").alias("node"), C("b").alias("comp"))
            .union(e.select("b", "b").distinct()))
