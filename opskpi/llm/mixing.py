"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; every document of a source is taken
``target / source_size`` times on average.  The whole part of that ratio is
taken for certain.  The fractional part is a copy probability, held as a mass
of ``probability * size`` in integer units: two open documents move mass
between them, as much as makes one of them integral, in the direction that a
coin decides whose odds keep each document's expectation.  The sum of masses -
the words of the source - never changes, and at most one document of a block
stays open.  Those residuals meet in blocks of the next level, a reduction
tree of fan-in ``BLOCK``, until one document a source is left, which is
rounded by its own probability.  So a source's taken words are within one
document of its target, and no document exceeds its ratio rounded up.

Blocks are hashes of documents within a source, so a hot source is spread over
many blocks; equal rows (same id, text and source) are counted first and dealt
out in runs of ``BLOCK``.  Coins and blocks depend on ids and texts only, not
on files or partitions: reruns agree.

Defined cases: null text has size 0 and is taken 0 times; null ``source`` is a
source of its own, the last one; a null ``doc_id`` is a document like any
other; equal rows are mixed as so many documents; a source of size 0 has target
0; an empty table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.llm.local import _BLANK, key_runs, mix64
from opskpi.llm.staging import Staging
from opskpi.operators.rank import ranked

C = F.col
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)      #: the mix has 3/2 of all words
MOST = 2            #: a target is at most so many times its source's size
BLOCK = 4096
_UNIT = 30          # masses count in 2**-30 of a word
_U = np.uint64

UNITS = ("doc_id long, source string, size long, source_size long, target double, taken long, "
         "key long, mass long, bucket long")


def count_words(column: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text of an Arrow string column; null has none."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column) or ends[-1] == ends[0]:
        return np.zeros(len(column), np.int64)
    word = ~_BLANK[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = ends[:-1] - ends[0]
    full = first < ends[1:] - ends[0]
    begins[first[full]] = word[first[full]]           # a text's first byte follows no byte of another's
    upto = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
    return upto[ends[1:] - ends[0]] - upto[first]


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key`` - the key is a hash of the id and the text."""

    def run(batches):
        for b in batches:
            texts = b.column("text")
            key = [xxhash.xxh3_64_intdigest(t or b"", xxhash.xxh3_64_intdigest(repr(d))) - (1 << 63)
                   for d, t in zip(b.column("doc_id").to_pylist(), texts.cast(pa.large_binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), pa.array(count_words(texts)), pa.array(key, pa.int64())],
                names=["doc_id", "source", "size", "key"])

    return docs.select(C("doc_id").cast("long").alias("doc_id"), C("source").cast("string").alias("source"),
                       C("text").cast("string").alias("text")) \
               .mapInArrow(run, "doc_id long, source string, size long, key long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE,
            most: int = MOST) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: weights by rank, capped at ``most`` times the size.

    The excess over a cap goes to the sources below theirs by weight, until
    none is above.  A round is one aggregate over the table of sources; two
    numbers reach the driver.  All sums are exact integers.
    """
    placed = ranked(sources.withColumn("g", F.lit(0)), "g", [C("source").asc_nulls_last()], "place")
    place = ((C("place") - 1) % len(weights)).cast("int")
    whole = "decimal(38,0)"
    rows = placed.select("source", "source_size", F.array(*map(F.lit, weights))[place].cast(whole).alias("w"),
                         (C("source_size") * share[1] * most).cast(whole).alias("cap"))   # in 1/share[1] words
    total = rows.agg(F.sum(C("source_size").cast(whole)).alias("n")).first()["n"]
    if not total:
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    left, level, capped = int(total) * share[0], None, -1
    while True:
        over = F.lit(False) if level is None else C("w") * F.lit(level[0]).cast(whole) > C("cap") * F.lit(level[1]).cast(whole)
        now = rows.agg(F.sum(F.when(over, C("cap"))).alias("cap"), F.sum(F.when(~over, C("w"))).alias("w"),
                       F.count_if(over).alias("n")).first()
        if now["n"] == capped or not now["w"]:
            break
        capped, level = now["n"], (str(left - int(now["cap"] or 0)), str(now["w"]))
    fair = C("w").cast("double") * float(level[0]) / (float(level[1]) * share[1])
    return rows.select("source", "source_size", F.when(over, C("cap").cast("double") / share[1])
                       .otherwise(fair).alias("target"))


def round_pairs(mass: np.ndarray, room: np.ndarray, key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivotal rounds over open documents until one is left: (masses, places still open).

    ``0 < mass < room`` where a document is open; neighbours are paired, the
    survivors are paired again.  The sum of masses never changes.
    """
    mass = mass.copy()
    live = np.flatnonzero((mass > 0) & (mass < room))
    turn = 0
    while len(live) > 1:
        i, j = live[0:len(live) - 1:2], live[1::2]
        odd = live[len(j) * 2:]
        up = np.minimum(room[i] - mass[i], mass[j])       # what j can give to i
        down = np.minimum(mass[i], room[j] - mass[j])     # what i can give to j
        coin = mix64(mix64(key[i].astype(_U) + _U(turn + 64 * level)) ^ key[j].astype(_U)) >> _U(11)
        give = coin.astype(np.float64) / 2.0 ** 53 * (up + down) < down
        move = np.where(give, up, -down)
        mass[i] += move
        mass[j] -= move
        live = live[(mass[live] > 0) & (mass[live] < room[live])] if not len(odd) else np.concatenate(
            (live[:-1][(mass[live[:-1]] > 0) & (mass[live[:-1]] < room[live[:-1]])], odd))
        turn += 1
    return mass, live


def settle_last(mass: np.ndarray, room: np.ndarray, opened: np.ndarray, last: int, up: bool) -> None:
    """Rounds the last open document and gives the difference back, document by document, where one fits whole."""
    left = int(room[last] - mass[last] if up else mass[last])
    mass[last] = room[last] if up else 0
    opened[last] = False
    for i in np.flatnonzero(opened & ((mass == room) if up else (mass == 0)) & (room <= left)):
        if room[i] <= left:
            left -= int(room[i])
            mass[i] = 0 if up else room[i]


def _level(blocks: DataFrame, level: int, last: bool) -> DataFrame:
    """One level of the tree: each block settles all but one of its documents (the last level all)."""

    def run(batches):
        for t in key_runs(batches, ["group", "bucket"]):
            t = t.combine_chunks()
            n = t.column("n").to_numpy()
            t = t.take(pa.array(np.repeat(np.arange(len(n)), n))) if (n > 1).any() else t
            size, key = t.column("size").to_numpy(), t.column("key").to_numpy().copy()
            key += np.concatenate([np.arange(k) for k in n]) if (n > 1).any() else 0
            mass, room = t.column("mass").to_numpy().copy(), size << _UNIT
            # a group is a hash of the source: names that collide stay apart
            names = t.column("source").to_pylist()
            for name in dict.fromkeys(names):
                at = np.fromiter((x == name for x in names), bool, len(names)) if len(set(names)) > 1 else np.ones(len(names), bool)
                at = np.flatnonzero(at)
                done, live = round_pairs(mass[at], room[at], key[at], level)
                if last and len(live):
                    k = live[0]
                    coin = float(mix64(mix64(key[at[k:k + 1]].astype(_U)) + _U(level))[0] >> _U(11)) / 2.0 ** 53
                    settle_last(done, room[at], (mass[at] > 0) & (mass[at] < room[at]), k, coin * float(room[at[k]]) < float(done[k]))
                mass[at] = done
            full = mass >= room
            taken = t.column("taken").to_numpy() + np.where(full & (mass > 0), size, 0)
            is_open = (mass > 0) & ~full
            yield pa.RecordBatch.from_arrays(
                [*(c.combine_chunks() for c in (t.column("doc_id"), t.column("source"), t.column("size"),
                                                t.column("source_size"), t.column("target"))),
                 pa.array(taken), pa.array(key), pa.array(np.where(is_open, mass, 0)),
                 pa.array(t.column("bucket").to_numpy() // BLOCK)],
                names=["doc_id", "source", "size", "source_size", "target", "taken", "key", "mass", "bucket"])

    dealt = (blocks.withColumn("group", F.xxhash64("source")).repartition("group", "bucket")
             .sortWithinPartitions("group", "bucket", "key", "size"))
    return dealt.mapInArrow(run, UNITS)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of ``docs(doc_id, text, source)``."""
    staging = Staging(docs.sparkSession, "mixing")
    rows = staging.put(sized(docs).groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n")), "sized")
    sums = staging.put(rows.groupBy("source").agg(F.sum(C("size") * C("n")).alias("source_size"), F.sum("n").alias("docs")), "sources")
    goal = targets(sums.select("source", "source_size"), weights, share, most)
    goal = staging.put(goal.join(sums.select(C("source").alias("s"), "docs"), C("source").eqNullSafe(C("s")))
                       .drop("s").withColumn("blocks", F.ceil(C("docs") / F.lit(BLOCK)).cast("long")), "targets")
    ratio = F.when(C("source_size") > 0, C("target") / C("source_size")).otherwise(F.lit(0.0))
    units = (rows.join(goal.withColumnRenamed("source", "s"), C("source").eqNullSafe(C("s"))).drop("s")
             .withColumn("ratio", ratio).withColumn("sure", F.floor("ratio"))
             .withColumn("taken", (C("sure") * C("size")).cast("long"))
             .withColumn("mass", (F.round((C("ratio") - C("sure")) * float(1 << _UNIT)) * C("size")).cast("long"))
             .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((C("n") - 1) / F.lit(BLOCK)).cast("long"))))
             .withColumn("n", F.least(C("n") - C("run") * BLOCK, F.lit(BLOCK)))
             .withColumn("key", F.when(C("run") == 0, C("key")).otherwise(F.xxhash64("key", "run")))
             .withColumn("bucket", F.pmod("key", "blocks"))
             .select("doc_id", "source", "size", "source_size", "target", "taken", "key", "mass", "bucket", "n"))
    most_blocks = goal.agg(F.max("blocks").alias("n")).first()["n"] or 0
    out, level = None, 0
    while True:
        done = staging.put(_level(units, level, most_blocks <= 1), f"level{level}")
        settled = done.where("mass = 0")
        out = settled if out is None else out.union(settled)
        if most_blocks <= 1:
            break
        units = done.where("mass > 0").withColumn("n", F.lit(1).cast("long"))
        level, most_blocks = level + 1, -(-most_blocks // BLOCK)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")
