"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors are one class.  Each class has the signs of its products with
``tables * bits`` random hyperplanes; each table keys a bucket by its own
bits.  ``plan`` sizes them from the number of classes: enough bits that a
bucket holds few unrelated vectors, enough tables that a pair at the threshold
meets in one of them with probability ``recall``.  Bucket mates whose whole
sign vectors agree (four standard deviations of slack) are joined to candidate
groups; then each group's vectors travel once, and all pairs of a group are
verified by their exact cosine in double precision, in cells of bounded size.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of unequal
length never link; a repeated row is a vector like any other (it links with its
twin); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.llm.cells import by_cell, with_cells
from opskpi.llm.components import connected_components
from opskpi.llm.local import Links, key_runs
from opskpi.llm.staging import Staging

C = F.col
COSINE = 0.9
RECALL = 0.9995
BUCKET = 1024
CELL = 512
_SEED = 0x51A5


def plan(classes: int, cosine: float = COSINE, recall: float = RECALL, load: int = 32) -> tuple[int, int]:
    """Bits per table and tables for so many vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = max(8, math.ceil(math.log2(max(classes, 1) / load))) if classes > load else 8
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree ** bits))


def _valid(values: list | None) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64) + 0.0
    return x if np.isfinite(x).all() and x.any() else None


def _named(table: DataFrame) -> DataFrame:
    """``vec_id, name, vec``: the class (null if it can link with nothing) and the components as doubles."""

    def run(batches):
        for b in batches:
            names, data = [], []
            for values in b.column(1).to_pylist():
                x = _valid(values)
                data.append(None if x is None else x.tobytes())
                names.append(None if x is None else xxhash.xxh3_128_digest(data[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(data, pa.binary())],
                                             names=["vec_id", "name", "vec"])

    return table.select(C("vec_id").cast("long").alias("vec_id"), C("embedding").cast("array<double>").alias("embedding")) \
                .mapInArrow(run, "vec_id long, name binary, vec binary")


def signs(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Sign bits of each row, ``tables * bits`` of them, as 0 and 1."""
    planes = np.random.default_rng([_SEED, x.shape[1]]).standard_normal((tables * bits, x.shape[1]))
    return (x @ planes.T >= 0).astype(np.uint8)


def _table_rows(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``(key, id, sig)`` for each class and table."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                ids, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
                size = np.asarray([len(v) for v in raw])
                for s in np.unique(size):
                    at = np.flatnonzero(size == s)
                    x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
                    bit = signs(x / np.abs(x).max(axis=1, keepdims=True), bits, tables)
                    sig = [r.tobytes() for r in np.packbits(np.pad(bit, ((0, 0), (0, -bit.shape[1] % 64))), axis=1)]
                    own = bit.reshape(len(at), tables, bits).astype(np.int64) @ weights
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), s * 65536 + t)), pa.array(own[:, t]), pa.array(ids[at]),
                             pa.array(sig, pa.binary())], names=["table", "bucket", "id", "sig"])

    return classes.select("id", "vec").mapInArrow(run, "table long, bucket long, id long, sig binary").select(
        F.xxhash64("table", "bucket").alias("comp"), "id", "sig")


def _bucket_links(cells: DataFrame, most: int) -> DataFrame:
    """Links between bucket mates that differ in at most ``most`` signs."""

    def run(batches):
        for t in key_runs(batches, ["comp", "cx", "cy"], at_least=2):
            ids = t.column("id").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(len(ids), -1)
            blk = t.column("blk").to_numpy()
            one = t.column("cx")[0].as_py() == t.column("cy")[0].as_py()
            x = np.arange(len(ids)) if one else np.flatnonzero(blk == blk.min())
            y = x if one else np.flatnonzero(blk != blk.min())
            apart = np.zeros((len(x), len(y)), np.int32)
            for w in range(sig.shape[1]):
                apart += np.bitwise_count(sig[x, None, w] ^ sig[None, y, w])
            links = Links(len(ids))
            links.link_matrix(apart <= most, x, y)
            root = links.roots()
            own = np.flatnonzero(root != np.arange(len(ids)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])

    return by_cell(cells).mapInArrow(run, "a long, b long").distinct()


def _verified(cells: DataFrame, cosine: float) -> DataFrame:
    """Exact links per cell: each member's number of linked vectors there and its root."""

    def run(batches):
        for t in key_runs(batches, ["comp", "cx", "cy"], at_least=2):
            node, copies, blk = (t.column(c).to_numpy() for c in ("node", "copies", "blk"))
            raw = t.column("vec").to_pylist()
            size = np.asarray([len(v) for v in raw])
            linked = np.zeros((len(node), len(node)), bool)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                norm = np.sqrt((x * x).sum(axis=1))
                linked[np.ix_(at, at)] = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
            np.fill_diagonal(linked, False)
            if t.column("cx")[0].as_py() != t.column("cy")[0].as_py():
                linked &= blk[:, None] != blk[None, :]
            links = Links(len(node))
            links.link_matrix(linked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(linked @ copies), pa.array(node[links.roots()])],
                names=["node", "links", "root"])

    return by_cell(cells).mapInArrow(run, "node long, links long, root long")


def near_vectors(table: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``table(vec_id, embedding)``."""
    staging = Staging(table.sparkSession, "vectors")
    rows = staging.put(_named(table), "rows")
    classes = staging.put(
        rows.where("name is not null").groupBy("name")
        .agg(F.min("vec_id").alias("first"), F.min("vec").alias("vec"), F.count(F.lit(1)).alias("copies"))
        .withColumn("id", F.monotonically_increasing_id()), "classes")
    bits, tables = plan(classes.count(), cosine, recall)
    total = bits * tables
    apart = math.acos(cosine) / math.pi
    most = math.ceil(total * apart + 4 * math.sqrt(total * apart * (1 - apart)))
    keyed = staging.put(_table_rows(classes, bits, tables), "tables")
    sizes = keyed.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = _bucket_links(with_cells(keyed, sizes, BUCKET, member="id"), most)
    groups = connected_components(links, staging)
    members = classes.join(groups, classes.id == groups.node).select("node", "comp", "copies", "vec")
    verified = staging.put(_verified(with_cells(
        members, groups.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), CELL), cosine), "verified")
    final = connected_components(verified.select(C("node").alias("a"), C("root").alias("b")), staging)
    degree = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = (classes.join(final, classes.id == final.node, "left").drop("node")
             .join(degree, classes.id == degree.node, "left")
             .select("name", "first", "copies", F.coalesce("comp", "id").alias("comp"),
                     F.coalesce("links", F.lit(0)).alias("links")))
    least = known.groupBy("comp").agg(F.min("first").alias("component_id"))
    known = known.join(least, "comp").select("name", "component_id", (C("copies") - 1 + C("links")).alias("n_links"))
    linked = rows.where("name is not null").join(known, "name").select(
        "vec_id", C("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("name is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                              C("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", C("vec_id").eqNullSafe(C("component_id")))
