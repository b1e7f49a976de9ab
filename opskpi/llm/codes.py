"""Vector code compression: product codebooks fitted by dual-tree Lloyd rounds.

Components become integers ``floor(scale * x)``; a vector is cut into equal
consecutive parts, and each part position has a codebook.  Vectors are kept as
*blocks* (``BLOCK`` numbers in all), each with one balanced tree of boxes per
part position: a permutation of the block whose halves, quarters, ... are the
nodes.  The entries of a codebook form a small tree of boxes as well.  A round
descends both trees together: an entry node whose smallest distance to a box
of parts exceeds the largest distance of another one is pruned for that box;
where a single entry is left the whole box is assigned to it, its sum taken
from prefix sums; boxes that stay uncertain down to their leaf are decided
point by point.  Bounds and distances are integers throughout, so every result
is exact, and ties go to the lower index.

A round is one pass over the staged blocks: each task adds up its sums, the
shuffle adds those of the tasks, and the new codebooks - ``entries`` times the
vector width, whatever the number of rows - are all that reaches the driver.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; a vector shorter than the longest one is extended by zeros, and
the width is rounded up to a multiple of ``parts``; rows that repeat an id are
rows like any other and start the codebooks in order of their vectors; a null
id stands after all others; with fewer rows than entries a codebook has as many
entries as rows; integers of any size are exact (beyond 64 bits they are Python
integers), but errors end at the largest long; an empty table gives no rows;
further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.llm.staging import Staging

C = F.col
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK = 1 << 21     #: numbers in a block of vectors
LEAF = 16
_LONG = (1 << 63) - 1
_LIMB = 40          # sums travel in limbs of so many bits
_SAFE = 1 << 62


def integers(values: list[list[float]], width: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` exactly, zeros up to ``width``; int64, or Python integers if some do not fit."""
    out = np.zeros((len(values), width))
    for row, v in zip(out, values):
        row[:len(v)] = v
    if not len(out) or np.abs(out).max() * scale < 2.0 ** 52:
        return np.floor(out * scale).astype(np.int64)
    return np.asarray([[math.floor(x) * scale if abs(x) >= 2.0 ** 53 else
                        (lambda n, d: n * scale // d)(*x.as_integer_ratio()) for x in row] for row in out.tolist()], object)


def _fits(*arrays: np.ndarray) -> bool:
    """Whether squared distances between the rows stay within 64 bits."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return 4 * most * most * max(a.shape[-1] for a in arrays) < _SAFE


def _pack(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "text", ",".join(map(str, x.ravel())).encode()
    kind = next(k for k in ("int16", "int32", "int64") if not x.size or (np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max))
    return kind, x.astype(kind).tobytes()


def _unpack(kind: str, data: bytes, rows: int) -> np.ndarray:
    if kind == "text":
        return np.asarray([int(v) for v in data.decode().split(",")], object).reshape(rows, -1)
    return np.frombuffer(data, kind).astype(np.int64).reshape(rows, -1)


def depth(n: int) -> int:
    return max(0, math.ceil(math.log2(n / LEAF))) if n > LEAF else 0


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end in the permuted block."""
    return (np.arange((1 << level) + 1) * n) >> level


def plant(x: np.ndarray) -> np.ndarray:
    """The permutation of a balanced tree: every node is halved along the widest side of its box."""
    n = len(x)
    order = np.arange(n)
    for level in range(depth(n)):
        at = bounds(n, level)[:-1]
        own = x[order]
        wide = (np.maximum.reduceat(own, at) - np.minimum.reduceat(own, at)).argmax(axis=1)
        node = np.repeat(np.arange(len(at)), np.diff(bounds(n, level)))
        value = own[np.arange(n), wide[node]]
        if value.dtype == object:   # ranks sort like the integers themselves
            value = np.unique(value, return_inverse=True)[1]
        order = order[np.lexsort((value, node))]
    return order


@dataclass
class EntryTree:
    """Boxes over the distinct entries of a codebook; node 0 is the root, leaves name their entry."""

    low: np.ndarray
    high: np.ndarray
    kids: np.ndarray     # (nodes, 2), -1 at leaves
    entry: np.ndarray    # -1 at inner nodes

    @classmethod
    def over(cls, book: np.ndarray) -> EntryTree:
        seen: dict[tuple, int] = {}
        for i, c in enumerate(book.tolist()):
            seen.setdefault(tuple(c), i)    # of equal entries the lowest index is nearest
        low, high, kids, entry = [], [], [], []

        def grow(ids: list[int]) -> int:
            me, box = len(low), book[ids]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            kids.append([-1, -1])
            entry.append(ids[0] if len(ids) == 1 else -1)
            if len(ids) > 1:
                side = int((high[me] - low[me]).argmax()) if book.shape[1] else 0
                ids = sorted(ids, key=lambda i: book[i, side])
                kids[me] = [grow(ids[:len(ids) // 2]), grow(ids[len(ids) // 2:])]
            return me

        grow(list(seen.values()))
        return cls(np.asarray(low), np.asarray(high), np.asarray(kids), np.asarray(entry))


def dual_tree(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of each row of the permuted block ``x``: (entries, counts, sums, rows decided one by one)."""
    n, tree = len(x), EntryTree.over(book)
    out = np.full(n, -1)
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, x.dtype)
    prefix = np.concatenate((np.zeros((1, x.shape[1]), x.dtype), np.cumsum(x, axis=0)))
    last = depth(n)
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    single = 0
    for level in range(last + 1):
        at = bounds(n, level)
        nodes = np.unique(q)
        span = np.stack([at[nodes], at[nodes + 1]], axis=1)
        flat = span.ravel() if span[-1, 1] < n else span.ravel()[:-1]
        low = np.minimum.reduceat(x, flat)[::2]
        high = np.maximum.reduceat(x, flat)[::2]
        while True:
            inner = tree.kids[r, 0] >= 0
            if inner.any():     # both children of an inner entry node
                q = np.concatenate((q[~inner], np.repeat(q[inner], 2)))
                r = np.concatenate((r[~inner], tree.kids[r[inner]].ravel()))
            by = np.lexsort((tree.entry[r], q))
            q, r = q[by], r[by]
            node = np.searchsorted(nodes, q)
            gap = np.maximum(np.maximum(low[node] - tree.high[r], tree.low[r] - high[node]), 0)
            reach = np.maximum(high[node] - tree.low[r], tree.high[r] - low[node])
            first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            most = np.minimum.reduceat((reach * reach).sum(axis=1), first)
            keep = (gap * gap).sum(axis=1) <= np.repeat(most, np.diff(np.append(first, len(q))))
            q, r = q[keep], r[keep]
            if level < last or (tree.entry[r] >= 0).all():
                break
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        width = np.diff(np.append(first, len(q)))
        whole = first[(width == 1) & (tree.entry[r[first]] >= 0)]
        for k in whole:         # one entry is left: the whole box at once
            e, a, b = tree.entry[r[k]], at[q[k]], at[q[k] + 1]
            out[a:b] = e
            counts[e] += b - a
            sums[e] += prefix[b] - prefix[a]
        rest = np.ones(len(q), bool)
        rest[whole] = False
        q, r = q[rest], r[rest]
        if not len(q):
            return out, counts, sums, single
        if level < last:
            q, r = np.concatenate((2 * q, 2 * q + 1)), np.concatenate((r, r))
    # uncertain leaves: every row against the entries left for its leaf, in order of their index
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    width = np.diff(np.append(first, len(q)))
    leaf = q[first]
    rows = np.concatenate([np.arange(at[k], at[k + 1]) for k in leaf])
    place = np.repeat(np.arange(len(leaf)), at[leaf + 1] - at[leaf])
    w = width[place]
    begin = np.cumsum(w) - w
    pair_row = np.repeat(rows, w)
    pair_entry = tree.entry[r[np.repeat(first[place] - begin, w) + np.arange(w.sum())]]
    apart = x[pair_row] - book[pair_entry]
    apart = (apart * apart).sum(axis=1)
    best = np.repeat(np.minimum.reduceat(apart, begin), w)
    out[rows] = np.minimum.reduceat(np.where(apart == best, pair_entry, len(book)), begin)
    single = len(rows)
    np.add.at(counts, out[rows], 1)
    np.add.at(sums, out[rows], x[rows])
    return out, counts, sums, single


def _assign(x: np.ndarray, order: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the rows of one part in their own order, counts and sums."""
    if not _fits(x, book):
        x, book = x.astype(object), book.astype(object)
    elif x.dtype == object or book.dtype == object:
        x, book = x.astype(np.int64), book.astype(np.int64)
    found, counts, sums, _ = dual_tree(x[order], book)
    out = np.empty(len(x), np.int64)
    out[order] = found
    return out, counts, sums


def _blocks(kept: DataFrame, width: int, parts: int, scale: int, label_type: str) -> DataFrame:
    """Blocks of vectors as integers, with the permutation of each part's tree."""
    most = max(LEAF, BLOCK // max(width, 1))

    def block(part: list[pa.RecordBatch]):
        t = pa.Table.from_batches(part)
        x = integers(t.column("embedding").to_pylist(), width, scale)
        kind, data = _pack(x)
        orders = np.stack([plant(p) for p in np.split(x, parts, axis=1)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())),
             pa.array([t.column("label").to_pylist()], pa.list_(t.schema.field("label").type)),
             pa.array([kind]), pa.array([data], pa.binary()), pa.array([orders.tobytes()], pa.binary())],
            names=["ids", "labels", "kind", "data", "orders"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, most - n)
                held.append(take)
                n += take.num_rows
                b = b.slice(take.num_rows)
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return kept.mapInArrow(run, f"ids array<long>, labels array<{label_type}>, kind string, data binary, orders binary")


def _round(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``part, entry, place, limb, value``: sums of the assigned parts, counts at place -1."""
    parts = len(books)

    def run(batches):
        counts = np.zeros((parts, len(books[0])), np.int64)
        sums = np.zeros((parts, *books[0].shape), object)
        for b in batches:
            for kind, data, orders in zip(*(b.column(c).to_pylist() for c in ("kind", "data", "orders"))):
                orders = np.frombuffer(orders, np.int32).reshape(parts, -1)
                x = np.split(_unpack(kind, data, orders.shape[1]), parts, axis=1)
                for p in range(parts):
                    _, n, s = _assign(x[p], orders[p], books[p])
                    counts[p] += n
                    sums[p] += s.astype(object)
        rows = []
        for p, e in zip(*np.nonzero(counts)):
            for place, v in enumerate((int(counts[p, e]), *map(int, sums[p, e])), -1):
                limb = 0
                while v or limb == 0:
                    low = v & ((1 << _LIMB) - 1)
                    v >>= _LIMB
                    if v == -1:     # the sign stays in the last limb
                        low, v = low - (1 << _LIMB), 0
                    rows.append((int(p), int(e), place, limb, low))
                    limb += 1
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["part", "entry", "place", "limb", "value"])

    return (blocks.mapInArrow(run, "part long, entry long, place long, limb long, value long")
            .groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")))


def _updated(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Entries become the floor of their mean; unused ones stay.  Reads at most entries x (width + 1) numbers."""
    total: dict[tuple, int] = {}
    for r in sums.collect():
        k = (r["part"], r["entry"], r["place"])
        total[k] = total.get(k, 0) + (r["value"] << (_LIMB * r["limb"]))
    out = [b.astype(object) for b in books]
    for (p, e, place), v in total.items():
        if place >= 0:
            out[p][e, place] = v // total[p, e, -1]
    return [b.astype(np.int64) if _fits(b) else b for b in out]


def _coded(blocks: DataFrame, books: list[np.ndarray], label_type: str) -> DataFrame:
    """``vec_id, label, codes, error`` of every vector."""
    parts = len(books)

    def run(batches):
        for b in batches:
            for ids, labels, kind, data, orders in zip(*(b.column(c) for c in ("ids", "labels", "kind", "data", "orders"))):
                orders = np.frombuffer(orders.as_py(), np.int32).reshape(parts, -1)
                x = np.split(_unpack(kind.as_py(), data.as_py(), orders.shape[1]), parts, axis=1)
                codes = np.empty((orders.shape[1], parts), np.uint8)
                error = np.zeros(len(codes), object)
                for p in range(parts):
                    codes[:, p], _, _ = _assign(x[p], orders[p], books[p])
                    apart = x[p].astype(object) - books[p][codes[:, p]] if not _fits(x[p], books[p]) else x[p] - books[p][codes[:, p]]
                    error += (apart * apart).sum(axis=1).astype(object)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array([min(int(e), _LONG) for e in error], pa.int64())], names=["vec_id", "label", "codes", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label_type}, codes binary, error long")


def compress(table: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, codes, error)`` per kept row of ``table(vec_id, embedding, label)``, and the codebooks.

    ``codes`` has one byte a part; ``entries`` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    staging = Staging(table.sparkSession, "codes")
    label_type = dict(table.dtypes)["label"]
    x = C("embedding").cast("array<double>")
    kept = (table.select(C("vec_id").cast("long").alias("vec_id"), x.alias("embedding"), "label")
            .where(C("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))))
    width = kept.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    width = max(1, -(-width // parts)) * parts
    seeds = kept.orderBy(C("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    blocks = staging.put(_blocks(kept, width, parts, scale, label_type), "blocks")
    if not seeds:
        return blocks.sparkSession.createDataFrame([], f"vec_id long, label {label_type}, codes binary, error long"), []
    books = np.split(integers([list(r["embedding"]) for r in seeds], width, scale), parts, axis=1)
    for _ in range(rounds):
        books = _updated(books, _round(blocks, books))
    return staging.put(_coded(blocks, books, label_type), "codes"), books


def digest(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: codes in hex, errors of equal labels summed."""
    whole = ",".join(str(int(v)) for book in books for entry in book for v in entry)
    totals = coded.groupBy(C("label").alias("l")).agg(
        F.least(F.sum(C("error").cast("decimal(38,0)")), F.lit(str(_LONG)).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(totals, C("label").eqNullSafe(C("l"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(whole.encode()).hexdigest()).alias("codebooks_sha256"))
