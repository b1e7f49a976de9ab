"""N-gram Jaccard join by chosen paths: documents whose word 5-shingles overlap to 0.8 or more.

Documents with the same set of shingles are one class (a grouped minimum), so
exact copies cost one row.  Each class has a MinHash signature of 128 values:
its sampled tokens.  A chosen-path run starts with all classes in one node
and splits a node on sampled shared tokens: a class follows token ``x`` of
its signature if a hash of (path, x) falls below ``1 / (similarity * 128)``,
so that two classes similar enough share one path on average at each split.
Nodes of at most ``LEAF`` classes are compared by brute force, larger ones are
split again, and nodes still larger at the last level are compared in cells
of bounded size.  ``runs_for`` repeats runs until the target recall.

Comparing inside a node uses a 4-bit sketch of the signature with four standard
deviations of slack.  It only joins classes to candidate groups; then each
group's shingle sets travel once, and *all* pairs of a group are verified
exactly in cells (a group larger than a cell is dealt over a square of
cells).  So the links found are exact, and a link the sampling missed is still
found if its two ends were joined by way of others.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` of the lower-case text; a text
of one to four words has one shingle, of all of them; texts without a word,
and null texts, link with nothing; rows with equal ``doc_id`` and text are two
rows of one class and link with each other; an empty table gives no rows;
further columns are ignored.  Shingles are compared by 64-bit hashes, sets by
128-bit hashes.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.llm.cells import by_cell, with_cells
from opskpi.llm.components import connected_components
from opskpi.llm.local import Links, _powers, key_runs, mix64, prefix_hash, span_hash, text_chunks, word_spans
from opskpi.llm.staging import Staging

C = F.col
_U = np.uint64
WORDS = 5
SIMILARITY = 0.8
TOKENS = 128
LEAF = 256
LEVELS = 3
TARGET_RECALL = 0.999
CELL = 192
_SEED = np.random.default_rng(0x5EED)
_MULTIPLY = _SEED.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _SEED.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Runs until a pair at the threshold has met with probability ``recall``.

    The paths two classes share form a branching process with one child on
    average (Poisson), so one run meets after ``levels`` splits with
    ``p(l) = 1 - exp(-p(l - 1))``.
    """
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, _, buf, starts in text_chunks(texts):
        a, b = word_spans(buf)
        h = span_hash(prefix_hash(buf), a, b)
        up, _ = _powers(max(len(buf), words + 1))
        n = len(h) - words + 1
        grams = np.zeros(max(n, 0), _U)
        for k in range(words if n > 0 else 0):
            grams += h[k:k + n] * up[k + 1]
        grams = mix64(grams)
        bounds = np.searchsorted(a, starts)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i >= words:
                out.append(np.unique(grams[i:j - words + 1]))
            elif j > i:
                out.append(mix64((h[i:j] * up[1:j - i + 1]).sum(keepdims=True) + _U(j - i)))
            else:
                out.append(np.zeros(0, _U))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values (16 bits each) of a non-empty set."""
    low = np.full(TOKENS, ~_U(0), _U)
    for i in range(0, len(grams), 4096):
        low = np.minimum(low, (grams[i:i + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    return (mix64(low) & _U(0xFFFF)).astype(np.uint16)


def _set_table(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                names, sizes, sigs = [], [], []
                for s in shingle_sets(b.column(2).to_pylist(), words):
                    sizes.append(len(s))
                    names.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(sigs, pa.binary())], names=["doc_id", "th", "name", "size", "sig"])

    return docs.select("doc_id", "th", "text").mapInArrow(
        run, "doc_id long, th long, name binary, size long, sig binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TOKENS)


def chosen(sig: np.ndarray, path: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the paths they follow out of the nodes ``path`` (one node per row of ``sig``)."""
    token = sig.astype(_U) | (np.arange(TOKENS, dtype=_U) << _U(16))
    mixed = mix64(path.astype(_U)[:, None] ^ (token * _U(0x9E3779B97F4A7C15)))
    row, col = np.nonzero(mixed < _U(int(2 ** 64 / (similarity * TOKENS))))
    return row, mix64(mixed[row, col] + _U(1))


def _paths(rows: DataFrame, similarity: float) -> DataFrame:
    """``rows(id, sig, nodes array<long>)`` -> ``(node, id)`` one level further."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048)
                nodes = b.column(2)
                n = np.asarray([len(x) for x in nodes.to_pylist()])
                flat = nodes.flatten().to_numpy().view(_U)
                which = np.repeat(np.arange(b.num_rows), n)
                sig, ids = _signatures(b.column(1)), b.column(0).to_numpy()
                for k in range(0, len(flat), 4096):
                    own = which[k:k + 4096]
                    row, path = chosen(sig[own], flat[k:k + 4096], similarity)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(path.view(np.int64)), pa.array(ids[own[row]])], names=["node", "id"])

    return rows.mapInArrow(run, "node long, id long").distinct()


def _near(sketch: np.ndarray, other: np.ndarray, least: int) -> np.ndarray:
    out = np.empty((len(sketch), len(other)), bool)
    step = max(1, (1 << 22) // max(1, len(other) * TOKENS))
    for i in range(0, len(sketch), step):
        out[i:i + step] = (sketch[i:i + step, None, :] == other[None, :, :]).sum(axis=2) >= least
    return out


def _least_equal(similarity: float) -> int:
    """Equal 4-bit values that a pair at the threshold has, less four standard deviations."""
    p = similarity + (1 - similarity) / 16
    return math.floor(TOKENS * p - 4 * math.sqrt(TOKENS * p * (1 - p)))


def _node_links(rows: DataFrame, similarity: float) -> DataFrame:
    """``rows(comp, cx, cy, blk, id, sketch)`` sorted by cell -> links between sketches near each other."""
    least = _least_equal(similarity)

    def run(batches):
        a_out, b_out = [], []
        for t in key_runs(batches, ["comp", "cx", "cy"], at_least=2):
            ids = t.column("id").to_numpy()
            packed = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            sketch = np.concatenate((packed & 15, packed >> 4), axis=1)
            links = Links(len(ids))
            if t.column("cx")[0].as_py() == t.column("cy")[0].as_py():
                links.link_matrix(_near(sketch, sketch, least))
            else:
                blk = t.column("blk").to_numpy()
                x, y = np.flatnonzero(blk == blk.min()), np.flatnonzero(blk != blk.min())
                links.link_matrix(_near(sketch[x], sketch[y], least), x, y)
            root = links.roots()
            own = np.flatnonzero(root != np.arange(len(ids)))
            a_out.append(ids[own])
            b_out.append(ids[root[own]])
            if len(a_out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))],
                                                 names=["a", "b"])
                a_out, b_out = [], []
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))],
                                             names=["a", "b"])

    return by_cell(rows).mapInArrow(run, "a long, b long").distinct()


def candidate_links(classes: DataFrame, staging: Staging, similarity: float = SIMILARITY,
                    recall: float = TARGET_RECALL, levels: int = LEVELS, leaf: int = LEAF) -> DataFrame:
    """Chosen-path runs over ``classes(id, sig)``: links ``(a, b)`` that make the candidate groups."""
    def sketches(batches):
        for b in batches:
            low = (_signatures(b.column(1)) & 15).astype(np.uint8)
            packed = low[:, :TOKENS // 2] | (low[:, TOKENS // 2:] << 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in packed], pa.binary())],
                                             names=["id", "sketch"])

    sketch = staging.put(classes.select("id", "sig").mapInArrow(sketches, "id long, sketch binary"), "sketches")
    runs = [int(x) for x in mix64(np.arange(1, runs_for(recall, levels) + 1, dtype=_U)).view(np.int64)]
    todo = classes.select("id", "sig", F.array(*(F.lit(r) for r in runs)).alias("nodes"))
    links = None
    for level in range(1, levels + 1):
        rows = staging.put(_paths(todo.select("id", "sig", "nodes"), similarity), f"paths{level}")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = staging.put(rows.join(sizes, "node"), f"nodes{level}")
        # at the last level a node of any size is compared, in cells
        ready = rows if level == levels else rows.where(C("n") <= leaf)
        ready = ready.join(sketch, "id").select(C("node").alias("comp"), "id", "sketch", "n")
        k = F.ceil(C("n") / F.lit(leaf)).cast("int")
        cells = (ready.withColumn("blocks", k)
                 .withColumn("blk", F.pmod(F.xxhash64("id"), C("blocks").cast("long")).cast("int"))
                 .withColumn("_x", F.explode(F.sequence(F.lit(0), C("blocks") - 1)))
                 .withColumn("cx", F.least("blk", "_x")).withColumn("cy", F.greatest("blk", "_x"))
                 .select("comp", "cx", "cy", "blk", "id", "sketch"))
        found = staging.put(_node_links(cells, similarity), f"links{level}")
        links = found if links is None else links.union(found)
        todo = classes.join(rows.where(C("n") > leaf).groupBy("id").agg(F.collect_list("node").alias("nodes")), "id")
    return links


def _member_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    both = docs.alias("d").join(members.alias("m"), C("d.doc_id").eqNullSafe(C("m.doc_id")) & (C("d.th") == C("m.th")))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                sets = [s.tobytes() for s in shingle_sets(b.column(0).to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(sets, pa.binary())],
                                                 names=["node", "comp", "copies", "grams"])

    return both.select("d.text", "m.node", "m.comp", "m.copies").mapInArrow(
        run, "node long, comp long, copies long, grams binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[col] > 1
    owner, col = owner[shared], col[shared]
    out = np.zeros((n, n), np.int64)
    number = np.cumsum(seen > 1) - 1
    col = number[col]
    width = max(1, (1 << 22) // n)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (lo, lo + width))
        m = np.zeros((n, int(min(width, col[-1] + 1 - lo))), np.float32)
        m[owner[i:j], col[i:j] - lo] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _verified(cells: DataFrame, similarity: Fraction) -> DataFrame:
    """Exact links per cell: each member's number of linked documents there and its root."""
    p, q = similarity.numerator, similarity.denominator

    def run(batches):
        for t in key_runs(batches, ["comp", "cx", "cy"], at_least=2):
            node, first = np.unique(t.column("node").to_numpy(), return_index=True)
            t = t.take(pa.array(first))
            copies, blk = t.column("copies").to_numpy(), t.column("blk").to_numpy()
            sets = [np.frombuffer(x, _U) for x in t.column("grams").to_pylist()]
            both = overlaps(sets)
            size = np.asarray([len(s) for s in sets])
            linked = q * both >= p * (size[:, None] + size[None, :] - both)
            np.fill_diagonal(linked, False)
            if t.column("cx")[0].as_py() != t.column("cy")[0].as_py():
                linked &= blk[:, None] != blk[None, :]
            links = Links(len(node))
            links.link_matrix(linked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(linked @ copies), pa.array(node[links.roots()])],
                names=["node", "links", "root"])

    return by_cell(cells).mapInArrow(run, "node long, links long, root long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS,
                    recall: float = TARGET_RECALL) -> DataFrame:
    """``doc_id, th, class_id, n_links, kept`` per row of ``docs(doc_id, text)``.

    ``class_id`` is the smallest doc_id reachable by links, ``n_links`` the
    number of other rows linked directly, ``kept`` marks the row(s) of that doc_id.
    """
    keyed = docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").alias("text")) \
                .withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    staging = Staging(docs.sparkSession, "setjoin")
    sets = staging.put(_set_table(keyed, words), "sets")
    classes = staging.put(
        sets.where("name is not null").groupBy("name")
        .agg(F.min(F.struct("doc_id", "th", "sig")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("name", "first.*", "copies").withColumn("id", F.monotonically_increasing_id()), "classes")
    groups = connected_components(candidate_links(classes, staging, similarity, recall), staging)
    members = classes.join(groups, classes.id == groups.node).select("doc_id", "th", "node", "comp", "copies")
    sizes = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    verified = staging.put(_verified(with_cells(_member_sets(keyed, members, words), sizes, CELL),
                                     Fraction(str(similarity))), "verified")
    final = connected_components(verified.select(C("node").alias("a"), C("root").alias("b")), staging)
    degree = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = (classes.join(final, classes.id == final.node, "left").drop("node")
             .join(degree, classes.id == degree.node, "left")
             .select("name", "doc_id", "copies", F.coalesce("comp", "id").alias("comp"),
                     F.coalesce("links", F.lit(0)).alias("links")))
    least = known.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    known = known.join(least, "comp").select("name", "class_id", (C("copies") - 1 + C("links")).alias("n_links"))
    linked = sets.where("name is not null").join(known, "name").select(
        "doc_id", "th", "class_id", C("n_links").cast("long").alias("n_links"))
    alone = sets.where("name is null").select("doc_id", "th", C("doc_id").alias("class_id"),
                                              F.lit(0).cast("long").alias("n_links"))
    return linked.union(alone).withColumn("kept", C("doc_id").eqNullSafe(C("class_id")))
