"""Exact substring deduplication over sampled windows, by hash refinement of buckets.

This replaces bucket-pointer refinement: no suffix is sorted and no bucket
identifier of a later offset is reused; identifiers are hashes of the bytes of
each range.  One offset in 170 is looked at instead of ranking every suffix
in each round, and no rank has to be joined on.

A byte goes when a string of ``length`` bytes around it also starts anywhere
else in the corpus.  Not every suffix is sorted: a *sampled* suffix starts at
the smallest 64-gram hash of some window of ``length`` bytes, so that equal
windows sample the same suffix at the same place (about two in 340 offsets).
All windows of a sample are told apart by how far left of it they start; such
a range of left offsets is what a bucket refines:

* initial buckets: the 64-gram at the sample.  A bucket of one is done - no
  window through it occurs twice (most samples of unique text end here);
* a range whose whole context (all its windows joined) is in a bucket of two
  or more is done as well - every window of it occurs again;
* what is left is split into seven smaller ranges, whose identifiers are made
  from the bytes at the earlier and later offsets, and refined again.  Three
  rounds (49, 7 and 1 left offsets) decide every window exactly.

A range found twice stays on, once, as the witness of shorter matches in its
bucket.  Buckets are counted, never gathered: a grouped count with map-side combining
and a join give each sample its verdict; rows of hot buckets are not shuffled
for it (``hot.py``), so a passage that a third of the corpus shares costs no
more per row than a rare one.  The 64-gram buckets
use 64-bit identifiers (a collision only costs a further look); verdicts use
128-bit identifiers.

Defined cases: null text is empty text; texts shorter than ``length`` keep
everything; rows with equal ``doc_id`` and text are occurrences like any
others (each is found in the other), whose equal ranges are listed once; a null ``doc_id`` is an id of its own;
an empty table gives no rows; further columns are ignored, or handed through
in ``row`` when asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.llm.hot import hot_join
from opskpi.llm.local import mix64, prefix_hash, text_chunks
from opskpi.llm.staging import Staging

C = F.col
LENGTH = 400
GRAM = 64
FAN = 7

_U = np.uint64
_LOW = _U((1 << 24) - 1)
#: Window starts looked at in one go; positions must fit in 24 bits.
_STRETCH = 1 << 20


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    from opskpi.llm.local import _powers

    prefix = prefix_hash(buf)
    _, inv = _powers(len(buf))
    n = len(buf) - gram + 1
    return mix64((prefix[gram:] - prefix[:n]) * inv[:n])


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a) - w + 1
    pad = -len(a) % w
    blocks = np.concatenate((a, np.full(pad, ~_U(0), _U))).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def _samples(buf: np.ndarray, valid: np.ndarray, length: int, gram: int):
    """Sampled positions of a buffer with the first and last valid window start of each, and their gram hash."""
    h = _gram_hashes(buf, gram)
    keyed = (h & ~_LOW) | np.arange(len(h), dtype=_U)
    starts = np.flatnonzero(valid[:len(buf) - length + 1])
    at = (_sliding_min(keyed, length - gram + 1)[starts] & _LOW).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    head = np.concatenate(([0], cut)).astype(np.int64)
    tail = np.concatenate((cut, [len(at)])).astype(np.int64) - 1
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
    p = at[head]
    return p, starts[head], starts[tail], h[p]


def samples_of(texts: list[str | None], length: int = LENGTH, gram: int = GRAM):
    """Per sample: text number, position, smallest and largest left offset, gram hash, context hash or None."""
    out = []
    reach = length - gram

    def emit(doc, p, lmin, lmax, h, data):
        n = len(data)
        ctx = [xxhash.xxh3_128_digest(data[x - reach:x + length]) if x >= reach and x + length <= n else None
               for x in p.tolist()]
        out.append((doc, p, lmin, lmax, h.view(np.int64), ctx))

    for first, last, buf, starts in text_chunks(texts, lower=False):
        if last - first == 1 and len(buf) > _STRETCH:
            n = len(buf) - 1
            parts = []
            for a in range(0, max(0, n - length + 1), _STRETCH):
                piece = buf[a:min(n, a + _STRETCH + length - 1)]
                p, s0, s1, h = _samples(piece, np.ones(len(piece), bool), length, gram)
                parts.append((p + a, s0 + a, s1 + a, h))
            if not parts:
                continue
            p, s0, s1, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(p, kind="stable")
            p, s0, s1, h = p[order], s0[order], s1[order], h[order]
            head = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            s0, s1 = np.minimum.reduceat(s0, head), np.maximum.reduceat(s1, head)
            p, h = p[head], h[head]
            emit(np.full(len(p), first), p, p - s1, p - s0, h, memoryview(buf[:n]))
            continue
        if len(buf) < length:
            continue
        lens = np.diff(starts) - 1
        edge = np.zeros(len(buf) + 1, np.int64)
        long = np.flatnonzero(lens >= length)
        np.add.at(edge, starts[:-1][long], 1)
        np.add.at(edge, starts[:-1][long] + lens[long] - length + 1, -1)
        p, s0, s1, h = _samples(buf, np.cumsum(edge)[:len(buf)] > 0, length, gram)
        doc = np.searchsorted(starts, p, side="right") - 1
        bounds = np.searchsorted(doc, np.arange(len(lens) + 1))
        for d in np.unique(doc):
            i, j, at = bounds[d], bounds[d + 1], starts[d]
            emit(np.full(j - i, first + d), p[i:j] - at, p[i:j] - s1[i:j], p[i:j] - s0[i:j], h[i:j],
                 memoryview(buf[at:at + lens[d]]))
    return out


def _sample_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            doc, th, texts = b.column(0), b.column(1), b.column(2)
            for lo in range(0, b.num_rows, 512):
                for d, p, lmin, lmax, h, ctx in samples_of(texts.slice(lo, 512).to_pylist(), length, gram):
                    at = pa.array(d + lo)
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(at), th.take(at), pa.array(p), pa.array(lmin, pa.int32()), pa.array(lmax, pa.int32()),
                         pa.array(h), pa.array(ctx, pa.binary())],
                        names=["doc_id", "th", "p", "lmin", "lmax", "gram", "context"])

    return docs.mapInArrow(run, "doc_id long, th long, p long, lmin int, lmax int, gram long, context binary")


def _contexts(docs: DataFrame, open_: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes around each open sample (``left`` of them before it)."""
    per_doc = open_.groupBy("doc_id", "th").agg(F.collect_set(F.struct("p", "lmin", "lmax")).alias("samples"))
    both = docs.alias("d").join(per_doc.alias("s"), C("d.doc_id").eqNullSafe(C("s.doc_id")) & (C("d.th") == C("s.th")))
    reach = length - gram

    def run(batches):
        for b in batches:
            texts, samples = b.column(2), b.column(3)
            for i in range(b.num_rows):
                data = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
                s = samples[i].values
                p = s.field("p").to_numpy()
                m = len(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(b.column(0)[i], m), pa.repeat(b.column(1)[i], m), s.field("p"), s.field("lmin"),
                     s.field("lmax"), pa.array([data[max(0, x - reach):x + length] for x in p.tolist()], pa.binary()),
                     pa.array(np.minimum(p, reach).astype(np.int32))],
                    names=["doc_id", "th", "p", "lmin", "lmax", "bytes", "left"])

    return both.select("d.doc_id", "d.th", "d.text", "s.samples").mapInArrow(
        run, "doc_id long, th long, p long, lmin int, lmax int, bytes binary, left int")


def _identifiers(ranges: DataFrame, width: int, length: int) -> DataFrame:
    """Splits each ``[lo, hi]`` into ranges of ``width`` left offsets with the bucket identifiers of each.

    ``core`` names what all windows of the range share, ``whole`` all of them
    joined (null where the text ends inside).
    """
    def run(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            rows = {k: [] for k in ("uid", "p", "lo", "core", "whole")}
            for i in range(b.num_rows):
                data, left = cols["bytes"][i].as_py(), cols["left"][i].as_py()
                lmin, lmax = cols["lmin"][i].as_py(), cols["lmax"][i].as_py()
                uid, right = cols["uid"][i].as_py(), len(data) - left
                for parent in cols["los"][i].as_py():
                    top = min(parent + width * FAN - 1, lmax)
                    for lo in range(parent, top + 1, width):
                        hi = lo + width - 1
                        if hi < lmin:
                            continue
                        seed = lo * 1024 + width
                        core = data[left - lo:left + max(length - hi, 0)]
                        whole = hi <= left and length - lo <= right
                        rows["uid"].append(uid)
                        rows["lo"].append(lo)
                        rows["core"].append(xxhash.xxh3_64_intdigest(core, seed) - (1 << 63))
                        rows["whole"].append(xxhash.xxh3_128_digest(data[left - hi:left + length - lo], seed)
                                             if whole else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["uid"], pa.int64()), pa.array(rows["lo"], pa.int32()),
                 pa.array(rows["core"], pa.int64()), pa.array(rows["whole"], pa.binary())],
                names=["uid", "lo", "core", "whole"])

    return ranges.select("uid", "lmin", "lmax", "bytes", "left", "los").mapInArrow(
        run, "uid long, lo int, core long, whole binary")


def _buckets_of_two(rows: DataFrame, key: str) -> DataFrame:
    """Keys of two rows or more, with their number."""
    return rows.where(C(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _judged(rows: DataFrame, of: DataFrame, key: str, total: int) -> DataFrame:
    """Rows with a key, and whether the key is there twice in ``of`` (``total`` rows)."""
    twice = _buckets_of_two(of, key).withColumn("twice", F.lit(True))
    return hot_join(rows.where(C(key).isNotNull()), twice, key, total, "left")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs(doc_id, th, text)`` -> ``(doc_id, th, a, b)``: byte ranges covered by repeated strings."""
    reach = length - gram
    if length - gram + 1 > FAN ** 3:
        raise ValueError("length - gram must stay below 343")
    staging = Staging(docs.sparkSession, "suffixes")
    every = staging.put(_sample_table(docs, length, gram), "samples")
    shared = staging.put(hot_join(every, _buckets_of_two(every, "gram"), "gram", every.count(), "left_semi"), "shared")
    staging.drop(every)
    judged = _judged(shared, shared, "context", shared.count())
    found = [judged.where("twice").select("doc_id", "th", (C("p") - reach).alias("a"), (C("p") + length).alias("b"))]
    cols = ["doc_id", "th", "p", "lmin", "lmax", "gram"]
    open_ = judged.where("twice is null").select(cols).union(shared.where("context is null").select(cols))
    # a context found twice stays on as a witness (once) where its bucket still has open samples
    witness = (judged.where("twice").groupBy("context").agg(F.min(F.struct(*cols)).alias("w")).select("w.*")
               .join(open_.select("gram").distinct(), "gram", "left_semi").select(cols))
    open_ = open_.union(witness)
    samples = staging.put(_contexts(docs, open_, length, gram)
                          .withColumn("uid", F.monotonically_increasing_id()), "contexts")
    todo = samples.withColumn("los", F.array(F.lit(0)))
    for width in (FAN * FAN, FAN, 1):
        ids = staging.put(_identifiers(todo, width, length), f"ids{width}")
        total = ids.count()
        alive = hot_join(ids, _buckets_of_two(ids, "core"), "core", total, "left_semi")
        verdict = staging.put(_judged(alive, ids, "whole", total)
                              .select("uid", "lo", "core", "whole", F.coalesce("twice", F.lit(False)).alias("twice"))
                              .union(alive.where("whole is null").select("uid", "lo", "core", "whole", F.lit(False))),
                              f"verdict{width}")
        staging.drop(ids)
        found.append(verdict.where("twice").join(samples.select("uid", "doc_id", "th", "p"), "uid").select(
            "doc_id", "th", (C("p") - C("lo") - (width - 1)).alias("a"), (C("p") - C("lo") + length).alias("b")))
        left = verdict.where("not twice")
        witness = (verdict.where("twice").groupBy("whole").agg(F.min(F.struct("uid", "lo", "core")).alias("w"))
                   .select("w.*").join(left.select("core").distinct(), "core", "left_semi"))
        todo = samples.join(left.select("uid", "lo").union(witness.select("uid", "lo")).groupBy("uid")
                            .agg(F.collect_list("lo").alias("los")), "uid")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_row: bool = False) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` per document: removed byte ranges (maximal) and the bytes that stay.

    ``with_row`` adds ``row``, the document's other columns as a struct, and ``text``, the characters that stay whole.
    """
    others = [C(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*others) if with_row and others else F.struct(F.lit(0).alias("_"))
    keyed = docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").alias("text"), row.alias("row")) \
                .withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    ranges = (repeated_ranges(keyed.select("doc_id", "th", "text"), length, gram)
              .groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("ranges")))
    both = keyed.alias("d").join(
        ranges.alias("r"), C("d.doc_id").eqNullSafe(C("r.doc_id")) & (C("d.th") == C("r.th")), "left")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n_bytes, spans, kept = [], [], []
                for text, r in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    n_bytes.append(len(data))
                    own, pieces, done = [], [], 0
                    if r.is_valid:
                        a = np.clip(r.values.field("a").to_numpy(), 0, len(data))
                        e = np.clip(r.values.field("b").to_numpy(), 0, len(data))
                        order = np.argsort(a, kind="stable")
                        a, e = a[order], np.maximum.accumulate(e[order])
                        head = np.flatnonzero(np.concatenate(([True], a[1:] > e[:-1])))
                        for s, t in zip(a[head].tolist(), e[np.append(head[1:], len(a)) - 1].tolist(), strict=True):
                            own.append({"start": s, "end": t})
                            pieces.append(data[done:s])
                            done = t
                    pieces.append(data[done:])
                    spans.append(own)
                    kept.append(b"".join(pieces))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n_bytes, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array(kept, pa.binary()),
                     pa.array([k.decode("utf-8", "ignore") if with_row else None for k in kept], pa.string())],
                    names=["doc_id", "row", "n_bytes", "spans", "kept", "text"])

    kind = keyed.schema["row"].dataType.simpleString()
    out = both.select("d.doc_id", "d.row", "d.text", "r.ranges").mapInArrow(
        run, f"doc_id long, row {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary, text string")
    return out if with_row else out.drop("row", "text")
