"""Vector best-fit packing of tokenised documents into sequences.

Every piece is a vector (tokens, documents, attention cost = tokens squared),
and every sequence has a capacity in each of the three.  Pieces are placed in
decreasing length into the open sequence that the rule prefers among those
with room in every dimension:

* ``norm`` - smallest weighted norm of the residual that would be left (best fit),
* ``dot``  - largest weighted dot-product of residual and piece.

A piece's vector depends on its length alone, so the whole corpus is packed
from its histogram of lengths - at most ``max_tokens`` rows, whatever the size
of the corpus.  The result is a table of placements (a run of equal pieces
laid out over a run of equal sequences); each piece finds its place by its
rank among the pieces of its length.  The rank is a count inside the task plus
an offset of the task, so no length is gathered into one task.

Text that spells a token added to the vocabulary (``<|endoftext|>``) gets that
token's id, as the library gives it by default: such texts go through the whole
tokenizer, all others word by word.

Defined cases: null text packs as empty text (only the end token); a repeated
row is packed again; an empty table gives no rows; further input columns are
ignored.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opskpi.llm.local import IdMemory, prefix_hash, span_hash, text_chunks, word_spans
from opskpi.llm.staging import Staging

C = F.col
END_ID = 1
MAX_TOKENS = 4096

#: Words, and parts of words, whose ids a worker remembers; a full memory starts anew (speed only, never the result).
WORD_MEMORY = 1_000_000
PART_MEMORY = 150_000
_LONG_WORD = 48
_PLAIN = "\u0250"  # below it a character is in normal form and has no sense for its neighbours

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, seq long"


class WordTokenizer:
    """A ``tokenizers`` file whose pre-tokenizer never crosses white space, with a memory of words.

    Words of plain characters are lower-cased, split by the file's own pattern
    and handed to the file's BPE model, many to a call; all others go through
    the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.memory = IdMemory(WORD_MEMORY)
        self.parts: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.split = regex.compile(split["pattern"]["Regex"])
        assert level["type"] == "ByteLevel" and not level["use_regex"] and suffix
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in
                self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        for lo in range(0, len(parts), 1000):
            own = parts[lo:lo + 1000]
            text = "\n".join(own).encode().decode("latin-1").translate(self.letters)
            ids = np.asarray(self.model.encode(text.replace(self.letters[10], " "),
                                               add_special_tokens=False).ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            assert len(cuts) == len(own) + 1
            data = ids.tobytes()
            self.parts.update(zip(own, [data[i:j] for i, j in itertools.pairwise(cuts)], strict=True))

    def _ids(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        split, other = [], []
        for i, w in enumerate(words):
            if len(w) <= _LONG_WORD and max(w) < _PLAIN and min(w) > " ":
                low = w.lower()
                split.append((i, [low] if low.isalpha() else self.split.findall(low)))
            else:
                other.append(i)
        if len(self.parts) > PART_MEMORY:
            self.parts.clear()
        parts = self.parts
        self._learn_parts(list({x for _, s in split for x in s if x not in parts}))
        for i, s in split:
            out[i] = parts[s[0]] if len(s) == 1 else b"".join([parts[x] for x in s])
        if other:
            for i, data in zip(other, self._whole([words[i] for i in other]), strict=True):
                out[i] = data
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A word is known by a 64-bit hash of its bytes; looking up and laying
        out the ids of the words of a stretch are a few array operations.
        """
        odd = [i for i, t in enumerate(texts) if t and any(a in t for a in self.added)]
        if odd:
            whole = dict(zip(odd, self._whole([texts[i] for i in odd]), strict=True))
            plain = self.encode([None if i in whole else t for i, t in enumerate(texts)])
            return [whole.get(i, ids) for i, ids in enumerate(plain)]
        out: list[bytes] = []
        for _, _, buf, starts in text_chunks(texts, lower=False):
            a, b = word_spans(buf)
            raw = buf.tobytes()

            def learn(new):
                return self._ids([raw[i:j].decode() for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True)])

            ids, end = self.memory.lay_out(span_hash(prefix_hash(buf), a, b), learn)
            data = ids.tobytes()
            cuts = np.concatenate(([0], end))[np.searchsorted(a, starts)] * 4
            out.extend(data[i:j] for i, j in itertools.pairwise(cuts.tolist()))
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids plus the end id; ``task``/``seq`` number equal lengths."""

    def run(batches):
        tok = _tokenizer(path)
        end = np.asarray([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        used = np.zeros(max_tokens + 1, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(ids), 256):
                rows = {k: [] for k in ("doc_id", "piece", "start", "length", "crc", "ids", "seq")}
                coded = tok.encode(texts[lo:lo + 256])
                for doc, data in zip(ids[lo:lo + 256], coded, strict=True):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * max_tokens)):
                        own = data[at:at + 4 * max_tokens]
                        n = len(own) // 4
                        rows["doc_id"].append(doc)
                        rows["piece"].append(k)
                        rows["start"].append(at // 4)
                        rows["length"].append(n)
                        rows["crc"].append(zlib.crc32(own))
                        rows["ids"].append(own if with_ids else None)
                        rows["seq"].append(int(used[n]))
                        used[n] += 1
                m = len(rows["piece"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()),
                     pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()),
                     pa.array(rows["crc"], pa.int64()), pa.array(rows["ids"], pa.binary()),
                     pa.array(np.full(m, task, np.int32)), pa.array(rows["seq"], pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "seq"])

    return docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").alias("text")) \
               .mapInArrow(run, PIECES)


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most; ``None`` leaves a dimension to the token capacity."""

    tokens: int = MAX_TOKENS
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> tuple[int, int, int]:
        return (self.tokens, self.documents or self.tokens, self.attention or self.tokens ** 2)


@dataclass(frozen=True)
class Placements:
    """Per length: ranks from ``rank0`` on, ``per_bin`` to a sequence from ``bin0`` on, from ``offset`` on."""

    length: np.ndarray
    rank0: np.ndarray
    per_bin: np.ndarray
    bin0: np.ndarray
    offset: np.ndarray
    bins: int

    def locate(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of the given lengths and ranks."""
        shift = np.int64(1) << 44
        key = self.length * shift + self.rank0
        at = np.searchsorted(key, length * shift + rank, side="right") - 1
        k = rank - self.rank0[at]
        return self.bin0[at] + k // self.per_bin[at], self.offset[at] + k % self.per_bin[at] * length


def best_fit(histogram: dict[int, int], capacity: Capacity = Capacity(), rule: str = "norm",
             weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Placements:
    """Packs ``{length: pieces}``; equal sequences are handled together as one group."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    cap = np.asarray(capacity.vector(), np.float64)
    w = np.asarray(weights, np.float64)
    res = np.zeros((1024, 3))
    count = np.zeros(1024, np.int64)   # sequences of the group
    first = np.zeros(1024, np.int64)   # their first number
    groups, bins = 0, 0
    rows: list[tuple[int, int, int, int, int]] = []

    def add(residual: np.ndarray, n: int, at: int) -> None:
        nonlocal res, count, first, groups
        if residual[0] < 1 or residual[1] < 1 or residual[2] < 1:
            return
        if groups == len(count):
            res, count, first = np.vstack([res, res * 0]), np.tile(count, 2), np.tile(first, 2)
        res[groups], count[groups], first[groups] = residual, n, at
        groups += 1

    def remove(g: int) -> None:
        nonlocal groups
        groups -= 1
        res[g], count[g], first[g] = res[groups], count[groups], first[groups]

    for length in sorted(histogram, reverse=True):
        left, rank = int(histogram[length]), 0
        item = np.asarray((length, 1, length * length), np.float64)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity of {capacity}")
        while left:
            r = res[:groups]
            fits = np.flatnonzero((r >= item).all(axis=1))
            if len(fits):
                scaled = (r[fits] - (item if rule == "norm" else 0)) / cap
                score = (w * scaled * scaled).sum(axis=1) if rule == "norm" else -(w * scaled * item / cap).sum(axis=1)
                g = int(fits[np.lexsort((first[fits], score))[0]])
                residual, n, at = res[g].copy(), int(count[g]), int(first[g])
                each = int((residual // item).min()) if rule == "norm" else 1
                remove(g)
            else:
                residual, at = cap.copy(), bins
                each = int((residual // item).min())
                n = math.ceil(left / each)
                bins += n
            offset = int(cap[0] - residual[0])
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, each, at, offset))
                rank += whole * each
                left -= whole * each
                add(residual - each * item, whole, at)
            if whole < n:
                rest = left if left < each else 0
                if rest:
                    rows.append((length, rank, each, at + whole, offset))
                    rank += rest
                    left -= rest
                    add(residual - rest * item, 1, at + whole)
                if n - whole - (rest > 0):
                    add(residual, n - whole - (rest > 0), at + whole + (rest > 0))
    table = np.asarray(sorted(rows), np.int64).reshape(-1, 5)
    return Placements(*(np.ascontiguousarray(table[:, i]) for i in range(5)), bins)


def pack(docs: DataFrame, path: str, capacity: Capacity = Capacity(), rule: str = "norm",
         weights: tuple[float, float, float] = (1.0, 1.0, 1.0), end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset (``ids`` holds the tokens if asked for)."""
    spark = docs.sparkSession
    tokens, _, attention = capacity.vector()
    staging = Staging(spark, "packing")
    pieces = staging.put(token_pieces(docs, path, min(tokens, math.isqrt(attention)), end_id, with_ids), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = spark.sparkContext.broadcast(best_fit(histogram, capacity, rule, weights))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        plan = layout.value
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            sequence, offset = plan.locate(col["length"].to_numpy(), col["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(col[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")),
                 pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    ranked = pieces.join(base, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (C("base") + C("seq")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "ids binary, sequence_id long, offset long")
