"""Byte-level BPE as a finite-state transducer, and streaming decode.

The merges of a rank file define one encoding for every string, and a token
sequence is that encoding exactly if each token encodes itself and each pair
of neighbours encodes to itself.  So the encodings are the paths of a
transducer that reads bytes along a trie of the tokens and, at a token's end,
may emit it if it is compatible with the token before.  It is made
deterministic lazily: a state is the set of its live readings - the tokens
read but not yet emitted and the trie node reached since - and what all
readings agree on is emitted at once.  No reading lives longer than the
longest token, so the lookahead is bounded.  Transitions are computed when
first taken and remembered.

Texts are split by the pattern of the rank files on code-point classes (array
operations); a piece met before is answered from a memory, a new one runs
through the transducer.  A piece that is a token itself is that token.

Decoding joins the tokens' bytes in blocks of any size; a UTF-8 state machine
holds back the bytes of a character that is not complete yet.

Defined cases: null text is empty (no ids, no bytes); strings of special
tokens are ordinary text; a repeated row is encoded again; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opskpi.llm.local import IdMemory, prefix_hash, span_hash

C = F.col
#: Pieces whose ids a worker remembers (a full memory starts anew), and transducer states it keeps (further ones are
#: computed each time); for speed and memory only.
PIECE_MEMORY = 2_500_000
STATES = 60_000
_STRETCH = 1 << 18

#: White space of the pattern (fixed values: the Unicode property White_Space).
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000)
#: Endings split off after an apostrophe (fixed values of the pattern).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


class Transducer:
    """Encoder of single pieces for ``ranks`` (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.accept: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for c in token:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.accept.append(-1)
                node = self.child[node][c]
            self.accept[node] = i
        self._pairs: dict[tuple[int, int], bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._number: dict[tuple, int] = {}
        self._readings: list[tuple] = []
        self._next: dict[int, tuple[int | tuple, tuple]] = {}
        self.initial = self._state((-1, (((), 0),)))

    def _state(self, readings: tuple) -> int | tuple:
        """Number of a state; the state itself where the memory of states is full."""
        n = self._number.get(readings)
        if n is not None:
            return n
        if len(self._readings) >= STATES:
            return readings
        n = self._number[readings] = len(self._readings)
        self._readings.append(readings)
        return n

    def merge(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """The parts of a piece after merging pairs of lowest rank until ``down_to`` are left, or none can be."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        got = self._split.get(token, 0)
        if got == 0:
            piece = self.tokens[token]
            got = None
            if len(piece) > 1:
                parts = self.merge(piece, 2)
                got = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
            self._split[token] = got
        return got

    def _follows(self, a: int, b: int) -> bool:
        """Whether ``b`` may come after ``a`` (-1: at the start) in an encoding.

        Undoes the merges inside ``a`` and ``b`` from the last to the first; if
        at any time the two parts that face each other would have been merged
        sooner than the merge undone last, the border between them would be gone.
        """
        own = self._halves(b)
        if own is not None and own[0] < 0:
            return False  # merging never makes this token
        if a < 0:
            return True
        x, y, before = a, b, (1 << 30, 0)
        while True:
            across = self.ranks.get(self.tokens[x] + self.tokens[y])
            if across is not None and (across, 1) < before:
                return False
            left, right = self._halves(x), self._halves(y)
            if left is None and right is None:
                return True
            # equal ranks merge from the left: the right token's merge is the later one of a tie
            if right is None or left is not None and (x, 0) > (y, 2):
                x, before = left[1], (x, 0)
            else:
                y, before = right[0], (y, 2)

    def _step(self, state: int | tuple, byte: int) -> tuple[int | tuple, tuple]:
        child, accept, pairs = self.child, self.accept, self._pairs
        known = type(state) is int
        last, readings = self._readings[state] if known else state
        live, done = [], None
        for held, node in readings:
            to = child[node].get(byte)
            if to is None:
                continue
            token = accept[to]
            if token >= 0 and done is None:
                prev = held[-1] if held else last
                ok = pairs.get((prev, token))
                if ok is None:
                    ok = pairs[prev, token] = self._follows(prev, token)
                if ok:
                    done = held + (token,)
            if child[to]:
                live.append((held, to))
        most = len(done)
        for held, _ in live:
            if len(held) < most:
                most = len(held)
        agreed = 0
        while agreed < most:
            x = done[agreed]
            for held, _ in live:
                if held[agreed] != x:
                    break
            else:
                agreed += 1
                continue
            break
        if agreed:
            out = done[:agreed]
            live = [(held[agreed:], node) for held, node in live]
            last, done = out[-1], done[agreed:]
        else:
            out = ()
        live.append((done, 0))
        got = (self._state((last, tuple(live))), out)
        if known and type(got[0]) is int:
            self._next[state << 8 | byte] = got
        return got

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, get, out = self.initial, self._next.get, []
        for byte in piece:
            got = get(state << 8 | byte) if type(state) is int else None
            if got is None:
                got = self._step(state, byte)
            state = got[0]
            if got[1]:
                out.extend(got[1])
        # the last reading has nothing open
        out.extend((self._readings[state] if type(state) is int else state)[1][-1][0])
        return out


def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = _SPACE
    return out


_CLASS: list[np.ndarray] = []


def pieces(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in code points; ``first`` marks where texts start."""
    if not _CLASS:
        _CLASS.append(_classes())
    kind = _CLASS[0][points]
    n = len(points)
    prev = np.empty(n, np.uint8)
    prev[0] = 255
    prev[1:] = kind[:-1]
    prev[first] = 255
    start = kind != prev
    # white space before a word: the last character stands alone, or leads the word if it is a blank
    space = kind == _SPACE
    word = start & ~space & (prev == _SPACE)
    at = np.flatnonzero(word)
    blank = points[at - 1] == 0x20
    start[at[blank]] = False
    start[at - 1] = True
    # an apostrophe that starts a match and the ending after it
    lead = np.flatnonzero(start & (points == 0x27))
    for i in lead.tolist():
        for e in ENDINGS:
            m = len(e)
            if i + m < n and all(points[i + 1 + k] == ord(c) for k, c in enumerate(e)) and not first_in(first, i, m):
                start[i + 1] = False
                if i + 1 + m < n:
                    start[i + 1 + m] = True
                break
    return np.flatnonzero(start)


def first_in(first: np.ndarray, at: int, m: int) -> bool:
    """Whether a text starts among the ``m`` points after ``at``."""
    k = np.searchsorted(first, at, side="right")
    return k < len(first) and first[k] <= at + m


class ByteLevelBPE:
    """Whole texts to ids and back for a tiktoken rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.memory = IdMemory(PIECE_MEMORY)
        top = max(ranks.values()) + 1
        self.size = np.zeros(top, np.int64)
        for t, i in ranks.items():
            self.size[i] = len(t)
        self.at = np.cumsum(self.size) - self.size
        tokens = {i: t for t, i in ranks.items()}
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(top)), np.uint8)

    @cached_property
    def transducer(self) -> Transducer:
        return Transducer(self.ranks)

    def _stretch(self, texts: list[str]) -> list[np.ndarray]:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens)
        if not ends[-1]:
            return [np.zeros(0, "<u4") for _ in texts]
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        first = (ends - lens)[lens > 0]
        starts = pieces(points, first)
        stops = np.append(starts[1:], len(points))

        def learn(new):
            return [np.asarray(self.transducer.encode(joined[i:j].encode("utf-8", "surrogatepass")), "<u4").tobytes()
                    for i, j in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]

        ids, end = self.memory.lay_out(span_hash(prefix_hash(points), starts, stops), learn)
        cuts = np.concatenate(([0], end))[np.searchsorted(starts, np.concatenate(([0], ends)))]
        return [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= _STRETCH:
                out.extend(self._stretch(part))
                part, size = [], 0
        if part:
            out.extend(self._stretch(part))
        return out

    def token_bytes(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(self.at[ids] - end + n, n) + np.arange(total)].tobytes()


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the characters complete so far, ``close`` what is left.

    The state is the bytes of an unfinished character; bytes that cannot
    become one turn into U+FFFD.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def _open(data: bytes) -> int:
        """Bytes at the end that begin a character and lack its rest."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back >= 2:  # the second byte decides whether the lead can still be completed
                second = data[-back + 1]
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= second <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self._open(data)
        self.held = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


_CODECS: dict[str, ByteLevelBPE] = {}


def codec(path: str) -> ByteLevelBPE:
    if path not in _CODECS:
        _CODECS[path] = ByteLevelBPE(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` for each row of ``docs(doc_id, text)``."""

    def run(batches):
        bpe = codec(path)
        gc.disable()  # the states hold no cycles, and walking them over and over takes a fifth of the time
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                ids = bpe.encode(b.column(1).to_pylist())
                ends = np.cumsum([len(x) for x in ids])
                offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)],
                                                 names=["doc_id", "ids"])

    return docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").alias("text")) \
               .mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, block: int = 4096) -> DataFrame:
    """``doc_id, ids, text`` for each row of ``rows(doc_id, ids)``; ids are read in blocks, as a stream."""

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                texts = []
                for x in b.column(1):
                    ids = x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)
                    stream = Utf8Stream()
                    texts.append("".join([stream.feed(bpe.token_bytes(ids[i:i + block]))
                                          for i in range(0, len(ids), block)]) + stream.close())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                                 names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
