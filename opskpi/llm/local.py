"""Small numpy helpers used inside tasks: key runs of sorted batches, union-find, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS = {"p": np.ones(1, _U), "i": np.ones(1, _U)}

#: Longest stretch of bytes hashed at once (a longer text is one stretch of its own).
CHUNK_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n + 1`` of them."""
    if len(_POWERS["p"]) <= n:
        m = max(n + 1, CHUNK_BYTES + 1)
        for k, b in (("p", _BASE), ("i", _INV)):
            steps = np.full(m, b, _U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS["p"], _POWERS["i"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of ``(byte + 1) * base**i`` modulo 2**64; length ``len(buf) + 1``."""
    p, _ = _powers(len(buf))
    out = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * p[:len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each ``[start, end)``: equal strings have equal hashes wherever they stand."""
    _, inv = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inv[start])


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 buffer."""
    edge = np.diff(np.concatenate(([True], _BLANK[buf], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def text_chunks(texts: list[str | None], lower: bool = True,
                limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Joins texts by newlines to buffers of about ``limit`` bytes: (first, last, buffer, text starts)."""
    part: list[bytes] = []
    size, first = 0, 0

    def flush(last: int):
        lens = np.fromiter((len(b) for b in part), np.int64, len(part))
        starts = np.concatenate(([0], np.cumsum(lens + 1)))
        return first, last, np.frombuffer(b"\n".join(part) + b"\n", np.uint8), starts

    for i, t in enumerate(texts):
        b = ((t or "").lower() if lower else (t or "")).encode("utf-8", "surrogatepass")
        if part and size + len(b) > limit:
            yield flush(i)
            part, size, first = [], 0, i
        part.append(b)
        size += len(b) + 1
    if part:
        yield flush(len(texts))


class Links:
    """Union-find over ``0 .. n-1`` with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x < y:
            self.up[y] = x
        else:
            self.up[x] = y
        return True

    def link_matrix(self, linked: np.ndarray, rows: np.ndarray | None = None,
                    cols: np.ndarray | None = None) -> None:
        """Links row ``i`` to column ``j`` wherever ``linked[i, j]``; frontier search, no pair list."""
        n, m = linked.shape
        rows = np.arange(n) if rows is None else rows
        cols = np.arange(m) if cols is None else cols
        todo_r, todo_c = np.ones(n, bool), np.ones(m, bool)
        for i in range(n):
            if not todo_r[i]:
                continue
            todo_r[i] = False
            front = [i]
            while front:
                hit = linked[front].any(axis=0) & todo_c
                found = np.flatnonzero(hit)
                todo_c[found] = False
                for j in found:
                    self.link(int(rows[i]), int(cols[j]))
                if not len(found):
                    break
                back = linked[:, found].any(axis=1) & todo_r
                front = np.flatnonzero(back).tolist()
                todo_r[front] = False
                for r in front:
                    self.link(int(rows[i]), int(rows[r]))

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.up))), np.int64, len(self.up))


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 1) -> Iterator[pa.Table]:
    """Consecutive rows with equal integer ``keys`` out of batches sorted by them, over batch borders.

    Holds one batch and the run that is open; runs shorter than ``at_least``
    are passed over without being built.
    """
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None

    def close():
        if held and sum(b.num_rows for b in held) >= at_least:
            yield pa.Table.from_batches(held)

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [b.num_rows]))
        first = tuple(c[0] for c in cols)
        if held and held_key != first:
            yield from close()
            held = []
        if len(cuts) == 2:
            held.append(b)
            held_key = first
            continue
        if held:
            held.append(b.slice(0, cuts[1]))
            yield from close()
        elif cuts[1] >= at_least:
            yield pa.Table.from_batches([b.slice(0, cuts[1])])
        inner = np.flatnonzero(np.diff(cuts[1:-1]) >= at_least) + 1
        for i in inner:
            yield pa.Table.from_batches([b.slice(cuts[i], cuts[i + 1] - cuts[i])])
        held = [b.slice(cuts[-2], cuts[-1] - cuts[-2])]
        held_key = tuple(c[-1] for c in cols)
    yield from close()


class IdMemory:
    """Sequences of token ids by a 64-bit key, in sorted arrays; starts anew when it holds ``limit`` keys."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.flat = np.zeros(0, _U), np.zeros(0, "<u4")
        self.at = self.n = np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key and whether it is known."""
        i = np.searchsorted(self.keys, keys)
        i[i == len(self.keys)] = 0
        return i, (self.keys[i] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """Sorted new keys with their ids as little-endian unsigned 32-bit integers."""
        n = np.fromiter((len(d) // 4 for d in ids), np.int64, len(ids))
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), "<u4")))
        where = np.searchsorted(self.keys, keys)
        self.at, self.n = np.insert(self.at, where, at), np.insert(self.n, where, n)
        self.keys = np.insert(self.keys, where, keys)

    def lay_out(self, keys: np.ndarray, learn) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all keys in a row, and where those of each end; ``learn(first places)`` gives unknown ones.

        Keys are looked up once each and in order, which reads the sorted arrays front to back.
        """
        if len(self.keys) > self.limit:
            self.clear()
        kinds, first, kind = np.unique(keys, return_index=True, return_inverse=True)
        at, known = self.find(kinds)
        if not known.all():
            self.add(kinds[~known], learn(first[~known]))
            at, _ = self.find(kinds)
        at = at[kind]
        n = self.n[at]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(self.at[at] - end + n, n) + np.arange(total)], end
