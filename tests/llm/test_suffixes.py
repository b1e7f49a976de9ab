from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from opskpi.llm.suffixes import remove_repeats, samples_of
from tests.llm.cases import awkward, frame


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s:s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((i, len(b), tuple(spans), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    return sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"]))
                   for r in remove_repeats(frame(spark, rows), **kw).collect()), key=repr)


def test_awkward_documents(spark):
    rows = [(i, t[:4000] if t else t) for i, t in awkward()]
    assert run(spark, rows) == brute(rows, 400)


@pytest.mark.parametrize("seed", [0, 1])
def test_patched_documents(spark, seed):
    """Pieces of a pool put together: repeats of all lengths around the limit, at every kind of border."""
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefgh ") for _ in range(700)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(pool)
            a = r.choice((0, r.randint(0, 300)))
            parts.append(p[a:a + r.choice((60, 90, 119, 120, 121, 150, 300, 400))])
            if r.random() < 0.5:
                parts.append("".join(r.choice("ijkl") for _ in range(r.randint(0, 60))))
        rows.append((i, "".join(parts)))
    assert run(spark, rows, length=120, gram=16) == brute(rows, 120)


def test_equal_windows_sample_the_same_place():
    r = random.Random(4)
    shared = "".join(r.choice("abcdef") for _ in range(900))
    texts = [shared, "zz" + shared[13:] + "qq", shared[:500]]
    found = []
    for doc, p, lmin, lmax, _, _ in samples_of(texts):
        found += list(zip(doc.tolist(), p.tolist(), lmin.tolist(), lmax.tolist(), strict=True))
    place = {}
    for doc, p, lmin, lmax in found:
        for left in range(lmin, lmax + 1):
            window = texts[doc][p - left:p - left + 400]
            assert place.setdefault(window, left) == left
    assert len(place) >= 501


def test_long_text_in_stretches(monkeypatch):
    import opskpi.llm.suffixes as s

    text = "".join(random.Random(2).choice("abcd") for _ in range(9000))
    whole = [(p.tolist(), a.tolist(), b.tolist()) for _, p, a, b, _, _ in s.samples_of([text])]
    monkeypatch.setattr(s, "_STRETCH", 1000)
    assert [(p.tolist(), a.tolist(), b.tolist()) for _, p, a, b, _, _ in s.samples_of([text])] == whole


def test_empty_table_and_row(spark):
    assert run(spark, []) == []
    rows = [(1, "é" * 500), (2, "é" * 500 + "tail")]
    got = {r["doc_id"]: r for r in remove_repeats(frame(spark, rows), with_row=True).collect()}
    assert got[1]["text"] == "" and got[2]["text"] == "tail"
    assert got[1]["row"]["source"] is None and got[2]["row"]["n_chars"] == 504
