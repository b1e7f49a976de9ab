from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

import opskpi.llm.codes as codes
from opskpi.llm.codes import compress, digest, dual_tree, plant


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd with Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    d = width // parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(Fraction(x) * 4096) for x in r[1]]))
    x = [[math.floor(Fraction(c) * 4096) for c in v] + [0] * (width - len(v)) for _, v, _ in kept]
    books = [[list(row[p * d:(p + 1) * d]) for row in x[:entries]] for p in range(parts)]

    def nearest(p, row):
        part = row[p * d:(p + 1) * d]
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        sums = defaultdict(lambda: [0] * (d + 1))
        for row in x:
            for p in range(parts):
                s = sums[p, nearest(p, row)[1]]
                s[d] += 1
                for k in range(d):
                    s[k] += row[p * d + k]
        for (p, e), s in sums.items():
            books[p][e] = [v // s[d] for v in s[:d]]
    found = [[nearest(p, row) for p in range(parts)] for row in x]
    errors = [sum(e for e, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for _, c in f), e, by_label[lab], sha)
                   for (i, _, lab), f, e in zip(kept, found, errors)), key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, lab, "?", 0) for i, v, lab in rows],
                               "vec_id long, embedding array<double>, label int, ids string, entry int").repartition(parts)
    got = digest(*compress(df)).collect() if rows else compress(df)[0].collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=str)


def clusters(seed, n, width, spread=0.1, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, width))
    return [(int(i), (c[i % centres] + spread * rng.standard_normal(width)).tolist(), int(i % 5) if i % 7 else None)
            for i in rng.permutation(n)]


@pytest.mark.parametrize(("n", "width", "spread"), [(300, 32, 0.05), (300, 64, 1.0), (9, 16, 0.3), (700, 8, 0.2)])
def test_brute_force(spark, n, width, spread):
    rows = clusters(n, n, width, spread)
    assert run(spark, rows) == brute(rows)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 16 * 40)
    rows = clusters(4, 500, 16, 0.2)
    assert run(spark, rows, 4) == brute(rows)


def test_ties_repeats_and_defined_cases(spark):
    rows = [(i, [float(i % 3)] * 16, i % 2) for i in range(40)]             # equal entries: the lower index
    rows += [(5, [9.0] * 16, None), (5, [8.0] * 16, 1), (None, [0.5] * 16, 3), (50, None, 0), (51, [1.0, None] * 8, 0),
             (52, [float("nan")] * 16, 0), (53, [float("inf")] * 16, 1), (54, [], 4), (55, [-0.0001, 0.25], 4)]
    rows += [(60, [float(k) for k in range(13)], 9)] * 3
    assert run(spark, rows) == brute(rows)


def test_huge_components_stay_exact(spark):
    rows = [(i, [(i % 5) * 1e6 + k for k in range(8)], 0) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    # 2**40 and more: distances leave 64 bits and are taken as Python integers; errors end at the largest long
    rows = [(i, [float(i % 20) * 2.0 ** 45 + k for k in range(8)], 0) for i in range(60)] + [(99, [1e300, -3.3e38] * 4, 1)]
    most = (1 << 63) - 1
    want = [(i, c, min(e, most), min(sum(min(x[2], most) for x in brute(rows) if (x[0] == 99) == (i == 99)), most), h)
            for i, c, e, _, h in brute(rows)]
    assert run(spark, rows) == want


def test_no_vectors(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, None, 1), (2, [None], 2)], "vec_id long, embedding array<float>, label int")
    assert digest(*compress(df)).collect() == []


def test_whole_boxes_are_assigned():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))
    x = x[plant(x)]
    found, counts, sums, single = dual_tree(x, centres)
    apart = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (found == apart.argmin(axis=1)).all()
    assert (counts == np.bincount(found, minlength=16)).all()
    assert all((sums[e] == x[found == e].sum(axis=0)).all() for e in range(16))
    assert single < 1200        # most rows go with their box
