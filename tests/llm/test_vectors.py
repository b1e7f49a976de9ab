from __future__ import annotations

import numpy as np

from opskpi.llm.vectors import near_vectors, plan
from tests.llm.cases import Sets


def brute(rows):
    def good(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    groups, links = Sets(range(len(rows))), [0] * len(rows)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if good(a) and good(b) and len(a) == len(b):
                x, y = np.asarray(a, np.float64), np.asarray(b, np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    links[i] += 1
                    links[j] += 1
                    groups.join(i, j)
    least = {}
    for i, (v, _) in enumerate(rows):
        least[groups.find(i)] = min(least.get(groups.find(i), v), v)
    return sorted((v, links[i], least[groups.find(i)], v == least[groups.find(i)]) for i, (v, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "?", 0) for i, v in rows],
                               "vec_id long, embedding array<double>, name string, label int").repartition(3)
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect())


def clusters(seed, dims, sizes, spread):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        c = rng.standard_normal(dims)
        out += [(c + spread * rng.standard_normal(dims)).tolist() for _ in range(n)]
    return out


def test_clusters_and_borders(spark):
    vectors = clusters(1, 32, [1, 2, 5, 30, 60], 0.22) + clusters(2, 32, [40], 0.3)
    rows = list(enumerate(vectors))
    want = brute(rows)
    assert any(0 < w[1] for w in want)
    got = run(spark, rows)
    assert got == want


def test_defined_cases(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (2, one), (2, one), (3, [2.0, 4.0, 6.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, []),
            (7, [1.0, None, 3.0]), (8, [1.0, float("nan"), 3.0]), (9, [float("inf"), 2.0, 3.0]), (10, [1.0, 2.0]),
            (11, [-1.0, -2.0, -3.0]), (12, [0.0, 0.0, 0.0]), (13, [1e300, 2e300, 3e300]), (14, [1e-200, 2e-200, 3e-200])]
    want = [w for w in brute([r for r in rows if r[0] < 13])]
    got = run(spark, rows)
    # the scale of a vector does not matter, however large: 13 and 14 link with 1, 2, 2 and 3
    assert [g for g in got if g[0] in (13, 14)] == [(13, 5, 1, False), (14, 5, 1, False)]
    assert [(a, b + (2 if a in (1, 2, 3) else 0), c, d) for a, b, c, d in want] == [g for g in got if g[0] < 13]


def test_a_group_larger_than_a_cell(spark, monkeypatch):
    import opskpi.llm.vectors as v

    monkeypatch.setattr(v, "CELL", 16)
    monkeypatch.setattr(v, "BUCKET", 16)
    rows = list(enumerate(clusters(5, 16, [90, 50], 0.15) + [[1.0] * 16] * 30))
    assert run(spark, rows) == brute(rows)


def test_plan_grows_slowly():
    sizes = [plan(n) for n in (10, 10 ** 4, 10 ** 7)]
    assert sizes[0][0] <= sizes[1][0] < sizes[2][0] and sizes[2][1] < 400


def test_empty_table(spark):
    assert run(spark, []) == []
