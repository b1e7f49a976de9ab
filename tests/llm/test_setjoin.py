from __future__ import annotations

import random

import numpy as np

from opskpi.llm.setjoin import near_duplicates, overlaps, runs_for, shingle_sets
from tests.llm.cases import Sets, awkward, edited, frame, prose, words


def shingles(text):
    w = words((text or "").lower())
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Rows are told apart by place; ids may repeat or be null."""
    sets = [shingles(t) for _, t in rows]
    groups, links = Sets(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        g = groups.find(i)
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return sorted(((doc, least.get(groups.find(i)), links[i], doc == least.get(groups.find(i)))
                   for i, (doc, _) in enumerate(rows)), key=repr)


def run(spark, rows):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["kept"])
                   for r in near_duplicates(frame(spark, rows)).collect()), key=repr)


def test_awkward_documents(spark):
    assert run(spark, awkward()) == brute(awkward())


def test_groups_of_near_copies(spark):
    r = random.Random(11)
    rows, at = [], 0
    for k in range(12):
        base = prose(300 + k, r.randint(20, 200))
        for _ in range(r.randint(1, 9)):
            rows.append((at, edited(base, at, r.randint(0, 4))))
            at += 1
    rows += [(at + i, prose(700 + i, 60)) for i in range(40)]
    want = brute(rows)
    assert sum(w[2] for w in want) > 40
    assert run(spark, rows) == want


def test_one_group_larger_than_a_cell(spark):
    base = prose(77, 160)
    rows = [(i, edited(base, i, 1 + i % 2)) for i in range(230)]
    assert run(spark, rows) == brute(rows)


def test_small_nodes_are_split(spark, monkeypatch):
    import opskpi.llm.setjoin as s

    passage = prose(5, 60)
    rows = [(i, f"{passage} {prose(2000 + i, 30)}") for i in range(120)]
    rows += [(500 + i, edited(prose(31, 80), i, i % 2)) for i in range(30)]
    monkeypatch.setattr(s, "LEAF", 8)
    monkeypatch.setattr(s, "CELL", 16)
    assert run(spark, rows) == brute(rows)


def test_overlaps_count_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = overlaps(sets)
    for i in range(20):
        for j in range(20):
            assert i == j or got[i, j] == want[i][j]


def test_shingles_are_five_words():
    a, b, c, d, e = shingle_sets(["A b c d e f", "a  b\nc d e", "b c d e f", "a b", None])
    assert len(a) == 2 and set(b) < set(a) and set(c) < set(a) and len(d) == 1 and not len(e)


def test_more_recall_takes_more_runs():
    assert runs_for(0.9) < runs_for(0.99) < runs_for(0.999)


def test_empty_table(spark):
    assert run(spark, []) == []
