from __future__ import annotations

import math

import pytest

from opskpi.llm import sites
from tests.conftest import SF_SMALL
from tests.llm.cases import awkward, frame, prose

DOCS = [(i, prose(i, 40) + (" ***" * 30 if i % 4 == 0 else "")) for i in range(80)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_scores_by_hand(spark):
    lab = labels(spark, [(i, int(i % 4 != 0), 0) for i in range(0, 80, 3)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)])
    docs = frame(spark, DOCS)
    rows = [(r["doc_id"], r["host"], r["path"], r["n_words"], r["bins"]) for r in sites.features(docs).collect()]
    good = {i: int(i % 4 != 0) for i in range(0, 80, 3)}  # 3 has both labels: good
    total = {g: sum(good[i] == g for i in good) for g in (0, 1)}

    def ratio(f, b):
        c = [sum(good.get(i) == g and x[f] == b for i, *_, x in rows) for g in (0, 1)]
        s, k = sites.SMOOTHING, sites.SMOOTHING * sites.BINS
        return math.log((c[1] + s) / (total[1] + k)) - math.log((c[0] + s) / (total[0] + k))

    odds = math.log(total[1] / total[0])
    ev = [sum(ratio(f, b) for f, b in enumerate(x)) * n / (n + sites.FEW_WORDS) for _, _, _, n, x in rows]
    p = [1 / (1 + math.exp(-(e + odds))) for e in ev]
    world = sum(p) / len(p)

    def sums(key):
        out = {}
        for r, x in zip(rows, p, strict=True):
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, s + x)
        return out

    host, path = sums(lambda r: r[1]), sums(lambda r: r[1:3])

    def kappa(groups):
        groups = [g for g in groups if g[0] > 1]
        spread = sum((s / n - m) ** 2 for n, s, m in groups) / len(groups)
        noise = sum(m * (1 - m) / n for n, s, m in groups) / len(groups)
        unit = sum(m * (1 - m) for *_, m in groups) / len(groups)
        return 1e6 if spread <= noise else min(max(unit / (spread - noise) - 1, 1), 1e6)

    strong = kappa([(n, s, world) for n, s in host.values()])
    firm = kappa([(n, s, (host[k[0]][1] + strong * world) / (host[k[0]][0] + strong)) for k, (n, s) in path.items()])
    want = {}
    for r, e, x in zip(rows, ev, p, strict=True):
        of_host = (host[r[1]][1] - x + strong * world) / (host[r[1]][0] - 1 + strong)
        n, s = path[r[1:3]]
        prior = (s - x + firm * of_host) / (n - 1 + firm)
        want[r[0]] = 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior)))))
    got = {r["doc_id"]: r for r in sites.quality(docs, lab).collect()}
    assert {i: r["score"] for i, r in got.items()} == pytest.approx(want)
    assert all(r["kept"] == (i % 4 != 0) for i, r in got.items())


def test_sparse_sites_lean_on_the_whole(spark):
    docs = spark.createDataFrame(
        [(i, prose(i, 40) + (" ***" * 30 if i % 2 else ""), f"s{i % 2}", "x") for i in range(100)]
        + [(1000, prose(1, 3), "s1", "x"), (1001, prose(1, 3), "new", "x"), (1002, prose(1, 3), "s0", "x")],
        "doc_id long, text string, source string, lang string")
    lab = labels(spark, [(i, 1 - i % 2, 0) for i in range(100)])
    prior = {r["doc_id"]: r["prior"] for r in sites.quality(docs, lab).collect()}
    assert prior[1000] < 0.2 < prior[1001] < 0.8 < prior[1002]


def test_held_back_labels(spark):
    docs, lab = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in lab.collect()}
    got = {r["doc_id"]: r["kept"] for r in sites.quality(docs, lab.where("doc_id % 2 = 0")).collect()}
    held = [i for i in truth if i % 2 and i in got]
    assert sum(got[i] == bool(truth[i]) for i in held) >= 0.93 * len(held)


def test_defined_cases(spark):
    docs = frame(spark, awkward())
    got = sites.quality(docs, labels(spark, [])).collect()
    assert len(got) == len(awkward()) and {round(r["score"], 9) for r in got} == {0.5}
    got = sites.quality(docs, labels(spark, [(1, 1, 0), (13, 0, 0), (777, 0, 0)])).collect()
    assert len(got) == len(awkward()) and all(0 < r["score"] < 1 for r in got)
    assert sites.quality(frame(spark, []), labels(spark, [(1, 1, 0)])).count() == 0
