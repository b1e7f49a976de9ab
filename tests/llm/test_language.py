from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from opskpi.llm.language import KneserNey, gram_counts, grams, identify, symbols
from tests.conftest import SF_SMALL
from tests.llm.cases import awkward, frame


def plain_symbols(text):
    out = [0]
    for c in (text or "").lower():
        cp = ord(c)
        k = (cp - 96 if 97 <= cp <= 122 else 27 + cp % 37) if c.isalpha() else 0
        if k or out[-1]:
            out.append(k)
    return out


def plain_grams(text, order=4):
    s = plain_symbols(text)
    return [tuple(s[max(0, i - order + 1):i + 1]) for i in range(1, len(s))]


def code_of(gram, order=4):
    return sum(x << 6 * k for k, x in enumerate(reversed([*(0,) * (order - len(gram)), *gram])))


TEXTS = ["Hello,  wörld!", None, "", "123 ... 456", "ÀÉ ß 漢字", " x", "a" * 9, "😀𝒜b"]


def test_symbols_and_grams():
    sym, starts = symbols(TEXTS)
    assert [sym[i:j].tolist() for i, j in zip(starts[:-1], starts[1:], strict=True)] == [plain_symbols(t) for t in TEXTS]
    code, n = grams(sym, starts)
    assert n.tolist() == [len(plain_grams(t)) for t in TEXTS]
    assert code.tolist() == [code_of(g) for t in TEXTS for g in plain_grams(t)]


def plain_model(texts, order=3):
    """Textbook interpolated Kneser-Ney over tuples."""
    counts = [None] * (order + 1)
    counts[order] = {}
    for t in texts:
        for g in plain_grams(t, order):
            g = (0,) * (order - len(g)) + g
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def prob(g):
        k = len(g)
        if k == 0:
            return 1 / 64
        own = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return prob(g[1:])
        n1, n2 = (sum(n == i for n in counts[k].values()) for i in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * prob(g[1:])

    return prob


def test_probabilities_are_kneser_ney():
    train = {"aa": ["the cat sat on the mat", "a hat"], "bb": ["der hund und die katze", "rund"]}
    counts = {}
    for g, ts in train.items():
        code, _ = grams(*symbols(ts), 3)
        counts[g] = np.unique(code, return_counts=True)
    model = KneserNey(counts, 3)
    probe = ["the rat", "hund", "xyz", "on der mat"]
    code, _ = grams(*symbols(probe), 3)
    got = model.log_prob(code)
    plain = {g: plain_model(ts) for g, ts in train.items()}
    want = [[math.log(plain[g]((0,) * (3 - len(x)) + x)) for g in ("aa", "bb")] for t in probe for x in plain_grams(t, 3)]
    assert np.allclose(got, want, rtol=1e-5)
    entropy, n = model.cross_entropy([*probe, None])
    assert n[-1] == 0 and not entropy[-1].any()
    assert np.allclose(entropy[0], -np.asarray(want[:n[0]]).mean(axis=0), rtol=1e-5)


def test_probabilities_sum_to_one():
    code, _ = grams(*symbols(["the cat sat on the mat and ran"]), 3)
    model = KneserNey({"x": np.unique(code, return_counts=True)}, 3)
    for context in ((20, 8), (0, 0), (5, 5)):
        base = code_of(context, 2) << 6
        assert np.exp(model.log_prob(base + np.arange(64)).astype(float)).sum() == pytest.approx(1, abs=1e-5)


def test_counts_are_of_all_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    got = {(r["lang"], r["code"]): r["n"] for r in gram_counts(frame(spark, rows)).collect()}
    want = {}
    for k, (_, t) in enumerate(rows):
        for g in plain_grams(t) if k % 5 else ():
            want["en", code_of(g)] = want.get(("en", code_of(g)), 0) + 1
    assert got == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    truth = {r["doc_id"]: r for r in docs.collect()}
    assert got.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i]["lang"] for i in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in got.values()) <= 0.01 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_noise_is_rejected(spark):
    noise = next(i for i in range(10 ** 6, 2 * 10 ** 6) if zlib.crc32(str(i).encode()) % 3 == 1)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(3)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600))
    more = spark.createDataFrame([(noise, text, "en")], docs.schema)
    got = {r["doc_id"]: r for r in identify(docs.union(more)).collect()}
    assert got[noise]["rejected"] and got[noise]["held_out"] and got[noise]["lang_pred"] != "und"


def test_defined_cases(spark):
    got = identify(frame(spark, [*awkward(), (500, "12 34 ...")])).collect()
    assert len(got) == len(awkward()) + 1
    by = {r["doc_id"]: r for r in got}
    for i in (5, 6, 7, 500):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"]
    assert all(r["lang_pred"] in ("en", "und") for r in got)
    assert identify(frame(spark, [])).count() == 0
    untrained = frame(spark, [(1, "text"), (2, None)]).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in identify(untrained).collect()} == {"und"}
