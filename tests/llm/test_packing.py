from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opskpi.llm.packing import Capacity, WordTokenizer, best_fit, pack
from tests.llm.cases import awkward, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def bins_of(histogram, placed):
    out = {}
    for length, n in histogram.items():
        seq, off = placed.locate(np.full(n, length, np.int64), np.arange(n, dtype=np.int64))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            out.setdefault(s, []).append((o, length))
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(100), Capacity(100, documents=4), Capacity(100, attention=3000),
                                      Capacity(100, documents=3, attention=5000)])
def test_every_capacity_holds(rule, capacity):
    r = random.Random(str((rule, capacity)))
    top = 54 if capacity.attention else 100
    histogram = {r.randint(1, top): r.randint(1, 60) for _ in range(25)}
    placed = best_fit(histogram, capacity, rule)
    bins = bins_of(histogram, placed)
    tokens, documents, attention = capacity.vector()
    assert len(bins) == placed.bins and sum(len(b) for b in bins.values()) == sum(histogram.values())
    for own in bins.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= tokens and len(own) <= documents and sum(x * x for _, x in own) <= attention


def test_best_fit_equals_item_by_item():
    r = random.Random(9)
    for _ in range(20):
        histogram = {r.randint(1, 64): r.randint(1, 9) for _ in range(12)}
        bins: list[int] = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                fit = [b for b in range(len(bins)) if bins[b] >= length]
                if fit:
                    bins[min(fit, key=lambda b: bins[b])] -= length
                else:
                    bins.append(64 - length)
        assert best_fit(histogram, Capacity(64)).bins == len(bins)


def test_close_to_the_least_number():
    r = random.Random(1)
    histogram = {n: r.randint(1, 400) for n in (r.randint(1, 4096) for _ in range(800))}
    least = -(-sum(n * k for n, k in histogram.items()) // 4096)
    assert best_fit(histogram).bins <= 1.03 * least


def test_a_piece_beyond_a_capacity_is_refused():
    with pytest.raises(ValueError):
        best_fit({11: 1}, Capacity(10))


def test_words_give_the_ids_of_whole_texts():
    tok, full = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    r = random.Random(3)
    letters = list("abXY'stTrE09 \t\n.,!|*%") + ["é", "É", "ß", "İ", "Σ", "σ", "é", "\xa0", "\x85", "\x1c", "漢", "😀",
                                                   "½", "<|endoftext|>", "​", "　", "\x00", "ﬁ", "don't"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["", "w" * 500]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == [
        full.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_awkward_documents(spark):
    rows = [*awkward(), (70, "hello <|endoftext|> x"), (71, "<|startoftext|>")]
    full = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 64)):
            own = np.asarray(ids[s:s + 64], "<u4").tobytes()
            want.append((i, k, s, len(own) // 4, zlib.crc32(own), own))
    got = pack(frame(spark, rows), PATH, Capacity(64), with_ids=True).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got),
                  key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 64
    assert pack(frame(spark, []), PATH).count() == 0
