from __future__ import annotations

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from opskpi.llm.bytepairs import Transducer, Utf8Stream, codec, decode, encode
from tests.llm.cases import awkward, frame

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LETTERS = [*"abXY'stTrEdlm09 \t\n.,!|*%$", "é", "É", "ß", "İ", " ", "\x85", "\x1c", "　", "漢", "字", "😀", "ª", "²", "½",
           "<|endoftext|>", "​", "'re", "'ll", "  ", "\r\n", "é", "\x00", "한국", " '"]


def texts(seed, n, top=30):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, top))) for _ in range(n)]


def test_ids_of_the_library(library):
    own = [*texts(1, 3000), "don't we'll 's 'x it's' '", " ", "\n\n", "a" * 300, "the " * 200]
    assert [x.tolist() for x in codec(PATH).encode(own)] == [library.encode_ordinary(t) for t in own]


def test_pieces_that_run_through_the_transducer(library):
    r = random.Random(2)
    t = Transducer({library.decode_single_token_bytes(i): i for i in range(50_256)})
    for _ in range(400):
        piece = bytes(r.choice(b"aeinorstlh \xc3\xa9\xe6\xbc") for _ in range(r.randint(1, 24)))
        want = [t.ranks[piece]] if piece in t.ranks else [t.ranks[p] for p in t.merge(piece)]
        assert t.encode(piece) == want


def test_full_state_memory_changes_nothing(library, monkeypatch):
    import opskpi.llm.bytepairs as b

    monkeypatch.setattr(b, "STATES", 50)
    t = b.Transducer({library.decode_single_token_bytes(i): i for i in range(50_256)})
    for text in texts(7, 300):
        for piece in text.split():
            data = piece.encode()
            assert t.encode(data) == ([t.ranks[data]] if data in t.ranks else [t.ranks[p] for p in t.merge(data)])
    assert len(t._readings) == 50


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_streaming_decode(block):
    c = codec(PATH)
    own = texts(3, 300)
    for t, ids in zip(own, c.encode(own), strict=True):
        s = Utf8Stream()
        assert "".join(s.feed(c.token_bytes(ids[i:i + block])) for i in range(0, len(ids), block)) + s.close() == t


def test_broken_utf8_in_pieces():
    r = random.Random(6)
    for _ in range(2000):
        data = bytes(r.choice((0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF)) for _ in range(9))
        s, cut = Utf8Stream(), sorted(r.sample(range(10), 3))
        got = "".join(s.feed(data[i:j]) for i, j in zip([0, *cut], [*cut, 9], strict=True)) + s.close()
        assert got == data.decode("utf-8", "replace")


def test_round_trip_of_awkward_documents(spark, library):
    rows = awkward()
    got = decode(encode(frame(spark, rows), PATH), PATH, block=50).collect()
    assert sorted(((r["doc_id"], list(r["ids"]), r["text"]) for r in got), key=repr) == sorted(
        ((i, library.encode_ordinary(t or ""), t or "") for i, t in rows), key=repr)
    assert decode(encode(frame(spark, []), PATH), PATH).count() == 0
