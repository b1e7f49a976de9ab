"""Awkward documents that every operator has to take, and brute-force helpers."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

#: Further columns whose names are used inside the operators.
CLASHING = ("th", "n", "node", "comp", "id", "row", "sig", "key", "a", "b", "cx", "blk", "line", "task", "words", "host")

_WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tru", "sel", "nor") for b in ("na", "ri", "sto", "vel", "ga", "du", "pe")
          for c in ("", "n", "r", "s", "th")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) for _ in range(n))


def edited(text: str, seed: int, k: int) -> str:
    """The text with ``k`` words replaced."""
    r, w = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(w)), k):
        w[i] = f"xx{r.randint(0, 10 ** 6)}"
    return " ".join(w)


def awkward() -> list[tuple[int | None, str | None]]:
    base, other, passage = prose(1, 150), prose(2, 220), prose(3, 90)
    return [
        (1, base), (2, base), (3, edited(base, 5, 2)), (4, edited(base, 6, 3)), (5, None), (6, ""), (7, "\n\n"),
        (8, other), (8, other), (9, f"{prose(4, 40)}\n{passage}\n{prose(5, 40)}"), (10, f"{passage}\n{prose(6, 70)}"),
        (11, "short"), (12, "short"), (13, "a" * 1500), (14, "b" + "a" * 900), (15, " ".join(["echo"] * 300)),
        (16, prose(7, 6000)), (17, prose(7, 6000)[:30000]), (None, prose(8, 120)), (None, None),
        (18, "Ünïcödé 漢字 😀 " * 60), (19, "x\x00y\x1c z　w   v"), (20, passage),
        (21, "\n".join([passage, base, passage])), (22, f"{base}\n{edited(passage, 9, 1)}"), (-5, prose(2, 220)),
    ]


def frame(spark, rows, clash: bool = True):
    """``doc_id, text, lang, source, n_chars`` and columns with clashing names, over several partitions."""
    extra = CLASHING if clash else ()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in extra)])
    data = [(i, t, "en" if k % 5 else None, f"src{k % 3}" if k % 7 else None, len(t or ""), *("?" for _ in extra))
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema).repartition(3)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


class Sets:
    """Plain union-find."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x
