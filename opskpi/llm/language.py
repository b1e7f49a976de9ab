"""Language identification by interpolated Kneser-Ney character models.

Texts are read as lower-case letters in 64 classes (26 plain letters, 37 for
all others by code point, and one for every stretch of non-letters).  Spark
counts all 4-grams of the training texts per language; the lower orders are
continuation counts of those, so one grouped count is all that is gathered
from the corpus, and it has at most ``64**4`` rows a language whatever its
size (a few ten thousand in practice).  The models are kept as sorted arrays
of n-gram codes with one column of log-probabilities per language, so that a
single search scores a position under every language.

A text gets the language of the lowest cross-entropy per symbol.  Rejection
is calibrated on the training texts: a text is rejected if its cross-entropy
lies nearer to that of random symbols than to the mean of its language's texts,
and beyond ``spread`` of their standard deviations (wider for short texts, by
the square root of the length); texts without a letter are rejected as ``und``.

Defined cases: null and letterless texts are ``und`` with score 0; rows
without a language do not train; ties go to the first language in
alphabetical order; without any training row every text is ``und``; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opskpi.llm.staging import Staging

C = F.col
ORDER = 4
UNKNOWN = "und"
_BITS = 6
_CLASSES = 1 << _BITS
#: Symbols beyond which a text's evidence no longer sharpens the score.
SCORE_SYMBOLS = 40
_STRETCH = 1 << 19


def _letter_classes() -> np.ndarray:
    """Class of each code point of the basic plane: 0 for all but letters."""
    out = np.zeros(0x10000, np.int32)
    for cp in range(0x10000):
        if chr(cp).isalpha():
            out[cp] = 1 + cp - 97 if 97 <= cp <= 122 else 27 + cp % 37
    return out


_CLASS: list[np.ndarray] = []


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts in one array (each text starts after a 0) and where each text starts.

    Stretches of non-letters become a single 0; a text without letters has no symbols.
    """
    if not _CLASS:
        _CLASS.append(_letter_classes())
    own = [("\n" + t.lower()) if t else "\n" for t in texts]
    raw = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))))
    wide = raw >= 0x10000
    cls = _CLASS[0][np.where(wide, 0, raw)]
    for i in np.flatnonzero(wide):
        if chr(raw[i]).isalpha():
            cls[i] = 27 + int(raw[i]) % 37
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != 0) | (cls[:-1] != 0)
    keep[starts[:-1]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return cls[keep], kept[starts]


def grams(sym: np.ndarray, starts: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ``order``-grams ending at each symbol but the texts' first, and the number per text.

    A text is preceded by 0s.
    """
    n = len(sym)
    code = np.zeros(n, np.int64)
    at = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    for k in range(order - 1, -1, -1):
        past = np.zeros(n, np.int64)
        past[k:] = sym[:n - k]
        past[at < k] = 0
        code = (code << _BITS) | past
    return code[at > 0], np.maximum(np.diff(starts) - 1, 0)


def _pieces(texts: list[str | None]):
    """Groups of texts of about ``_STRETCH`` characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= _STRETCH or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def _merge(a, b):
    codes, inverse = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate((a[1], b[1]))).astype(np.int64)


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs(lang, text)`` -> ``(lang, code, n)`` over all rows with a language."""

    def run(batches):
        held: dict[str, list] = {}
        for b in batches:
            lang = np.asarray(b.column(0).to_pylist(), object)
            texts = b.column(1)
            for name in set(lang):
                own = texts.take(pa.array(np.flatnonzero(lang == name))).to_pylist()
                for lo, hi in _pieces(own):
                    code, _ = grams(*symbols(own[lo:hi]), order)
                    got = np.unique(code, return_counts=True)
                    parts = held.setdefault(name, [])
                    parts.append(got)
                    while len(parts) > 1 and len(parts[-2][0]) <= 2 * len(parts[-1][0]):
                        parts[-2:] = [_merge(parts[-2], parts[-1])]
        for name, parts in held.items():
            while len(parts) > 1:
                parts[-2:] = [_merge(parts[-2], parts[-1])]
            codes, n = parts[0]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), len(codes)), pa.array(codes), pa.array(n)],
                                             names=["lang", "code", "n"])

    part = docs.where("lang is not null and text is not null").select(
        C("lang").cast("string").alias("lang"), C("text").cast("string").alias("text"))
    return part.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated Kneser-Ney models of several languages over the union of their n-grams."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.languages = sorted(counts)
        self.order = order
        self.keys: dict[int, np.ndarray] = {}       # order -> sorted n-gram codes
        self.prob: dict[int, np.ndarray] = {}       # order -> probability, one column per language
        self.contexts: dict[int, np.ndarray] = {}   # order -> sorted codes of its contexts
        self.backoff: dict[int, np.ndarray] = {}    # order -> weight of the next lower order
        per = {g: (np.asarray(c[0], np.int64), np.asarray(c[1], np.float64)) for g, c in counts.items()}
        tables = {order: per}
        for k in range(order - 1, 0, -1):
            mask = (1 << _BITS * k) - 1
            lower = {}
            for g, (codes, _) in tables[k + 1].items():
                low, n = np.unique(codes & mask, return_counts=True)
                lower[g] = (low, n.astype(np.float64))
            tables[k] = lower
        self.prob[0] = np.full((1, len(self.languages)), 1.0 / _CLASSES)
        for k in range(1, order + 1):
            keys = np.unique(np.concatenate([c for c, _ in tables[k].values()]))
            contexts = np.unique(keys >> _BITS)
            prob = np.zeros((len(keys), len(self.languages)))
            weight = np.ones((len(contexts), len(self.languages)))
            self.keys[k], self.contexts[k], self.backoff[k] = keys, contexts, weight
            for j, g in enumerate(self.languages):
                codes, n = tables[k][g]
                n1, n2 = (n == 1).sum(), (n == 2).sum()
                discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                ctx = np.searchsorted(contexts, codes >> _BITS)
                total = np.bincount(ctx, n, len(contexts))
                kinds = np.bincount(ctx, minlength=len(contexts))
                seen = total > 0
                weight[seen, j] = discount * kinds[seen] / total[seen]
                prob[np.searchsorted(keys, codes), j] = (n - discount) / total[ctx]
            prob += weight[np.searchsorted(contexts, keys >> _BITS)] * self._at(k - 1, keys)
            self.prob[k] = prob
        self.log = np.log(self.prob[order]).astype(np.float32)

    def _at(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Probabilities of the last ``k`` symbols' order for any codes."""
        if k == 0:
            return self.prob[0]
        codes = codes & ((1 << _BITS * k) - 1)
        i = np.searchsorted(self.keys[k], codes)
        i[i == len(self.keys[k])] = 0
        hit = self.keys[k][i] == codes
        out = self.prob[k][i]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            ctx = codes[miss] >> _BITS
            c = np.searchsorted(self.contexts[k], ctx)
            c[c == len(self.contexts[k])] = 0
            weight = np.where((self.contexts[k][c] == ctx)[:, None], self.backoff[k][c], 1.0)
            out[miss] = weight * self._at(k - 1, codes[miss])
        return out

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.keys[self.order], codes)
        i[i == len(self.log)] = 0
        hit = self.keys[self.order][i] == codes
        out = self.log[i]
        if not hit.all():
            out[~hit] = np.log(self._at(self.order, codes[~hit]))
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol under each language, and the number of symbols."""
        code, n = grams(*symbols(texts), self.order)
        sums = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            head = np.cumsum(n) - n
            sums[some] = np.add.reduceat(self.log_prob(code), head[some], axis=0, dtype=np.float64)
        return -sums / np.maximum(n, 1)[:, None], n


def train(docs: DataFrame, order: int = ORDER) -> KneserNey | None:
    """Models of all languages in ``docs(lang, text)``; None if there is nothing to learn from."""
    rows = gram_counts(docs, order).toArrow()
    if not rows.num_rows:
        return None
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    which = lang.indices.to_numpy()
    code, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    return KneserNey({g: (code[which == i], n[which == i]) for i, g in enumerate(names)}, order)


def _scores(docs: DataFrame, model: KneserNey | None) -> DataFrame:
    """``doc_id, train`` and ``row`` with ``lang_pred``, ``score``, ``entropy`` and ``n_symbols``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.asarray([*(m.languages if m else []), UNKNOWN], object)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            for lo, hi in _pieces(texts):
                if m is None:
                    n, best, score, h = (np.zeros(hi - lo, np.int64),) * 2 + (np.zeros(hi - lo),) * 2
                else:
                    e, n = m.cross_entropy(texts[lo:hi])
                    best = e.argmin(axis=1)
                    h = e[np.arange(len(n)), best]
                    gap = (e - h[:, None]) * np.minimum(n, SCORE_SYMBOLS)[:, None]
                    score = np.where(n > 0, 1 / np.exp(-gap).sum(axis=1), 0.0)
                part = b.slice(lo, hi - lo)
                keep = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in keep),
                     pa.array(names[np.where(n > 0, best, -1)], pa.string()), pa.array(score), pa.array(h), pa.array(n)],
                    names=[*keep, "lang_pred", "score", "entropy", "n_symbols"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kept}, lang_pred string, score double, entropy double, n_symbols long")


def held_out(doc_id: Column) -> Column:
    """One of three folds by the checksum of the id: not learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, spread: float = 6.0, floor_symbols: int = 400) -> DataFrame:
    """``doc_id, th, held_out, lang_pred, score, rejected`` per row of ``docs(doc_id, text, lang)``.

    ``rejected`` is null-safe: true for ``und`` and for a cross-entropy above
    the limit of the predicted language.
    """
    part = docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").alias("text"),
                       C("lang").cast("string").alias("lang")).withColumn("held_out", held_out(C("doc_id"))) \
        .withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    model = train(part.where("not held_out").select("lang", "text"))
    staging = Staging(docs.sparkSession, "language")
    scored = staging.put(_scores(part, model), "scores")
    limits = (scored.where("not held_out and lang = lang_pred").groupBy("lang_pred")
              .agg(F.avg("entropy").alias("mean"), F.coalesce(F.stddev_pop("entropy"), F.lit(0.0)).alias("sd")))
    short = F.sqrt(F.lit(float(floor_symbols)) / F.greatest(C("n_symbols"), F.lit(1)))
    room = F.greatest(spread * C("sd") * F.greatest(F.lit(1.0), short), (math.log(_CLASSES) - C("mean")) / 2)
    above = C("entropy") > C("mean") + room
    return scored.join(limits, "lang_pred", "left").select(
        "doc_id", "th", "held_out", "lang_pred", "score",
        ((C("lang_pred") == UNKNOWN) | F.coalesce(above, F.lit(False))).alias("rejected"))
