"""Quality rules with adaptive thresholds, in DataFrame functions only.

A base rule drops texts of few words or many repeated ones.  Beyond it, each
text gets a handful of shares (symbols, duplicate lines, word length).  A mergeable quantile sketch of each share is kept per source
and language: a histogram whose bins are exact up to 63 and grow by 1/32 of a
power of two beyond (a share is scaled to a whole number first), so two
sketches merge by adding counts and any part of the corpus may be counted
anywhere.  From the merged sketch of a group come its median and the median
distance from it, which up to half of the texts cannot inflate, and from those
the fences beyond which a text is an outlier *of its group*; a group with few
texts leans on the sketch of its language, and so does one whose very median is
an outlier there.  A language with few texts leans on the sketch of the corpus,
but one with enough is never judged by the fence of others: words of a script
without blanks are not long words.  The fences join back to the texts.

Defined cases: null text has no words and fails the base rule; null source or
language is a group of its own; repeated rows count as often as they stand;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opskpi.llm.staging import Staging

C = F.col
WINDOW = 5
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
SCALE = 10_000

#: Share -> (numerator, denominator, which side is poor, least distance from the median to be an outlier).
SHARES = {
    "symbols": ("n_symbols", "word_chars", "high", 500),
    "dup_lines": ("n_dup_lines", "n_lines", "high", 5000),
    "long_words": ("word_chars", "n_words * 20", "high", 5000),
    "short_words": ("word_chars", "n_words * 20", "low", 1500),
}
#: Fence: this many median distances from the median (about five standard deviations of normal shares).
REACH = 7.6
OUTER = 0.9
#: Texts that a group needs to be judged by its own sketch.
GROUP_ROWS = 100


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by ``WINDOW``-word windows that stand in the text twice or more."""
    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            n = F.size(s)
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                             | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def cover(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.when(k == 0, WINDOW).otherwise(
                F.least(F.lit(WINDOW), x - F.get(p, k - 1))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(order, lambda s: _let(places(s), cover))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                           lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(hashes(words), counted))


def text_counts(docs: DataFrame, group: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``doc_id``, the group columns and the counts of each text."""
    text = F.coalesce(C("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    return docs.select(
        C("doc_id").cast("long").alias("doc_id"), *(C(g).cast("string").alias(g) for g in group),
        F.length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("_w"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                       (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("_l"),
    ).select("doc_id", *group, C("_w.n").alias("n_words"), "word_chars", "n_symbols", C("_l.d").alias("n_dup_lines"),
             C("_w.r").alias("n_repeat_words"), C("_l.n").alias("n_lines"))


def _scaled(numerator: str, denominator: str) -> Column:
    num, den = F.expr(numerator), F.expr(denominator)
    return F.when(den > 0, F.floor(num * SCALE / den)).otherwise(F.lit(0)).cast("long")


def _bin(v: Column) -> Column:
    """Number of the sketch bin of a whole number: itself below 64, then 32 bins to each power of two."""
    power = F.floor(F.log2(v.cast("double") + 0.5)).cast("int")
    return F.when(v < 64, v).otherwise((power - 5) * 32 + F.floor(v / F.pow(F.lit(2.0), power - 5))).cast("long")


def _bin_top(b: Column) -> Column:
    """Largest whole number of a bin."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.when(b < 64, b).otherwise(
        (b - shift * 32 + 1) * F.pow(F.lit(2), shift).cast("long") - 1).cast("long")


def sketches(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Merged histograms ``(*keys, share, bin, n)`` of all texts that have words."""
    bins = F.array(*(F.struct(F.lit(name).alias("share"), _bin(_scaled(num, den)).alias("bin"))
                     for name, (num, den, _, _) in SHARES.items()))
    return (counts.where("n_words > 0").select(*keys, F.explode(bins).alias("s"))
            .groupBy(*keys, C("s.share").alias("share"), C("s.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, median, outer quantiles and median distance from the median (``mad``) of each sketch."""
    up = Window.partitionBy(*keys, "share").orderBy("bin")
    whole = Window.partitionBy(*keys, "share")
    ranked = sketch.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(whole))

    def at(q: float, upto: str = "upto", value: str = "bin") -> Column:
        return F.min(F.when(C(upto) >= F.ceil(C("total") * F.lit(q)), C(value)))

    ranked = ranked.withColumn("away", F.abs(_bin_top(C("bin")) - _bin_top(at(0.5).over(whole))))
    ranked = ranked.withColumn("within", F.sum("n").over(whole.orderBy("away")))
    return ranked.groupBy(*keys, "share").agg(
        F.max("total").alias("rows"), at(0.5).alias("mid"), at(OUTER).alias("high"), at(1 - OUTER).alias("low"),
        at(0.5, "within", "away").alias("mad")).select(
        *keys, "share", "rows", *(_bin_top(C(c)).alias(c) for c in ("mid", "high", "low")), "mad")


def with_fence(levels: DataFrame) -> DataFrame:
    """Adds ``fence`` and ``sign`` (1: poor is above it, -1: below) by the own median and distance of each sketch."""
    sign, fence = F.lit(None), F.lit(None)
    for name, (_, _, side, least) in SHARES.items():
        own, here = (1 if side == "high" else -1), C("share") == name
        sign = F.when(here, F.lit(own)).otherwise(sign)
        fence = F.when(here, C("mid") + own * F.greatest(REACH * C("mad"), F.lit(float(least)))).otherwise(fence)
    return levels.withColumn("sign", sign).withColumn("fence", fence)


def thresholds(counts: DataFrame, group: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """One row per (source, language): a fence for each share."""
    source, lang = group
    fine = sketches(counts, [source, lang])
    by_lang = fine.groupBy(lang, "share", "bin").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("share", "bin").agg(F.sum("n").alias("n"))
    own = with_fence(quantiles(fine, [source, lang])).alias("o")
    middle = with_fence(quantiles(by_lang, [lang])).alias("m")
    world = with_fence(quantiles(overall, [])).alias("w")
    level = own.join(middle, C(f"o.{lang}").eqNullSafe(C(f"m.{lang}")) & (C("o.share") == C("m.share"))) \
               .join(world, C("o.share") == C("w.share"))

    # a language is judged by the corpus only where it has too few texts of its own; a source by its
    # language also where its very median is an outlier there
    middle_fence = F.when(C("m.rows") < GROUP_ROWS, C("w.fence")).otherwise(C("m.fence"))
    poor = C("o.sign") * (C("o.mid") - middle_fence) > 0
    fence = F.when((C("o.rows") < GROUP_ROWS) | poor, middle_fence).otherwise(C("o.fence"))
    return level.select(C(f"o.{source}").alias(source), C(f"o.{lang}").alias(lang), C("o.share").alias("share"),
                        fence.alias("fence")).groupBy(source, lang).agg(
        *(F.max(F.when(C("share") == name, C("fence"))).alias(f"{name}_fence") for name in SHARES))


def judge(docs: DataFrame, group: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """Counts, shares' fences, ``base_failed`` and ``kept`` per row of ``docs(doc_id, text, source, lang)``."""
    counts = Staging(docs.sparkSession, "rules").put(text_counts(docs, group), "counts")
    limits = thresholds(counts, group)
    base = (C("n_words") < 10) | (100 * C("n_repeat_words") > 20 * C("n_words"))
    c, t = counts.withColumn("base_failed", base).alias("c"), limits.alias("t")
    joined = c.join(t, C(f"c.{group[0]}").eqNullSafe(C(f"t.{group[0]}")) & C(f"c.{group[1]}").eqNullSafe(C(f"t.{group[1]}")),
                    "left")
    odd = F.lit(False)
    for name, (num, den, side, _) in SHARES.items():
        v, fence = _scaled(num, den), C(f"{name}_fence")
        odd = odd | F.coalesce(v > fence if side == "high" else v < fence, F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~C("base_failed") & ~odd).alias("kept"))
