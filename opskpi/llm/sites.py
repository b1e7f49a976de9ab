"""Quality classifier by hierarchical empirical Bayes over sites.

Evidence of a text: the log-likelihood ratio of a handful of binned features
(symbols, word length, length, repeated lines, distinct words, sentence ends),
learned from all labelled rows by one grouped count; the table of ratios has at
most ``len(FEATURES) * BINS`` rows whatever the corpus.

Prior of a text: what its site is known for.  Every text, labelled or not,
adds its expected quality to its path (host and section) and its host by
grouped sums.  A host's rate is shrunk towards the corpus's, and a path's
towards its host's, with the weight of ``kappa`` texts; ``kappa`` is estimated
at each level by moments, as the spread of the rates beyond what their sizes
explain.  A text's own contribution is left out of the prior it gets.  The
score is the posterior probability of good quality.

Defined cases: null text is empty text; null hosts and paths are groups of
their own; ids labelled more than once count once, as good if any label says
so; without labels all evidence is 0 and the score is one half; repeated rows
count as often as they stand; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opskpi.llm.staging import Staging

C = F.col
FEATURES = ("symbols", "word_length", "words", "dup_lines", "distinct_words", "sentence_ends")
BINS = 32
SMOOTHING = 0.1
#: A text of so many words counts with half its evidence: shares of a few words say little.
FEW_WORDS = 10
_BLANKS = " \t\n\x0b\x0c\r"


def _bin(value: Column) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(BINS - 1)).cast("int")


def features(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``doc_id, host, path, n_words`` and one bin per feature."""
    text = F.coalesce(C("text").cast("string"), F.lit(""))
    chars = F.length(F.translate(text, _BLANKS, ""))
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")

    def sizes(x: Column) -> Column:
        return F.element_at(F.transform(F.array(x), lambda a: F.struct(
            F.size(a).alias("n"), F.size(F.array_distinct(a)).alias("u"))), 1)

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    counted = docs.select(
        C("doc_id").cast("long").alias("doc_id"), C(host).cast("string").alias("host"), C(path).cast("string").alias("path"),
        chars.alias("chars"), (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("symbols"),
        (F.length(text) - F.length(F.translate(text, ".!?", ""))).alias("ends"),
        sizes(words).alias("w"), sizes(lines).alias("l"))
    # shares of up to one on a log scale: each bin is a factor of two, the first is none
    return counted.select("doc_id", "host", "path", C("w.n").alias("n_words"), F.array(
        _bin(F.when(C("symbols") == 0, 0).otherwise(16 + F.log2(share(C("symbols"), C("chars"))))),
        _bin(2 * share(C("chars"), C("w.n"))),
        _bin(2 * F.log2(C("w.n") + 1)),
        _bin(16 * share(C("l.n") - C("l.u"), C("l.n"))),
        _bin(20 * share(C("w.u"), C("w.n"))),
        _bin(F.when(C("ends") == 0, 0).otherwise(16 + F.log2(share(C("ends"), C("chars")))))).alias("bins"))


def ratios(rows: DataFrame, labels: DataFrame) -> tuple[dict[tuple[int, int], float], float]:
    """Log-likelihood ratio (good over poor) of each feature's bins, and the labelled rows' log odds."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(C("doc_id").cast("long").alias("doc_id")).agg(
        F.max(C("quality").cast("int")).alias("good"))
    counts = (rows.join(known, "doc_id").select("good", F.posexplode("bins").alias("feature", "bin"))
              .groupBy("good", "feature", "bin").agg(F.count(F.lit(1)).alias("n")).collect())
    seen = {(r["good"], r["feature"], r["bin"]): r["n"] for r in counts}
    total = {g: sum(n for (a, f, _), n in seen.items() if a == g and f == 0) for g in (0, 1)}
    if not total[0] or not total[1]:
        return {}, 0.0

    def log(good: int, f: int, b: int) -> float:
        return math.log((seen.get((good, f, b), 0) + SMOOTHING) / (total[good] + SMOOTHING * BINS))

    return ({(f, b): log(1, f, b) - log(0, f, b) for f in range(len(FEATURES)) for b in range(BINS)},
            math.log(total[1] / total[0]))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _kappa(groups: DataFrame, parent: Column) -> float:
    """Weight of the parent's rate, by moments, from groups with their size ``n`` and sum ``s``."""
    m = parent
    r = groups.where("n > 1").agg(
        F.avg((C("s") / C("n") - m) ** 2).alias("spread"), F.avg(m * (1 - m) / C("n")).alias("noise"),
        F.avg(m * (1 - m)).alias("unit")).first()
    if r["spread"] is None or not r["unit"]:
        return 1.0
    between = r["spread"] - r["noise"]
    return 1e6 if between <= 0 else min(max(r["unit"] / between - 1, 1.0), 1e6)


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``doc_id, host, path, evidence, prior, score, kept`` per row of ``docs``."""
    staging = Staging(docs.sparkSession, "sites")
    rows = staging.put(features(docs, host, path), "features")
    table, odds = ratios(rows, labels)
    evidence = F.lit(0.0)
    for f in range(len(FEATURES)) if table else ():
        ratio = F.array(*(F.lit(table[f, b]) for b in range(BINS)))
        evidence = evidence + F.get(ratio, F.get(C("bins"), F.lit(f)))
    evidence = evidence * C("n_words") / (C("n_words") + F.lit(FEW_WORDS))
    # the labelled rate only starts the texts' expectations; their sums are the priors
    rows = rows.select("doc_id", "host", "path", evidence.alias("evidence")).withColumn(
        "p", 1 / (1 + F.exp(-(C("evidence") + F.lit(odds)))))
    paths = staging.put(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    hosts = staging.put(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    world = whole["s"] / whole["n"] if whole["n"] else 0.5
    strong = _kappa(hosts, F.lit(world))
    joined = paths.alias("p").join(hosts.alias("h"), C("p.host").eqNullSafe(C("h.host"))).select(
        "p.host", "p.path", C("p.n").alias("n"), C("p.s").alias("s"), C("h.n").alias("host_n"), C("h.s").alias("host_s"))
    firm = _kappa(joined, (C("host_s") + strong * world) / (C("host_n") + strong))
    r, g = rows.alias("r"), joined.alias("g")
    placed = r.join(g, C("r.host").eqNullSafe(C("g.host")) & C("r.path").eqNullSafe(C("g.path"))).select(
        "doc_id", "r.host", "r.path", "evidence", "p", "n", "s", "host_n", "host_s")
    of_host = (C("host_s") - C("p") + strong * world) / (C("host_n") - 1 + strong)
    prior = (C("s") - C("p") + firm * of_host) / (C("n") - 1 + firm)
    return placed.withColumn("prior", prior).withColumn(
        "score", 1 / (1 + F.exp(-(C("evidence") + _logit(C("prior")))))).select(
        "doc_id", "host", "path", "evidence", "prior", "score", (C("score") >= 0.5).alias("kept"))
