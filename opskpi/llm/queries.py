"""The registered queries of this subpackage: thin calls of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opskpi.llm import bytepairs, codes
from opskpi.llm.language import identify
from opskpi.llm.lines import dedup_lines
from opskpi.llm.mixing import mix
from opskpi.llm.packing import pack
from opskpi.llm.pages import main_text
from opskpi.llm.rules import judge
from opskpi.llm.setjoin import near_duplicates
from opskpi.llm.sites import quality
from opskpi.llm.statements import CONVERSATION_REPAIR, VECTOR_CODES
from opskpi.llm.suffixes import remove_repeats
from opskpi.llm.turns import damage_and_repair
from opskpi.llm.vectors import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("th")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bytepairs.decode(bytepairs.encode(_table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents")).drop("th")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(_table(spark, sf_dir, "conversations"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("source")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(*codes.compress(_table(spark, sf_dir, "embeddings")))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_line_dedup, op3_best_fit_packing, op4_quality_classifier, op5_quality_rules,
                                    op6_embedding_dedup, op7_jaccard_join, op8_byte_bpe, op9_language_id,
                                    op10_html_extraction, op11_conversation_repair, op12_source_mixing,
                                    op13_vector_codes)}


#: The operators of approximate search, models, tokenizers and markup have no SQL form; their tests use brute force.
ORACLE = {"op5_quality_rules": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source, lang FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
g AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 4), ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, sum(k)::BIGINT AS n FROM
      (SELECT rid, least(5, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 5)) AS k FROM d) GROUP BY rid),
c AS (SELECT w.rid, doc_id, source, lang, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines
      FROM w LEFT JOIN r USING (rid)),
p(share, sign, least) AS (VALUES ('symbols', 1, 500), ('dup_lines', 1, 5000), ('long_words', 1, 5000), ('short_words', -1, 1500)),
s AS (SELECT rid, source, lang, share, CASE WHEN den > 0 THEN (num * 10000) // den ELSE 0 END AS v FROM (
      SELECT rid, source, lang, share, CASE share WHEN 'symbols' THEN n_symbols WHEN 'dup_lines' THEN n_dup_lines ELSE word_chars END AS num,
             CASE share WHEN 'symbols' THEN word_chars WHEN 'dup_lines' THEN n_lines ELSE n_words * 20 END AS den
      FROM c, p WHERE n_words > 0)),
h AS (SELECT source, lang, share, bin, count(*) AS n FROM (
      SELECT *, CASE WHEN v < 64 THEN v ELSE (e - 5) * 32 + (v >> (e - 5)) END AS bin
      FROM (SELECT *, CASE WHEN v < 64 THEN 0 ELSE floor(log2(v + 0.5))::INT END AS e FROM s)) GROUP BY ALL),
l AS (SELECT 0 AS lev, source, lang, share, bin, n FROM h UNION ALL
      SELECT 1, NULL, lang, share, bin, sum(n) FROM h GROUP BY lang, share, bin UNION ALL
      SELECT 2, NULL, NULL, share, bin, sum(n) FROM h GROUP BY share, bin),
b AS (SELECT *, CASE WHEN bin < 64 THEN bin ELSE (bin - (bin // 32 - 1) * 32 + 1) * (1 << (bin // 32 - 1)::INT) - 1 END AS top FROM l),
u AS (SELECT *, sum(n) OVER (PARTITION BY lev, source, lang, share ORDER BY bin) AS upto,
                sum(n) OVER (PARTITION BY lev, source, lang, share) AS total FROM b),
m AS (SELECT *, min(top) FILTER (upto >= ceil(total * 0.5::DOUBLE)) OVER (PARTITION BY lev, source, lang, share) AS mid FROM u),
d2 AS (SELECT *, sum(n) OVER (PARTITION BY lev, source, lang, share ORDER BY abs(top - mid)) AS within FROM m),
k AS (SELECT lev, source, lang, share, max(total) AS n, min(mid) AS mid,
             min(abs(top - mid)) FILTER (within >= ceil(total * 0.5::DOUBLE)) AS mad FROM d2 GROUP BY ALL),
y AS (SELECT k.*, sign, mid + sign * greatest(7.6::DOUBLE * mad, least) AS fence FROM k JOIN p USING (share)),
x AS (SELECT o.source, o.lang, o.share, o.sign, o.n, o.mid, o.fence, CASE WHEN g.n >= 100 THEN g.fence ELSE a.fence END AS wide
      FROM y o JOIN y g ON o.lev = 0 AND g.lev = 1 AND o.lang IS NOT DISTINCT FROM g.lang AND o.share = g.share
               JOIN y a ON a.lev = 2 AND o.share = a.share),
z AS (SELECT source, lang, share, CASE WHEN n < 100 OR sign * (mid - wide) > 0 THEN wide ELSE fence END AS fence FROM x),
f AS (SELECT source, lang, max(fence) FILTER (share = 'symbols') AS f1, max(fence) FILTER (share = 'dup_lines') AS f2,
             max(fence) FILTER (share = 'long_words') AS f4, max(fence) FILTER (share = 'short_words') AS f5 FROM z GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (
           (word_chars > 0 AND (n_symbols * 10000) // word_chars > f1) OR (n_lines > 0 AND (n_dup_lines * 10000) // n_lines > f2)
           OR (n_words > 0 AND ((word_chars * 10000) // (n_words * 20) > f4
                                OR (word_chars * 10000) // (n_words * 20) < f5))) AS kept
FROM c LEFT JOIN f ON c.source IS NOT DISTINCT FROM f.source AND c.lang IS NOT DISTINCT FROM f.lang
"""}


def llm_oracle() -> dict[str, str]:
    return {**ORACLE, "op11_conversation_repair": CONVERSATION_REPAIR, "op13_vector_codes": VECTOR_CODES}
