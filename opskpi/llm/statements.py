"""DuckDB statements of operators that SQL can express, independent of their methods."""

from __future__ import annotations

_ROUND = """
a{i} AS MATERIALIZED (SELECT rn, p, min({{'d': d, 'e': e}}) AS m FROM (
    SELECT rn, x.p, e, list_sum([(part[j] - c[j]) * (part[j] - c[j]) FOR j IN range(1, w + 1)])::BIGINT AS d
    FROM x JOIN b{i} b ON x.p = b.p) GROUP BY rn, p),
u{i} AS (SELECT p, e, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END::BIGINT ORDER BY j) AS c FROM (
    SELECT x.p, m.e AS e, j, sum(part[j]) AS s, count(*) AS n
    FROM x JOIN a{i} USING (rn, p), (SELECT unnest(range(1, (SELECT max(w) FROM x) + 1)) AS j) GROUP BY x.p, m.e, j) GROUP BY p, e),
b{k} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b{i} b LEFT JOIN u{i} u ON b.p = u.p AND b.e = u.e),"""

#: Plain Lloyd rounds over all rows and entries.
VECTOR_CODES = """
WITH k AS (SELECT vec_id, label, [floor(4096 * v::DOUBLE)::BIGINT FOR v IN embedding] AS v,
                  row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn
           FROM embeddings WHERE embedding IS NOT NULL AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0),
x AS MATERIALIZED (SELECT rn, p, w, v[p * w + 1 : (p + 1) * w] AS part
                   FROM (SELECT rn, v, len(v) // 8 AS w FROM k), (SELECT unnest(range(8)) AS p)),
b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, part AS c FROM x WHERE rn <= 16),
""" + "".join(_ROUND.format(i=i, k=i + 1) for i in range(6)) + """
f AS (SELECT rn, p, min({'d': d, 'e': e}) AS m FROM (
      SELECT rn, x.p, e, list_sum([(part[j] - c[j]) * (part[j] - c[j]) FOR j IN range(1, w + 1)])::BIGINT AS d
      FROM x JOIN b6 b ON x.p = b.p) GROUP BY rn, p),
r AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error
      FROM f JOIN k USING (rn) GROUP BY rn, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b6) AS codebooks_sha256
FROM r
"""

#: Every state's least (cost, audit) row by row; state 0 nothing, 1 system, 2 ...user, 3 ...assistant.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         [ascii(ch) FOR ch IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS bytes
  FROM conversations),
crc(bytes, i, c) AS (
  SELECT DISTINCT bytes, 0, 4294967295::BIGINT FROM base
  UNION ALL
  SELECT bytes, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, bytes[i // 9 + 1]::BIGINT)
                            ELSE xor(c >> 1, (c & 1) * 3988292384) END
  FROM crc WHERE i < 9 * len(bytes)),
kinds AS (SELECT bytes, xor(c, 4294967295) % 20 AS kind FROM crc WHERE i = 9 * len(bytes)),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
         FROM base JOIN kinds USING (bytes) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                        md5(length(role) || ':' || role || ':' || text), again) AS i FROM hurt),
judged AS (SELECT *, left(role, 1) AS ini,
                  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
           FROM placed),
lines AS MATERIALIZED (SELECT *, coalesce(conv_id::VARCHAR, 'null') AS c,
                       coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS illegal
                       FROM judged),
report AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n
           FROM lines GROUP BY c),
gap(a, b, ins, made, spent) AS (VALUES                       -- insertions before a row or at the end
  (0, 0, '', '', 0), (1, 1, '', '', 0), (2, 2, '', '', 0), (3, 3, '', '', 0),
  (0, 2, 'I', 'user:', 2), (1, 2, 'I', 'user:', 2), (3, 2, 'I', 'user:', 2), (2, 3, 'I', 'assistant:', 2),
  (0, 3, 'II', 'user:' || chr(10) || 'assistant:', 4), (1, 3, 'II', 'user:' || chr(10) || 'assistant:', 4)),
best(c, i, state, m) AS (
  SELECT c, 0, 0, {'cost': 0, 'audit': '', 'made': ''} FROM report
  UNION ALL
  SELECT c, i, state, min({'cost': cost, 'audit': audit, 'made': made}) FROM (
    SELECT l.c, l.i, e.t AS state, s.m.cost + g.spent + e.cost AS cost, s.m.audit || g.ins || e.edit AS audit,
           concat_ws(chr(10), nullif(s.m.made, ''), nullif(g.made, ''), e.made) AS made
    FROM best s JOIN lines l ON l.c = s.c AND l.i = s.i + 1 JOIN gap g ON g.a = s.state,
         LATERAL (SELECT 'D' AS edit, g.b AS t, 3 AS cost, NULL AS made
                  UNION ALL SELECT 'R', CASE g.b WHEN 2 THEN 3 ELSE 2 END, 2 + (l.fault IS NOT NULL)::INT,
                                   CASE g.b WHEN 2 THEN 'assistant:' ELSE 'user:' END || l.text
                            WHERE l.fault IS NULL OR l.fault = 'truncated'
                  UNION ALL SELECT 'K', CASE l.ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, (l.fault IS NOT NULL)::INT,
                                   l.role || ':' || l.text
                            WHERE (l.fault IS NULL OR l.fault = 'truncated')
                              AND ((l.ini = 's' AND g.b = 0) OR (l.ini = 'u' AND g.b <> 2) OR (l.ini = 'a' AND g.b = 2))) e)
  GROUP BY c, i, state),
done AS (SELECT c, min({'cost': m.cost + g.spent, 'audit': m.audit || g.ins,
                        'made': concat_ws(chr(10), nullif(m.made, ''), nullif(g.made, ''))}) AS m
         FROM best JOIN report USING (c) JOIN gap g ON g.a = state WHERE i = n AND g.b IN (0, 3) GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(m.cost, 0)::BIGINT AS cost,
       coalesce(m.audit, '') AS audit, sha256(coalesce(m.made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'null') AS c FROM conversations)
     LEFT JOIN report USING (c) LEFT JOIN done USING (c)
"""
