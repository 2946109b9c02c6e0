"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from rowsight.llm.conversations import BODY, CONTROL, END, ESCAPE, START

#: 52 bits of a digest over 2 ** 52
UNIFORM = "(('0x' || substr(md5({}), 1, 13))::UBIGINT)"

SOURCE_MIXTURE = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM counts) / ((SELECT count(*) FROM counts)::DOUBLE * n) AS rate FROM counts),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
),
drawn AS (SELECT *, {UNIFORM.format("doc_id::VARCHAR || ':11:1'")} / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS copies
  FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       CAST({UNIFORM.format("doc_id::VARCHAR || ':' || copy::VARCHAR || ':11:order'")} AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, copies)) AS copy FROM counted)
"""


def _escaped(text: str) -> str:
    for i, control in enumerate([ESCAPE, *CONTROL]):
        text = f"replace({text}, '{control}', '{ESCAPE}{i}')"
    return text


REPLY_TREES = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS t(conv_id, turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum({len(START) + len(BODY) + len(END)} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


#: vectors that can link, their pairs, and what links lead to
NEAR_VECTORS = """
WITH RECURSIVE able AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, x -> x <> 0)) > 0
),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
),
reached AS (SELECT a AS node, b AS other FROM pairs UNION SELECT r.node, p.b FROM reached r JOIN pairs p ON r.other = p.a),
least AS (SELECT node, min(other) AS other FROM reached GROUP BY node),
degree AS (SELECT a AS node, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, vec_id <= coalesce(other, vec_id) AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN degree d ON d.node = e.vec_id LEFT JOIN least l ON l.node = e.vec_id
"""


def all_sql() -> dict[str, str]:
    return {"op6_source_mixture": SOURCE_MIXTURE, "op8_reply_trees": REPLY_TREES, "op13_projection_passes": NEAR_VECTORS}
