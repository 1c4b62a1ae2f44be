"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rulespark.llm import quality


def _rules() -> str:
    by = {"n_words": "n_words", "mean_word_chars": "word_chars / n", "symbol_ratio": "n_symbols / n", "stop_ratio": "n_stop / n", "dup_line_ratio": "n_dup_lines / n_lines", "repeat_ratio": "n_repeat_words / n"}
    out = []
    for r in quality.RULES:
        for sign, bound in ((">=", r.least), ("<=", r.most)):
            if bound is not None:
                out.append(f"(n_words < {r.from_words} OR {by[r.metric]} {sign} {bound})")
    return " AND ".join(out)


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(" ".join(quality.STOP_WORDS).split()))

_QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t)),
g AS (SELECT r, i, word, lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS rest FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, rest) AS n FROM g WHERE rest IS NOT NULL) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, (SELECT unnest(range(5)) AS k) GROUP BY r),
c AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (word IN ({_STOP})) AS n_stop FROM w GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stop, 0)::BIGINT AS n_stop, greatest(coalesce(n_lines, 0), 1) AS n_lines, greatest(coalesce(n_words, 0), 1) AS n
  FROM t LEFT JOIN c USING (r) LEFT JOIN l USING (r) LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {_rules()} AS kept
FROM m
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS pos
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((k - 1) % 3 + 1)::INT]::BIGINT AS w, (sum(s) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(2 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lev
  FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * s / w, k)),
t AS (SELECT source, s, least(2.0::DOUBLE * s, greatest(w * max(lev) OVER (), 0.0::DOUBLE)) AS target, greatest(1, ceil(s * 4096.0::DOUBLE / greatest(total, 1)))::BIGINT AS nb FROM l),
r AS (SELECT d.*, t.s, t.target, least(floor(pos / 4503599627370496.0::DOUBLE * nb)::BIGINT, nb - 1) AS block, least(floor(target / greatest(s, 1)), 2)::BIGINT AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT source, block, any_value(target) AS target, any_value(s) AS s, any_value(whole) AS whole, sum(size)::BIGINT AS bs FROM r GROUP BY source, block),
c AS (SELECT source, block, bs, target - whole * s - coalesce(sum(bs) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest FROM b),
x AS (SELECT r.*, c.rest, c.bs, (sum(size) OVER (PARTITION BY r.source, r.block ORDER BY pos))::BIGINT AS upto FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.block = c.block),
z AS (SELECT source, block, max(pos) AS last FROM x WHERE upto - size / 2.0::DOUBLE <= rest GROUP BY source, block),
y AS (SELECT x.*, whole + CASE WHEN rest <= 0 THEN 0 WHEN rest >= bs THEN 1 WHEN pos <= last THEN 1 ELSE 0 END AS times FROM x LEFT JOIN z ON x.source IS NOT DISTINCT FROM z.source AND x.block = z.block)
SELECT doc_id, size, s AS source_size, target, (size * times)::BIGINT AS taken, times::BIGINT AS times FROM y
"""

_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

SQL: dict[str, str] = {"op5_mix_sources": _MIX, "op6_quality_rules": _QUALITY, "op10_exact_topk": _TOPK}
