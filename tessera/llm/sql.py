"""SQL (DuckDB) that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from tessera.llm import rules

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (SELECT vec_id, n, generate_subscripts(e, 1) AS j, unnest(e) AS x FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c AS q JOIN c ON q.j = c.j AND q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: Sketches are exact on tables of up to their accuracy in rows a group, so discrete quantiles equal them there.
RULES_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS lang_key, coalesce('=' || source, '') AS source_key, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, lang_key, source_key, text, regexp_extract_all(text, '[^ \t-\r]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS n
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, lang_key, source_key, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
   len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN repeated USING (doc_id)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbol_rate, n_dup_lines / greatest(n_lines, 1) AS dup_line_rate,
   n_repeat_words / greatest(n_words, 1) AS repeat_rate, word_chars / greatest(n_words, 1) AS word_length FROM counts
), q AS (
  SELECT grouping_id(one, lang_key, source_key) AS level, lang_key, source_key, count(*) AS n, QUANTILES
  FROM (SELECT *, 1 AS one FROM m WHERE NOT base_failed) GROUP BY ROLLUP (one, lang_key, source_key)
), judged AS (
  SELECT m.*, FENCES FROM m LEFT JOIN q AS q0 ON q0.level = 0 AND q0.n >= 50 AND q0.lang_key = m.lang_key AND q0.source_key = m.source_key
   LEFT JOIN q AS q1 ON q1.level = 1 AND q1.n >= 50 AND q1.lang_key = m.lang_key LEFT JOIN q AS q3 ON q3.level = 3
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND VERDICT AS kept FROM judged
"""

#: crc32 is linear: a byte's share depends on its value and on how many bytes follow, so shares are looked up and xor-ed.
VARIANTS_SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), d AS (SELECT row_number() OVER () AS i, * FROM (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run)),
b AS (SELECT i, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM d),
bits AS (SELECT range AS b, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256) UNION ALL SELECT b, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
t AS (SELECT b, c FROM bits WHERE k = 8),
z AS (SELECT b, c, 0 AS k FROM t UNION ALL SELECT z.b, xor(t.c, z.c >> 8), k + 1 FROM z JOIN t ON t.b = z.c & 255 WHERE k < (SELECT max(length(h)) / 2 FROM b)),
start AS (SELECT CAST(4294967295 AS BIGINT) AS c, 0 AS k UNION ALL SELECT xor(t.c, start.c >> 8), k + 1 FROM start JOIN t ON t.b = start.c & 255 WHERE k < (SELECT max(length(h)) / 2 FROM b)),
bytes AS (SELECT i, length(h) // 2 AS size, unnest(range(length(h) // 2)) AS place, h FROM b),
sums AS (SELECT i, size, bit_xor(z.c) AS x FROM bytes JOIN z ON z.b = CAST('0x' || substr(h, 2 * place + 1, 2) AS INTEGER) AND z.k = size - 1 - place GROUP BY i, size),
crc AS (SELECT i, xor(xor(x, start.c), 4294967295) AS h FROM sums JOIN start ON start.k = size),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM d JOIN crc USING (i) GROUP BY 1
), words AS (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
cuts AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts AS a JOIN cuts AS b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts AS a JOIN words AS b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cuts AS a JOIN words AS b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, max(n) AS n, arg_min(other, (-n, other)) AS other FROM near GROUP BY word),
judged AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * words.n THEN other END AS form, CASE WHEN best.n >= 2 * words.n THEN best.n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (SELECT word, word AS root, form AS next FROM judged UNION ALL SELECT walk.word, walk.next, judged.form FROM walk JOIN judged ON judged.word = walk.next)
SELECT word, form, root, judged.n, n_near, form_n FROM judged JOIN (SELECT word, root FROM walk WHERE next IS NULL) USING (word)
"""

COLLOCATIONS_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS words FROM p),
grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS sizes (k) WHERE len(words) >= k) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, a, cut, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c JOIN grams AS l ON l.lang = c.lang AND l.k = cut AND l.phrase = array_to_string(words[:cut], ' ')
  JOIN grams AS r ON r.lang = c.lang AND r.k = c.k - cut AND r.phrase = array_to_string(words[cut + 1:], ' ')
), judged AS (SELECT lang, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM cuts GROUP BY lang, phrase, a),
inside AS (SELECT lang, array_to_string(words[i:i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT judged.* FROM judged LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def rules_sql(reach: float = 3.0, least: int = 50) -> str:
    quantiles = ", ".join(f"quantile_disc({m}, [0.25, 0.75, 0.95]) AS {m}" for m in rules.MEASURES)
    fences, verdict = [], []
    for m, (small, large) in rules.MEASURES.items():
        q = f"coalesce(q0.{m}, q1.{m}, q3.{m})"
        slack = f"least(greatest({q}[3] - {q}[2], {small}), {large})"
        fences.append(f"{q}[2] + {reach} * ({q}[2] - {q}[1]) + {slack} AS {m}_most")
        verdict.append(f"coalesce({m} <= {m}_most, true)")
        if m in rules.FLOOR:
            fences.append(f"{q}[1] - {reach} * ({q}[2] - {q}[1]) - {slack} AS {m}_least")
            verdict.append(f"coalesce({m} >= {m}_least, true)")
    text = RULES_SQL.replace("QUANTILES", quantiles).replace("FENCES", ", ".join(fences)).replace("VERDICT", " AND ".join(verdict))
    return text.replace(">= 50 AND", f">= {least} AND")
