"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from tidewater.llm.quality_table import RULES, STOP_WORDS, SYMBOLS

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_LOWERED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

_VERDICTS = ", ".join(f"CASE WHEN {r.measure} {r.op} {r.threshold} AND n_words >= {r.min_words} THEN '{r.name}' END" for r in RULES)

ORACLE = {
    "op2_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
  x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
  l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT DISTINCT a AS i, a AS c FROM e UNION SELECT r.i, e.b FROM r JOIN e ON e.a = r.c)
  SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id FROM s LEFT JOIN (SELECT i, min(c) AS c FROM r GROUP BY i) m ON m.i = s.doc_id""",
    "op8_substrings": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
  p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13), g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p),
  m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s), r AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS pos FROM g JOIN m ON m.s = g.s WHERE m.first < g.doc_id),
  n AS (SELECT doc_id, count(*) AS gone FROM r GROUP BY doc_id), a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
  t AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.pos) AS kept FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = a.doc_id AND r.pos = a.pos) GROUP BY a.doc_id)
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id""",
    "op9_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
  c AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT l.b AS vec_id, c.root FROM c JOIN l ON l.a = c.vec_id),
  n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
  SELECT c.vec_id, CAST(coalesce(max(n.n_links), 0) AS BIGINT) AS n_links, min(c.root) AS component_id, min(c.root) = c.vec_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id GROUP BY c.vec_id""",
    "op10_quality": f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
  p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8), g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM p),
  o AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM g), h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS pos FROM o WHERE times > 1),
  r AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
  x AS (SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
  m AS (SELECT x.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda y: lower(y) IN ({", ".join(f"'{s}'" for s in sorted(set(STOP_WORDS)))}))) AS n_stop_words FROM x LEFT JOIN r ON r.doc_id = x.doc_id),
  q AS (SELECT *, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0.0) AS mean_word_chars, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0.0) AS symbol_ratio, coalesce(n_stop_words::DOUBLE / nullif(n_words, 0), 0.0) AS stop_ratio,
    coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0.0) AS repeat_ratio, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0.0) AS dup_line_ratio FROM m),
  z AS (SELECT *, concat_ws(',', {_VERDICTS}) AS reasons, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND reasons = '' AS kept, reasons FROM z""",
    "op11_ball_kmeans": """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
  s AS (SELECT e, row_number() OVER (ORDER BY sha256('3:' || vec_id), e) AS k FROM v WHERE vec_id IS NOT NULL QUALIFY k <= 8),
  c AS (SELECT 0 AS round, list(e ORDER BY k) AS cs FROM s
    UNION ALL SELECT round + 1, list_transform(range(1, len(cs) + 1), lambda k: coalesce(moved[k], cs[k])) FROM (
      SELECT any_value(round) AS round, any_value(cs) AS cs, map_from_entries(list((k, m))) AS moved FROM (
        SELECT any_value(round) AS round, any_value(cs) AS cs, k, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM (
          SELECT any_value(round) AS round, any_value(cs) AS cs, k, j, sum(x) AS t, count(*) AS n FROM (
            SELECT round, cs, k, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM (
              SELECT round, cs, e, list_position(ds, list_min(ds)) AS k FROM (SELECT round, cs, e, list_transform(cs, lambda c: list_sum(list_transform(range(1, 65), lambda i: (e[i] - c[i]) * (e[i] - c[i])))) AS ds FROM c, v WHERE round < 10))) GROUP BY k, j) GROUP BY k) HAVING count(*) > 0)),
  f AS (SELECT cs FROM c WHERE round = 10),
  d AS (SELECT vec_id, cs, list_transform(cs, lambda c: list_sum(list_transform(range(1, 65), lambda i: (e[i] - c[i]) * (e[i] - c[i])))) AS ds FROM v, f),
  a AS (SELECT vec_id, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster, CAST(list_min(ds) AS BIGINT) AS distance, sha256(array_to_string(cs[list_position(ds, list_min(ds))], ',')) AS centroid_sha256 FROM d)
  SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a""",
    "op12_chat_format": r"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
  c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
  s AS (SELECT *, '<|im_start|>' || regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<(\\*)\|', '<\1\\|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10) AS segment FROM c)
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(segment)) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id""",
    "op13_phrase_hash": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p), s AS (SELECT lang, count(*) AS n FROM (SELECT lang, unnest(ws) FROM w) GROUP BY lang),
  g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(ws) >= k),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
  c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
  x AS (SELECT c.lang, c.k, phrase, a, ws, array_to_string(ws[:i], ' ') AS left_part, array_to_string(ws[i + 1:], ' ') AS right_part, i FROM c, (VALUES (1), (2)) t(i) WHERE i < c.k),
  y AS (SELECT x.lang, x.k, x.phrase, a, i, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = left_part JOIN f r ON r.lang = x.lang AND r.phrase = right_part),
  b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
  d AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[:2], ' '), array_to_string(ws[2:], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase),
  o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase AND b.k = 2 WHERE most IS NULL OR 100 * most < 50 * a)
  SELECT o.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM o JOIN s ON s.lang = o.lang WHERE rank <= 2000""",
}
