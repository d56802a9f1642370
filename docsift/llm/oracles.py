"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {}

ORACLES["op2_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
),
firsts AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
bad AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN firsts USING (h), range(0, 13) r(k) WHERE doc_id > least),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM each ANTI JOIN bad USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op4_url_filters"] = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""

_RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 0.05),
    "dup_line_rate": ("n_dup_lines", "n_lines", 0.5),
    "repeat_rate": ("n_repeat_words", "n_words", 0.25),
    "word_length": ("word_chars", "n_words", 3.0),
}
_QUARTILES = ", ".join(f"quantile_disc({r}, 0.25) AS {r}_1, quantile_disc({r}, 0.75) AS {r}_3" for r in _RATES)
_INSIDE = " AND ".join(f"{r} <= {r}_3 + 3.0 * ({r}_3 - {r}_1) + {s}" for r, (_, _, s) in _RATES.items())

ORACLES["op5_quality_rules"] = f"""
WITH w AS (SELECT doc_id, lang, source, text, {WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, i, words[i:i + 7] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)
),
twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN twice USING (doc_id, g), range(0, 8) r(k) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
),
c AS (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
),
r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    {", ".join(f"{a}::DOUBLE / greatest(1, {b}) AS {r}" for r, (a, b, _) in _RATES.items())}
  FROM c
),
t AS (SELECT lang, source, {_QUARTILES} FROM r WHERE NOT base_failed GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({_INSIDE}
    AND word_length >= word_length_1 - 3.0 * (word_length_3 - word_length_1) - 3.0, true) AS kept
FROM r LEFT JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source
"""

ORACLES["op6_ngram_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, sha256(array_to_string(words[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM g a JOIN g b ON a.h = b.h AND a.doc_id != b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b, n_both = na.n AND n_both = nb.n AS same FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE n_both >= 0.8 * (na.n + nb.n - n_both) - 1e-9
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, least(doc_id, coalesce(c.m, doc_id)) AS class_id, least(doc_id, coalesce(s.m, doc_id)) AS same_id,
  coalesce(k.n, 0)::BIGINT AS n_links
FROM documents
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = doc_id
LEFT JOIN (SELECT a, min(b) AS m FROM links WHERE same GROUP BY a) s ON s.a = doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = doc_id
"""

ORACLES["op8_mixing"] = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source
),
levels AS (
  SELECT o.source AS source, 3.0 * o.n / o.w AS full_at,
    ((SELECT sum(n) FROM s) - coalesce(sum(3 * i.n) FILTER (before), 0))::DOUBLE
      / ((SELECT sum(w) FROM s) - coalesce(sum(i.w) FILTER (before), 0))::DOUBLE AS level
  FROM s o, (SELECT *, 0 AS one FROM s) i, LATERAL (
    SELECT (3.0 * i.n / i.w < 3.0 * o.n / o.w) OR (3.0 * i.n / i.w = 3.0 * o.n / o.w
      AND coalesce(i.source < o.source, o.source IS NULL AND i.source IS NOT NULL)) AS before)
  GROUP BY o.source, o.n, o.w
),
chosen AS (SELECT arg_min(level, full_at) AS level FROM levels WHERE full_at >= level),
t AS (SELECT source, n, least(n * 3.0::DOUBLE, w * level) AS target FROM s, chosen),
d AS (
  SELECT doc_id, size, n, target, CASE WHEN n > 0 THEN target / n ELSE 1.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS coin
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, n AS source_size, target::DOUBLE AS target,
  (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d
"""

ORACLES["op11_phrase_mining"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (
    SELECT lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
  )
),
f AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) r(k))
  )
  GROUP BY ALL
),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
inner_of AS (
  SELECT lang, phrase, max(m) AS m
  FROM (
    SELECT lang, m, array_to_string(w[i:i + s - 1], ' ') AS phrase
    FROM (SELECT lang, a AS m, w, s, unnest(range(1, k - s + 2)) AS i FROM c, range(2, 4) r(s) WHERE s < k)
  )
  GROUP BY ALL
),
kept AS (
  SELECT c.* FROM c LEFT JOIN inner_of USING (lang, phrase) WHERE m IS NULL OR 100::HUGEINT * m < 80::HUGEINT * a
),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)
),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
),
lowest AS (
  SELECT lang, phrase, a, l, r, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

#: moves of a row by its initial (0 other, 1 system, 2 user, 3 assistant) and the state before it (0 nothing, 1 s, 2 u, 3 a)
_KEEP = [(1, 0, 1), (2, 0, 2), (2, 1, 2), (2, 3, 2), (3, 2, 3)]
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_MOVES = [(i, q, "K", 0, t, None) for i, q, t in _KEEP]
_MOVES += [(i, q, "R", 3, t, "user" if t == 2 else "assistant") for i in range(4) for q, t in _NEXT.items()]
_INSERTS = [(q, q, "", 0, "") for q in range(4)]
_INSERTS += [(q, t, "I", 3, "user:\n" if t == 2 else "assistant:\n") for q, t in _NEXT.items()]
_INSERTS += [(q, 3, "II", 6, "user:\nassistant:\n") for q in (0, 1)]


def _values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)


ORACLES["op12_conversation_repair"] = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS chars
  FROM conversations
),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(chars, lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))),
    4294967295) % 20 AS d
  FROM named
),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, range(0, 2) r(copy) WHERE d != 0 AND (copy = 0 OR d = 3)
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM rows_after
),
marked AS (
  SELECT conv_id, turn, role, text, pos,
    CASE substr(role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS initial,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut
  FROM ordered
),
faults AS (
  SELECT conv_id, turn, role, text, pos, initial, blank, seen AND NOT blank AS duplicate, cut AND NOT blank AND NOT seen AS truncated,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) * 4 + initial NOT IN (6, 11, 14), false) AS illegal
  FROM marked
),
totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(pos) AS n
  FROM faults GROUP BY conv_id
),
moves(initial, q, letter, cost, q2, new_role) AS (VALUES {_values(_MOVES)}),
inserts(q, q2, letters, cost, rows) AS (VALUES {_values(_INSERTS)}),
dp AS (
  SELECT conv_id, 0::BIGINT AS pos, q2 AS q, cost, letters::VARCHAR AS audit, rows::VARCHAR AS rows FROM totals, inserts WHERE q = 0
  UNION ALL
  SELECT * FROM (
    SELECT dp.conv_id, f.pos, i.q2 AS q, dp.cost + m.cost + i.cost AS cost, dp.audit || m.letter || i.letters AS audit, dp.rows || m.line || i.rows AS rows
    FROM dp JOIN faults f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos + 1,
    LATERAL (
      SELECT 'D' AS letter, 4 AS cost, dp.q AS q2, '' AS line
      UNION ALL
      SELECT letter, cost + CASE WHEN f.truncated THEN 3 ELSE 0 END, q2, coalesce(new_role, f.role) || ':' || f.text || chr(10)
      FROM moves WHERE moves.initial = f.initial AND moves.q = dp.q AND NOT f.blank AND NOT f.duplicate
    ) m JOIN inserts i ON i.q = m.q2
    QUALIFY row_number() OVER (PARTITION BY dp.conv_id, f.pos, i.q2 ORDER BY dp.cost + m.cost + i.cost, dp.audit || m.letter || i.letters) = 1
  )
),
best AS (
  SELECT dp.conv_id, cost, audit, rows FROM dp JOIN totals t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.n = dp.pos
  WHERE q IN (0, 3) QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost, audit) = 1
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(rows[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
