"""SQL counterparts of ``queries`` for DuckDB over the same tables.

They state the answer from the tables directly: where a query renders pages or
inventories and extracts them again, its counterpart computes the expected rows
from the rendered table.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# --- shared expressions -----------------------------------------------------


def case(number: str, values: list[str | None]) -> str:
    quoted = ["NULL" if v is None else f"'{v}'" for v in values]
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted[:-1]))
    return f"CASE {number} {whens} ELSE {quoted[-1]} END"


ROLES = ["function", "type", "enum", "macro", "enumerator", "data", "label", "", "class"]
DOMAINS = ["cpp", "c", "py", "std"]
W1, W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
SWAPPED = "left({w}, 1) || substr({w}, 3, 1) || substr({w}, 2, 1) || substr({w}, 4)"
CAMEL = f"p_type || '_' || {W1} || upper(left({W2}, 1)) || substr({W2}, 2)"
TITLE = f"upper(left({W1}, 1)) || substr({W1}, 2) || '{{sep}}' || upper(left({W2}, 1)) || substr({W2}, 2)"

SYMBOLS = f"""symbols AS (
  SELECT 'lib_' || (p_partkey % 3) AS source, p_partkey AS pos, {CAMEL} AS name,
         'https://docs.example.com/item/' || (p_partkey - p_partkey % 12 + p_partkey % 6) AS url,
         {case('p_size % 9', ROLES)} AS role, {case('p_partkey % 4', DOMAINS)} AS domain
  FROM part)"""


def segments(name: str) -> str:
    cut = f"regexp_replace(regexp_replace({name}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')"
    parts = f"regexp_split_to_array({cut}, '[_:\\-]+')"
    return f"list_filter(list_transform({parts}, lambda x: lower(x)), lambda x: x <> '')"


def bare(name: str) -> str:
    return f"trim(split_part({name}, '(', 1))"


def tier(term: str, name: str) -> str:
    segs = segments(bare(name))
    return f"""CASE WHEN {term} = lower({name}) OR {term} = lower({bare(name)}) THEN 100.0
      WHEN list_contains({segs}, {term}) THEN 97.0
      WHEN len(list_filter({segs}, lambda x: starts_with(x, {term}))) > 0 THEN 94.0
      WHEN contains(lower({name}), {term}) THEN 88.0 END"""


def ratios(pairs: str) -> str:
    """CTEs that end in ``ratio(term, text, ratio)`` for a relation ``pairs`` of (term, text)."""
    row = """list_reduce(list_transform(range(1, length(s) + 1), lambda j: [j]),
        lambda r, j: list_append(r, CASE WHEN substr(s, j[1], 1) = substr(w, c[1], 1) THEN acc[j[1]] + 1
                                         ELSE greatest(acc[j[1] + 1], r[-1]) END), [0::BIGINT])"""
    lcs = f"""list_reduce(list_transform(range(1, length(w) + 1), lambda i: [i]),
        lambda acc, c: {row}, list_transform(range(0, length(s) + 1), lambda z: 0::BIGINT))[-1]"""
    return f"""
  sides AS (SELECT DISTINCT term, text, term AS s, text AS l FROM {pairs} WHERE length(term) <= length(text)
            UNION ALL SELECT DISTINCT term, text, text, term FROM {pairs} WHERE length(text) <= length(term)),
  starts AS (SELECT *, unnest(range(1 - length(s), length(l))) AS p FROM sides),
  windows AS (SELECT DISTINCT term, text, s, substr(l, greatest(p, 0) + 1, least(p + length(s), length(l)) - greatest(p, 0)) AS w
              FROM starts),
  ratio AS (SELECT term, text, max(200.0 * {lcs} / (length(s) + length(w))) AS ratio FROM windows GROUP BY term, text)"""


def bonus(role: str) -> str:
    return f"""CASE coalesce({role}, '') WHEN 'function' THEN 4 WHEN 'type' THEN 1 WHEN 'enum' THEN -3 WHEN 'data' THEN -3
      WHEN '' THEN -5 WHEN 'enumerator' THEN -8 WHEN 'label' THEN -10 ELSE 0 END"""


def ranked_score(base: str, role: str) -> str:
    return f"greatest(0.0, least(100.0, {base} + {bonus(role)}))"


# --- one query over a list of sources ---------------------------------------


def literal_search(groups: list[list[str]], sources: list[tuple[str, str, float]], similarity: bool) -> str:
    """Fuzzy search: ``sources`` lists (source, requested name, threshold) in request order."""
    asked = ", ".join(f"('{s}', '{r}', {i}, {t})" for i, (s, r, t) in enumerate(sources))
    terms = ", ".join(
        f"({g}, '{','.join(group)}', {len(group)}, '{t.lower()}')" for g, group in enumerate(groups) for t in group
    )
    sim = ratios("open") if similarity else "ratio AS (SELECT '' AS term, '' AS text, 0.0 AS ratio)"
    return f"""WITH {SYMBOLS},
  asked(source, requested, request_ord, cut) AS (VALUES {asked}),
  terms(g, label, n, term) AS (VALUES {terms}),
  names AS (SELECT DISTINCT name FROM symbols),
  tiers AS (SELECT DISTINCT term, name, {tier('term', 'name')} AS tier FROM names, terms),
  open AS (SELECT term, lower(name) AS text FROM tiers WHERE tier IS NULL),
  {sim},
  scores AS (SELECT t.term, t.name, coalesce(t.tier, least(82.0, r.ratio)) AS base
             FROM tiers t LEFT JOIN ratio r ON r.term = t.term AND r.text = lower(t.name)),
  groups AS (SELECT s.source, s.pos, s.name, s.url, s.role, s.domain, a.requested, a.request_ord, t.g, t.label, min(x.base) AS base
             FROM symbols s JOIN asked a USING (source) CROSS JOIN terms t JOIN scores x ON x.term = t.term AND x.name = s.name
             WHERE x.base >= a.cut
             GROUP BY ALL HAVING count(*) = any_value(t.n)),
  ranked AS (SELECT *, {ranked_score('base', 'role')} AS score FROM groups),
  per_row AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY source, pos ORDER BY score DESC, g) = 1),
  per_url AS (SELECT *, min(pos) OVER (PARTITION BY source, url) AS tie_pos,
                     row_number() OVER (PARTITION BY source, url ORDER BY score DESC, pos) AS rn FROM per_row)
  SELECT {{columns}} FROM per_url WHERE rn = 1"""


RANK = "CAST(row_number() OVER (ORDER BY score DESC, request_ord, tie_pos) AS INT) AS rank"
FULL = f'{RANK}, name AS "group", url, role, domain, requested AS source, round(score, 6) AS score, label AS matched_keyword, CAST(NULL AS VARCHAR) AS origin'

ORACLES["fuzzy_search_tiers"] = literal_search(
    [["red", "widget"], ["bolt"], ["ECON"]],
    [("lib_2", "lib_2", 83.0), ("lib_1", "tag1", 83.0), ("lib_0", "lib_0", 83.0)],
    False,
).format(columns=FULL)
ORACLES["search_limit"] = ORACLES["fuzzy_search_tiers"].replace("SELECT CAST(row_number()", "SELECT * FROM (SELECT CAST(row_number()") + ") WHERE rank <= 20"
ORACLES["search_nulls"] = (
    ORACLES["fuzzy_search_tiers"]
    .replace("WITH symbols AS", "WITH whole AS", 1)
    .replace(
        "asked(source",
        """symbols AS (SELECT source, pos, CASE WHEN pos % 5 <> 0 THEN name END AS name, CASE WHEN pos % 7 <> 0 THEN url END AS url,
                     CASE WHEN pos % 3 <> 0 THEN role END AS role, CASE WHEN pos % 2 <> 0 THEN domain END AS domain FROM whole),
  asked(source""",
        1,
    )
    .replace("(PARTITION BY source, url", "(PARTITION BY source, url, CASE WHEN url IS NULL THEN pos END")
)
ORACLES["fuzzy_search_partial"] = literal_search(
    [["red", "wigdet"], ["blot"], ["Pormo"]], [("lib_0", "lib_0", 60.0), ("lib_1", "lib_1", 70.0)], True
).format(columns=FULL)
ORACLES["best_per_url"] = literal_search(
    [["red"], ["bolt"]], [(f"lib_{i}", f"lib_{i}", 83.0) for i in range(3)], False
).format(columns='source, url, name AS "group", score, label AS matched_keyword, tie_pos')
ORACLES["multi_source_merge"] = literal_search(
    [["gear"]], [("lib_0", "TAG0", 90.0), ("lib_2", "lib_2", 90.0)], False
).format(columns=f'{RANK}, name AS "group", url, requested AS source, score')


def boolean(hits: list[str], sources: list[str], where: str = "true") -> str:
    first = " ".join(f"WHEN {h} THEN {i}" for i, h in enumerate(hits))
    order = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(sources))
    listed = ", ".join(f"'{s}'" for s in sources)
    return f"""WITH {SYMBOLS},
  hit AS (SELECT *, lower(name) AS n, CASE source {order} END AS request_ord FROM symbols
          WHERE source IN ({listed}) AND {where}),
  grouped AS (SELECT *, CASE {first} END AS g FROM hit),
  best AS (SELECT * FROM grouped WHERE g IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY source, url ORDER BY g, pos) = 1)
  SELECT CAST(row_number() OVER (ORDER BY request_ord, g, pos) AS INT) AS rank, name AS "group", url, {{more}} source
  FROM best"""


ORACLES["boolean_search"] = boolean(
    ["contains(n, 'red') AND contains(n, 'widget')", "contains(n, 'old')"], ["lib_1"], "domain IN ('cpp', 'py')"
).format(more="role, domain,")
ORACLES["boolean_search_order"] = boolean(["contains(n, 'gear')", "contains(n, 'red')"], ["lib_2", "lib_0"]).format(
    more=""
)
ORACLES["multi_source_concat"] = f"""WITH {SYMBOLS}
  SELECT CAST(row_number() OVER (ORDER BY source = 'lib_0', pos) AS INT) AS rank, name AS "group", url, source
  FROM symbols WHERE source IN ('lib_1', 'lib_0')"""

# --- tables of queries ------------------------------------------------------


def batch(threshold: str, max_results: str, where: str = "true", asked: str = "true") -> str:
    """Everything about the batch up to ``best`` (one row per match) and ``targets``."""
    swapped = SWAPPED.format(w="w2")
    return f"""WITH {SYMBOLS},
  words AS (SELECT DISTINCT {W1} AS w1, {W2} AS w2 FROM part),
  shapes AS (SELECT w1, w2, unnest(['and', 'or', 'typo', 'bool', 'pipe']) AS tag FROM words),
  queries AS (SELECT *, tag || '-' || w1 || '-' || w2 AS query_id, tag <> 'bool' AS fuzzy,
                     CASE WHEN w2 = 'rod' THEN ['cpp', 'py'] END AS wanted,
                     CASE WHEN w2 = 'rod' THEN 'cpp, py' ELSE 'all' END AS domains,
                     {threshold} AS threshold, {max_results} AS max_results FROM shapes WHERE {where}),
  requests AS (SELECT query_id, r.source, r.requested, r.request_ord FROM queries,
                 (VALUES ('lib_2', 'tag2', 0), ('lib_1', 'lib_1', 1), ('lib_0', 'lib_0', 2)) r(source, requested, request_ord)
               WHERE (request_ord < 2 OR query_id LIKE '%gear') AND {asked}),
  targets AS (SELECT q.*, r.source, r.requested, r.request_ord,
                     CASE WHEN fuzzy THEN coalesce(threshold, CASE r.source WHEN 'lib_1' THEN 70.0 END, 60.0) ELSE 88.0 END AS cut
              FROM queries q JOIN requests r USING (query_id)),
  groups AS (SELECT query_id, 0 AS g, w1 || ',' || w2 AS label, [w1, w2] AS terms FROM queries WHERE tag = 'and'
             UNION ALL SELECT query_id, 0, w1 || ',' || {swapped}, [w1, {swapped}] FROM queries WHERE tag = 'typo'
             UNION ALL SELECT query_id, 0, CASE tag WHEN 'or' THEN upper(w1) ELSE w1 END, [w1] FROM queries WHERE tag IN ('or', 'bool')
             UNION ALL SELECT query_id, 1, w2, [w2] FROM queries WHERE tag IN ('or', 'bool')),
  terms AS (SELECT query_id, g, label, len(terms) AS n, unnest(terms) AS term FROM groups),
  names AS (SELECT DISTINCT name FROM symbols),
  lowest AS (SELECT term, min(cut) AS cut FROM terms JOIN targets USING (query_id) GROUP BY term),
  tiers AS (SELECT term, cut, name, {tier('term', 'name')} AS tier FROM names, lowest),
  open AS (SELECT term, lower(name) AS text FROM tiers WHERE tier IS NULL AND cut <= 82),
  {ratios('open')},
  scores AS (SELECT t.term, t.name, coalesce(t.tier, least(82.0, r.ratio)) AS base
             FROM tiers t LEFT JOIN ratio r ON r.term = t.term AND r.text = lower(t.name)
             WHERE coalesce(t.tier, least(82.0, r.ratio)) >= cut),
  hits AS (SELECT q.query_id, q.requested, q.request_ord, q.fuzzy, t.g, t.label, t.n, s.*, x.base
           FROM terms t JOIN targets q USING (query_id) JOIN symbols s ON s.source = q.source
           JOIN scores x ON x.term = t.term AND x.name = s.name
           WHERE x.base >= q.cut AND (q.wanted IS NULL OR list_contains(q.wanted, s.domain))),
  matched AS (SELECT query_id, requested, request_ord, fuzzy, g, label, source, pos, name, url, role, domain, min(base) AS base
              FROM hits GROUP BY ALL HAVING count(*) = any_value(n)),
  ranked AS (SELECT *, CASE WHEN fuzzy THEN {ranked_score('base', 'role')} END AS score FROM matched),
  per_url AS (SELECT *, min(pos) OVER (PARTITION BY query_id, source, url) AS first_pos,
                     row_number() OVER (PARTITION BY query_id, source, url
                                        ORDER BY CASE WHEN fuzzy THEN -score ELSE g END, pos, g) AS rn FROM ranked),
  best AS (SELECT *, CASE WHEN fuzzy THEN first_pos ELSE pos END AS tie_pos FROM per_url WHERE rn = 1),
  numbered AS (SELECT b.*, max_results,
                      CAST(row_number() OVER (PARTITION BY query_id
                        ORDER BY CASE WHEN b.fuzzy THEN -score ELSE request_ord END,
                                 CASE WHEN b.fuzzy THEN request_ord ELSE g END, tie_pos) AS INT) AS rank
               FROM best b JOIN queries q USING (query_id)),
  results AS (SELECT * FROM numbered WHERE max_results IS NULL OR rank <= max_results)"""


MIXED = "CASE WHEN w1 = 'red' OR w2 = 'red' THEN 65.0 WHEN w1 = 'hot' OR w2 = 'hot' THEN 83.0 END"
BATCH_ROWS = """ SELECT query_id, rank, name AS "group", url, role, domain, requested AS source, round(score, 6) AS score,
         CASE WHEN fuzzy THEN label END AS matched_keyword, CAST(NULL AS VARCHAR) AS origin FROM results"""
ORACLES["fuzzy_search_batch"] = batch(MIXED, "CASE WHEN w1 = 'cold' THEN 7 END") + BATCH_ROWS
ORACLES["fuzzy_search_batch_shuffled"] = ORACLES["fuzzy_search_batch"]
ORACLES["fuzzy_search_low_threshold"] = batch("50.0", "CASE WHEN w1 = 'cold' THEN 7 END", "tag = 'typo'") + BATCH_ROWS
ORACLES["topk_per_query"] = (
    batch("88.0", "CASE WHEN tag = 'or' THEN 3 ELSE 5 END")
    + ' SELECT query_id, rank, name AS "group", url, requested AS source, score FROM results'
)
COUNTS = """,
  counts AS (SELECT t.query_id, t.request_ord, t.requested,
                    (SELECT count(*) FROM symbols s WHERE s.source = t.source
                       AND (t.wanted IS NULL OR list_contains(t.wanted, s.domain))) AS total_found,
                    (SELECT count(*) FROM best b WHERE b.query_id = t.query_id) AS filtered_count
             FROM targets t)"""
ORACLES["search_counts"] = batch("90.0", "NULL") + COUNTS + " SELECT * FROM counts"

ORACLES["export_json_envelope"] = (
    batch("88.0", "4", "true", "(request_ord = 0 OR query_id NOT LIKE '%bolt')")
    + COUNTS
    + """,
  heads AS (SELECT query_id, count(*) AS n, any_value(filtered_count) AS f,
                   string_agg('"' || requested || '"', ',' ORDER BY request_ord) AS names,
                   string_agg('"' || requested || '":' || total_found, ',' ORDER BY request_ord) AS totals,
                   any_value(total_found) AS total
            FROM counts GROUP BY query_id)
  SELECT query_id, rank, '{"group":"' || name || '","url":"' || url || '","role":"' || role || '","domain":"' || domain ||
         '","source":"' || requested || '"' ||
         CASE WHEN fuzzy THEN ',"score":' || CAST(CAST(score AS DOUBLE) AS VARCHAR) || ',"matched_keyword":"' || label || '"' ELSE '' END || '}' AS line
  FROM results
  UNION ALL
  SELECT h.query_id, 0, CASE WHEN n = 1 THEN '{"source":' || names || ',"total_found":' || total
              ELSE '{"sources":[' || names || '],"total_found":{' || totals || '}' END
         || ',"filtered_count":' || f || ',"domains_filter":"' || q.domains || '"}'
  FROM heads h JOIN queries q USING (query_id)"""
)

ORACLES["domain_stats"] = f"""WITH {SYMBOLS},
  n AS (SELECT source, domain, count(*) AS n, min(pos) AS first FROM symbols GROUP BY ALL)
  SELECT source, domain, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS INT) AS rank,
         CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS total FROM n"""

# --- text expressions -------------------------------------------------------

ORACLES["query_parse"] = f"""WITH k AS (
    SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN {W1} || ' ' || {W2} || ' | ' || p_type
      WHEN 1 THEN '| ' || {W1} || ' | | ' || {W2} || ' |' WHEN 2 THEN {W1} || '|' || {W2} WHEN 3 THEN ' | | '
      WHEN 4 THEN '  ' || {W1} || ' ' || chr(9) || ' ' || {W2} || ' ' WHEN 5 THEN '||' || {W1} || ' |' || {W2} END AS keywords
    FROM part),
  t AS (SELECT *, string_split(' ' || regexp_replace(trim(coalesce(keywords, '')), '\\s+', '  ', 'g') || ' ', ' | ') AS parts FROM k)
  SELECT p_partkey, trim(coalesce(keywords, '')) <> '' AS has_keywords,
         CAST(to_json(list_filter(list_transform(parts, lambda p: list_filter(string_split(p, ' '), lambda x: x <> '')),
                                  lambda g: len(g) > 0)) AS VARCHAR) AS or_groups
  FROM t"""

ODD = f"""CASE p_partkey % 4 WHEN 0 THEN {CAMEL} WHEN 1 THEN 'ns::' || lower(p_type) || '--' || {TITLE.format(sep=' ')}
  WHEN 2 THEN '__XMLParser' || {TITLE.format(sep='')} || 'HTTP2' ELSE {CAMEL} || ' ( void* devPtr, ' || p_brand || ' )' END"""
ORACLES["tokenize_names"] = f"""WITH n AS (SELECT p_partkey, {ODD} AS name FROM part)
  SELECT p_partkey, CAST(to_json({segments('name')}) AS VARCHAR) AS segments, {bare('name')} AS bare_name FROM n"""

PAIRS = f"""WITH terms AS (SELECT p_partkey - 1 AS p_partkey, lower(CASE p_partkey % 5 WHEN 0 THEN {W1}
    WHEN 1 THEN {SWAPPED.format(w=W2)} WHEN 2 THEN p_brand || p_type || {W1} || {W2} || 'Extended'
    WHEN 3 THEN left({W2}, 2) ELSE lower(p_type) || '_' || {W1} END) AS term FROM part),
  named AS (SELECT p_partkey, {ODD} AS name FROM part),
  pairs AS (SELECT p_partkey, term, name, lower(name) AS text FROM named JOIN terms USING (p_partkey)),
  {ratios('pairs')}"""
ORACLES["partial_ratio"] = f"{PAIRS} SELECT p_partkey, round(ratio, 6) AS ratio FROM pairs JOIN ratio USING (term, text)"
ORACLES["term_score"] = f"""{PAIRS}
  SELECT p_partkey, term, round(coalesce({tier('term', 'name')}, least(82.0, ratio)), 6) AS score
  FROM pairs JOIN ratio USING (term, text)"""

ORACLES["role_adjust"] = f"""SELECT p_partkey, CAST({ranked_score('p_size * 2.0', case('p_partkey % 10', [*ROLES, None]))} AS DOUBLE) AS ranked_score
  FROM part"""

ORACLES["domain_filter"] = f"""WITH {SYMBOLS}
  SELECT pos, name AS "group", domain FROM symbols
  WHERE pos % 11 = 0 OR CASE pos % 7 WHEN 1 THEN domain IN ('cpp', 'py') WHEN 2 THEN domain = 'c' WHEN 3 THEN false
                                     WHEN 6 THEN domain IN ('std', 'nope') ELSE true END"""

ORACLES["noise_filter"] = """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents)
  SELECT doc_id, count(*) FILTER (word IN ('', '#', ',', '.', '(', ')', '[', ']', ';', ':', '*', '&', '–', '-')) AS noise_words,
         count(*) FILTER (right(word, 1) IN ('', '#', ',', '.', '(', ')', '[', ']', ';', ':', '*', '&', '–', '-')) AS noise_tails
  FROM w GROUP BY doc_id"""

LINES = """array_to_string(list_filter(list_transform(string_split({t}, chr(10)),
    lambda l: regexp_replace(regexp_replace(l, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda l: l <> ''), chr(10))"""
MESSY = "' ' || chr(9) || chr(10) || replace(text, '. ', '.' || chr(9) || '  ' || chr(10) || ' ' || chr(9)) || chr(10) || chr(10)"
ORACLES["normalize_whitespace"] = f"SELECT doc_id, {LINES.format(t=MESSY)} AS text FROM documents"

# --- registry ---------------------------------------------------------------


def site(shift: int) -> str:
    return f"'https://site' || (s_suppkey + {shift}) || '.example.com/'"


SOURCES = f"""sources AS (
  SELECT CASE WHEN s_suppkey % 17 <> 16 THEN s_name END AS name, CAST(s_suppkey AS INT) AS source_ord,
    CASE WHEN s_suppkey % 3 = 0 THEN 'Docs of ' || n_name END AS description,
    {case('s_suppkey % 6', ['sphinx', 'doxygen', 'sphinx_noinv', 'pdf', 'wiki', None])} AS doc_type,
    CASE WHEN s_suppkey % 6 = 0 AND s_suppkey % 4 <> 2 THEN [{site(0)} || 'view', {site(1)} || 'click'] END AS inventory_urls,
    CASE WHEN s_suppkey % 6 IN (1, 2) AND s_suppkey % 5 <> 0 THEN {site(0)} || 'view' END AS index_url,
    CASE WHEN s_suppkey % 6 = 3 AND s_suppkey % 7 <> 0
         THEN {site(0)} || CASE WHEN s_suppkey % 2 = 0 THEN 'view' ELSE 'error' END END AS doc_url,
    CASE WHEN s_suppkey % 6 = 0 AND s_suppkey % 5 <> 0 THEN [{site(2)} || 'signup//', {site(3)}] END AS base_urls,
    CASE WHEN s_suppkey % 4 = 0 THEN 70.0 END AS match_threshold,
    CASE WHEN s_suppkey % 9 <> 8 THEN [lower(r_name), 'alias_' || s_suppkey] WHEN s_suppkey % 2 = 0 THEN [] END AS tags,
    CASE WHEN s_suppkey % 12 = 0 THEN {site(4)} || 'purchase' END AS override_url
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

REQUESTS = """asks AS (SELECT c_custkey, 'c' || c_custkey AS query_id,
    ['Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0'), 'ALIAS_' || (c_custkey % 120),
     CASE c_custkey % 4 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'Asia' WHEN 2 THEN 'nowhere' ELSE 'europe' END] AS names FROM customer),
  requests AS (SELECT c_custkey, query_id, CAST(unnest([0, 1, 2]) AS INT) AS request_ord, unnest(names) AS requested FROM asks),
  by_name AS (SELECT name AS key, min(source_ord) AS source_ord FROM sources WHERE name IS NOT NULL GROUP BY 1),
  by_tag AS (SELECT lower(tag) AS key, min(source_ord) AS source_ord
             FROM (SELECT source_ord, unnest(tags) AS tag FROM sources WHERE name IS NOT NULL) GROUP BY 1),
  resolved AS (SELECT r.*, s.name AS source, s.match_threshold, s.source_ord
               FROM requests r LEFT JOIN by_name n ON n.key = r.requested LEFT JOIN by_tag t ON t.key = lower(r.requested)
               JOIN sources s ON s.source_ord = coalesce(n.source_ord, t.source_ord))"""

ORACLES["load_registry_file"] = f"""WITH {SOURCES}
  SELECT source_ord, name, doc_type, index_url, CAST(match_threshold AS DOUBLE) AS match_threshold, CAST(to_json(tags) AS VARCHAR) AS tags FROM sources"""
ORACLES["list_sources"] = f"""WITH {SOURCES}
  SELECT coalesce(name, '') AS name, coalesce(doc_type, '') AS doc_type, coalesce(description, '') AS description,
         CASE WHEN tags IS NULL THEN '[]' ELSE CAST(to_json(tags) AS VARCHAR) END AS tags FROM sources"""
ORACLES["validate_sources"] = f"""WITH {SOURCES}
  SELECT source_ord, name, 'name is required' AS violation FROM sources WHERE name IS NULL
  UNION ALL SELECT source_ord, name, 'doc_type is required' FROM sources WHERE doc_type IS NULL
  UNION ALL SELECT source_ord, name, 'doc_type is not supported' FROM sources WHERE doc_type = 'wiki'
  UNION ALL SELECT source_ord, name, 'inventory_urls or index_url is required' FROM sources
            WHERE doc_type IS DISTINCT FROM 'pdf' AND inventory_urls IS NULL AND index_url IS NULL
  UNION ALL SELECT source_ord, name, 'doc_url is required for pdf' FROM sources WHERE doc_type = 'pdf' AND doc_url IS NULL"""
ORACLES["resolve_alias"] = f"WITH {SOURCES}, {REQUESTS} SELECT query_id, request_ord, requested, source FROM resolved"
ORACLES["unknown_sources"] = f"""WITH {SOURCES}, {REQUESTS}
  SELECT query_id, request_ord, requested FROM requests r
  WHERE NOT EXISTS (SELECT 1 FROM resolved x WHERE x.query_id = r.query_id AND x.request_ord = r.request_ord)"""
CANONICAL = f"""WITH {SOURCES}, {REQUESTS},
  failed AS (SELECT query_id FROM requests r WHERE requested <> 'nowhere'
             AND NOT EXISTS (SELECT 1 FROM resolved x WHERE x.query_id = r.query_id AND x.request_ord = r.request_ord)),
  chosen AS (SELECT * FROM resolved WHERE query_id NOT IN (SELECT query_id FROM failed)
             QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY request_ord) = 1)"""
ORACLES["canonical_dedup"] = f"{CANONICAL} SELECT query_id, request_ord, requested, source FROM chosen"
ORACLES["threshold_resolve"] = f"""WITH {SOURCES}, {REQUESTS}
  SELECT query_id, request_ord, source,
         CAST(coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 END, match_threshold, 60.0) AS DOUBLE) AS cut FROM resolved"""

LOG = """log AS (
  SELECT 'https://site' || user_id || '.example.com/' || event_type AS url, event_type, ts,
         event_id % 11 = 0 AS failed, CASE WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS code, event_id % 5 = 0 AS moved FROM events),
  latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC) = 1),
  health AS (SELECT url, CASE WHEN NOT failed THEN CAST(code AS INT) END AS status, NOT failed AND code = 200 AS ok,
                    CASE WHEN NOT failed AND moved THEN url || '/' END AS redirected_to,
                    CASE WHEN failed THEN '' WHEN event_type = 'view' THEN 'text/HTML; charset=utf-8' ELSE 'application/pdf' END AS content_type,
                    CASE WHEN failed THEN 'timed out' END AS error FROM latest)"""
ORACLES["url_health"] = f"WITH {LOG} SELECT * FROM health"

# Final addresses are <site>/<type> or <site>/<type>/, so the file beside them is
# <site>/objects.inv or <site>/<type>/objects.inv; the log holds neither.
REACHABLE = """tries AS (
    SELECT name, source_ord, 0 AS priority, override_url AS url FROM sources WHERE override_url IS NOT NULL
    UNION ALL SELECT name, source_ord, 1 + i, inventory_urls[i + 1] FROM sources, range(2) r(i) WHERE inventory_urls IS NOT NULL),
  reachable AS (SELECT name AS source, arg_min(coalesce(redirected_to, h.url), priority) AS inventory_url
                FROM tries t JOIN health h ON h.url = t.url WHERE h.status < 400 AND name IS NOT NULL GROUP BY 1)"""
ORACLES["first_reachable"] = f"WITH {SOURCES}, {LOG}, {REACHABLE} SELECT * FROM reachable"

STATUS = f"""{CANONICAL}, {LOG}, {REACHABLE},
  reasons AS (SELECT s.name AS source, doc_type, inventory_url, index_url, doc_url,
     CASE WHEN source_ord % 13 = 12 THEN 'fetch error' WHEN doc_type = 'sphinx' THEN CASE WHEN inventory_url IS NULL THEN 'no inventory' END
          WHEN doc_type = 'sphinx_noinv' THEN CASE WHEN source_ord % 9 >= 3 THEN 'no genindex' END
          WHEN doc_type = 'pdf' THEN 'pdf' WHEN doc_type = 'doxygen' THEN NULL
          ELSE 'unsupported doc_type: ' || coalesce(doc_type, 'None') END AS skipped_reason
     FROM sources s LEFT JOIN (SELECT * FROM reachable) r ON r.source = s.name AND doc_type = 'sphinx' WHERE s.name IS NOT NULL),
  status AS (SELECT c.query_id, c.request_ord, c.requested, r.source, r.doc_type, r.inventory_url, r.skipped_reason,
     CASE skipped_reason WHEN 'no genindex' THEN coalesce(index_url, '') WHEN 'pdf' THEN coalesce(doc_url, index_url, '') END AS doc_url
     FROM chosen c JOIN reasons r USING (source))"""
ORACLES["source_status"] = f"""{STATUS}
  SELECT *, '''' || requested || '''' || CASE
     WHEN skipped_reason = 'no inventory' THEN ': no valid objects.inv found, skipping'
     WHEN skipped_reason = 'no genindex' THEN ' (sphinx_noinv): no genindex available, skipping'
     WHEN skipped_reason = 'pdf' THEN ' (pdf) does not support symbol search, skipping'
     WHEN skipped_reason = 'fetch error' THEN ': fetch failed (malformed link), skipping'
     WHEN skipped_reason IS NOT NULL THEN ': unsupported doc_type ''' || coalesce(doc_type, 'None') || ''', skipping' END AS warning
  FROM status"""
SHOWN = "skipped_reason IS NOT NULL AND coalesce(doc_url, '') <> ''"
ORACLES["skipped_sources"] = f"{STATUS} SELECT query_id, requested, doc_url FROM status WHERE {SHOWN}"
ORACLES["placeholder_rows"] = f"""{STATUS}
  SELECT query_id, request_ord, CASE WHEN skipped_reason = 'pdf' THEN '[PDF manual]' ELSE '[docs (no inventory)]' END
         || chr(9) || doc_url || chr(9) || chr(9) || chr(9) || requested AS line FROM status WHERE {SHOWN}"""

# --- source health ----------------------------------------------------------


def struct(check: str, ok: str, detail: str) -> str:
    return f"{{'check': '{check}', 'ok': {ok}, 'detail': {detail}}}"


REDIRECT = "coalesce(' (redirected to ' || redirected_to || ')', '')"
OUTCOME = "coalesce(CAST(status AS VARCHAR), error, 'not in crawl log')"
OBJECTS = f"""counted AS (
    SELECT 'https://site' || (p_partkey // 13) || '.example.com/' || {case('p_partkey % 4', ['view', 'click', 'click/', 'view/'])} AS url,
           {case('p_size % 4', DOMAINS)} AS domain, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL),
  counts AS (SELECT url, sum(n) AS total,
                    '{{' || string_agg('''' || domain || ''': ' || n, ', ' ORDER BY first) || '}}' AS domains FROM counted GROUP BY url)"""
LINKS = """links AS (SELECT 'https://site' || (p_partkey // 10) || '.example.com/view' || CASE WHEN (p_partkey // 10) % 2 = 1 THEN '/' ELSE '' END AS url,
    count(*) FILTER (p_size % 16 < 2) AS n_links FROM part GROUP BY 1)"""
FLAT = "unnest(range(len(c))) AS i, unnest(c) AS x"

INVENTORY_CHECKS = f"""own AS (
    SELECT source_ord, list_concat(coalesce(inventory_urls, []),
      coalesce(list_filter(list_transform(base_urls, lambda b: rtrim(b, '/') || '/objects.inv'),
                           lambda u: NOT list_contains(coalesce(inventory_urls, []), u)), [])) AS urls
    FROM sources WHERE doc_type = 'sphinx'),
  flat AS (SELECT source_ord, unnest(range(len(urls))) AS nth, unnest(urls) AS url FROM own),
  tried AS (SELECT f.*, h.status, h.error, h.redirected_to, coalesce(h.ok, false) AS ok, coalesce(c.total, 0) AS total,
                   coalesce(c.domains, '{{}}') AS domains,
                   coalesce(max(CASE WHEN coalesce(h.ok, false) AND c.total > 0 THEN 1 ELSE 0 END)
                     OVER (PARTITION BY source_ord ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
            FROM flat f LEFT JOIN health h ON h.url = f.url LEFT JOIN counts c ON c.url = coalesce(h.redirected_to, f.url)),
  inventory_checks AS (
    SELECT source_ord, CAST(nth * 2 AS INT) AS check_ord, 'inventory_url' AS "check", ok,
           CASE WHEN ok THEN url || {REDIRECT} ELSE url || ' -> ' || {OUTCOME} END AS detail FROM tried WHERE done = 0
    UNION ALL SELECT source_ord, CAST(nth * 2 + 1 AS INT), 'inventory_parse', total > 0,
           CAST(total AS VARCHAR) || ' objects, domains: ' || domains FROM tried WHERE done = 0 AND ok
    UNION ALL SELECT source_ord, 0, 'inventory_urls', false, 'no inventory_urls or base_urls defined' FROM own WHERE len(urls) = 0)"""


def one_page(name: str, kind: str, field: str, ok: str, detail: str, more: str = "") -> str:
    return f"""{name} AS (
    SELECT source_ord, 0 AS check_ord, '{field}' AS "check", CASE WHEN {field} IS NULL THEN false ELSE {ok} END AS ok,
           CASE WHEN {field} IS NULL THEN 'no {field} defined' ELSE {detail} END AS detail
    FROM sources s LEFT JOIN health h ON h.url = s.{field} WHERE doc_type = '{kind}' {more})"""


ANSWER = f"index_url || ' -> ' || {OUTCOME} || {REDIRECT}"
INDEX_CHECKS = one_page(
    "index_checks",
    "doxygen",
    "index_url",
    "coalesce(ok, false)",
    ANSWER,
    """UNION ALL SELECT source_ord, 1, 'group_links', coalesce(n_links, 0) > 0, coalesce(n_links, 0) || ' group__ links found'
    FROM sources s JOIN health h ON h.url = s.index_url LEFT JOIN links l ON l.url = coalesce(redirected_to, h.url)
    WHERE doc_type = 'doxygen' AND ok""",
)
PDF_CHECKS = one_page(
    "pdf_checks",
    "pdf",
    "doc_url",
    "coalesce(ok AND NOT contains(lower(content_type), 'text/html'), false)",
    f"""CASE WHEN status IS NULL THEN 'HEAD ' || doc_url || ' failed: ' || coalesce(error, 'not in crawl log')
      WHEN ok AND contains(lower(content_type), 'text/html')
      THEN doc_url || ' -> 200 but Content-Type is ' || content_type || ' (expected PDF, not HTML)' || {REDIRECT}
      ELSE doc_url || ' -> ' || status || ', Content-Type: ' || CASE content_type WHEN '' THEN 'unknown' ELSE content_type END || {REDIRECT} END""",
)
PAGE_CHECKS = one_page("page_checks", "sphinx_noinv", "index_url", "coalesce(ok, false)", ANSWER)
CONFIG_CHECKS = """config_checks AS (
    SELECT source_ord, 0 AS check_ord, 'doc_type' AS "check", false AS ok, 'unsupported doc_type: ' || coalesce(doc_type, 'unknown') AS detail
    FROM sources WHERE coalesce(doc_type, 'wiki') = 'wiki')"""

ORACLES["audit_inventory"] = f"WITH {SOURCES}, {LOG}, {OBJECTS}, {INVENTORY_CHECKS} SELECT * FROM inventory_checks"
ORACLES["audit_index"] = f"WITH {SOURCES}, {LOG}, {LINKS}, {INDEX_CHECKS} SELECT * FROM index_checks"
ORACLES["audit_pdf"] = f"WITH {SOURCES}, {LOG}, {PDF_CHECKS} SELECT * FROM pdf_checks"
ORACLES["audit_page"] = f"WITH {SOURCES}, {LOG}, {PAGE_CHECKS} SELECT * FROM page_checks"
ORACLES["audit_config"] = f"WITH {SOURCES}, {CONFIG_CHECKS} SELECT * FROM config_checks"

AUDIT = f"""WITH {SOURCES}, {LOG}, {OBJECTS}, {LINKS}, {INVENTORY_CHECKS}, {INDEX_CHECKS}, {PDF_CHECKS}, {PAGE_CHECKS}, {CONFIG_CHECKS},
  checks AS (SELECT * FROM inventory_checks UNION ALL SELECT * FROM index_checks UNION ALL SELECT * FROM pdf_checks
             UNION ALL SELECT * FROM page_checks UNION ALL SELECT * FROM config_checks),
  results AS (SELECT s.source_ord, coalesce(name, 'unknown') AS name, coalesce(doc_type, 'unknown') AS doc_type,
                     CASE WHEN doc_type = 'sphinx' THEN bool_or(c.ok AND "check" = 'inventory_parse') ELSE bool_and(c.ok) END AS ok,
                     arg_max(detail, check_ord) FILTER (c.ok) AS last_ok, arg_max(detail, check_ord) AS last_detail,
                     arg_min("check" || ': ' || detail, check_ord) FILTER (NOT c.ok) AS first_bad,
                     '[' || string_agg('{{"check":"' || "check" || '","ok":' || CAST(c.ok AS VARCHAR) || ',"detail":"' || detail || '"}}', ','
                                       ORDER BY check_ord) || ']' AS checks
              FROM sources s JOIN checks c USING (source_ord) GROUP BY s.source_ord, name, doc_type)"""
ORACLES["audit_rollup"] = f"{AUDIT} SELECT source_ord, name, ok, doc_type, checks FROM results"
ORACLES["audit_headline"] = f"""{AUDIT},
  lines AS (SELECT *, coalesce(CASE WHEN ok THEN last_ok ELSE first_bad END, last_detail) AS d FROM results)
  SELECT source_ord, name, doc_type, CASE WHEN ok THEN 'OK' ELSE 'FAIL' END AS status,
         CASE WHEN length(d) > 60 THEN left(d, 57) || '...' ELSE d END AS detail FROM lines"""
ORACLES["audit_summary"] = f"{AUDIT} SELECT count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM results"

# --- extraction -------------------------------------------------------------

ORACLES["page_scan"] = """SELECT page_id, url, length(html) AS size FROM pages WHERE page_id % 4 <> 0 AND page_id % 6 <> 0"""
ORACLES["page_scan_many"] = """SELECT page_id, url, length(html) AS size FROM pages WHERE page_id % 4 = 2 AND page_id % 6 <> 0"""
ANCHORS = """found AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs,
                          regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages),
  anchors AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*') AS host, CAST(unnest(range(len(hrefs))) AS INT) AS idx,
                     unnest(hrefs) AS href, unnest(texts) AS text FROM found)"""
ORACLES["url_resolution"] = f"""WITH {ANCHORS}
  SELECT page_id, idx, href, host || href AS resolved, split_part(host || href, '#', 1) AS page_url FROM anchors"""
ORACLES["group_links"] = f"""WITH {ANCHORS}
  SELECT url AS index_url, idx AS pos, text AS "group", host || href AS url FROM anchors
  WHERE contains(href, '/') AND NOT contains(href, 'th')
  QUALIFY row_number() OVER (PARTITION BY anchors.url, split_part(host || href, '#', 1) ORDER BY idx) = 1"""

RENDERED = f"""parts AS (SELECT *, p_partkey // 50 AS src, p_partkey // 10 AS page, {CAMEL} AS name,
    'lib' || (p_partkey // 50) AS source, 'https://lib' || (p_partkey // 50) || '.example.com/' AS site FROM part),
  typed AS (SELECT *, {case('src % 5', ['sphinx', 'doxygen', 'sphinx_noinv', 'pdf', 'wiki'])} AS doc_type FROM parts)"""
HEADING_ROLE = case("p_size % 6", ["function", "type", "enum", "macro", "data", ""])
MEMBERS = f"""headed AS (SELECT *, site || 'group__g_p' || (page % 5) || '.html' AS page_url,
      max(CASE WHEN p_partkey % 5 <> 1 THEN p_partkey END) OVER (PARTITION BY page ORDER BY p_partkey) AS head_key
    FROM typed WHERE doc_type = 'doxygen'),
  members AS (
    SELECT h.source, h.p_partkey AS pos, h.page_url || '#group__g_1g' || (h.p_partkey - h.p_partkey % 4) AS url,
      CASE h.p_partkey % 3 WHEN 0 THEN h.name || ' ( int ' || h.p_size || ' )' WHEN 1 THEN h.name || ' (void)' ELSE h.name END AS "group",
      coalesce((SELECT {HEADING_ROLE} FROM part x WHERE x.p_partkey = h.head_key), '') AS role,
      CASE WHEN h.page % 5 IN (1, 4) THEN 'cpp' ELSE 'c' END AS domain
    FROM headed h QUALIFY row_number() OVER (PARTITION BY h.source, url ORDER BY h.page, h.p_partkey) = 1)"""
ORACLES["page_members"] = f'WITH {RENDERED}, {MEMBERS} SELECT source, "group", url, role, domain FROM members'
ORACLES["member_domain"] = """SELECT p_partkey,
    CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 10 IN (1, 4) THEN 'cpp' WHEN p_partkey % 3 <> 0 THEN 'c' ELSE '' END AS domain FROM part"""
ENTRIES = f"""entries AS (SELECT source, CAST(row_number() OVER (PARTITION BY src ORDER BY p_partkey) - 1 AS BIGINT) AS pos, p_partkey,
      name AS "group", site || 'api.html#e' || p_partkey AS url, 'function' AS role,
      {case('p_partkey % 4', ['cpp', 'c', 'py', 'rust'])} AS domain, 'genindex' AS origin
    FROM typed WHERE doc_type = 'sphinx_noinv' AND src % 10 <> 7),
  index_entries AS (SELECT * FROM entries WHERE p_partkey % 8 <> 3)"""
ORACLES["index_entries"] = f'WITH {RENDERED}, {ENTRIES} SELECT source, pos, "group", url, role, domain, origin FROM index_entries'
OBJECTS_OF = f"""objects AS (SELECT source, src, row_number() OVER (PARTITION BY src ORDER BY p_partkey) - 1 AS pos,
      CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE name END AS "group",
      site || 'v2/api/' || p_partkey || '.html' ||
        CASE WHEN p_partkey % 2 = 0 THEN '#' || CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE name END ELSE '' END AS url,
      {case('p_size % 9', [*ROLES[:7], 'class', 'class'])} AS role, {case('p_partkey % 4', DOMAINS)} AS domain
    FROM typed WHERE doc_type = 'sphinx')"""
ORACLES["inventory_symbols"] = f'WITH {RENDERED}, {OBJECTS_OF} SELECT source, pos, "group", url, role, domain FROM objects'
ORACLES["inventory_files"] = f"""WITH {RENDERED}, {OBJECTS_OF}
  SELECT source, pos, "group", url, role, domain, true AS intact FROM objects WHERE domain IN ('cpp', 'py')"""
GATHERED = f"""WITH {RENDERED}, {MEMBERS}, {ENTRIES}, {OBJECTS_OF}, gathered AS (
  SELECT source, 'inventory' AS kind, "group", url, role, domain, NULL AS origin, pos FROM objects WHERE src % 10 <> 5
  UNION ALL SELECT source, 'member', "group", url, role, domain, NULL, pos FROM members
  UNION ALL SELECT source, 'index', "group", url, role, domain, origin, pos FROM index_entries
  UNION ALL SELECT source, 'group', 'Group ' || page, any_value(site) || 'group__g_p' || (page % 5) || '.html#k' || min(p_partkey), NULL, NULL, NULL, page
            FROM typed WHERE doc_type = 'doxygen' GROUP BY source, page)"""
ORACLES["gather_symbols"] = f'{GATHERED} SELECT source, kind, "group", url, role, domain, origin FROM gathered'
SITE_STATUS = """s AS (SELECT DISTINCT source, src, site, doc_type FROM typed),
  site_status AS (SELECT source, doc_type,
    CASE WHEN doc_type = 'sphinx' AND src % 10 <> 5 THEN site || 'v2/objects.inv' END AS inventory_url,
    CASE WHEN doc_type = 'sphinx' AND src % 10 = 5 THEN 'no inventory' WHEN doc_type = 'sphinx_noinv' AND src % 10 = 7 THEN 'no genindex'
         WHEN doc_type = 'pdf' THEN 'pdf' WHEN doc_type = 'wiki' THEN 'unsupported doc_type: wiki' END AS skipped_reason,
    CASE WHEN doc_type = 'sphinx_noinv' AND src % 10 = 7 THEN site WHEN doc_type = 'pdf' THEN site || 'manual.pdf' END AS doc_url
  FROM s)"""
ORACLES["gather_status"] = f"WITH {RENDERED}, {SITE_STATUS} SELECT * FROM site_status"

ASKED = """asks AS (SELECT tag || '-' || src AS query_id, tag, src, CASE WHEN src % 3 = 1 THEN 'cpp' END AS wanted
            FROM (SELECT DISTINCT src FROM parts), (VALUES ('b'), ('f'), ('l')) t(tag)),
  targets AS (SELECT query_id, tag, wanted, 'lib' || src AS source, CASE tag WHEN 'f' THEN 'l' ELSE 'lib' END || src AS requested, 0 AS request_ord
              FROM asks WHERE NOT (tag = 'b' AND src % 7 = 6)
              UNION ALL SELECT query_id, tag, wanted, 'lib' || (src - src % 5), 'lib' || (src - src % 5), 1
              FROM asks WHERE tag = 'f' AND src % 5 <> 0),
  searched AS (SELECT t.*, kind, "group", url, role FROM targets t JOIN gathered g USING (source)
               WHERE wanted IS NULL OR kind = 'group' OR domain = wanted),
  scored AS (SELECT *, CASE WHEN tag = 'f' THEN {tier} END AS base FROM searched),
  found AS (SELECT *, CASE WHEN tag = 'f' THEN {score} END AS score FROM scored
            WHERE CASE tag WHEN 'b' THEN contains(lower("group"), 'gear') WHEN 'f' THEN base >= 88 ELSE true END)""".format(
    tier=tier("'red'", '"group"'), score=ranked_score("base", "role")
)
ORACLES["search_gathered"] = f"{GATHERED}, {ASKED} SELECT query_id, requested AS source, url, CAST(score AS DOUBLE) AS score FROM found"
ORACLES["failed_queries"] = """SELECT DISTINCT 'b-' || (p_partkey // 50) AS query_id, 'nowhere' AS requested FROM part
  WHERE (p_partkey // 50) % 7 = 6"""
ORACLES["export_unsearchable"] = f"""{GATHERED}, {SITE_STATUS}, {ASKED},
  totals AS (SELECT t.*, (SELECT count(*) FROM searched x WHERE x.query_id = t.query_id AND x.source = t.source) AS n,
                    doc_type, skipped_reason, doc_url FROM targets t JOIN site_status USING (source)),
  heads AS (SELECT query_id, any_value(wanted) AS wanted, count(*) AS m, any_value(n) AS total, string_agg('"' || requested || '"', ',' ORDER BY request_ord) AS names,
                   string_agg('"' || requested || '":' || n, ',' ORDER BY request_ord) AS counts, any_value(requested) AS requested,
                   any_value(doc_type) AS doc_type, any_value(skipped_reason) AS reason, any_value(doc_url) AS doc_url,
                   string_agg('"' || requested || '":"' || doc_url || '"', ',' ORDER BY request_ord) AS skipped
            FROM totals GROUP BY query_id)
  SELECT query_id, CASE WHEN m = 1 THEN '{{"source":' || names || ',"total_found":' || total ELSE '{{"sources":[' || names || '],"total_found":{{' || counts || '}}' END
    || ',"filtered_count":' || (SELECT count(*) FROM found f WHERE f.query_id = h.query_id) || ',"domains_filter":"' || coalesce(wanted, 'all') || '"'
    || CASE WHEN m > 1 THEN coalesce(',"skipped_sources":{{' || skipped || '}}', '')
            WHEN reason IN ('pdf', 'no genindex') THEN ',"doc_type":"' || doc_type || '","doc_url":"' || doc_url || '","message":"''' || requested || '''' ||
              CASE reason WHEN 'pdf' THEN ' is distributed as a PDF manual only. Symbol search is not available. Download the PDF to read the documentation.'
                          ELSE ' has no Sphinx inventory for symbol search. Browse the documentation directly.' END || '"'
            ELSE '' END || '}}' AS line FROM heads h"""
ORACLES["export_stats"] = f"""{GATHERED}, {SITE_STATUS},
  per AS (SELECT source, domain, count(*) AS n, min(pos) AS first FROM gathered WHERE kind IN ('inventory', 'member') GROUP BY ALL),
  all_of AS (SELECT source, sum(n) AS total, string_agg('"' || domain || '":' || n, ',' ORDER BY n DESC, first) AS domains FROM per GROUP BY source)
  SELECT source, CASE WHEN doc_type = 'doxygen' OR inventory_url IS NOT NULL THEN '{{"source":"' || source || '"' ||
           coalesce(',"inventory_url":"' || inventory_url || '"', '') || ',"total":' || coalesce(total, 0) || ',"domains":{{' || coalesce(domains, '') || '}}}}' END AS line,
         CASE WHEN doc_type = 'sphinx' AND inventory_url IS NULL THEN 'could not resolve Sphinx inventory for --stats'
              WHEN doc_type NOT IN ('sphinx', 'doxygen') THEN '--stats is not supported for doc_type ''' || doc_type || '''' END AS error
  FROM site_status LEFT JOIN all_of USING (source)"""

SPACES = "regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
DOC_TREE = """'{' || chr(10) || source || chr(10) || b.body || chr(10) || '}'"""
BODIES = f"bodies AS (SELECT doc_id, source, lang, {LINES.format(t='text')} AS body FROM documents)"
ORACLES["text_tree_rendered"] = f"""WITH {BODIES}
  SELECT doc_id, CASE WHEN body IN ('', '#', ',', '.', '-') THEN source ELSE {DOC_TREE.replace('b.body', 'body')} END AS text_tree,
         'ok' AS status FROM bodies"""
ORACLES["text_tree_main"] = ORACLES["text_tree_rendered"]
ORACLES["text_tree_section"] = f"""WITH {BODIES}
  SELECT doc_id, CASE doc_id % 4
      WHEN 0 THEN '{{' || chr(10) || 'Note of ' || source || chr(10) || 'lang ' || lang || chr(10) || '}}'
      WHEN 3 THEN {DOC_TREE.replace('b.body', 'body')} END AS text_tree,
    CASE WHEN doc_id % 4 IN (0, 3) THEN 'ok' ELSE 'section not found' END AS status FROM bodies"""

def unescaped(t: str) -> str:
    """Titles are cut off anywhere; HTML reads ``&amp`` without its semicolon as the same character."""
    return f"regexp_replace(replace({t}, '&quot;', '\"'), '&amp;?', '&', 'g')"


def stripped(t: str) -> str:
    return f"regexp_replace(regexp_replace({unescaped(t)}, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


# Every page follows one template.  Its first paragraph opens a <b> that nothing closes
# before the article ends, so the article is its heading and the text of that <b>.
ORACLES["text_tree_pages"] = f"""WITH cut AS (
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<!--([^>]*)-->', 1) AS ad,
           regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS lead, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS head,
           list_filter(list_transform(regexp_split_to_array(regexp_extract(html, '</h1>(.*)</article>', 1, 's'), '<[^>]*>'),
                                      lambda t: {stripped('t')}), lambda t: t <> '') AS pieces FROM pages),
  text AS (SELECT page_id, list_filter([{stripped('lead')}, '{{' || chr(10) || {stripped('head')} || chr(10) || array_to_string(pieces, ' ')
                                        || chr(10) || '}}'], lambda t: t <> '') AS blocks, {stripped('title')} AS title, {stripped('ad')} AS ad FROM cut)
  SELECT page_id, 'html {{' || chr(10) || '{{' || chr(10) || title || chr(10) || ad || ' {{' || chr(10) || array_to_string(blocks, chr(10))
         || chr(10) || '}}' || chr(10) || '}}' || chr(10) || '}}' AS text_tree, 'ok' AS status FROM text"""

# --- export -----------------------------------------------------------------

TSV = "CAST(row_number() OVER (ORDER BY score DESC, tie_pos) AS INT) AS rank"
ORACLES["export_tsv_rows"] = (
    "SELECT * FROM ("
    + literal_search([["red"]], [("lib_1", "lib_1", 83.0)], False).format(
        columns=f"source, {TSV}, concat_ws(chr(9), name, url, role, domain, source, CAST(score AS VARCHAR), label) AS line"
    )
    + ") UNION ALL SELECT source, rank, line FROM ("
    + boolean(["contains(n, 'gear')"], ["lib_2"]).format(
        more="concat_ws(chr(9), name, url, role, domain, source) AS line,"
    )
    + ")"
)

# --- files written and read back ---------------------------------------------

ORACLES["export_tsv_files"] = f"SELECT CAST(rank AS BIGINT) AS n, line FROM ({ORACLES['export_tsv_rows']}) WHERE source = 'lib_1'"
ORACLES["export_json_files"] = f"SELECT row_number() OVER (ORDER BY query_id, rank) AS n, line FROM ({ORACLES['export_json_envelope']})"

# --- whole tables where an older query takes a part -----------------------------

ORACLES["fuzzy_search_below_60"] = batch("50.0", "CASE WHEN w1 = 'cold' THEN 7 END") + BATCH_ROWS
_ASKED = "(request_ord = 0 OR query_id NOT LIKE '%bolt')"
ORACLES["export_json_whole"] = ORACLES["export_json_envelope"].replace(batch("88.0", "4", "true", _ASKED), batch("88.0", "NULL", "true", _ASKED), 1)
