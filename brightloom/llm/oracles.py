"""DuckDB SQL for the queries that SQL can express."""

from . import secrets
from .quality import STOP_FORMS

SQL: dict[str, str] = {}

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_FORMS)

SQL["op1_quality_rules"] = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ws AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM docs),
keyed AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM ws)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM again) GROUP BY doc_id),
base AS (SELECT ws.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN ({STOP_SQL}))) AS n_stop_words, len(l) AS n_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•●‣][\x20\x09-\x0D]'))) AS n_bullet
  FROM ws LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 20.0 AND n_symbols / n_words <= 0.25 AND n_stop_words / n_words >= 0.02
    AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_ellipsis / greatest(n_lines, 1) <= 0.5 AND n_bullet / greatest(n_lines, 1) <= 0.9 AS kept,
  n_stop_words::BIGINT AS n_stop_words
FROM judged
"""

SQL["op5_line_dedup"] = r"""
WITH ls AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
places AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^\x20\x09-\x0D]')) AS a FROM ls),
wins AS (SELECT doc_id, a, l, n, unnest(range(1, len(a) - n + 2)) AS j FROM places CROSS JOIN (VALUES (1), (2), (3)) t(n) WHERE len(a) >= n),
every AS (SELECT doc_id, j, n, a[j:j+n-1] AS c, len(a) AS lines, array_to_string(list_transform(a[j:j+n-1], lambda x: regexp_replace(l[x], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), chr(10)) AS k FROM wins),
keyed AS (SELECT * FROM every WHERE n = 3 OR lines = n OR len(list_filter(regexp_split_to_array(k, '[\x20\x09-\x0D]+'), lambda w: w <> '')) > 50),
later AS (SELECT doc_id, unnest(c) AS i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, j, n) AS r FROM keyed) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM later GROUP BY doc_id)
SELECT p.doc_id, len(a)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
  CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(p.l) + 1), lambda i: NOT list_contains(g, i)), lambda i: p.l[i]), chr(10)) END AS text
FROM places p JOIN ls USING (doc_id) LEFT JOIN gone ON gone.doc_id = p.doc_id
"""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op6_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({_LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
held AS (SELECT item_id, k, i AS j, array_to_string(w[i:i+k-1], ' ') AS s FROM spans),
wins AS (SELECT DISTINCT item_id, k, s FROM held),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM wins) WHERE len(w) >= k),
hits AS (SELECT doc_id, i, k, s FROM (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS s FROM places) WHERE s IN (SELECT s FROM wins)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits JOIN wins USING (s, k) GROUP BY 1),
runs AS (SELECT doc_id, item_id, k, i - j AS shift, i - row_number() OVER (PARTITION BY doc_id, item_id, k, i - j ORDER BY i) AS run FROM hits JOIN held USING (s, k)),
longest AS (SELECT doc_id, max(n)::BIGINT AS n FROM (SELECT doc_id, k + count(*) - 1 AS n FROM runs GROUP BY doc_id, item_id, k, shift, run) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest.n, 0) AS longest_match
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

#: Spans of a pattern: each match starts after the gaps and matches before it.
_SPANS = """SELECT doc_id, '{kind}' AS kind, {rank} AS rank, m[i] AS s, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS a
  FROM (SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, $re${pattern}$re$) AS m, regexp_split_to_array(text, $re${pattern}$re$) AS g FROM docs))"""


#: What the scan allows, in a dialect without possessive repeats.
_ALLOWED = (
    "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", "^/?[A-Za-z]{2,}(/[A-Za-z0-9_.]{2,}){2,}/?$", "EXAMPLE|example", "^[A-Za-z]+([-_][A-Za-z]+)+$",
)


def _secret_sql() -> str:
    kinds = ((secrets.ASSIGN, "assign"), (secrets.ACCESS, "access"), (secrets.HEX, "hex"), (secrets.CANDIDATE, "entropy"))
    found = " UNION ALL ".join(_SPANS.format(kind=k, rank=i, pattern=p) for i, (p, k) in enumerate(kinds))
    belongs = lambda c: " AND ".join(f"regexp_matches(s, $re${p}$re$)" for p in c.patterns)
    window = "list_max(list_transform(range(1, greatest(length(s) - {w}, 0) + 2), lambda i: list_aggregate(string_split(substr(s, i, {w}), ''), 'entropy')))"
    verdict = " ".join(f"WHEN {belongs(c)} THEN {window.format(w=c.window)} >= {c.bits} - 1e-9" for c in secrets.CLASSES)
    allowed = " AND ".join(f"NOT regexp_matches(s, $re${p}$re$)" for p in _ALLOWED)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), raw AS ({found}), spans AS (SELECT *, a + length(s) AS e FROM raw),
base AS (SELECT * FROM spans WHERE kind IN ('access', 'hex') OR kind = 'assign' AND length(regexp_extract(s, $re${secrets.ASSIGN}$re$, 2)) >= {secrets.ASSIGN_LEAST}),
more AS (SELECT * FROM spans WHERE kind = 'entropy' AND {allowed} AND CASE {verdict} ELSE false END),
free AS (SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND m.a < b.e AND b.a < m.e)),
every AS (SELECT *, kind || ':' || a || ':' || e AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM free)),
named AS (SELECT doc_id, string_agg(x, ',' ORDER BY a, rank) AS spans, coalesce(string_agg(x, ',' ORDER BY a, rank) FILTER (kind <> 'entropy'), '') AS base,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy FROM every GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0)::BIGINT AS n_entropy
FROM docs LEFT JOIN named USING (doc_id)
"""


SQL["op2_secret_scan"] = _secret_sql()

SQL["op11_warc"] = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, list_transform(string_split(sha1(coalesce(html, '')), ''), lambda x: strpos('0123456789abcdef', x) - 1) AS x FROM pages),
d AS (SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((x[1 + (5 * i) // 4] * 256 + x[2 + (5 * i) // 4] * 16 + coalesce(x[3 + (5 * i) // 4], 0)) // (128 >> ((5 * i) % 4))::INTEGER) % 32, 1)), '') AS payload_digest FROM h)
SELECT *, CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest)
"""

SQL["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed
  FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
placed AS (SELECT *, CASE WHEN failed = '' THEN 9 ELSE list_min(list_transform(string_split(failed, ''), lambda x: strpos(o, x))) END AS place FROM f CROSS JOIN orders),
steps AS (SELECT part, o AS filter_order, s::INTEGER AS step, substr(o, s, 1) AS x, sum(n) FILTER (place > s) AS kept, sum(n) FILTER (place = s) AS removed,
    sum(n) FILTER (contains(failed, substr(o, s, 1)) AND place < s) AS redundant, sum(n) FILTER (failed = substr(o, s, 1)) AS unique_fails,
    sum(n) FILTER (place = s AND good) AS good_lost, sum(n) FILTER (place = s AND toxic) AS toxic_lost
  FROM placed CROSS JOIN (SELECT unnest(range(1, 6)) AS s) GROUP BY part, o, s)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM steps
"""

#: CRC-32 bit by bit, then one step of the least cost and audit for each turn and last role.
SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS how FROM keyed),
damaged AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, (VALUES (1), (2)) v(copy) WHERE how <> 0 AND (copy = 1 OR how = 3)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) AS again FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j FROM damaged)),
turns AS (SELECT *, substr(role, 1, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM seen),
pairs AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY j) || i AS pair FROM turns),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY 1),
follows(p, q, added) AS (VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'a', ''), ('u', 'u', 'a'), ('a', 'u', ''), ('a', 'a', 'u')),
named(q, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS j, '' AS q, {'cost': 0, 'audit': '', 'made': ''} AS best FROM conversations
  UNION ALL
  SELECT conv_id, j, q, min(best) FROM (
    SELECT t.conv_id, t.j, w.q, {'cost': best.cost + 4, 'audit': best.audit || 'D', 'made': best.made} AS best FROM ways w JOIN turns t ON t.conv_id = w.conv_id AND t.j = w.j + 1
    UNION ALL
    SELECT t.conv_id, t.j, f.q, {'cost': best.cost + 3 * length(f.added) + CASE WHEN f.q = t.i THEN 0 ELSE 3 END + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END,
      'audit': best.audit || repeat('I', length(f.added)) || CASE WHEN f.q = t.i THEN 'K' ELSE 'R' END,
      'made': best.made || CASE f.added WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END || chr(10) || CASE WHEN f.q = t.i THEN t.role ELSE n.name END || ':' || t.text}
    FROM ways w JOIN turns t ON t.conv_id = w.conv_id AND t.j = w.j + 1 JOIN follows f ON f.p = w.q LEFT JOIN named n ON n.q = f.q WHERE fault NOT IN ('blank', 'duplicate') AND (f.q <> 's' OR t.i = 's')
  ) GROUP BY conv_id, j, q),
ends AS (SELECT conv_id, min({'cost': best.cost + CASE q WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END, 'audit': best.audit || CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
    'made': best.made || CASE q WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END}) AS b
  FROM ways w WHERE j = (SELECT count(*) FROM turns t WHERE t.conv_id = w.conv_id) GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.cost::BIGINT AS cost, b.audit AS audit, sha256(substr(b.made, 2)) AS repaired_sha256
FROM ends LEFT JOIN counts USING (conv_id)
"""
