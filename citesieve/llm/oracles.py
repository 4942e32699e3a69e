"""SQL twins of the training-data queries that SQL can express."""

from citesieve.llm.filter_audit import MAX_CAPITALS, MIN_DISTINCT, MIN_WORDS, SYMBOLS
from citesieve.llm.phrases import COVERED, LONGEST, SUPPORT, TOP
from citesieve.llm.quality_rules import CUTOFFS, ERROR, RISK, RULES

BLANK = r"[\x20\x09-\x0D]"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LEVELS = ", ".join(f"len(list_filter({list(CUTOFFS)}, lambda c: 1000 * {a} > c * {b})) AS above_{r}" for r, (a, b) in RULES.items())
_UNPIVOT = " UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, above_{r} AS above FROM held" for r in RULES)
_SHARE = RISK / len(RULES)

OP1 = rf"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, lang AS stratum, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
metrics AS (
  SELECT c.* EXCLUDE (lines), len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words FROM counted c LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_LEVELS} FROM metrics),
marks AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT * FROM judged JOIN marks USING (doc_id) WHERE NOT base_failed),
seen AS ({_UNPIVOT}),
grid AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND above >= cutoff) AS k, count(*) FILTER (NOT good AND above >= cutoff) AS hits
  FROM seen, range(1, {len(CUTOFFS) + 1}) r(cutoff) GROUP BY ALL),
tested AS (
  SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))))
            > {ERROR} / ({len(RULES)} * (SELECT count(DISTINCT coalesce('=' || stratum, '')) FROM held)) AS fails FROM grid),
safe AS (SELECT * FROM (SELECT *, sum(fails::INT) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS failed FROM tested) WHERE failed = 0 AND hits > 0),
chosen AS (SELECT stratum, rule, arg_max(cutoff, hits * 1000 + cutoff) AS cutoff FROM safe GROUP BY ALL),
rejected AS (
  SELECT doc_id, rule FROM judged j JOIN chosen c ON j.stratum IS NOT DISTINCT FROM c.stratum
  WHERE CASE rule {" ".join(f"WHEN '{r}' THEN above_{r}" for r in RULES)} END >= cutoff),
listed AS (SELECT doc_id, array_to_string(list_filter({list(RULES)}, lambda r: list_contains(rules, r)), ',') AS rejected_by
           FROM (SELECT doc_id, list(rule) AS rules FROM rejected GROUP BY doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed, coalesce(rejected_by, '') AS rejected_by,
       NOT base_failed AND rejected_by IS NULL AS kept
FROM judged LEFT JOIN listed USING (doc_id)"""

OP3 = f"""WITH folded AS (SELECT doc_id, {FOLDED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM folded"""

OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to, 'ok' AS status FROM f"""

OP6 = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT a, a FROM edges UNION SELECT b, root FROM reach JOIN edges ON doc_id = a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) USING (doc_id)"""

OP11 = rf"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {FOLDED} AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
runs AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM runs GROUP BY lang),
grams AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS g FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM runs, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, g, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= {SUPPORT}),
cuts AS (
  SELECT c.lang, c.k, c.g, c.f, x AS cut, p.f AS l, q.f AS r, (1000 * c.f * n) // (p.f * q.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS x FROM counts WHERE k > 1) c
  JOIN counts p ON p.lang = c.lang AND p.g = list_slice(c.g, 1, x) JOIN counts q ON q.lang = c.lang AND q.g = list_slice(c.g, x + 1, c.k) JOIN totals t ON t.lang = c.lang),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, list_slice(g, i, i + m - 1) AS g, max(f) AS f FROM (SELECT lang, g, f, k, m, unnest(range(1, k - m + 2)) AS i FROM counts, range(2, {LONGEST}) t(m) WHERE k > m)
  GROUP BY ALL),
free AS (SELECT s.* FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.g = s.g WHERE o.f IS NULL OR 100 * o.f < {COVERED} * s.f),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(array_to_string(g, ' '))) AS rank FROM free)
SELECT lang, rank::BIGINT AS rank, phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""

OP12 = rf"""WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
         {{'A': len(w) < {MIN_WORDS}, 'B': 100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text), 'D': regexp_matches(text, '{SYMBOLS}'),
          'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)}} AS x
  FROM docs LEFT JOIN marks USING (doc_id)),
flags AS (SELECT part, good, toxic, [f for f in ['A', 'B', 'C', 'D', 'E'] if CASE f WHEN 'A' THEN x.A WHEN 'B' THEN x.B WHEN 'C' THEN x.C WHEN 'D' THEN x.D ELSE x.E END] AS fails FROM judged),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM orders, range(1, 6) t(step)),
placed AS (SELECT part, filter_order, step, own, n, good, toxic, fails, list_contains(fails, own) AS failing, list_has_any(fails, before) AS gone FROM cells, steps),
rows AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (failing AND len(fails) = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
  FROM placed GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM rows"""

OP13 = r"""WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM cut),
rules(rule, rule_host, rule_path, says) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (
  SELECT page_id, rule, says FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)"""

ORACLES = {"op1_quality_rules": OP1, "op3_exact_dedup": OP3, "op5_warc_segments": OP5, "op6_jaccard_join": OP6, "op11_phrase_mining": OP11,
           "op12_filter_audit": OP12, "op13_url_filter": OP13}
