"""DuckDB statements of the queries that SQL can express; written from the contract, not from the operators."""

from __future__ import annotations

import itertools

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[\x20\x09-\x0D]+"

NEAR_DUPLICATES = f"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WHITE}'),
  lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
o AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT o.b, r.c FROM r JOIN o ON o.a = r.id)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM n JOIN r ON r.id = doc_id GROUP BY doc_id, n"""

ARCHIVES = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f < page_id THEN f END AS refers_to FROM f"""

_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                  for w in ("password", "passwd", "secret", "token", "api_?key"))
#: (kind, regular expression, group whose length counts, least length)
_KINDS = [
    ("assign", rf"""({_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("login_url", r"[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@]+@", 0, 0),
]


def _matches(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Starts are running sums of the pieces between matches and of the matches before."""
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, s, s + n AS e FROM (
  SELECT doc_id, unnest(v) AS v, unnest(m) AS n, unnest(list_transform(range(1, len(m) + 1), lambda i:
    list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0))) AS s FROM (
    SELECT doc_id, list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x)) AS m,
      list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda x: length(x)) AS v,
      list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) AS g FROM t WHERE regexp_matches(text, '{pattern}')))
WHERE v >= {least}"""


_SPAN = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, o"
SECRETS = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_matches(i, *k) for i, k in enumerate(_KINDS))})
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg({_SPAN}) FILTER (o < 3), '')) AS base_sha256,
  coalesce(string_agg({_SPAN}), '') AS spans FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id"""

_SUBSETS, _EACH = 41, 8


def _near(name: str, other: str) -> str:
    """Per text the likeness of prints ``p`` and ``other``, rows (doc_id, k, h)."""
    return f"""{name} AS (SELECT doc_id, CASE WHEN bool_or(k = 0 AND a = b) THEN 1.0
  ELSE coalesce(max(near) FILTER (k > 0 AND na > 1 AND nb > 1), 0.0) END AS near FROM (
  SELECT doc_id, k, a, b, na, nb, CASE WHEN count(*) FILTER (a <> '' OR b <> '') OVER w >= 4 THEN
    count(*) FILTER (a <> '' AND a = b) OVER w / count(*) FILTER (a <> '' OR b <> '') OVER w ELSE 0.0 END AS near FROM (
    SELECT p.doc_id, k, p.h AS a, q.h AS b, p.n AS na, q.n AS nb FROM p JOIN {other} q USING (doc_id, k))
  WINDOW w AS (PARTITION BY doc_id, (k + {_EACH - 1}) // {_EACH})) GROUP BY doc_id)"""


FINGERPRINTS = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS following,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id), first(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM t),
e AS (SELECT doc_id, next_id, text, length(text) AS n,
  substr(text, 1, length(text) - length(text) // 4) || substr(following, 1, length(text) // 4) AS edited FROM o),
b AS (SELECT doc_id, 0 AS side, text AS body FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
l AS (SELECT doc_id, side, list_sort(list_distinct(list_filter(string_split_regex(lower(body), '{WHITE}'),
  lambda x: x <> ''))) AS w FROM b),
u AS (SELECT doc_id, side, unnest(w) AS term FROM l),
lex AS (SELECT term FROM u WHERE side = 0 GROUP BY term HAVING count(*) BETWEEN
  greatest(2, ceil((SELECT count(*) FROM t) * 0.0005)) AND greatest(2, (SELECT count(*) FROM t) * 0.05)),
sub AS (SELECT term, k FROM lex, range({_SUBSETS}) r(k) WHERE k = 0 OR
  CAST('0x' || substr(md5(term || '|' || k), 1, 5) AS INT) < (1 << 20) >> CAST(2 * (1 + (k - 1) // {_EACH}) AS INT)),
h AS (SELECT doc_id, side, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h FROM u JOIN sub USING (term) GROUP BY ALL),
has AS (SELECT DISTINCT doc_id, side FROM h),
f AS (SELECT doc_id, side, k, coalesce(h, '') AS h, {_SUBSETS} AS n FROM has CROSS JOIN range({_SUBSETS}) r(k) LEFT JOIN h USING (doc_id, side, k)
  UNION ALL SELECT doc_id, side, 0, md5(array_to_string(w, ' ')), 1 FROM l ANTI JOIN has USING (doc_id, side)),
p AS (SELECT * FROM f WHERE side = 0), q1 AS (SELECT * FROM f WHERE side = 1),
q2 AS (SELECT e.doc_id, k, h, p.n FROM e JOIN p ON p.doc_id = e.next_id),
{_near("x1", "q1")},
{_near("x2", "q2")},
s AS (SELECT doc_id, side, string_agg(h, '-' ORDER BY k) AS fp FROM f GROUP BY ALL)
SELECT e.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  x1.near AS near_edited, x2.near AS near_next FROM e JOIN s a ON a.doc_id = e.doc_id AND a.side = 0
  JOIN s b ON b.doc_id = e.doc_id AND b.side = 1 JOIN x1 ON x1.doc_id = e.doc_id JOIN x2 ON x2.doc_id = e.doc_id"""

_MARKS = "<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|<s>|</s>|\\[ROLE\\]|\\[/ROLE\\]|\\[/TURN\\]|\\[NOROLE\\]"
CHATS = f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
t AS (SELECT *, lag(role) OVER w AS before, lead(turn) OVER w IS NULL AS at_end,
  CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 4 + 6
    ELSE 6 + length(role) + 7 + 7 END + length(text) + length(text) - length(replace(text, chr(92), ''))
    + len(regexp_extract_all(text, '{_MARKS}')) AS chars FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(CASE role WHEN 'system' THEN before IS NULL
    WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN before = 'user' AND before IS NOT NULL
    ELSE false END) AS valid, bool_or(at_end AND role = 'assistant') AS answered FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars, valid, valid AND answered AS complete FROM g"""

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in itertools.permutations("ABCDE"))
AUDIT = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END,
    CASE WHEN e THEN 'E' END) AS fails, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT o AS filter_order, CAST(i AS INT) AS step, substr(o, CAST(i AS INT), 1) AS filter, left(o, CAST(i AS INT) - 1) AS before
  FROM (VALUES {_ORDERS}) t(o), range(1, 6) r(i)),
x AS (SELECT *, contains(fails, filter) AS hit, translate(fails, before, '') <> fails AS gone FROM m, o),
y AS (SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (fails = filter), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0) AS BIGINT) AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE (filter), CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM y"""

_TERMS = f"""regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
SEARCH = f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
p AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
