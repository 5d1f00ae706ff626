"""DuckDB statements of the same results, built from the fixed values alone.

Everything here is written against relations, not spans in a row: hits are unnested, containment is an
anti join, the merge is a list fold.  It shares the regexes with the engine and nothing else.
"""

from __future__ import annotations

from cloakframe.functions import patterns
from cloakframe.operators.detect import shape_orders
from cloakframe.policy import FALSE_POSITIVE_WORDS, Policy, registered_entities


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qlist(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]" if words else "[]::VARCHAR[]"


DIGITS = "regexp_replace({v}, '[^0-9]', '', 'g')"


def digits(v: str) -> str:
    return DIGITS.format(v=v)


def weighted(d: str, weights) -> str:
    terms = " + ".join(f"{w} * TRY_CAST(substr({d}, {i}, 1) AS INT)" for i, w in enumerate(weights, 1))
    return f"({terms})"


def luhn(v: str) -> str:
    d = digits(v)
    total = (
        f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 "
        f"THEN TRY_CAST(substr({d}, CAST(length({d}) - i AS INT), 1) AS INT) "
        f"ELSE (2 * TRY_CAST(substr({d}, CAST(length({d}) - i AS INT), 1) AS INT)) - "
        f"CASE WHEN TRY_CAST(substr({d}, CAST(length({d}) - i AS INT), 1) AS INT) > 4 THEN 9 ELSE 0 END END))"
    )
    return f"(CASE WHEN length({d}) BETWEEN 13 AND 19 THEN {total} % 10 = 0 ELSE false END)"


def card(v: str) -> str:
    return f"({luhn(v)} AND NOT regexp_matches({v}, '^1[0-9]{{12}}$'))"


def ssn(v: str) -> str:
    d = digits(v)
    return (f"(length({d}) = 9 AND substr({d},1,3) NOT IN ('000','666') AND substr({d},1,3) < '900' "
            f"AND substr({d},4,2) <> '00' AND substr({d},6,4) <> '0000')")


def tfn(v: str) -> str:
    d = digits(v)
    return f"(CASE WHEN length({d}) = 9 THEN {weighted(d, (1, 4, 3, 7, 5, 8, 6, 9, 10))} % 11 = 0 ELSE false END)"


def medicare(v: str) -> str:
    d = digits(v)
    return (f"(CASE WHEN length({d}) = 10 THEN substr({d},1,1) BETWEEN '2' AND '6' AND "
            f"{weighted(d, (1, 3, 7, 9, 1, 3, 7, 9))} % 10 = TRY_CAST(substr({d},9,1) AS INT) ELSE false END)")


def abn(v: str) -> str:
    d = digits(v)
    return (f"(CASE WHEN length({d}) = 11 THEN ({weighted(d, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19))} - 10) % 89 = 0 "
            "ELSE false END)")


def acn(v: str) -> str:
    d = digits(v)
    return (f"(CASE WHEN length({d}) = 9 THEN (10 - {weighted(d, (8, 7, 6, 5, 4, 3, 2, 1))} % 10) % 10 "
            f"= TRY_CAST(substr({d},9,1) AS INT) ELSE false END)")


def nhs(v: str) -> str:
    d = digits(v)
    return (f"(CASE WHEN length({d}) = 10 THEN (11 - {weighted(d, (10, 9, 8, 7, 6, 5, 4, 3, 2))} % 11) % 11 "
            f"= TRY_CAST(substr({d},10,1) AS INT) ELSE false END)")


def iban(v: str) -> str:
    """All digits first, then one mod 97 over the whole number as HUGEINT pieces."""
    c = f"upper(replace({v}, ' ', ''))"
    turned = f"(substr({c}, 5) || substr({c}, 1, 4))"
    number = (f"array_to_string(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' "
              f"THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')")
    return (f"(list_reduce(list_transform(string_split({number}, ''), lambda c: CAST(c AS BIGINT)), "
            f"lambda a, d: (a * 10 + d) % 97, 0::BIGINT) = 1)")


CHECKS = {"card": card, "ssn": ssn, "tfn": tfn, "medicare": medicare, "abn": abn, "acn": acn, "nhs": nhs, "iban": iban}

BEFORE = """({g}.confidence > {f}.confidence OR ({g}.confidence = {f}.confidence AND ({g}.s < {f}.s OR ({g}.s = {f}.s
 AND ({g}.e - {g}.s > {f}.e - {f}.s OR ({g}.e - {g}.s = {f}.e - {f}.s AND {g}.ord < {f}.ord))))))"""


def hits_cte(src: str, policy: Policy) -> str:
    orders = shape_orders()
    branches = []
    for e in policy.selected():
        for s in e.shapes:
            r = q(s.flagged())
            branches.append(
                f"SELECT id, text, {orders[(e.pii_type, s.name)]} AS ord, regexp_extract_all(text, {r}) AS m, "
                f"string_split_regex(text, {r}) AS g FROM src WHERE regexp_matches(text, {r})")
    return f"src AS ({src}),\nhits AS ({' UNION ALL '.join(branches)})"


def facts_cte(policy: Policy) -> str:
    orders = shape_orders()
    rows = [
        f"({orders[(e.pii_type, s.name)]}, {q(e.pii_type)}, {q(s.name)}, {s.score}::DOUBLE, "
        f"{qlist([w.lower() for w in e.context])})"
        for e in policy.selected() for s in e.shapes
    ]
    return f"facts(ord, pii_type, shape, score, words) AS (VALUES {', '.join(rows)})"


def card_ctes(types: list[str]) -> str:
    """From ``matched`` to ``typed``: a match whose check digit is wrong gives the cards among the whole groups of its run,
    one row for each first and last group; inside a hyphenated number only a card's usual grouping begins one."""
    if not types:
        return ""
    of_type = f"pii_type IN ({', '.join(map(q, types))})"
    chars = "coalesce(list_sum(list_transform({g}, lambda x: length(x))), 0)"
    return f"""
digit_runs AS (SELECT *, regexp_extract(substr(text, CAST(s + 1 AS INT), 80), '^[0-9](?:[- ]?[0-9])*') AS run FROM matched WHERE {of_type} AND NOT {card('value')}),
digit_groups AS (SELECT *, regexp_extract_all(run, '[0-9]+') AS gr FROM digit_runs),
firsts AS (SELECT *, unnest(range(1, len(gr) + 1)) AS i FROM digit_groups),
lasts AS (SELECT *, unnest(range(i, len(gr) + 1)) AS j, {chars.format(g='gr[1:i - 1]')} + i - 1 AS off FROM firsts),
stretches AS (SELECT *, {chars.format(g='gr[i:j]')} + j - i AS n, {chars.format(g='gr[i:j]')} AS n_digits FROM lasts WHERE off < length(value)),
cards AS (SELECT *, substr(run, CAST(off + 1 AS INT), CAST(n AS INT)) AS number FROM stretches WHERE n_digits BETWEEN 13 AND 19
  AND (length(gr[i]) = 4 OR length(gr[i]) BETWEEN 13 AND 19
    OR ((i = 1 OR substr(run, CAST(off AS INT), 1) = ' ') AND substr(run, CAST(off + n + 1 AS INT), 1) <> '-'))),
typed AS (SELECT * FROM matched WHERE NOT {of_type} OR {card('value')}
  UNION ALL SELECT id, text, ord, pii_type, shape, score, words, CAST(s + off AS INT), number FROM cards WHERE number[1] BETWEEN '1' AND '6' AND {card('number')}),"""


def raw_ctes(src: str, policy: Policy) -> str:
    """CTEs up to ``raw``: id, text, ord, pii_type, shape, s, e, value, confidence."""
    checks = " ".join(
        f"WHEN pii_type = {q(e.pii_type)} THEN {CHECKS[e.check]('value')}" for e in policy.selected() if e.check)
    certain = f"CASE {checks} END" if checks else "NULL::BOOLEAN"
    cards = card_ctes([e.pii_type for e in policy.selected() if e.check == "card"])
    lead = f"CASE WHEN pii_type = 'PERSON' THEN length(regexp_extract(v0, {q(patterns.TITLE_LEAD)})) ELSE 0 END"
    return f"""{hits_cte(src, policy)},
{facts_cte(policy)},
each AS (SELECT id, text, ord, m, g, unnest(range(1, len(m) + 1)) AS i FROM hits),
spans AS (SELECT id, text, ord, m[i] AS v0,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS s0
  FROM each),
{'matched' if cards else 'typed'} AS (SELECT id, text, ord, pii_type, shape, score, words, s0 + {lead} AS s, substr(v0, 1 + {lead}) AS value FROM spans JOIN facts USING (ord)),{cards}
checked AS (SELECT *, {certain} AS certain,
  string_split_regex(substr(text, 1, s), '[ \\t\\r\\n]+') AS toks FROM typed),
near AS (SELECT *, lower(array_to_string(toks[-6:], chr(10)) || chr(10) || string_split_regex(value, '[ \\t\\r\\n]+')[1]) AS around FROM checked
  WHERE coalesce(certain, true)),
raw AS (SELECT id, text, ord, pii_type, shape, CAST(s AS INT) AS s, CAST(s + length(value) AS INT) AS e, value,
  round(CASE WHEN len(list_filter(words, lambda w: contains(around, w))) > 0
    THEN least(greatest(CASE WHEN certain THEN 1.0::DOUBLE ELSE score END + 0.35, 0.4), 1.0)
    ELSE CASE WHEN certain THEN 1.0::DOUBLE ELSE score END END, 2) AS confidence
  FROM near)"""


def false_positive(t: str, v: str, words) -> str:
    toks = f"string_split_regex(lower(trim({v}, ' ' || chr(9) || chr(10) || chr(13))), '\\s+')"
    return (f"(CASE WHEN {t} = 'PERSON' THEN list_contains({qlist(words)}, {toks}[1]) "
            f"WHEN {t} IN ('ORGANIZATION','LOCATION','NRP') THEN list_has_any({qlist(words)}, {toks}) ELSE false END)")


def found_ctes(src: str, policy: Policy) -> str:
    """CTEs up to ``found``: what the analysis step reports."""
    skipped = ", ".join(q(t) for t in policy.skipped_types)
    return f"""{raw_ctes(src, policy)},
uncovered AS (SELECT f.* FROM raw f WHERE NOT EXISTS (SELECT 1 FROM raw g WHERE g.id = f.id AND g.pii_type = f.pii_type
  AND g.s <= f.s AND g.e >= f.e AND {BEFORE.format(g='g', f='f')})),
found AS (SELECT * FROM uncovered WHERE confidence >= {policy.threshold} AND pii_type NOT IN ({skipped})
  AND NOT {false_positive('pii_type', 'value', policy.false_positive_words)})"""


def known_ctes(src: str, keys: str, exact: bool) -> str:
    """CTEs up to ``known``: id, text, key, pii_type, value, s, e of the leftmost-longest matches of the keys (key, pii_type)
    in ``src``, both SELECT statements.  A window along the units of a text makes every stretch as long as some key."""
    gap = r"[\x20\x09-\x0D]"
    unit = rf"(?s){gap}+|[\p{{L}}\p{{N}}_]+|."
    normal = "x" if exact else rf"CASE WHEN regexp_matches(x, '^{gap}') THEN ' ' ELSE lower(x) END"
    word = lambda c: rf"coalesce(regexp_matches({c}, '^[\p{{L}}\p{{N}}_]'), false)"
    joiner = lambda c: f"coalesce({c} IN (chr(39), chr(8217), '-', '#'), false)"
    free = f"NOT ({word('b1')} AND NOT {word('u1')}) AND NOT ({word('a1')} AND NOT {word('un')})"
    if not exact:
        free += f" AND NOT ({joiner('b1')} AND {word('b2')}) AND NOT ({joiner('a1')} AND {word('a2')})"
    return f"""src AS ({src}),
named AS (SELECT list_transform(regexp_extract_all(regexp_replace(key, '^{gap}+|{gap}+$', '', 'g'), '{unit}'), lambda x: {normal}) AS u,
  pii_type FROM ({keys})),
dict AS (SELECT array_to_string(u, '') AS key, any_value(len(u)) AS n, min(pii_type) AS pii_type FROM named WHERE len(u) > 0 GROUP BY array_to_string(u, '')),
cut AS (SELECT id, regexp_extract_all(text, '{unit}') AS u FROM src),
unit AS (SELECT id, unnest(u) AS x, unnest(range(len(u))) AS i FROM cut),
along AS (SELECT id, i, x, {normal} AS nx, CAST(sum(length(x)) OVER (PARTITION BY id ORDER BY i) - length(x) AS INT) AS s FROM unit),
{_stretches(exact)},
hit AS (SELECT id, s, CAST(s + length(value) AS INT) AS e, value, pii_type FROM stretch JOIN dict USING (key) WHERE {free}),
chain AS (SELECT id, list_reduce(list(struct_pack(s := s, e := e, value := value, pii_type := pii_type) ORDER BY s, e DESC),
  lambda a, x: CASE WHEN len(a) > 0 AND x.s < a[-1].e THEN a ELSE list_append(a, x) END,
  []::STRUCT(s INTEGER, e INTEGER, value VARCHAR, pii_type VARCHAR)[]) AS k FROM hit GROUP BY id),
known AS (SELECT id, text, u.s AS s, u.e AS e, u.value AS value, u.pii_type AS pii_type
  FROM (SELECT id, unnest(k) AS u FROM chain) JOIN src USING (id))"""


def _stretches(exact: bool, longest: int = 12) -> str:
    """All stretches of one to ``longest`` units; no key of the queries is longer."""
    def part(n: int) -> str:
        key, value = (" || ".join([c] + [f"lead({c}, {k}) OVER o" for k in range(1, n)]) for c in ("nx", "x"))
        return (f"SELECT id, s, {key} AS key, {value} AS value, x AS u1, lead(x, {n - 1}) OVER o AS un, lag(x) OVER o AS b1, "
                f"lag(x, 2) OVER o AS b2, lead(x, {n}) OVER o AS a1, lead(x, {n + 1}) OVER o AS a2 FROM along "
                "WINDOW o AS (PARTITION BY id ORDER BY i)")

    return "stretch AS (" + " UNION ALL ".join(part(n) for n in range(1, longest + 1)) + ")"


def allowed(v: str, policy: Policy) -> str:
    parts = ["false"]
    if policy.allow_values:
        parts.append(f"{v} IN ({', '.join(q(x) for x in policy.allow_values)})")
    if policy.allow_domains:
        parts.append(f"coalesce(string_split({v}, '@')[2] IN ({', '.join(q(x) for x in policy.allow_domains)}), false)")
    parts += [f"regexp_matches({v}, {q(p)})" for p in policy.allow_patterns]
    return "(" + " OR ".join(parts) + ")"


def survives(v: str, policy: Policy) -> str:
    if not policy.apply_lists:
        return "true"
    denied = f"{v} IN ({', '.join(q(x) for x in policy.deny_values)})" if policy.deny_values else "false"
    return f"({denied} OR NOT {allowed(v, policy)})"


MERGE_FOLD = """list_reduce(list(struct_pack(s := s, e := e, confidence := confidence, pii_type := pii_type, value := value)
   ORDER BY s, confidence DESC, e - s DESC, ord),
  lambda a, x: CASE WHEN len(a) = 0 THEN [x]
    WHEN x.s < a[-1].e AND a[-1].s < x.e THEN
      CASE WHEN x.confidence > a[-1].confidence OR (x.confidence = a[-1].confidence AND x.e - x.s > a[-1].e - a[-1].s)
        THEN list_append(a[:-2], x) ELSE a END
    ELSE list_append(a, x) END,
  []::STRUCT(s INTEGER, e INTEGER, confidence DOUBLE, pii_type VARCHAR, value VARCHAR)[])"""


def kept_ctes(src: str, policy: Policy) -> str:
    """CTEs up to ``kept``: id, s, e, confidence, pii_type, value of the spans that are rewritten."""
    return f"""{found_ctes(src, policy)},
listed AS (SELECT * FROM found WHERE {survives('value', policy)}),
folded AS (SELECT id, {MERGE_FOLD} AS k FROM listed GROUP BY id),
kept AS (SELECT id, u.s AS s, u.e AS e, u.confidence AS confidence, u.pii_type AS pii_type, u.value AS value
  FROM (SELECT id, unnest(k) AS u FROM folded))"""


def spliced_ctes(replacement: str) -> str:
    """From ``src`` and ``kept`` to ``spliced``: id, text."""
    return f"""pieces AS (SELECT kept.id, kept.s, kept.e,
  substr(src.text, 1 + coalesce(lag(kept.e) OVER (PARTITION BY kept.id ORDER BY kept.s), 0),
         kept.s - coalesce(lag(kept.e) OVER (PARTITION BY kept.id ORDER BY kept.s), 0)) || {replacement} AS piece
  FROM kept JOIN src USING (id)),
joined AS (SELECT id, string_agg(piece, '' ORDER BY s) AS head, max(e) AS upto, count(*) AS n FROM pieces GROUP BY id),
spliced AS (SELECT src.id, CASE WHEN joined.id IS NULL THEN src.text ELSE joined.head || substr(src.text, joined.upto + 1) END AS text,
  coalesce(joined.n, 0) AS n FROM src LEFT JOIN joined USING (id))"""


# ---- replacements ----------------------------------------------------------------------------

REDACT = "('[' || pii_type || '_REDACTED]')"


def mask_generic(v: str) -> str:
    return f"(CASE WHEN length({v}) <= 1 THEN '*' ELSE substr({v},1,1) || repeat('*', length({v}) - 1) END)"


def mask_email(v: str) -> str:
    at = f"instr({v}, '@')"
    return (f"(CASE WHEN {at} = 0 THEN {mask_generic(v)} ELSE substr({v},1,least(1,{at}-1)) || "
            f"repeat('*', greatest({at} - 2, 1)) || substr({v}, {at}) END)")


def mask_phone(v: str) -> str:
    d = digits(v)
    return (f"(CASE WHEN length({d}) < 3 THEN repeat('*', length({v})) "
            f"WHEN contains({v}, '(') THEN '(' || substr({d},1,3) || ') ***-****' "
            f"WHEN contains({v}, '-') THEN substr({d},1,3) || '-***-****' "
            f"WHEN contains({v}, '.') THEN substr({d},1,3) || '.***.****' "
            f"ELSE substr({d},1,3) || repeat('*', length({d}) - 3) END)")


def mask_ssn(v: str) -> str:
    d = digits(v)
    return (f"(CASE WHEN length({d}) <> 9 THEN {mask_generic(v)} WHEN contains({v}, '-') THEN '***-**-' || right({d},4) "
            f"WHEN contains({v}, ' ') THEN '*** ** ' || right({d},4) ELSE '*****' || right({d},4) END)")


def mask_card(v: str) -> str:
    d = digits(v)
    return (f"(CASE WHEN length({d}) < 13 THEN {mask_generic(v)} WHEN contains({v}, '-') THEN '****-****-****-' || right({d},4) "
            f"WHEN contains({v}, ' ') THEN '**** **** **** ' || right({d},4) "
            f"ELSE repeat('*', length({d}) - 4) || right({d},4) END)")


def mask_ip(v: str) -> str:
    p6, p4 = f"string_split({v}, ':')", f"string_split({v}, '.')"
    return (f"(CASE WHEN contains({v}, ':') AND len({p6}) > 4 THEN {p6}[1] || ':' || {p6}[2] || repeat(':****', len({p6}) - 4) "
            f"|| ':' || {p6}[-2] || ':' || {p6}[-1] WHEN NOT contains({v}, ':') AND len({p4}) = 4 "
            f"THEN {p4}[1] || '.' || {p4}[2] || '.***.***' ELSE {mask_generic(v)} END)")


def mask(t: str, v: str) -> str:
    return (f"(CASE WHEN {t} IN ('EMAIL','EMAIL_ADDRESS') THEN {mask_email(v)} WHEN {t} IN ('PHONE','PHONE_NUMBER') "
            f"THEN {mask_phone(v)} WHEN {t} IN ('SSN','US_SSN') THEN {mask_ssn(v)} WHEN {t} IN ('CREDIT_CARD','CREDIT_CARD_NUMBER') "
            f"THEN {mask_card(v)} WHEN {t} IN ('IP_ADDRESS','IP') THEN {mask_ip(v)} ELSE {mask_generic(v)} END)")


def hashed(t: str, v: str, algorithm: str = "sha256", salt: str = "default_salt_change_in_production", n: int = 8) -> str:
    return f"({t} || '_' || substr({algorithm}({q(salt)} || {v}), 1, {n}))"


def pseudonym(t: str, v: str, seed: str) -> str:
    """The replacement rule: a keyed Feistel network for numbers, syllables for the rest.  ``t`` and ``v`` are columns."""
    from cloakframe.functions import strategies as st

    h, d = f"sha256({q(seed)} || '|' || {t} || '|' || {v})", digits(v)
    hexat = lambda x, at, n: f"CAST(('0x' || substr({x}, {at}, {n})) AS BIGINT)"
    power = lambda n: f"CAST('1' || repeat('0', CAST({n} AS INT)) AS BIGINT)"

    def feistel(a: str, b: str, ma: str, mb: str, mark: str) -> str:
        digest = f"sha256({q(seed)} || '|' || {t} || '|' || {mark} || '|' || i || '|' || s[2])"
        return (f"list_reduce(list_transform(range(0, {st.ROUNDS}), lambda x: CAST(x AS BIGINT)), lambda s, i: [s[2], "
                f"(s[1] + {hexat(digest, 1, 15)}) % CASE WHEN i % 2 = 0 THEN {ma} ELSE {mb} END], "
                f"[CAST({a} AS BIGINT), CAST({b} AS BIGINT)])")

    def permuted(x: str) -> str:
        n = f"length({x})"
        both = feistel(f"('0' || substr({x}, 1, {n} // 2))", f"('0' || substr({x}, {n} // 2 + 1))", power(f"{n} // 2"),
                       power(f"({n} - {n} // 2)"), f"CAST({n} AS VARCHAR)")
        return (f"list_transform([{both}], lambda z: CASE WHEN {n} > 1 THEN lpad(CAST(z[1] AS VARCHAR), CAST({n} // 2 AS INT), '0') ELSE '' END "
                f"|| lpad(CAST(z[2] AS VARCHAR), CAST({n} - {n} // 2 AS INT), '0'))[1]")

    def check(x: str) -> str:
        at = f"CAST(substr({x}, CAST(length({x}) - k AS INT), 1) AS INT)"
        return (f"(10 - list_sum(list_transform(range(0, length({x})), lambda k: CASE WHEN k % 2 = 1 THEN {at} "
                f"ELSE 2 * {at} - CASE WHEN {at} > 4 THEN 9 ELSE 0 END END)) % 10) % 10")

    def placed(x: str) -> str:
        return (f"list_transform([{x}], lambda w: array_to_string(list_transform(range(1, length({v}) + 1), lambda k: CASE "
                f"WHEN regexp_matches(substr({v}, CAST(k AS INT), 1), '[0-9]') THEN substr(w, CAST(length({digits(f'substr({v}, 1, CAST(k AS INT))')}) AS INT), 1) "
                f"ELSE substr({v}, CAST(k AS INT), 1) END), ''))[1]")

    def spelt(at: int, n: int) -> str:
        return " || ".join(f"substr('{st.CONSONANTS}', CAST({hexat(h, at + 2 * k, 1)} + 1 AS INT), 1) || {qlist(st.VOWELS)}[{hexat(h, at + 2 * k + 1, 1)} + 1]"
                           for k in range(n))

    title = lambda x: f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"
    first, last = f"({spelt(1, 3)})", f"({spelt(7, 5)})"
    octet = [f"CAST(split_part({v}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    v4 = feistel(f"({octet[0]} * 256 + {octet[1]})", f"({octet[2]} * 256 + {octet[3]})", "65536", "65536", "'v4'")
    v4 = f"list_transform([{v4}], lambda z: (z[1] // 256) || '.' || (z[1] % 256) || '.' || (z[2] // 256) || '.' || (z[2] % 256))[1]"
    head = f"substr({d}, 1, length({d}) - 1)"
    card = (f"list_transform([{permuted(head)}], lambda y: y || CAST((({check('y')} + CAST(right({d}, 1) AS INT) - {check(head)}) % 10 + 10) % 10 AS VARCHAR))[1]")
    groups = " || ':' || ".join(f"substr({h}, {1 + 4 * i}, 4)" for i in range(8))
    names = lambda ts: ", ".join(q(x) for x in ts)
    number = f"regexp_matches({v}, {q(st._NUMBER)})"
    return (f"(CASE WHEN {t} IN ({names(st.EMAIL_TYPES)}) THEN {first} || '.' || {last} || '@' || coalesce(string_split({v}, '@')[2], 'example.org') "
            f"WHEN {t} IN ({names(st.NAME_TYPES)}) THEN {title(first)} || ' ' || {title(last)} "
            f"WHEN {t} IN ({names(st.PLACE_TYPES)}) THEN {title(f'({spelt(1, 8)})')} "
            f"WHEN {t} IN ({names(st.IP_TYPES)}) AND regexp_matches({v}, {q(st._IPV4)}) THEN {v4} "
            f"WHEN {t} IN ({names(st.IP_TYPES)}) AND contains({v}, ':') THEN {groups} "
            f"WHEN {t} IN ({names(st.CARD_TYPES)}) AND length({d}) BETWEEN 13 AND 19 AND {number} THEN {placed(card)} "
            f"WHEN {number} AND length({d}) <= {st.MOST_DIGITS} THEN {placed(permuted(d))} ELSE {spelt(1, 8)} END)")


def snippet(s: str, e: str, around: int = 20) -> str:
    return (f"('...' || substr(text, greatest({s} - {around}, 0) + 1, {s} - greatest({s} - {around}, 0)) || '[' || "
            f"substr(text, {s} + 1, {e} - {s}) || ']' || substr(text, {e} + 1, {around}) || '...')")


__all__ = ["FALSE_POSITIVE_WORDS", "registered_entities"]
