"""Known strings of a table: units, matches, the joint rewrite, against plain restatements."""

import random
import re

from pyspark.sql import functions as F

from cloakframe.operators import dictionary, person
from cloakframe.plans.tables import rewrite_known, rewrite_with, spliced
from cloakframe.policy import Policy

UNIT = re.compile(r"[\x20\x09-\x0D]+|\w+|.", re.S)
KEYS = [("anna berg", "PERSON"), ("berg", "LOCATION"), ("Lake  Berg", "LOCATION"), ("lake berg hotel", "ORGANIZATION"), ("o'dell", "PERSON"),
        ("N#12", "PERSON"), ("über see", "LOCATION"), ("upload", "PERSON"), (None, "X"), (" \t", "X"), ("a.b+c", "Z"), ("+49", "Z")]


def plain(text, keys, exact):
    def normal(u):
        return u if exact else " " if u[0] in " \t\n\x0b\x0c\r" else u.lower()

    known = {}
    for k, kind in keys:
        n = tuple(normal(u) for u in UNIT.findall((k or "").strip(" \t\n\x0b\x0c\r")))
        if n:
            known[n] = min(kind, known.get(n, kind))
    u = UNIT.findall(text or "")
    word = lambda i: 0 <= i < len(u) and re.match(r"\w", u[i])
    join = lambda i: 0 <= i < len(u) and u[i] in "'’-#"
    out, i, at = [], 0, 0
    starts = [0]
    for x in u:
        starts.append(starts[-1] + len(x))
    while i < len(u):
        best = 0
        for n in {len(k) for k in known}:
            if i + n > len(u) or tuple(map(normal, u[i:i + n])) not in known:
                continue
            if (word(i - 1) and not word(i)) or (word(i + n) and not word(i + n - 1)):
                continue
            if not exact and ((join(i - 1) and word(i - 2)) or (join(i + n) and word(i + n + 1))):
                continue
            best = max(best, n)
        if best:
            out.append((starts[i], starts[i + best], known[tuple(map(normal, u[i:i + best]))]))
        i += best or 1
    return out


def texts(n, seed):
    draw = random.Random(seed)
    parts = ["Anna", "berg", "BERG", "lake", "Lake", "hotel", "O'Dell", "o’dell", "n#12", "N#12", "über", "See", "upload", "a.b+c", "+49",
             "\U0001f600", "berg-lake", "x", "_berg", "berg_", "é"]
    gaps = [" ", "  ", "\n", "\t ", "-", "'", ".", "", ", "]
    out = [(i, "".join(draw.choice(parts) + draw.choice(gaps) for _ in range(draw.randint(0, 40)))) for i in range(n)]
    return [*out, (n, None), (n + 1, ""), (n + 2, "lake berg hotel " * 30_000), (n + 3, "Über See über see")]


def df(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def test_matches_equal_a_plain_scan(spark):
    rows = texts(150, 1)
    table = spark.createDataFrame(KEYS, "key string, pii_type string")
    for style in (dictionary.NAMES, dictionary.LITERALS):
        known = dictionary.prepared(table, style)
        got = {}
        for r in dictionary.matches(df(spark, rows), "text", ["id"], known).collect():
            got.setdefault(r.id, []).append((r.start, r.end, r.pii_type))
            text = dict(rows)[r.id]
            assert text[r.start:r.end] == r.value and r.preceding == text[max(0, r.start - 10):r.start]
        for i, t in rows:
            want = plain(t, KEYS, style.exact)
            assert sorted(got.get(i, [])) == want, (style, t and t[:200])
    none = dictionary.prepared(table.where("key = 'nothing'"))
    assert dictionary.matches(df(spark, rows), "text", ["id"], none).count() == 0


def test_a_large_table_is_joined_by_shuffle(spark, monkeypatch):
    """The same rows when the table is too large to be broadcast, and when the bit arrays are full."""
    rows = texts(60, 2)
    table = spark.createDataFrame(KEYS, "key string, pii_type string").unionByName(spark.range(5000).select(
        F.concat(F.lit("key "), F.col("id")).alias("key"), F.lit("K").alias("pii_type")))
    known = dictionary.prepared(table)
    want = sorted(map(tuple, dictionary.matches(df(spark, rows), "text", ["id"], known).collect()))
    monkeypatch.setattr(dictionary, "_MOST_BITS", 1 << 12)
    full = dictionary.prepared(table)
    lookup = dictionary.lookup
    monkeypatch.setattr(dictionary, "lookup", lambda *a, **k: lookup(*a, **k, broadcast_bytes=0))
    assert full.bits == 1 << 12
    assert sorted(map(tuple, dictionary.matches(df(spark, rows), "text", ["id"], full).collect())) == want and want


def test_names_and_denied_values_in_the_rewrite(spark):
    rows = [(1, "Anna Berg <anna.berg@kiln.test> of Lake Berg, code L-7/2 and L-7/21"), (2, "nothing"), (3, None),
            (4, "kept@example.com kept@example.com2"), (5, "Dr Lake Berg")]
    names = spark.createDataFrame(KEYS, "key string, pii_type string")
    denied = spark.createDataFrame([("L-7/2",), ("kept@example.com",)], "value string")
    got = {r.id: r for r in rewrite_known(df(spark, rows), "text", ["id"], Policy(entities=("EMAIL_ADDRESS", "PERSON")), names, denied).collect()}
    assert got[1].text == ("[PERSON_REDACTED] <[EMAIL_ADDRESS_REDACTED]> of [LOCATION_REDACTED], code [DENIED_REDACTED] and L-7/21")
    assert (got[2].text, got[2].pii_anonymized, got[2].status, got[3].text, got[3].status) == ("nothing", 0, "ok", None, "skipped")
    assert got[4].text.startswith("[DENIED_REDACTED] ") and got[5].text == "Dr [PERSON_REDACTED]"
    assert rewrite_known(df(spark, rows), "text", ["id"], Policy(entities=("EMAIL_ADDRESS",))).where("id = 4").first().text.startswith("kept@")


def test_splice_by_stripe_equals_a_plain_splice(spark):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice("ab \U0001f600é") for _ in range(draw.choice([0, 3, 40, 400])))) for i in range(40)]
    spans = []
    for i, t in rows:
        at = 0
        while (start := at + draw.randint(0, 30)) < len(t):
            at = min(len(t), start + draw.randint(1, 50))
            spans.append((i, start, at, "T", t[start:at]))
    kept = spark.createDataFrame(spans, "id long, start int, `end` int, pii_type string, value string")
    given = df(spark, rows).select("id", F.lit("x").alias("row"), "text", F.col("id").alias("_n0"))
    for stripe in (16, 1 << 16):
        got = {r.id: r for r in spliced(given, "text", ["id"], kept, Policy(), stripe).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            out, at = "", 0
            mine = sorted(s for s in spans if s[0] == i)
            for _, a, b, *_ in mine:
                out, at = out + t[at:a] + "[T_REDACTED]", b
            assert (got[i].text, got[i]["_n"], got[i].row, got[i]["_n0"]) == (out + t[at:], len(mine), "x", i)


def test_rewrite_by_findings_of_a_long_text(spark):
    """More findings than a stripe, in one text; a bad one fails its text only."""
    n = 40_000
    rows = [(1, "word " * n), (2, "word")]
    found = spark.range(n).select(
        F.lit(1).cast("long").alias("id"), F.lit("T").alias("pii_type"), F.lit("word").alias("value"), (F.col("id") * 5).cast("int").alias("start"),
        (F.col("id") * 5 + 4).cast("int").alias("end"), F.lit(0.9).alias("confidence"), F.lit("d").alias("detector"), F.lit("s").alias("shape"),
        F.lit(0).alias("ord")).unionByName(spark.createDataFrame([(2, "T", "word", 0, 9, 0.9, "d", "s", 0)], "id long, pii_type string, "
        "value string, start int, `end` int, confidence double, detector string, shape string, ord int"))
    got = {r.id: r for r in rewrite_with(df(spark, rows), "text", ["id"], found, Policy(apply_lists=False)).collect()}
    assert got[1].text == "[T_REDACTED] " * n and got[1].pii_anonymized == n
    assert (got[2].text, got[2].status) == (None, "failed")


def test_denied_values_stand_free(spark):
    rows = [(1, "x-12 x-123 ax-12 (x-12)x-12"), (2, "#tag #tags a#tag # tag")]
    denied = spark.createDataFrame([("x-12",), ("#tag",)], "value string")
    got = sorted((r.id, r.start) for r in person.detect_denied(df(spark, rows), "text", ["id"], denied).collect())
    assert got == [(1, 0), (1, 18), (1, 23), (2, 0)]


def test_more_keys_than_the_arrays_hold(spark, monkeypatch):
    """Arrays that are too small for a table tell its keys by form; other stretches still are no candidates."""
    keys = [(f"L-{i}/{i % 7}", "A") for i in range(4000)] + [(f"{i}@mail{i % 9}.test", "B") for i in range(4000)] + [("red bus", "C")]
    table = spark.createDataFrame(keys, "key string, pii_type string")
    draw = random.Random(4)
    words = ["red", "bus", "tin", "cap", "12", "3", "L", "-", "@", "."]
    rows = [(i, " ".join(draw.choice(words) for _ in range(200)) + f" L-{i}/{i % 7} {i}@mail{i % 9}.test L-{i}/8 red bus") for i in range(50)]
    texts_ = df(spark, rows)
    for style, exact in ((dictionary.LITERALS, True), (dictionary.NAMES, False)):
        want = sorted((i, s, e, k) for i, t in rows for s, e, k in plain(t, keys, exact))
        for most in (1 << 24, 1 << 12):
            monkeypatch.setattr(dictionary, "_MOST_BITS", most)
            known = dictionary.prepared(table, style)
            assert known.has_forms == (most < 1 << 24)
            assert dictionary.candidates(texts_, "text", ["id"], known).count() < 10 * len(want)
            got = dictionary.matches(texts_, "text", ["id"], known).select("id", "start", "end", "pii_type").collect()
            assert sorted(map(tuple, got)) == want


def test_of_a_large_table_only_the_keys_asked_for_are_looked_up(spark, monkeypatch):
    """The lookup gets the keys that candidates have, and no text carries the arrays along."""
    table = spark.createDataFrame([(f"L-{i}/{i % 7}", "A") for i in range(4000)], "key string, pii_type string")
    texts_ = df(spark, [(1, "see L-7/0 and L-9/2"), (2, "L-9/9 of\tL-21/0"), (3, None)])
    monkeypatch.setattr(dictionary, "_MOST_BITS", 1 << 12)
    known = dictionary.prepared(table, dictionary.LITERALS)
    assert known.has_forms
    plan = dictionary.candidates(texts_, "text", ["id"], known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    lookup, sizes = dictionary.lookup, []
    monkeypatch.setattr(dictionary, "lookup", lambda found, typed, *a: sizes.append(typed.count()) or lookup(found, typed, *a))
    got = dictionary.matches(texts_, "text", ["id"], known).select("id", "start", "value").collect()
    assert sorted(map(tuple, got)) == [(1, 4, "L-7/0"), (1, 14, "L-9/2"), (2, 9, "L-21/0")] and sizes == [3]


def test_values_are_as_written(spark):
    """Also in plain texts, whose units are not normalised one by one."""
    table = spark.createDataFrame([("Lake Berg", "LOCATION"), ("ann", "PERSON")], "key string, pii_type string")
    texts_ = df(spark, [(1, "to LAKE berg by Ann"), (2, "to Lake  Berg, Ann"), (3, "über Lake Berg")])
    got = dictionary.matches(texts_, "text", ["id"], dictionary.prepared(table)).select("id", "value", "preceding", "context").collect()
    assert sorted(map(tuple, got)) == [
        (1, "Ann", "E berg by ", "...to LAKE berg by [Ann]..."), (1, "LAKE berg", "to ", "...to [LAKE berg] by Ann..."),
        (2, "Ann", "ke  Berg, ", "...to Lake  Berg, [Ann]..."), (2, "Lake  Berg", "to ", "...to [Lake  Berg], Ann..."),
        (3, "Lake Berg", "über ", "...über [Lake Berg]...")]
