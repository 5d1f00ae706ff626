import random

from pyspark.sql import functions as F

from cloakframe.functions import patterns
from cloakframe.functions.text import normalize_titled_caps, title_case
from cloakframe.operators.detect import _presence_sql, detect, with_hits
from cloakframe.policy import Policy, register_patterns, registered_entities, unregister_patterns
from registry.queries import notes
from tests.lines import LINES

EVERYTHING = Policy(entities=tuple(registered_entities()), threshold=0.0)


def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "id long, text string")


def found(spark, text, policy=None):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return {(r.pii_type, r.value): r for r in detect(df, "text", ["id"], policy).collect()}


def test_presence_never_hides_a_match(spark, sf):
    texts = lines(spark).unionByName(notes(spark, sf))
    probed = with_hits(texts, "text", EVERYTHING)
    shapes = [s for e in EVERYTHING.selected() for s in e.shapes]
    row = probed.agg(*[
        F.count_if(F.col("text").rlike(s.flagged()) & ~F.coalesce(F.expr(_presence_sql(s)), F.lit(False))).alias(f"c{i}")
        for i, s in enumerate(shapes)
    ], *[F.count_if(F.col("text").rlike(s.flagged())).alias(f"n{i}") for i, s in enumerate(shapes)]).first()
    assert [s.name for i, s in enumerate(shapes) if row[f"c{i}"]] == []
    assert [s.name for i, s in enumerate(shapes) if not row[f"n{i}"]] == []


def test_a_match_begins_with_its_lead(spark):
    shapes = [s for e in EVERYTHING.selected() for s in e.shapes]
    assert {s.name for s in shapes if not s.lead} == {"phone_international", "phone_area_in_brackets", "email"}
    for s in shapes:
        # each match with every other first character
        whole = lines(spark).select(F.explode(F.regexp_extract_all("text", F.lit(s.flagged()), F.lit(0))).alias("m")).distinct().limit(5)
        texts = whole.crossJoin(spark.range(32, 127)).select(F.concat(
            F.lit("call "), F.char(F.col("id")), F.substring(F.col("m"), F.lit(2), F.length("m")), F.lit(" and "), "m").alias("t"))
        apart = texts.where(F.regexp_extract_all("t", F.lit(s.flagged()), F.lit(0)) != F.regexp_extract_all(
            "t", F.lit(s.anchored()), F.lit(0)))
        assert apart.count() == 0, s.name


def test_matches_are_looked_for_in_compiled_code(spark):
    # inside a function with a lambda Spark interprets every expression for every row
    policy = Policy(entities=("AU_PO_BOX", "AU_ADDRESS"))
    plan = detect(lines(spark), "text", ["id"], policy)._jdf.queryExecution().optimizedPlan().toString()
    (step,) = [x for x in plan.splitlines() if "regexp_extract_all(_cf_text" in x and "AS _cf_runs" not in x]
    assert "AS _cf_matches" in step and "lambda" not in step


def test_titles_are_looked_for_by_their_regexes_alone(spark):
    # a search for each title before the regexes took longer than both regexes
    assert [_presence_sql(s) for s in patterns.BY_TYPE["PERSON"].shapes] == ["_cf_text IS NOT NULL"] * 2
    texts = spark.createDataFrame(
        [(0, None), (1, ""), (2, "no title, MRS"), (3, "Dr Ann Lee, not dr ann lee"), (4, "PROF REED-MARSH")], "id int, text string")
    found = detect(texts, "text", ["id"], Policy(entities=("PERSON",))).select("id", "value").sort("id").collect()
    assert [tuple(r) for r in found] == [(3, "Ann Lee"), (4, "REED-MARSH")]


def test_offsets_are_code_points_of_the_text(spark):
    for r in detect(lines(spark), "text", ["id"], EVERYTHING).collect():
        assert LINES[r.id][r.start:r.end] == r.value


def test_offsets_of_repeated_values_and_long_texts(spark):
    rng = random.Random(3)
    texts = []
    for i in range(40):
        parts = [rng.choice(["a@b.com", "é 😀", "1300 123 456", "word " * 300, "xa@b.com", "0412 345 678", "\n"]) for _ in range(30)]
        texts.append((i, " ".join(parts)))
    df = spark.createDataFrame(texts, "id long, text string")
    rows = detect(df, "text", ["id"]).collect()
    by_id = dict(texts)
    assert all(by_id[r.id][r.start:r.end] == r.value for r in rows)
    for i, t in texts:
        assert sum(r.id == i and r.pii_type == "EMAIL_ADDRESS" for r in rows) == t.count("a@b.com")
        for r in rows:
            if r.id == i:
                assert r.context == f"...{t[max(0, r.start - 20):r.start]}[{r.value}]{t[r.end:r.end + 20]}..."


def test_context_words_raise_the_score(spark):
    assert ("DATE_OF_BIRTH", "15/03/1985") not in found(spark, "met on 15/03/1985")
    assert found(spark, "birthday 15/03/1985")["DATE_OF_BIRTH", "15/03/1985"].confidence == 0.65
    far = "birthday one two three four five 15/03/1985"
    assert ("DATE_OF_BIRTH", "15/03/1985") not in found(spark, far)
    long_tokens = "birthday " + " ".join("x" * 80 for _ in range(4)) + " 15/03/1985"
    assert ("DATE_OF_BIRTH", "15/03/1985") in found(spark, long_tokens)


def test_context_equals_a_plain_restatement(spark):
    rng = random.Random(11)
    words = ["born", "xborny", "BORN", "word", "a", "x" * 70, "é😀", "met:"]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t", " \r\n"]) for _ in range(rng.randrange(12)))
              + rng.choice(["", "("]) + "15/03/1985") for i in range(300)]
    df = spark.createDataFrame(texts, "id long, text string")
    rows = {r.id: r for r in detect(df, "text", ["id"], Policy(entities=("DATE_OF_BIRTH",), threshold=0.0)).collect() if r["shape"] == "dob_ddmmyyyy_slash"}
    for i, t in texts:
        start = rows[i].start if i in rows else None
        if start is None:
            continue
        prefix = t[:start]
        attached = bool(prefix) and not prefix[-1].isspace()
        near = prefix.split()[-(5 + attached):] if prefix.split() else []
        want = any("born" in w.lower() for w in near)
        assert rows[i].confidence == (0.65 if want else 0.3), (t, near)
    assert len(rows) > 250 and len({r.confidence for r in rows.values()}) == 2


def test_check_digits(spark):
    f = found(spark, "ABN 51 824 753 556, 98 765 432 109; ACN 004 085 616; medicare 2123 45670 1; 4111 1111 1111 1111; "
                     "5019-7170-1010-3743; nhs 943 476 5919; iban GB82 WEST 1234 5698 7654 32")
    kinds = {k for k, _ in f}
    assert {"AU_ABN", "AU_ACN", "AU_MEDICARE", "CREDIT_CARD", "UK_NHS", "IBAN_CODE"} <= kinds
    assert [v for k, v in f if k == "CREDIT_CARD"] == ["4111 1111 1111 1111"]
    assert [v for k, v in f if k == "AU_ABN"] == ["51 824 753 556"]


def test_contained_findings_of_one_type_are_dropped(spark):
    f = found(spark, "IMEI: 490154203237518", Policy(entities=("IMEI",)))
    assert list(f) == [("IMEI", "IMEI: 490154203237518")]


def test_titles(spark):
    f = found(spark, "Mr Quill met MS TESS O'REED and DR KILN-MARSH, UPLOAD SPEED")
    assert {v for k, v in f if k == "PERSON"} == {"Quill", "TESS O'REED", "KILN-MARSH"}


def test_title_case(spark):
    df = spark.createDataFrame([("MR OTTO QUILL called",), ("MS TESS O'REED",), ("DR KILN-MARSH left",), ("PARTS LIST",)], "t string")
    got = [r[0] for r in df.select(normalize_titled_caps(F.col("t"))).collect()]
    assert got == ["Mr Otto Quill called", "Ms Tess O'Reed", "Dr Kiln-Marsh left", "PARTS LIST"]
    assert df.select(title_case(F.lit("o'REED-kiln"))).first()[0] == "O'Reed-Kiln"


def test_own_patterns(spark):
    register_patterns("STAFF_ID", [("emp", r"\bEMP\d{5}\b", 0.4)], context=("agent",))
    try:
        p = Policy(entities=("STAFF_ID",))
        assert found(spark, "agent EMP12345", p)["STAFF_ID", "EMP12345"].confidence == 0.75
        assert found(spark, "part EMP12345", p) == {}
    finally:
        unregister_patterns("STAFF_ID")


def test_shape_count():
    assert sum(len(e.shapes) for e in patterns.AU_ENTITIES) == 57


def test_snippets_are_made_only_where_asked_for(spark, monkeypatch):
    from cloakframe.operators import detect as module

    short, long = "mail ida@kiln.test and more words behind it", "x " * 1500 + "mail ida@kiln.test"
    df = spark.createDataFrame([(1, short), (2, long)], "id long, text string")
    want = {1: f"...mail [ida@kiln.test]{short[18:38]}...", 2: f"...{long[-33:-13]}[ida@kiln.test]..."}
    policy = Policy(entities=("EMAIL_ADDRESS",))
    assert {r.id: r.context for r in module.detect(df, "text", ["id"], policy).collect()} == want
    made = lambda *_: F.raise_error(F.lit("made")).cast("string")
    monkeypatch.setattr(module, "short_snippet", made, raising=False)
    monkeypatch.setattr(module, "snippet", made)
    found = module.detect(df.where("id = 1"), "text", ["id"], policy).select("id", "value").collect()
    assert [tuple(r) for r in found] == [(1, "ida@kiln.test")]
