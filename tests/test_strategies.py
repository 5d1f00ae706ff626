import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import checksums
from cloakframe.functions import strategies as st
from cloakframe.policy import Hash, Mask, Policy, Redact, Replace


def one(spark, make, pii_type, value):
    df = spark.createDataFrame([(pii_type, value)], "t string, v string")
    return df.select(make(F.col("t"), F.col("v"))).first()[0]


@pytest.mark.parametrize("pii_type,value,want", [
    ("EMAIL", "quill@kiln.test", "q****@kiln.test"), ("EMAIL_ADDRESS", "q@k.t", "q*@k.t"), ("EMAIL", "kilnpost", "k*******"),
    ("PHONE", "620-555-0188", "620-***-****"), ("PHONE", "(620) 555-0188", "(620) ***-****"), ("PHONE", "6205550188", "620*******"),
    ("PHONE_NUMBER", "620.555.0188", "620.***.****"), ("PHONE", "62", "**"),
    ("SSN", "509-33-8127", "***-**-8127"), ("US_SSN", "509 33 8127", "*** ** 8127"), ("SSN", "509338127", "*****8127"), ("SSN", "50-9", "5***"),
    ("CREDIT_CARD", "5019-7170-1010-3742", "****-****-****-3742"), ("CREDIT_CARD", "5019717010103742", "************3742"),
    ("IP_ADDRESS", "10.44.7.250", "10.44.***.***"), ("IP", "fd00:1:2:3:4:5:6:7", "fd00:1:****:****:****:****:6:7"), ("IP", "c:d", "c**"),
    ("AU_PHONE_NUMBER", "0488 777 101", "0***********"), ("X", "b", "*"), ("X", "", "*"),
])
def test_mask(spark, pii_type, value, want):
    assert one(spark, st.mask, pii_type, value) == want


def test_mask_options(spark):
    assert one(spark, lambda t, v: st.mask(t, v, Mask(au_phones=True)), "AU_PHONE_NUMBER", "0488-777-101") == "048-***-****"
    o = Mask(mask_char="#", ssn_visible_chars=0, email_visible_chars=2)
    assert one(spark, lambda t, v: st.mask(t, v, o), "SSN", "509-33-8127") == "###-##-"
    assert one(spark, lambda t, v: st.mask(t, v, o), "EMAIL", "quil@x.y") == "qu##@x.y"


def test_redact(spark):
    assert one(spark, st.redact, "EMAIL", "quill@kiln.test") == "[EMAIL_REDACTED]"
    assert one(spark, lambda t, v: st.redact(t, v, Redact(type_specific=False)), "EMAIL", "x") == "[REDACTED]"


def test_hash(spark):
    salted = lambda t, v: st.hash_token(t, v, Hash(salt="own salt"))
    for make, salt in ((salted, "own salt"), (st.hash_token, Hash.salt)):
        want = "EMAIL_" + hashlib.sha256((salt + "quill@kiln.test").encode()).hexdigest()[:8]
        assert one(spark, make, "EMAIL", "quill@kiln.test") == want
    whole = lambda t, v: st.hash_token(t, v, Hash(truncate=0, prefix=False, algorithm="md5"))
    assert len(one(spark, whole, "EMAIL", "x")) == 32
    with pytest.warns(UserWarning, match="salt"):
        st.rewriter(Policy(strategy="hash"))


KEYED = Replace(seed="a secret")


def keyed(t, v):
    return st.replace_pseudonym(t, v, KEYED)


def test_replace_is_consistent_and_keeps_the_format(spark):
    a = one(spark, keyed, "EMAIL_ADDRESS", "quill@kiln.test")
    assert a == one(spark, keyed, "EMAIL_ADDRESS", "quill@kiln.test")
    assert a.endswith("@kiln.test") and not a.startswith("quill@")
    assert a != one(spark, lambda t, v: st.replace_pseudonym(t, v, Replace(seed="another")), "EMAIL_ADDRESS", "quill@kiln.test")
    assert re.fullmatch(r"(\d+\.){3}\d+", one(spark, keyed, "IP_ADDRESS", "10.0.0.1"))
    assert one(spark, keyed, "IP_ADDRESS", "a::1").count(":") == 7
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", one(spark, keyed, "PHONE_NUMBER", "(620) 555-0188"))
    card = one(spark, keyed, "CREDIT_CARD", "4111 1111 1111 1111")
    assert re.fullmatch(r"(\d{4} ){3}\d{4}", card) and spark.range(1).select(checksums.luhn(F.lit(card))).first()[0]
    assert one(spark, lambda t, v: st.replace_pseudonym(t, v, Replace(available=False)), "PERSON", "Tess") == "[PERSON_FAKE]"
    with pytest.raises(ValueError, match="seed"):
        st.replace_pseudonym(F.lit("PERSON"), F.lit("Tess"))
    for value in ("7", "", "0", "9" * 36, "9" * 37):
        made = one(spark, keyed, "AU_PHONE_NUMBER", value)
        assert (len(made) == len(value) and made.isdigit()) if 0 < len(value) <= 36 else made.isalpha()


def test_short_numbers_are_permuted(spark):
    """All strings of one to three digits, and all of four with every last digit as a check digit."""
    for n in (1, 2, 3):
        df = spark.range(10 ** n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("v"))
        got = {r[0] for r in df.select(st.permuted_digits(F.col("v"), F.lit("T"), "s")).collect()}
        assert got == {str(i).zfill(n) for i in range(10 ** n)}
    cards = spark.range(10_000).select(F.concat(F.lit("411111111111"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("v"))
    made = cards.select("v", keyed(F.lit("CREDIT_CARD"), F.col("v")).alias("r")).select(
        "r", (checksums.luhn(F.col("v")) == checksums.luhn(F.col("r"))).alias("same"))
    assert made.where("same").select("r").distinct().count() == 10_000


@pytest.mark.parametrize("pii_type,value", [
    ("PHONE_NUMBER", "concat('(', lpad(id % 1000, 3, '0'), ') 555-', lpad(id div 1000, 4, '0'))"),
    ("US_SSN", "concat_ws('-', lpad(id div 10000, 3, '0'), '45', lpad(id % 10000, 4, '0'))"),
    ("EMAIL_ADDRESS", "concat('user', id, '@kiln.test')"), ("PERSON", "concat('Name ', id)"), ("LOCATION", "concat('Town ', id)"),
    ("IP_ADDRESS", "concat_ws('.', '10', id div 65536, id div 256 % 256, id % 256)"),
    ("CREDIT_CARD", "concat('4000 0000 ', lpad(id div 10000, 4, '0'), ' ', lpad(id % 10000, 4, '0'))"),
    ("AU_PASSPORT", "concat('PA', lpad(id, 7, '0'))"),
])
def test_distinct_values_have_distinct_replacements(spark, pii_type, value):
    n = 1_000_000 if pii_type in ("PHONE_NUMBER", "PERSON") else 100_000
    df = spark.range(0, n, 1, 8).selectExpr(f"{value} AS v")
    got = df.select("v", keyed(F.lit(pii_type), F.col("v")).alias("r")).agg(
        F.count_distinct("v").alias("v"), F.count_distinct("r").alias("r"), F.count_if(F.col("v") == F.col("r")).alias("same")).first()
    assert (got.v, got.r) == (n, n) and got.same < 10


def test_unknown_strategy_redacts(spark):
    with pytest.warns(UserWarning):
        made = st.rewriter(Policy(strategy="shred"))
    assert one(spark, made, "EMAIL", "x") == "[EMAIL_REDACTED]"


def test_own_strategy(spark):
    st.register_strategy("stars", lambda t, v: F.repeat(F.lit("*"), F.length(v)))
    assert one(spark, st.rewriter(Policy(strategy="stars")), "EMAIL", "abc") == "***"


@pytest.mark.parametrize("check,value,want", [
    ("luhn", "4111 1111 1111 1111", True), ("luhn", "5019717010103742", True), ("luhn", "79927398713", False),
    ("luhn", "5019-7170-1010-3743", False), ("luhn", "79927398710000", False), ("luhn", "", False), ("luhn", "42", False),
    ("ssn", "509-33-8127", True), ("ssn", "000-33-8127", False), ("ssn", "666-33-8127", False), ("ssn", "900-33-8127", False),
    ("ssn", "509-00-8127", False), ("ssn", "509-33-0000", False), ("abn", "51 824 753 556", True), ("abn", "12-345-678-901", False),
    ("acn", "004 085 616", True), ("acn", "123-456-789", False), ("tfn", "123 456 789", False), ("tfn", "123456782", True),
    ("medicare", "2123 45670 1", True), ("medicare", "4567890123", False), ("nhs", "943 476 5919", True), ("nhs", "943 476 5918", False),
    ("iban", "GB82 WEST 1234 5698 7654 32", True), ("iban", "GB83 WEST 1234 5698 7654 32", False), ("card", "1234567890128", False),
    ("email_tld", "a@b.com", True), ("email_tld", "a@b.c1", False), ("email_tld", "a@b", False),
])
def test_checksums(spark, check, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(getattr(checksums, check)(F.col("v"))).first()[0] is want
