"""MinHash, fingerprints, quality rules, secrets, byte-level BPE."""

import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import byte_bpe, circulant, decision_lists, imatch, secret_scan, toxicity
from cloakframe.llm.queries import QUERIES
from tests.llm.fixtures import (
    CLASHES, WORD, awkward, clashing, docs, empty, near_components, near_rows, one_of_each, prose, shingle_set,
)


def test_near_classes_against_all_pairs(spark):
    rows = awkward()
    want = near_components(rows)
    got = circulant.near_classes(docs(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component == (None if r.id is None else want[r.id])
    sizes = {k: len(shingle_set(t)) for k, t in rows}
    assert all(r.n_shingles == sizes[r.id] for r in got if r.id is not None)
    assert circulant.near_classes(empty(spark)).count() == 0


def test_near_classes_on_copies_that_hardly_reach_each_other(spark):
    base = prose(5, 200)
    draw = random.Random(3)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(draw.randint(1, 7)):
            w[draw.randrange(200)] = f"x{i}_{draw.randrange(99)}"
        rows.append((i, " ".join(w)))
    want = near_components(rows)
    got = {r.id: r.component for r in circulant.near_classes(docs(spark, rows)).collect()}
    assert got == want and 1 < len(set(want.values())) < 150


@pytest.mark.parametrize("similarity", [70, 80, 90])
def test_near_classes_at_other_similarities(spark, similarity):
    rows = awkward()
    want = near_components(rows, similarity)
    got = circulant.near_classes(docs(spark, rows), similarity=similarity).collect()
    assert {r.id: r.component for r in got if r.id is not None} == want != near_components(rows)
    assert 0 < circulant.agree_floor(similarity) < 5 * circulant.band_count(similarity) * similarity / 100


def test_texts_that_share_an_id_are_compared_each_on_its_own(spark):
    a, c, d = (" ".join(prose(40 + i, 60)) for i in range(3))
    near = a.replace(a.split()[30], "other")
    rows = [(3, a), (7, a), (7, c), (7, d), (7, d), (9, near), (7, near), (0, c), (1, None), (7, ""), (None, a)]
    rows += [(0, " ".join(prose(60 + i, 50))) for i in range(20)]
    want = near_rows(rows)
    got = circulant.near_classes(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    digest = {hashlib.sha256((t or "").encode()).digest(): (t or "") for _, t in rows}
    for r in got:
        text = digest[bytes(r.text_digest)]
        assert r.component == (want[r.id, text][0] if (r.id, text) in want else r.id)
    for similarity in (80, 85):
        kept = circulant.one_of_each(docs(spark, rows), similarity=similarity).select("doc_id", "text").collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, one_of_each(rows, similarity)))


def test_extra_columns_pass_whatever_their_names(spark):
    rows = awkward() + [(300, "token = abcdefghijklmnop " + " ".join(prose(3, 80)))]
    df = clashing(spark, rows)
    given = {r.key: r.asDict() for r in df.collect()}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.Chain()
    outs = {
        "quality": decision_lists.judged(df, decision_lists.learn(df, none)).where("kept").select("row.*"),
        "toxicity": toxicity.scored(df, chain).where("not is_toxic").select("row.*"),
        "near": circulant.one_of_each(df, similarity=80), "secrets": secret_scan.with_spans(df).select("row.*"),
    }
    for name, out in outs.items():
        assert out.columns == df.columns, name
        kept = out.collect()
        assert kept and all(r.asDict() == given[r.key] for r in kept), name
    assert len(CLASHES) > 20


def test_signature_is_a_shifted_permutation():
    scatter, shifted = circulant._permutations()
    assert sorted(scatter[:5]) != list(scatter[:5]) and len(set(scatter.tolist())) == circulant.PLACES
    assert shifted[3, 1] == shifted[4, 0] and shifted.shape[1] == circulant.COORDINATES
    found = circulant.shingles(" ".join(prose(2, 300)))
    least = circulant.signature(found)
    at = scatter[(found >> circulant.np.uint64(44)).astype(int)]
    assert least[7] == shifted[(at + 7) % circulant.PLACES, 0].min()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.id: r.component for r in circulant.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30))


def plain_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(g)
    again = {i + k for i, x in enumerate(g) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def test_statistics_against_plain_counting(spark):
    rows = awkward() + [(200, "a b c a b c a b c d"), (201, "# a|b <c> &amp; a|b"), (202, "x " * 400)]
    got = decision_lists.with_statistics(docs(spark, rows)).select("row.text", "stats.*").collect()
    for r in got:
        assert tuple(r[c] for c in decision_lists.BASE) == plain_statistics(r["text"])


def test_decision_list_learns_orders_and_filters(spark):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = prose(i, draw.randint(60, 120), 3000)
        bad = i % 4 == 0
        rows.append((i, " ".join(x + ("&&&" if i % 8 else "***") for x in w) if bad else " ".join(w)))
        labels.append((i, 0 if bad else 1))
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = decision_lists.learn(docs(spark, rows), given)
    assert rules.rules and all(str(c) for r in rules.rules for c in r)
    out = decision_lists.judged(docs(spark, rows), rules).where("kept").select("row.doc_id").collect()
    assert {r.doc_id for r in out} == {i for i, y in labels if y}
    assert not decision_lists.learn(docs(spark, rows), given.where("quality = 1")).rules
    assert not decision_lists.learn(empty(spark), given).rules
    assert decision_lists.judged(empty(spark), rules).count() == 0


def test_secret_spans_against_plain_search(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = awkward() + [
        (300, f'password = "abcdefghijklm" é token:abc {key}x {key[:17]}- deadbeefdeadbeef0 api-key=zzzzzzzzzzzzzz'),
        (301, 'token = "api_key: ABCDEFGHIJKLMNOP" SECRET=secret=0123456789ab ' * 70),
        (302, "ApiKey='0123456789abcdef0123' https://bob:hunter2@example.com/ ghp_" + "a1" * 20),
        (303, "-----BEGIN RSA PRIVATE KEY----- xoxb-1234567890-abc eyJabcdefghijklmnop.qrstuvwxyz012345.6789abcdefghij"),
        (304, "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop AIza" + "b" * 35), (None, f"{key} password=aaaabbbbccccdddd"),
    ]
    got = secret_scan.with_spans(docs(spark, rows)).select("row.doc_id", "row.text", "spans").collect()
    assert len(got) == len(rows)
    for r in got:
        want = []
        for i, rule in enumerate(secret_scan.RULES):
            for m in re.finditer(rule.pattern, r["text"] or "", re.ASCII):
                if len(m[rule.group]) >= rule.least:
                    want.append((m.start(), i, m.end(), rule.kind))
        assert [tuple(s) for s in r["spans"]] == sorted(want), r["doc_id"]
    clean = secret_scan.with_spans(docs(spark, rows)).select(
        "row.doc_id", secret_scan.redacted(F.col("row.text"), F.col("spans")).alias("text"))
    assert secret_scan.with_spans(clean).where("size(spans) > 0").count() == 0
    assert secret_scan.with_spans(empty(spark)).count() == 0


def test_redaction_joins_overlapping_spans(spark):
    df = spark.createDataFrame([("0123456789", [(2, 0, 5, "a"), (3, 1, 4, "b"), (4, 1, 6, "b"), (7, 0, 8, "a")])],
                               "text string, spans array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    assert df.select(secret_scan.redacted(F.col("text"), F.col("spans"), "#")).first()[0] == "01#6#89"


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.kind)
def test_trigram_queries_are_necessary(rule):
    draw = random.Random(4)
    samples = {"assign": ["Passwd: x1", "api_key=a", "APIKEY = b", "tokeN='c"], "access": ["AKIAX"], "hex": ["0f"],
               "private_key": ["-----BEGIN PRIVATE KEY-----"], "forge_token": ["ghs_1", "ghp_Z"],
               "chat_token": ["xoxa-1"], "web_token": ["eyJa.b.c"], "map_key": ["AIzaQ"],
               "login_url": ["ftp://u:p@"]}[rule.kind]
    clauses = secret_scan.trigram_query(rule.pattern)
    assert bool(all(clauses)) is (rule.kind != "hex")
    for s in samples:
        assert re.search(rule.pattern, s)
        low = f"{draw.random()}{s}".lower()
        assert any(all(t in low for t in c) for c in clauses)


def test_byte_bpe_like_tiktoken_and_back(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {p: i for i, p in enumerate(byte_bpe.read_ranks(path))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = awkward() + [(400, "".join(map(chr, range(1, 3000)))), (401, "a" * 5000 + "  \n\n ▁ <unk> 👩‍👩‍👧 中文")]
    out = byte_bpe.encoded(docs(spark, rows), path, public_tokenizers.PATTERN)
    back = byte_bpe.decoded(out, path, public_tokenizers.PATTERN).collect()
    assert Counter(bytes(r.content) for r in back) == Counter((t or "").encode() for _, t in rows)
    want = {}
    for k, t in rows:
        ids = other.encode_ordinary(t or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[k, sha] = (len(ids), hashlib.sha256((t or "").encode()).hexdigest())
    assert {(r.id, r.ids_sha256): (r.n_tokens, r.decoded_sha256) for r in out.collect()} == want
    assert byte_bpe.encoded(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_model_is_deterministic_and_needs_all_ranks(tmp_path):
    pieces = [bytes([b]) for b in range(256)] + [b"ab"]
    assert byte_bpe.model(pieces) == byte_bpe.model(pieces)
    gap = tmp_path / "gap"
    gap.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % (2 * i) for i, p in enumerate(pieces)))
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(gap))


def test_fingerprints_edit_and_order(spark):
    rows = [(k, t) for k, t in awkward() if k != 8] + [(500, "x y z"), (501, "x y z")]
    got = imatch.fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted((k, t or "") for k, t in rows if k is not None)
    want = {}
    for i, (k, t) in enumerate(order):
        cut = len(t) // 4
        want[k] = hashlib.sha256((t[:len(t) - cut] + order[(i + 1) % len(order)][1][:cut]).encode()).hexdigest()
    by_text = {}
    text = dict(rows)
    for r in got:
        if r.key is not None:
            assert r.edited_sha256 == want[r.key] and r.n_chars == len(text[r.key] or "")
            assert by_text.setdefault(text[r.key] or "", r.prints) == r.prints
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    near = {r.key: r for r in got}
    assert near[500].near_next == 1.0 and near[90].near_next == 1.0
    assert imatch.fingerprints(empty(spark)).count() == 0


def test_fingerprints_of_prose_notice_a_quarter(sf, spark):
    r = imatch.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).agg(
        F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert r.e > 0.3 > 0.1 > r.n


@pytest.mark.parametrize("name", ["op3_circulant_minhash", "op8_secret_scans", "op9_decision_lists"])
def test_queries_cover_all_documents(spark, sf, name):
    got = QUERIES[name](spark, sf)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {
        r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
