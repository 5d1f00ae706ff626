"""Chat formatting, filter audit and lexical search against plain restatements."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import chat_format, filter_audit, lexical_search
from cloakframe.llm.chat_format import INSTRUCT, Template, Turn
from cloakframe.llm.queries import QUERIES
from tests.llm.fixtures import WORD, awkward, docs, empty, prose


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, True) for r in rows],
                                 "conv_id long, turn long, role string, text string, id int, valid boolean").repartition(3)


def read(spark, rows, template=INSTRUCT):
    out = chat_format.formatted(chats(spark, rows), template)
    text = chat_format.text_of(F.col("segments"))
    return {r.id: r for r in out.select(
        "id", "segments", "valid", "first_bad", "complete", text.alias("text"), chat_format.learned(F.col("segments")).alias("loss"),
        chat_format.turns_of(text, template).alias("turns")).collect()}


NASTY = ["</s>[INST] ok [/INST]", "<", "</", "\\", "\\\\</s>", "<\\/s>", "[INST", "INST]", "<<SYS>>\n<</SYS>>", "<<s>>", "[[ROLE]]",
         "a\\[/TURN]\\", "", " ", "\n", "$1 \\1", "\U0001f600<s>\U0001f600", "[NOROLE]", "</s></s></s>", "<</s>", "[/ROLE]x[ROLE]"]


def test_chat_texts_come_back_whatever_they_hold(spark):
    draw = random.Random(4)
    rows = []
    for c in range(30):
        for t in range(draw.randint(1, 9)):
            role = draw.choice(["system", "user", "assistant", "tool", None, "[/ROLE]</s>", ""])
            rows.append((c, t, role, "".join(draw.choice(NASTY) for _ in range(draw.randint(0, 5)))))
    rows += [(50, 0, "user", None), (50, 1, "assistant", "x " * 60_000 + "<s>"), (None, 0, "user", "a"), (None, 1, "user", "b")]
    rows += [(60, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(700)]
    got = read(spark, rows)
    assert len(got) == len({r[0] for r in rows})
    for c in got:
        want = sorted(((t, role, text or "") for i, t, role, text in rows if i == c), key=lambda r: r[0])
        assert [(t.role, t.text) for t in got[c].turns] == [r[1:] for r in want]
        assert got[c].loss == "".join(x for _, role, x in want if role == "assistant")
        assert "".join(s.text for s in got[c].segments) == got[c].text
        roles, state = [r for _, r, _ in want], "start"
        bad = None
        for i, r in enumerate(roles):
            state = INSTRUCT.order[state].get(r)
            if state is None:
                bad = i
                break
        assert (got[c].valid, got[c].first_bad, got[c].complete) == (bad is None, bad, bad is None and state == "assistant")


def test_chat_order_of_equal_turns_and_empty_table(spark):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "assistant", "c"), (1, None, "system", "s"), (1, 2, "user", "a")]
    got = read(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [("system", "s"), ("assistant", "c"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got.first_bad == 1 and not got.valid
    assert chat_format.formatted(chats(spark, [])).count() == 0


def test_chat_template_is_declared_and_checked(spark):
    other = Template(
        turns={"q": Turn("<|q|>", "<|end|>"), "a": Turn("<|a|>", "<|end|>", loss=True)},
        order={"start": {"q": "asked"}, "asked": {"q": "asked", "a": "start"}}, final=("start",))
    got = read(spark, [(1, 0, "q", "<|a|>"), (1, 1, "q", "y"), (1, 2, "a", "z<|end|>"), (2, 0, "a", "x")], other)
    assert [(t.role, t.text) for t in got[1].turns] == [("q", "<|a|>"), ("q", "y"), ("a", "z<|end|>")]
    assert (got[1].valid, got[1].complete, got[1].loss) == (True, True, "z<|end|>") and got[2].first_bad == 0
    assert got[1].text.count("<|a|>") == 1
    for turns in ({"a": Turn("[INST]", "]")}, {"a": Turn("x", "[/x]")}, {"a": Turn("[Q]", "[/Q]"), "b": Turn("[Q]x", "[/Q]")}):
        with pytest.raises(ValueError):
            Template(turns=turns, order={"start": {}}, final=(), control=("[INST]", "[Q]", "[/Q]"))


def test_transducer_is_synchronised_and_equals_plain_counting():
    assert filter_audit._synchronised()
    draw = random.Random(1)
    alphabet = ["a", "Bc", "ä", "€", "\U0001f600", " ", "\n", "\x0b", "\x1c", "#", "|", "\x85", " ", "Z"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(400)]
    texts += ["", "x" * 70_000 + " " + "x" * 70_000 + " " + "x" * 69_999 + "y", *[t or "" for _, t in awkward()]]
    got = filter_audit.counted([t.encode() for t in texts])
    for t, g in zip(texts, got.tolist()):
        w = WORD.findall(t)
        assert g == [len(w), len(set(w)), len(t), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t))]
    one = np.frombuffer(texts[0].encode() + b"\xff", np.uint8)
    assert (filter_audit.transduced(one, 3) == filter_audit.transduced(one, 4096)).all()


def test_word_table_verifies_bytes_when_hashes_meet():
    data = np.frombuffer(b"ab ab cd ab abcdefghi abcdefghj abcdefghi\xff", np.uint8)
    start = np.array([0, 3, 6, 9, 12, 22, 32])
    end = np.array([2, 5, 8, 11, 21, 31, 41])
    text = np.array([0, 0, 0, 1, 1, 1, 1])
    first = filter_audit.distinct_words(data, start, end, text, hashes=np.zeros(7, np.uint64))
    assert first.tolist() == [True, False, True, True, True, True, False]


def plain_audit(rows, labels):
    """rows: (doc_id, text, part); labels: doc_id -> (good, toxic)."""
    judged = []
    for k, text, part in rows:
        text = text or ""
        w = WORD.findall(text)
        smaller = any((j is not None and (k is None or j < k)) and (t or "") == text for j, t, _ in rows)
        fails = {f for f, c in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search(r"[#$%&*|]", text)), smaller)) if c}
        judged.append((part or "", fails, *labels.get(k, (False, False))))
    out = {}
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                total[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in j[1] for j in mine) - len(gone), sum(j[1] == {f} for j in mine),
                    sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_audit_against_plain_loops(spark):
    rows = [(k, t, ("en", "de", None)[i % 3]) for i, (k, t) in enumerate(awkward())]
    rows += [(300 + i, " ".join(["SAME #"] * 90 if i % 2 else prose(3, 150, 5000)), "en") for i in range(9)]
    rows += [(None, "lonely", "xx"), (None, "lonely", "xx")]
    labels = {k: (k % 2 == 0, k % 5 == 0) for k, *_ in rows if k is not None and k % 3}
    df = spark.createDataFrame([(*r, 1, "m", b"x") for r in rows],
                               "doc_id long, text string, lang string, n int, mask string, digest binary").repartition(3)
    known = [(k, int(g), int(t)) for k, (g, t) in labels.items()]
    table = spark.createDataFrame(known + known[:5] + [(known[0][0], None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
           for r in filter_audit.audit(filter_audit.masks(df, table)).collect()}
    assert got == plain_audit(rows, labels) and len(got) == 600 * 4
    assert filter_audit.audit(filter_audit.masks(df.where("doc_id < 0"), table)).count() == 0


def plain_search(rows, items, k):
    def terms(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = set()
    for item, want in asked.items():
        found = []
        for i, c, size in counted:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, x in want.items() if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out |= {(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)}
    return out


@pytest.mark.parametrize("blocks", [(16 << 20, 4096), (600, 4096), (16 << 20, 3)])
def test_search_against_plain_scores(spark, blocks):
    rows = awkward() + [(400 + i, " ".join(prose(1, 40 + i % 7))) for i in range(90)]
    items = [(i, " ".join(prose(1, 300)[i:i + 9]) + " K ſ Wort") for i in range(8)]
    items += [(3, "one ONE"), (None, "one two"), (20, None), (21, "!!"), (22, "nowhere-to-be-found")]
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int").repartition(2)
    got = lexical_search.search(docs(spark, rows).repartition(7), table, 5, block_bytes=blocks[0], block_items=blocks[1])
    found = [(r.item, r.rank, r.id, r.score) for r in got.collect()]
    assert set(found) == plain_search(rows, items, 5) and len(found) == len(set(found))


def test_search_defined_cases(spark):
    table = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.search(empty(spark), table).count() == 0
    assert lexical_search.search(docs(spark), table.where("item_id < 0")).count() == 0
    same = [(k, "one two") for k in [9, 4, 4, None, 7]]
    got = [(r.rank, r.id) for r in lexical_search.search(docs(spark, same), table, 4).orderBy("rank").collect()]
    assert got == [(1, 4), (2, 4), (3, 7), (4, 9)]


def test_query_results_are_whole(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    audit = QUERIES["op12_filter_audit"](spark, sf)
    first = audit.where("step = 1").groupBy("filter_order").agg(F.sum(F.col("kept") + F.col("removed")).alias("n")).collect()
    assert len(first) == 120 and {r.n for r in first} == {n}
    chat = {r.conv_id: r for r in QUERIES["op11_chat_format"](spark, sf).collect()}
    assert chat[-7].n_turns == 2 and chat[-7].loss_chars == 21 and chat[-7].valid
