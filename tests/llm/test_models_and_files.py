"""Classifiers, language identification, packing, archives, the pipeline."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakframe.llm import cotraining, lang_id, packing, toxicity, warc
from cloakframe.llm.linear import Rows, among, telling
from cloakframe.llm.queries import QUERIES
from cloakframe.sources.staging import shared_folder
from tests.llm.fixtures import WORD, awkward, docs, empty, near_components, prose


def labelled(spark, mark, n=400):
    """Texts of which every fourth is spoilt by ``mark``, and their labels."""
    rows = [(i, " ".join(mark(prose(i, 90, 3000), i) if i % 4 == 0 else prose(i, 90, 3000))) for i in range(n)]
    return rows, spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(0, n, 2)],
                                       "doc_id long, quality int, toxic int")


def test_telling_keys_and_their_rows():
    rows = Rows.of([np.array([1, 5]), np.array([5]), np.array([1, 9]), np.array([], int)] * 20)
    y = np.array([1, 0, 1, 0] * 20)
    keys = telling(rows, y)
    assert 1 in keys and 5 not in keys
    assert list(among(rows, np.array([5, 9])).at[:3]) == [0, 0, 1]


def test_toxicity_chain_on_held_out_texts(spark):
    rows, labels = labelled(spark, lambda w, i: [*w[:40], "vilebadword"[:9 + i % 3], *w[40:]])
    chain = toxicity.fit(docs(spark, rows), labels)
    got = toxicity.scored(docs(spark, rows + [(None, None), (900, "")]), chain).collect()
    assert {r.row.doc_id for r in got if r.is_toxic} == {i for i in range(0, 400, 4)}
    assert len(got) == 402 and not any(r.is_toxic for r in got if r.row.doc_id in (None, 900))
    for none in (labels.where("toxic = 0"), labels.where("doc_id < 0")):
        kept = toxicity.scored(docs(spark), toxicity.fit(docs(spark, rows), none))
        assert kept.where("is_toxic").count() == 0 and kept.count() == len(awkward())
    assert toxicity.scored(empty(spark), chain).count() == 0


def test_co_training_exchanges_labels_and_scores_all(spark):
    rows, labels = labelled(spark, lambda w, i: [x + "&&&" for x in w])
    model = cotraining.fit(docs(spark, rows), labels.where("doc_id < 200"))
    assert len(model.views) == 2 and any(map(any, model.exchanged))
    got = cotraining.scored(docs(spark, rows), model).collect()
    wrong = sum((r.score >= 0.5) != (r.id % 4 != 0) for r in got)
    assert len(got) == 400 and wrong <= 8
    one = cotraining.fit(docs(spark, rows), labels.where("quality = 1"))
    assert {r.score for r in cotraining.scored(docs(spark), one).collect()} == {1.0}
    assert cotraining.scored(empty(spark), model).count() == 0


def test_co_training_exchanges_all_texts_but_the_labelled(spark, monkeypatch):
    """More texts than any sample, labels for few; the telling source of the second half never occurs in labels."""
    n = 6000
    rows = [(i, " ".join(x + "&&&" * (i % 4 == 0) for x in prose(i, 30, 200))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 300)], "doc_id long, quality int")
    seen = []
    confidence = cotraining._Corpus.confidence
    monkeypatch.setattr(cotraining._Corpus, "confidence", lambda c, r, v: seen.append(
        (c.n, confidence(c, r, v))) or seen[-1][1])
    df = docs(spark, rows).withColumn("source", F.when(F.col("doc_id") < 300, "s").otherwise(
        F.when(F.col("doc_id") % 4 == 0, "spoilt").otherwise("clean")))
    model = cotraining.fit(df, labels)
    assert {k for k, _ in seen} == {n - 300} and seen[0][1][0].sum() > 4000
    most = int(0.05 * (n - 300))
    assert 1.5 * most < model.exchanged[0][0] <= 2 * most
    got = cotraining.scored(df, model).collect()
    assert sum((r.score >= 0.5) != (r.id % 4 != 0) for r in got) <= n // 50


def test_co_training_cuts_pass_the_surest():
    found = np.zeros((2, 2, cotraining._BINS))
    found[0, 1, [10, 20, 30]] = 5, 8, 4
    least, part, passed = cotraining._cuts(found, 8)
    assert (least[0, 1], part[0, 1], passed[0, 1]) == (20, cotraining._CHANCE // 2, 8)
    assert least[1, 0] == 0 and passed[1, 0] == 0
    assert list(cotraining._bins(np.array([-40.0, 0.0, 2.9, 3.0, 90.0]), 0.95)) == [-1, -1, -1, 7, cotraining._BINS - 1]


def test_language_id_on_held_out_texts(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op6_language_id"](spark, sf).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == table.count() and held
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.85
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_defined_cases(spark):
    rows = [(i, " ".join(prose(1, 30)) if i % 2 else "αβγ δεζ " * 9) for i in range(60)]
    df = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "la").otherwise("el"))
    model = lang_id.fit(df, F.lit(True))
    got = {r.id: (r.lang_pred, r.score) for r in lang_id.predicted(
        docs(spark, [(1, None), (2, "12 !?"), (3, "γαδ βε"), (4, "")]), model).collect()}
    assert got[1] == got[2] == got[4] == ("und", 0.0) and got[3][0] == "el"
    nothing = lang_id.fit(df.where("doc_id < 0"), F.lit(True))
    assert {r.lang_pred for r in lang_id.predicted(docs(spark), nothing).collect()} == {"und"}
    assert lang_id.predicted(empty(spark), model).count() == 0


def test_language_id_knows_rare_languages(spark):
    """Three texts of 30,000: a uniform sample of 4,000 would hardly hold one."""
    rows = [(i, " ".join(prose(1 + i % 2, 12))) for i in range(30_000)]
    for i in (5, 11_111, 29_000):
        rows[i] = (i, "αβγ δεζ " * 9)
    df = docs(spark, rows).withColumn("lang", F.when(F.col("text").startswith("α"), "el").when(
        F.col("doc_id") % 2 == 0, "la").otherwise("lb"))
    model = lang_id.fit(df, F.lit(True))
    assert model.languages == ["el", "la", "lb"]
    got = {r.id: r.lang_pred for r in lang_id.predicted(
        docs(spark, [(1, "γαδ βε δεζ"), (2, rows[2][1]), (3, rows[3][1])]), model).collect()}
    assert got == {1: "el", 2: "la", 3: "lb"}
    shares = lang_id._shares({"a": 10**9, "b": 3, "c": 1000}, 4000, 64)
    assert shares["b"] == 1 and shares["c"] * 1000 == 64 and shares["a"] * 10**9 < 4001


def test_ftrl_equals_a_plain_loop():
    """The published update, one weight at a time."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(40):
        at = np.unique(draw.integers(0, 25, 6))
        rows.append((at, draw.random(len(at)), i % 3))
    got = lang_id.ftrl(rows, 3, passes=2, alpha=0.7, beta=1.3, l1=0.05, l2=0.2, seed=5)
    z, n = {}, {}

    def weight(i, k):
        free = i == lang_id.PLACES
        s, a, b = z.get((i, k), 0.0), 0 if free else 0.05, 0 if free else 0.2
        return 0.0 if abs(s) <= a else -(s - np.sign(s) * a) / ((1.3 + n.get((i, k), 0.0) ** 0.5) / 0.7 + b)

    order = np.random.default_rng(5)
    for _ in range(2):
        for r in order.permutation(40):
            x = {**dict(zip(rows[r][0].tolist(), rows[r][1].tolist())), lang_id.PLACES: 1.0}
            e = np.exp([sum(v * weight(i, k) for i, v in x.items()) for k in range(3)])
            for i, v in x.items():
                for k in range(3):
                    g = v * (e[k] / e.sum() - (rows[r][2] == k))
                    before, w = n.get((i, k), 0.0), weight(i, k)
                    # the other weights of the row must still be those before the update
                    x_new = (z.get((i, k), 0.0) + g - ((before + g * g) ** 0.5 - before ** 0.5) / 0.7 * w, before + g * g)
                    z[i, k], n[i, k] = x_new
    want = np.array([[weight(i, k) for k in range(3)] for i in [*range(25), lang_id.PLACES]])
    assert got[[*range(25), lang_id.PLACES]] == pytest.approx(want, abs=1e-5) and (want == 0).any()


def test_chain_equals_models_fitted_one_by_one():
    """A chain of plain logistic models; what a later one sees of the earlier ones comes from other folds."""
    draw = np.random.default_rng(2)
    lists = [np.unique(draw.integers(0, 40, 8)) for _ in range(240)]
    toxic = np.array([(3 in x) or (7 in x and 9 in x) for x in lists])
    rows = Rows.of(lists)
    chain = toxicity.fit_chain(rows, toxic)
    keys = telling(rows, toxic)
    labels = toxicity._derived(rows, toxic, keys)

    def plain_fit(lists, y, dense, keys):
        """The same steps with dense rows."""
        x = np.array([[float(k in set(r.tolist())) for k in keys] for r in lists]).reshape(len(lists), len(keys))
        p = y.sum()
        if p in (0, len(y)):
            return lambda a, d: np.full(len(a), 1 / (1 + np.exp(-5.0 if p else 5.0)))
        weight = np.where(y > 0, 0.5 / p, 0.5 / (len(y) - p))
        use = x.sum(axis=0) >= 3
        full = np.hstack([x, dense, np.ones((len(x), 1))])
        w, m, s = (np.zeros(full.shape[1]) for _ in range(3))
        for t in range(1, 61):
            g = full.T @ (weight * (1 / (1 + np.exp(-np.clip(full @ w, -35, 35))) - y))
            g[:len(keys)] *= use
            g[:-1] += 1e-3 * w[:-1] / len(w) ** 0.5
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w = w - 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-6)

        def prob(lists, d):
            x = np.array([[float(k in set(r.tolist())) for k in keys] for r in lists]).reshape(len(lists), len(keys))
            return 1 / (1 + np.exp(-np.clip(np.hstack([x, d, np.ones((len(x), 1))]) @ w, -35, 35)))

        return prob

    fold, held, out = np.arange(240) % 4, np.zeros((240, 3)), np.zeros((240, 3))
    logit = lambda p: np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3)))
    for i in range(3):
        before = logit(held[:, :i])
        for k in range(4):
            seen = np.flatnonzero(fold != k)
            own = telling(rows.take(seen), toxic[seen])
            prob = plain_fit([lists[j] for j in seen], labels[seen, i], before[seen], own)
            aside = np.flatnonzero(fold == k)
            held[aside, i] = prob([lists[j] for j in aside], before[aside])
        out[:, i] = plain_fit(lists, labels[:, i], before, keys)(lists, logit(out[:, :i]))
    assert chain.prob(rows) == pytest.approx(out, abs=1e-6)


def test_plan_is_best_fit_piece_by_piece():
    """The plan by counts against one piece at a time: each into the fullest open bin, or a new one of least cost."""
    draw = random.Random(9)
    for lengths in ((16, 32, 64), (100,), (8, 64)):
        for _ in range(20):
            pieces = sorted((draw.randint(1, max(lengths)) for _ in range(draw.randint(1, 120))), reverse=True)
            bins, left = [], sum(pieces)
            for n in pieces:
                fits = [b for b in bins if b[0] - sum(b[1]) >= n]
                if fits:
                    best = min(b[0] - sum(b[1]) for b in fits)
                    # of equally full bins the one that was made so last, as the plan's stack of kinds does
                    next(b for b in fits if b[0] - sum(b[1]) == best)[1].append(n)
                else:
                    size = min((s for s in lengths if s >= n), key=lambda s: packing.cost(s) / min(s, max(n, min(left, s))))
                    bins.append((size, [n]))
                left -= n
            kinds = packing.plan({n: pieces.count(n) for n in set(pieces)}, lengths)
            got = sorted(min(s for s in lengths if s >= sum(n * c for n, c in k.pieces)) for k in kinds for _ in range(k.count))
            want = sorted(min(s for s in lengths if s >= sum(b)) for _, b in bins)
            if len(lengths) == 1:
                assert sorted(k.size - k.room for k in kinds for _ in range(k.count)) == sorted(sum(b) for _, b in bins)
            # among several lengths, equally full bins of different sizes may be filled in another order
            assert sum(got) <= 1.05 * sum(want) + max(lengths) and abs(len(got) - len(want)) <= 1 + len(want) // 20


def test_ftrl_leaves_weights_at_zero_and_temperature_calibrates():
    draw = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = i % 2
        at = np.unique(np.concatenate([[10 + y], draw.integers(100, 4000, 20)]))
        rows.append((at, np.ones(len(at)) / len(at) ** 0.5, y))
    w = lang_id.ftrl(rows, 2, l1=0.3)
    assert (w[10] != 0).any() and np.mean(w == 0) > 0.95
    z = np.array([[4.0, 0], [4, 0], [4, 0], [0, 4]])
    t = lang_id.temperature(z, np.array([0, 0, 1, 1]))
    assert 1 / (1 + np.exp(-4 / t)) == pytest.approx(0.75, abs=0.01)


def test_plan_holds_every_piece_and_shrinks():
    draw = random.Random(2)
    for lengths in ((8, 16, 32), (100,), (512, 1024, 2048, 4096)):
        histogram = {n: draw.randint(1, 30) for n in draw.sample(range(1, max(lengths) + 1), min(60, max(lengths)))}
        histogram[max(lengths)] = 5
        kinds = packing.plan(dict(histogram), lengths)
        held = {}
        for k in kinds:
            used = sum(n * c for n, c in k.pieces)
            assert used <= k.size and not any(used <= s < k.size for s in lengths) and k.count > 0
            for n, c in k.pieces:
                held[n] = held.get(n, 0) + c * k.count
        assert held == histogram


def test_packing_places_are_disjoint_and_complete(spark):
    rows = awkward()
    got = packing.packed(docs(spark), lengths=(64, 256, 1024)).collect()
    tokens = sorted((k or -1, len(WORD.findall(t or ""))) for k, t in rows)
    want = sorted((k, n + 1 if n else 0) for k, n in tokens)
    total = {}
    for r in got:
        total.setdefault(r.id or -1, []).append(r.n_tokens)
    assert {k: sum(v) for k, v in total.items()} == {k: sum(n for j, n in want if j == k) for k, _ in want}
    bins = {}
    for r in got:
        assert (r.bin is None) == (r.n_tokens == 0)
        if r.bin is not None:
            bins.setdefault((r.bin, r.sequence_length), []).append((r.offset, r.n_tokens))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), places in bins.items():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    assert packing.packed(empty(spark)).count() == 0


def test_sequences_hold_the_words(spark):
    df = docs(spark, [(i, " ".join(prose(i, 5 + 11 * i))) for i in range(20)])
    out = packing.sequences(packing.packed(df, lengths=(32, 64)), df, "doc_id").collect()
    words = sorted(w for r in out for w in WORD.findall(r.text))
    assert words == sorted(w for i in range(20) for w in prose(i, 5 + 11 * i))
    rows = awkward() + [(3, "another text of three"), (3, "and one more")]
    df = docs(spark, rows)
    out = packing.sequences(packing.packed(df, lengths=(64, 256, 1024)), df, "doc_id").collect()
    assert sorted(w for r in out for w in WORD.findall(r.text)) == sorted(w for _, t in rows for w in WORD.findall(t or ""))


def test_packing_numbers_pieces_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_TASK", 100)
    rows = [(i % 50, " ".join(prose(i, 9))) for i in range(1500)]
    got = packing.packed(docs(spark, rows), lengths=(32, 64)).collect()
    places = {(r.bin, r.offset) for r in got}
    assert len(got) == len(places) == 1500 and {r.n_tokens for r in got} == {10}
    assert all(r.offset + 10 <= r.sequence_length for r in got)


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, 1) for k, u, h in rows],
                                 "page_id long, url string, html string, digest int").repartition(2)


def test_archives_round_trip(spark):
    big = "<p>ä</p>" * 40
    rows = [(5, "http://a/x y", big), (3, "http://b", big), (9, None, big), (4, "u", "x" * 99), (6, "u", "x" * 99),
            (7, "u", None), (8, "u", ""), (None, "u", big), (10, "u", "line\r\n\r\nline" * 5000), (3, "http://b", big)]
    folder = shared_folder(spark, "test-archives")
    manifest = warc.write(pages(spark, rows), folder)
    got = warc.records(spark, manifest).collect()
    assert len(got) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r.key, []).append(r)
    assert [(r.record_type, r.refers_to) for r in by_key[5] + by_key[9]] == [("revisit", 3)] * 2
    assert {r.record_type for k in (3, 4, 6, 7, 8, 10, None) for r in by_key[k]} == {"response"}
    for k, _, h in rows:
        for r in by_key[k]:
            data = (h or "").encode()
            assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
            assert r.payload is None or bytes(r.payload) == data
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_reader_frames_members_and_refuses_damage():
    one, two = (warc.record(k, "u", p, hashlib.sha256(p).hexdigest(), None) for k, p in ((1, b"abc"), (2, b"d" * 9000)))
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    got = list(warc.read(io.BytesIO(one + two)))
    assert [(r.key, r.offset, r.payload_bytes) for r in got] == [(1, 0, 3), (2, len(one), 9000)]
    with pytest.raises(ValueError, match="truncated"):
        list(warc.read(io.BytesIO(one + two[:-5])))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read(io.BytesIO(warc.record(1, "u", b"abc", "0" * 64, None))))


def test_pipeline_stages(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs_, kept = table, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs_.select("doc_id", "text").collect()} if "text" in docs_.columns else {}
        out = stage(spark, docs_, sf)
        path = shared_folder(spark, "stage")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        kept.append(out.count())
        if name != "packing":
            assert out.columns == docs_.columns
        after = {r.doc_id: r["text"] for r in out.select("doc_id", "text").collect()} if "text" in out.columns else {}
        if name == "near duplicates":
            want = near_components(list(before.items()), corpus_pipeline.NEAR)
            assert set(after) == {k for k in before if want[k] == k}
        if name == "secrets":
            assert set(after) == set(before)
        docs_ = out
    assert kept[0] < table.count() and kept[0] > kept[1] >= kept[2] == kept[3] <= kept[4]


def test_near_duplicate_stage_keeps_rows_without_id(spark):
    rows = awkward()
    df = docs(spark, rows)
    got = [r.doc_id for r in corpus_pipeline.unique(spark, df, "").select("doc_id").collect()]
    want = near_components(rows, corpus_pipeline.NEAR)
    assert got.count(None) == 2
    assert sorted(k for k in got if k is not None) == sorted({k for k, _ in rows if k is not None and want[k] == k})


def test_near_duplicate_stage_links_from_a_similarity_of_80(spark):
    rows = [(k, t) for k, t in awkward() if k is not None] + [
        (200 + 30 * b + i, " ".join([*prose(900 + b, 200)[:j], f"own{i}", f"own{i}b", *prose(900 + b, 200)[j + 2:]]))
        for b in (0, 1) for i in range(8) for j in [10 + 20 * i]]
    # two texts at exactly 0.8: 8 shared shingles of 10
    rows += [(300, "a b c d e f g h i j k l m"), (301, "a b c d e f g h i j k l x")]
    want = near_components(rows, 80)
    got = [r.doc_id for r in corpus_pipeline.unique(spark, docs(spark, rows), "").select("doc_id").collect()]
    assert sorted(got) == sorted({k for k in want if want[k] == k})
    assert set(got) < {k for k, c in near_components(rows).items() if k == c} and 301 not in got
