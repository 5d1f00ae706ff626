import random

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.text import splice
from cloakframe.operators import folds, resolve
from cloakframe.operators.detect import drop_contained
from cloakframe.operators.agreement import overlapping
from cloakframe.operators import lookup as lookup_module
from cloakframe.operators.lookup import SALTS, lookup, salted
from cloakframe.policy import Policy


def brute_dedup(rows):
    best = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        k = (r["start"], r["end"], r["pii_type"])
        if k not in best:
            best[k] = dict(r)
        elif r["confidence"] > best[k]["confidence"]:
            best[k] = {**r, "ord": best[k]["ord"]}
    return sorted(best.values(), key=lambda r: r["ord"])


def brute_merge(rows):
    kept, cur = [], None
    for r in sorted(rows, key=lambda r: (r["start"], r["ord"])):
        if cur is None:
            cur = r
        elif r["start"] < cur["end"] and cur["start"] < r["end"]:
            longer = r["end"] - r["start"] > cur["end"] - cur["start"]
            if r["confidence"] > cur["confidence"] or (r["confidence"] == cur["confidence"] and longer):
                cur = r
        else:
            kept.append(cur)
            cur = r
    return kept + ([cur] if cur else [])


def random_findings(seed, ids, per_id, width):
    rng = random.Random(seed)
    rows = []
    for i in ids:
        for o in range(per_id(rng)):
            start = rng.randrange(width)
            rows.append({"id": i, "pii_type": rng.choice("AB"), "value": f"v{o}", "start": start, "end": start + rng.randrange(1, 9),
                         "confidence": rng.choice([0.5, 0.6, 0.9]), "ord": o})
    return rows


SCHEMA = "id long, pii_type string, value string, start int, `end` int, confidence double, ord int"


def as_df(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("id", "pii_type", "value", "start", "end", "confidence", "ord")) for r in rows], SCHEMA)


def keys(rows):
    return sorted((r["id"], r["start"], r["end"], r["pii_type"], r["confidence"], r["value"]) for r in rows)


def test_table_form_equals_brute_force(spark):
    rows = random_findings(1, range(60), lambda r: r.randrange(0, 25), 60)
    rows += random_findings(2, [1000], lambda r: 600, 1500)  # one id with a third of all findings
    want = []
    for i in {r["id"] for r in rows}:
        want += brute_merge(brute_dedup([r for r in rows if r["id"] == i]))
    deduped = resolve.dedup_table(as_df(spark, rows), ["id"])
    assert keys(r.asDict() for r in deduped.collect()) == keys(
        d for i in {r["id"] for r in rows} for d in brute_dedup([r for r in rows if r["id"] == i]))
    assert keys(r.asDict() for r in resolve.merge_table(deduped, ["id"]).collect()) == keys(want)


def test_fold_across_stripes(spark):
    """Narrow stripes, so that many spans reach out of theirs and chains cross several."""
    rows = random_findings(5, range(4), lambda r: 120, 400)
    rows += random_findings(6, [7], lambda r: 300, 120)  # one chain over all stripes
    rows += [{"id": 8, "pii_type": "A", "value": "long", "start": 3, "end": 900, "confidence": 0.55, "ord": 0}]
    rows += random_findings(9, [8], lambda r: 60, 1000)
    want = [k for i in {r["id"] for r in rows} for k in brute_merge(brute_dedup([r for r in rows if r["id"] == i]))]
    for stripe in (5, 16, 1 << 16):
        got = folds.folded(as_df(spark, rows), ["id"], stripe=stripe)
        assert keys(r.asDict() for r in got.collect()) == keys(want), stripe
        assert got.columns == as_df(spark, rows).columns
    assert folds.folded(as_df(spark, []), ["id"]).count() == 0


def test_fold_leftmost_longest(spark):
    rows = random_findings(15, range(30), lambda r: 40, 200)
    want = []
    for i in range(30):
        at = 0
        for r in sorted((r for r in rows if r["id"] == i), key=lambda r: (r["start"], -r["end"])):
            if r["start"] >= at:
                want.append((i, r["start"], r["end"]))
                at = r["end"]
    for stripe in (7, 1 << 16):
        got = folds.folded(as_df(spark, rows), ["id"], folds.first, ("start", "-end", "pii_type"), stripe).collect()
        assert sorted((r.id, r.start, r.end) for r in got) == sorted(want)


def test_fold_streams_a_chain_of_a_million_spans(spark):
    """Every span overlaps the next; the task holds one of them."""
    n = 1_000_000
    chain = spark.range(0, n, 1, 8).select(
        F.lit(1).alias("id"), F.lit("A").alias("pii_type"), F.lit("v").alias("value"), (F.col("id") * 2).cast("int").alias("start"),
        (F.col("id") * 2 + 3).cast("int").alias("end"), F.lit(0.5).alias("confidence"), F.col("id").cast("int").alias("ord"))
    got = folds.folded(chain, ["id"]).agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("start").alias("b"),
                                          F.countDistinct("start").alias("d")).first()
    # the first stays, the next one overlaps it and loses, the one after that does not
    assert (got.n, got.d, got.a, got.b) == (n // 2, n // 2, 0, 2 * (n - 2))


def test_row_form_equals_brute_force(spark):
    rows = random_findings(3, range(80), lambda r: r.randrange(0, 20), 50)
    spans = F.collect_list(F.struct("ord", "pii_type", "value", "start", "end", "confidence")).alias("s")
    kept = as_df(spark, rows).groupBy("id").agg(spans).select(
        "id", F.explode(resolve.kept_spans(resolve.clusters(F.col("s")), Policy(apply_lists=False))).alias("k")).select("id", "k.*")
    # the row form orders equal starts by confidence, length and table order
    for r in rows:
        r["ord0"] = r["ord"]
    want = []
    for i in {r["id"] for r in rows}:
        mine = sorted((dict(r) for r in rows if r["id"] == i), key=lambda r: (r["start"], -r["confidence"], -(r["end"] - r["start"]), r["ord"]))
        for n, r in enumerate(mine):
            r["ord"] = n
        want += brute_merge(brute_dedup(mine))
    assert keys(r.asDict() for r in kept.collect()) == keys(want)


def brute_contained(rows):
    def before(g, f):
        return (-g["confidence"], g["start"], g["start"] - g["end"], g["ord"]) < (
            -f["confidence"], f["start"], f["start"] - f["end"], f["ord"])

    return [f for f in rows if not any(g["pii_type"] == f["pii_type"] and g["start"] <= f["start"] and g["end"] >= f["end"]
                                       and before(g, f) for g in rows)]


def test_few_spans_are_cut_without_a_running_reach(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, j, s, s + rng.randint(1, 9), 0.5) for i in range(300) for j in range(rng.randint(0, 9)) for s in [rng.randint(0, 40)]]
    df = spark.createDataFrame(rows, "id long, ord int, start int, end int, confidence double").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "start", "end", "confidence"))).alias("s"))
    few = df.select("id", resolve.clusters(F.col("s")).alias("c")).sort("id")
    monkeypatch.setattr(resolve, "FEW", 0)
    assert few.collect() == df.select("id", resolve.clusters(F.col("s")).alias("c")).sort("id").collect()


def test_dense_clusters_equal_brute_force(spark):
    """Clusters of a few and of hundreds of spans: containment, dedupe and merge by either way."""
    rows = [r for i in range(12) for r in random_findings(40 + i, [i], lambda r: (5, 20, 40, 400)[i % 4], 60)]
    spans = F.collect_list(F.struct("ord", "pii_type", "value", "start", "end", "confidence")).alias("s")
    grouped = as_df(spark, rows).groupBy("id").agg(spans).select("id", resolve.clusters(F.col("s")).alias("c"))
    sizes = [len(c) for r in grouped.collect() for c in r.c]
    assert min(sizes) == 1 and max(sizes) > 3 * resolve.FEW
    outer = grouped.select("id", F.transform("c", drop_contained).alias("c"))
    got = outer.select("id", F.explode(F.flatten("c")).alias("k")).select("id", "k.*").collect()
    want = [f for i in range(12) for f in brute_contained([r for r in rows if r["id"] == i])]
    assert keys(r.asDict() for r in got) == keys(want)
    kept = outer.select("id", F.explode(resolve.kept_spans(F.col("c"), Policy(apply_lists=False))).alias("k")).select("id", "k.*").collect()
    merged = []
    for i in range(12):
        mine = sorted((dict(r) for r in want if r["id"] == i), key=lambda r: (r["start"], -r["confidence"], -(r["end"] - r["start"]), r["ord"]))
        for n, r in enumerate(mine):
            r["ord"] = n
        merged += brute_merge(brute_dedup(mine))
    assert keys(r.asDict() for r in kept) == keys(merged)


def test_splice(spark):
    text = "ab😀cdéfgh"
    spans = F.expr("array(named_struct('start', 1, 'end', 3), named_struct('start', 3, 'end', 4), named_struct('start', 7, 'end', 8))")
    df = spark.createDataFrame([(text,), ("x" * 5000 + text,)], "t string")
    shifted = F.transform(spans, lambda s: F.struct(
        (s["start"] + F.length("t") - len(text)).alias("start"), (s["end"] + F.length("t") - len(text)).alias("end")))
    got = [r[0] for r in df.select(splice(F.col("t"), shifted, lambda s: F.lit("<>"))).collect()]
    assert got == ["a<><>déf<>h", "x" * 5000 + "a<><>déf<>h"]


def test_allow_and_deny(spark):
    p = Policy(allow_values=("a@b.c",), allow_domains=("ok.org",), allow_patterns=("^x",), deny_values=("d@ok.org",))
    values = ["a@b.c", "q@ok.org", "q@sub.ok.org", "d@ok.org", "xyz", "plain", "q@ok.org@z"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    kept = [r[0] for r in df.where(resolve.survives_lists(F.col("v"), p)).collect()]
    assert kept == ["q@sub.ok.org", "d@ok.org", "plain"]


def test_lookup_gives_the_same_rows_both_ways(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, n int")
    for how in ("inner", "left"):
        small = lookup(facts, table, ["key"], how)
        large = lookup(facts, table, ["key"], how, broadcast_bytes=0)
        assert sorted(map(tuple, small.collect())) == sorted(tuple(r) for r in large.select(small.columns).collect())


def test_only_hot_keys_are_repeated(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id")))
    facts = spark.range(6000).select("id", key.alias("key"))
    table = facts.where("key <> 'hot'").select("key").distinct().unionByName(spark.createDataFrame([("hot",)], "key string"))
    left, right = salted(facts, table, ["key"])
    repeated = {r["key"]: r["count"] for r in right.groupBy("key").count().collect()}
    assert repeated.pop("hot") == SALTS and set(repeated.values()) == {1} and len(repeated) == 2000
    dealt = {r["key"]: r["n"] for r in left.groupBy("key").agg(F.countDistinct("_salt").alias("n")).collect()}
    assert dealt.pop("hot") == SALTS and dealt.pop(None) == SALTS and set(dealt.values()) == {1}
    joined = lookup(facts, table.withColumn("n", F.length("key")), ["key"], "left", broadcast_bytes=0)
    assert joined.count() == 6000 and joined.where("n IS NULL").count() == 2000


def test_lookup_of_empty_tables(spark):
    facts = spark.createDataFrame([("a", 1)], "key string, n int")
    empty = spark.createDataFrame([], "key string, m int")
    assert [tuple(r) for r in lookup(facts, empty, ["key"], "left", broadcast_bytes=-1).collect()] == [("a", 1, None)]
    assert lookup(facts.limit(0), empty, ["key"], "left", broadcast_bytes=-1).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_list_tables(spark, limit):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    found = one("a@ok.org", "b@x.org", "c@ok.org", "d@x.org", "e", "both", None)
    kept = lookup_module.apply_list_tables(found, one("b@x.org", "both", "b@x.org"), one("ok.org"), one("c@ok.org", "both"), limit)
    assert {r["value"] for r in kept.collect()} == {"c@ok.org", "d@x.org", "e", "both", None}
    assert kept.columns == ["value"] and kept.count() == 5


def test_agreement(spark):
    a, b = random_findings(7, range(5), lambda r: 30, 300), random_findings(8, range(5), lambda r: 30, 300)
    want = sorted((x["id"], x["start"], x["end"], y["start"], y["end"], x["pii_type"], y["pii_type"]) for x in a for y in b
                  if x["id"] == y["id"] and x["start"] < y["end"] and y["start"] < x["end"])
    got = overlapping(as_df(spark, a), as_df(spark, b), ["id"], cell=4).collect()
    assert sorted((r.id, r.a_start, r.a_end, r.b_start, r.b_end, r.a_type, r.b_type) for r in got) == want
