"""I-Match fingerprints over randomised subsets of a lexicon.

Terms are the distinct lower-cased words of a text.  The lexicon holds the terms whose inverse document frequency
lies in a band: frequent enough to be shared, rare enough to tell texts apart.  As the band is a share of the
number of texts, the lexicon has at most (mean distinct terms of a text) / ``LEAST_SHARE`` entries however large
the corpus is, which bounds what is broadcast.  A text keeps its terms of the lexicon, sorted; subset 0 is the
whole lexicon (the classic fingerprint), and five scales of eight random subsets keep each term with a chance of
1/4, 1/16, ... 1/1024, so that short and long texts both have subsets with a few of their terms.  The fingerprint
is the row of hashes, one for each subset, empty where no term of the text is in it.

Two fingerprints are alike by the share of equal hashes among non-empty ones, on the scale where that is largest
and at least four subsets are filled; equal whole-lexicon hashes give 1.

Defined cases: a null text counts as empty; a text without a term of the lexicon is fingerprinted by all its
terms, so it is like equal ones only; rows with equal texts have equal fingerprints; rows with a null id have no
place in the order of documents: nothing follows them and they follow nothing.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import words
from cloakframe.sources.staging import staged

#: The band of document frequencies, as shares of the number of documents, ends included.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.05
SCALES, EACH, FILLED = 5, 8, 4
SUBSETS = 1 + SCALES * EACH


def terms(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) over all texts; combined before the shuffle."""
    return docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, mask): the terms inside the band; bit k of mask tells whether subset k keeps the term."""
    n = docs.count()
    kept = frequencies(docs, text_col).where(
        (F.col("df") >= max(2, ceil(n * LEAST_SHARE))) & (F.col("df") <= max(2, n * MOST_SHARE)))
    mask = F.lit(1).cast("long")
    for k in range(1, SUBSETS):
        draw = F.conv(F.substring(F.md5(F.concat("term", F.lit(f"|{k}"))), 1, 5), 16, 10).cast("long")
        inside = draw < (1 << 20) >> 2 * (1 + (k - 1) // EACH)
        mask = mask + F.when(inside, F.lit(1 << k)).otherwise(F.lit(0).cast("long"))
    return kept.select("term", mask.alias("mask"))


def with_prints(df: DataFrame) -> DataFrame:
    """Adds the fingerprint ``prints``: ``kept`` has the sorted (term, mask) of the lexicon, ``all_terms`` is the
    hash for texts without any.  Each scale looks at its own terms only."""
    def having(terms_: Column, bits: int) -> Column:
        return F.filter(terms_, lambda x: x["mask"].bitwiseAND(F.lit(bits)) != 0)

    def digest(terms_: Column) -> Column:
        h = F.substring(F.md5(F.array_join(terms_["term"], " ")), 1, 8)
        return F.when(F.size(terms_) == 0, F.lit("")).otherwise(h)

    scales = {f"_scale{s}": having(F.col("kept"), ((1 << EACH) - 1) << (1 + s * EACH)) for s in range(SCALES)}
    df = df.withColumns(scales).withColumn("_subsets", F.array(F.col("kept"), *[
        having(F.col(f"_scale{s}"), 1 << (1 + s * EACH + i)) for s in range(SCALES) for i in range(EACH)]))
    prints = F.transform("_subsets", digest)
    return df.withColumn("prints", F.when(F.size("kept") > 0, prints).otherwise(F.array("all_terms"))).drop(
        "_subsets", *scales)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two arrays made by ``with_prints``; 0 where one is null."""
    def part(first: int, n: int) -> Column:
        both = F.arrays_zip(F.slice(a, first, n).alias("a"), F.slice(b, first, n).alias("b"))
        filled = F.size(F.filter(both, lambda x: (x["a"] != "") | (x["b"] != "")))
        equal = F.size(F.filter(both, lambda x: (x["a"] != "") & (x["a"] == x["b"])))
        return F.when(filled >= FILLED, equal / filled).otherwise(F.lit(0.0))

    scales = F.greatest(*[part(2 + s * EACH, EACH) for s in range(SCALES)])
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(F.get(a, 0) == F.get(b, 0), F.lit(1.0)).when(
        (F.size(a) == 1) | (F.size(b) == 1), F.lit(0.0)).otherwise(scales)


def _blocks(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """``docs`` (key, text) with ``block``, a range of keys, and each block's successor as a ``ghost`` row in it:
    what follows a row is then found inside its block, and blocks go to tasks of their own."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * per_partition
    bounds = docs.agg(F.percentile_approx("key", [i / n for i in range(n)], 10 * max(n, 1000))).first()[0]
    bounds = sorted(set(bounds or ()))
    if not bounds:
        return docs.select("*", F.lit(0).alias("block"), F.lit(False).alias("ghost")).where("key is null")
    at = F.lit(bounds)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    block = F.aggregate(F.lit(steps), F.lit(-1), lambda p, s: F.when(
        F.coalesce(F.get(at, p + s) <= F.col("key"), F.lit(False)), p + s).otherwise(p))
    own = F.when(F.col("key").isNull(), -2 - F.pmod(F.xxhash64("text"), F.lit(64)).cast("int")).otherwise(
        F.greatest(block, F.lit(0)))
    df = docs.withColumn("own", own)
    before = F.when(F.col("own") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("own") - 1)
    first = F.coalesce(F.get(at, F.col("own")) == F.col("key"), F.lit(False)) & (F.col("own") >= 0)
    places = F.when(first, F.array(
        F.struct(F.col("own").alias("block"), F.lit(False).alias("ghost")),
        F.struct(before.alias("block"), F.lit(True).alias("ghost")),
    )).otherwise(F.array(F.struct(F.col("own").alias("block"), F.lit(False).alias("ghost"))))
    return df.select("key", "text", F.explode(places).alias("place")).select("key", "text", "place.*")


def edited(docs: DataFrame) -> DataFrame:
    """``docs`` (key, text) with ``edited``: the last quarter of the characters replaced by the first as many of the
    next text by key, after the last key the first.  Adds block, ghost and row for the same order later on."""
    order = Window.partitionBy("block").orderBy("ghost", "key", F.xxhash64("text"))
    df = _blocks(docs).withColumns({
        "row": F.row_number().over(order), "following": F.lead("text").over(order)})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    tail = F.when(F.col("key").isNull(), F.lit("")).otherwise(F.coalesce("following", F.lit("")))
    return df.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring(tail, F.lit(1), cut))
    ).drop("following")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: key, n_chars, edited_sha256, prints and edited_prints (arrays), near_edited,
    near_next.

    Texts are shuffled once, by ranges of ids; fingerprints are made where they then lie.
    """
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = staged(lexicon(texts), "lexicon")
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")),
                             F.struct(F.lit(1).alias("side"), F.col("edited").alias("body"))))
    both = edited(texts).select("block", "ghost", "row", "key", "n_chars", side.alias("x")).select(
        "block", "ghost", "row", "key", "n_chars", "x.side", "x.body")
    both = both.withColumn("terms", F.sort_array(terms(F.col("body")))).withColumns({
        "sha": F.when(F.col("side") == 1, F.sha2("body", 256)),
        "all_terms": F.md5(F.array_join("terms", " ")),
    }).select("block", "ghost", "row", "key", "n_chars", "side", "sha", "all_terms",
              F.explode(F.array_append("terms", F.lit(""))).alias("term"))
    # the empty term keeps a row of every text; it belongs to no subset
    known = known.unionByName(known.sparkSession.createDataFrame([("", 0)], "term string, mask long"))
    each = both.join(F.broadcast(known), "term").groupBy("block", "row", "side").agg(
        F.first("ghost").alias("ghost"), F.first("key").alias("key"), F.first("n_chars").alias("n_chars"),
        F.first("sha").alias("sha"), F.first("all_terms").alias("all_terms"),
        F.collect_list(F.when(F.col("mask") != 0, F.struct("term", "mask"))).alias("kept"))
    each = with_prints(each.withColumn("kept", F.sort_array("kept")))
    texts_ = Window.partitionBy("block").orderBy("row", "side")
    lines = each.select("block", "row", "side", "ghost", "key", "n_chars", "prints",
                        F.lead("prints", 1).over(texts_).alias("edited_prints"),
                        F.lead("sha", 1).over(texts_).alias("edited_sha256"),
                        F.lead("prints", 2).over(texts_).alias("next_prints"))
    following = F.when(F.col("key").isNotNull(), F.col("next_prints"))
    return lines.where("side = 0 and not ghost").select(
        "key", "n_chars", "edited_sha256", "prints", "edited_prints",
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), following).alias("near_next"))
