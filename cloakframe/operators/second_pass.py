"""The second pass: what a model said about already rewritten texts, located and applied.

The engine talks to a table of responses (ids, content).  Such a table can be filled by any service;
``infer`` fills it from a function that Spark calls once per batch of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import running_sums
from cloakframe.functions.text import code_points, let, piece, with_computed
from cloakframe.operators.detect import _quoted, stripped
from cloakframe.operators.lookup import lookup
from cloakframe.operators.resolve import clusters, dedup, merge
from cloakframe.policy import Policy
from cloakframe.sources.staging import staged

# Fixed values.
CONFIDENCE = 0.85
DETECTOR = "LLM"
LISTED_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "ORG", "NRP", "GPE")
# Text that is nothing but markers of an earlier rewrite.
ONLY_MARKERS = r"\A[\s\[\]A-Z_]*\z"


def is_candidate(text: Column) -> Column:
    return text.isNotNull() & ~text.rlike(ONLY_MARKERS)


def candidates(df: DataFrame, text_col: str) -> DataFrame:
    return df.where(is_candidate(F.col(text_col)))


def normalized_type(raw: Column) -> Column:
    return F.translate(F.upper(raw), " -", "__")


def parsed(content: Column) -> Column:
    """array<struct(ord, pii_type, value)> from one response: the outermost [...] as JSON, short or long
    keys; without a value or a type an item is dropped, and what is not JSON holds nothing."""
    items = F.from_json(
        F.regexp_extract(content, r"(?s)\[.*\]", 0),
        "array<struct<t:string,v:string,type:string,value:string>>")
    none_if_empty = lambda c: F.when(c != "", c)

    def item(r: Column, i: Column) -> Column:
        value = F.coalesce(none_if_empty(r["v"]), none_if_empty(r["value"]))
        kind = F.coalesce(none_if_empty(r["t"]), none_if_empty(r["type"]))
        return F.struct(i.alias("ord"), normalized_type(kind).alias("pii_type"), value.alias("value"))

    return F.filter(
        F.transform(F.coalesce(items, F.array().cast("array<struct<t:string,v:string,type:string,value:string>>")), item),
        lambda r: r["value"].isNotNull() & r["pii_type"].isNotNull())


def is_listed(pii_type: Column, value: Column, words: tuple[str, ...]) -> Column:
    if not words:
        return F.lit(False)
    listed = F.expr("array(" + ", ".join(_quoted(w.lower()) for w in words) + ")")
    return pii_type.isin(*LISTED_TYPES) & F.arrays_overlap(listed, F.split(F.lower(stripped(value)), r"\s+", -1))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _direct(text: Column, low: Column, value: Column) -> Column:
    """struct(start, end) of ``value`` as written, else whatever the case; null if there is none."""
    def at(i: Column) -> Column:
        return F.when(i > 0, _span(i - 1, i - 1 + F.length(value)))

    return F.when(F.length(value) > 0, F.coalesce(
        let(F.instr(text, value), at), let(F.instr(low, F.lower(value)), at)))


def _lowered(joined: Column) -> Column:
    """Lower case of the same length: a letter whose lower case is longer would move what is behind it."""
    return F.when(F.length(F.lower(joined)) == F.length(joined), F.lower(joined)).otherwise(
        F.translate(joined, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _bare(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"\s", ""))


def without_blanks(text: Column) -> Column:
    """A position map: ``low``, the text in lower case without white space, and of each of its runs where it ends there
    (``ends``) and how far its characters lie from their places in the text (``shift``)."""
    runs = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    gaps = F.split(text, r"\S+", -1)

    def of(r: Column, g: Column) -> Column:
        return F.struct(_lowered(F.array_join(r, "")).alias("low"), running_sums(F.transform(r, F.length)).alias("ends"),
                        running_sums(F.transform(r, lambda _, i: F.length(F.get(g, i)))).alias("shift"))

    return let(F.struct(runs.alias("r"), gaps.alias("g")), lambda x: of(x["r"], x["g"]))


def _place(free: Column, i: Column) -> Column:
    """Where character ``i`` of the text without white space stands in the text."""
    return i + F.get(free["shift"], F.size(F.filter(free["ends"], lambda e: e <= i)))


def _spaced(free: Column, value: Column) -> Column:
    """struct(start, end) of ``value`` whatever the case and the white space between its characters."""
    def found(v: Column) -> Column:
        return let(F.instr(free["low"], v), lambda i: F.when(
            i > 0, _span(_place(free, i - 1), _place(free, i - 2 + F.length(v)) + 1)))

    return let(_bare(value), lambda v: F.when(F.length(v) > 0, found(v)))


def located(text: Column, value: Column) -> Column:
    """struct(start, end) of the first place of ``value`` in ``text``: as written, else whatever the
    case, else whatever the white space between its characters; null if there is none."""
    return let(_direct(text, F.lower(text), value), lambda d: F.when(d.isNotNull(), d).otherwise(
        let(without_blanks(text), lambda free: _spaced(free, value))))


def named(content: Column, policy: Policy, filter_listed: bool = True) -> Column:
    """What a response names, without what consists of listed words."""
    if not filter_listed:
        return parsed(content)
    return F.filter(parsed(content), lambda r: ~is_listed(r["pii_type"], r["value"], policy.false_positive_words))


_FOUND = ("array<struct<ord:int,pii_type:string,value:string,start:int,end:int,confidence:double,detector:string,"
          "shape:string>>")


def with_response_findings(df: DataFrame, text_col: str, contents: str, name: str, policy: Policy,
                           filter_listed: bool = True) -> DataFrame:
    """``df`` with the findings of the responses in ``contents`` (an array, or null) in the coordinates of the text; the
    value is read from the text.  The text is looked through without white space only where a value asks for it, once
    for all of them, and its position map is made only where such a value is in it at all.  Each step is a column of its
    own, computed once."""
    text = F.col(text_col)
    items = F.when(is_candidate(text), F.flatten(F.transform(
        F.col(contents), lambda c: named(c, policy, filter_listed))))
    df = with_computed(df, "_items", items)
    direct = let(F.lower(text), lambda low: F.transform("_items", lambda r: F.struct(
        r["ord"].alias("ord"), r["pii_type"].alias("pii_type"), r["value"].alias("value"),
        _direct(text, low, r["value"]).alias("at"))))
    df = df.withColumn("_direct", direct)
    # what is not even in the text without white space costs one search, not a position map of the whole text
    joined = F.when(F.exists("_direct", lambda r: r["at"].isNull()), _lowered(F.regexp_replace(text, r"\s+", "")))
    df = df.withColumn("_joined", joined)
    spaced = let(F.col("_joined"), lambda j: F.exists("_direct", lambda r: r["at"].isNull() & F.contains(j, _bare(r["value"]))))
    df = df.withColumn("_free", F.when(F.col("_joined").isNotNull() & spaced, without_blanks(text)))
    placed = let(F.col("_free"), lambda m: F.transform("_direct", lambda r: F.struct(
        r["ord"].alias("ord"), r["pii_type"].alias("pii_type"),
        F.when(r["at"].isNotNull(), r["at"]).otherwise(_spaced(m, r["value"])).alias("at"))))
    df = df.withColumn("_placed", placed)

    def finding(r: Column) -> Column:
        s = r["at"]
        return F.struct(
            r["ord"].alias("ord"), r["pii_type"].alias("pii_type"),
            F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"),
            s["start"].alias("start"), s["end"].alias("end"), F.lit(CONFIDENCE).alias("confidence"),
            F.lit(DETECTOR).alias("detector"), F.lit("response").alias("shape"))

    found = F.transform(F.filter("_placed", lambda r: r["at"].isNotNull()), finding)
    return df.withColumn(name, F.coalesce(found, F.array().cast(_FOUND))).drop(
        "_items", "_direct", "_joined", "_free", "_placed")


def _by_text(responses: DataFrame, ids: list[str], policy: Policy, filter_listed: bool = True) -> DataFrame:
    """(ids, _contents): all answers that name something, together for each text, so that a text that was answered
    twice stays one row; texts whose answers name nothing are not joined at all.  Staged, as it is measured before it is
    joined: where it is small, no text is shuffled."""
    return staged(responses.where(F.size(named(F.col("content"), policy, filter_listed)) > 0).groupBy(*ids).agg(
        F.sort_array(F.collect_set("content")).alias("_contents")), "answers")


def second_pass_findings(texts: DataFrame, text_col: str, responses: DataFrame, ids: list[str],
                         policy: Policy | None = None, filter_listed: bool = True) -> DataFrame:
    """One row per located finding of the responses (ids, content)."""
    policy = policy or Policy()
    asked = candidates(texts.select(*ids, F.col(text_col).alias("_text")), "_text")
    joined = lookup(asked, _by_text(responses, ids, policy, filter_listed), ids, salts=1)
    found = with_response_findings(joined, "_text", "_contents", "_found", policy, filter_listed).select(
        *ids, "_text", F.explode_outer("_found").alias("_f"))
    points = code_points(F.col("_text"))
    left = F.greatest(F.col("_f.start") - 20, F.lit(0))
    around = piece(points, left, F.least(F.col("_f.end") + 20, F.length("_text")) - left)
    return found.where(F.col("_f").isNotNull()).select(
        *ids, "_f.pii_type", "_f.value", "_f.start", "_f.end", "_f.confidence", around.alias("context"),
        "_f.detector", "_f.shape", "_f.ord")


def apply_second_pass(texts: DataFrame, text_col: str, responses: DataFrame, ids: list[str],
                      policy: Policy | None = None) -> DataFrame:
    """``texts`` with the located findings rewritten and ``llm_pii_found`` added; pii_anonymized, where
    present, grows by it.  A text without a response stays as it is."""
    from cloakframe.plans.rewrite import rewritten

    policy = policy or Policy()
    joined = lookup(texts, _by_text(responses, ids, policy), ids, "left", salts=1)
    text = F.col(text_col)
    found = with_response_findings(joined, text_col, "_contents", "_found", policy)
    found = found.withColumn("_groups", clusters(F.col("_found")))
    found = found.withColumn("_kept", F.flatten(F.transform("_groups", lambda c: let(dedup(c), merge))))
    done = with_computed(found, "_p", let(F.col("_kept"), lambda k: F.struct(
        rewritten(text, k, policy).alias("text"), F.size(k).alias("n"))))
    out = []
    for c in texts.columns:
        if c == text_col:
            out.append(F.col("_p.text").alias(c))
        elif c == "pii_anonymized":
            out.append((F.col(c) + F.col("_p.n")).alias(c))
        else:
            out.append(F.col(c))
    return done.select(*out, F.col("_p.n").alias("llm_pii_found"))


def answered(texts: DataFrame, text_col: str, responses: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, content, failed): every candidate text with its answer in the table ``responses`` (ids, content); without
    one it failed."""
    asked = candidates(texts, text_col).select(*ids)
    return asked.join(responses.select(*ids, "content"), ids, "left").select(
        *ids, "content", F.col("content").isNull().alias("failed"))


def infer(texts: DataFrame, text_col: str, ids: list[str], make_client: Callable[[], Callable[[str], str]],
          concurrency: int = 8) -> DataFrame:
    """Responses (ids, content, error) of a model for every candidate text.

    ``make_client`` runs once per task and gives a function from text to response.  A call that fails
    has no content and says why, so one text never fails its batch and is not taken for a text in which
    nothing was found; at most tasks x ``concurrency`` calls are open.
    """
    slim = candidates(texts.select(*ids, F.col(text_col).alias("_text")), "_text")
    schema = texts.select(*ids).schema.add("content", "string").add("error", "string")

    def answer(batches: Iterable) -> Iterable:
        from concurrent.futures import ThreadPoolExecutor

        client = make_client()

        def safe(text: str) -> tuple[str | None, str | None]:
            try:
                return client(text), None
            except Exception as e:  # the contract: one text never fails its batch
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                answers = list(pool.map(safe, pdf["_text"]))
                yield pdf[ids].assign(content=[a[0] for a in answers], error=[a[1] for a in answers])

    return slim.mapInPandas(answer, schema)
