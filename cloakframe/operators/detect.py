"""Text column -> findings, without a shuffle: every finding of a row is computed inside that row.

Per row: cheap presence tests, then only the regexes whose presence tests pass, then positions for
the regexes that hit, then check digits, context words and scores for the hits.  Prose without digits
or keywords costs a few substring searches instead of about ninety regex passes.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import checksums
from cloakframe.functions.arrays import first_of_runs, running_max, running_sums
from cloakframe.functions.patterns import DIGIT_CLASSES, TITLE_LEAD, TITLES, Entity, Shape
from cloakframe.functions.text import SHORT, code_points, let, piece, short_snippet, snippet, with_computed
from cloakframe.operators.resolve import FEW, clusters, in_merge_order
from cloakframe.policy import Policy, registered_entities

# How much a nearby context word adds, the least score it lifts to, and the reach.
CONTEXT_BOOST = 0.35
CONTEXT_FLOOR = 0.4
CONTEXT_TOKENS = 5

# Characters looked at first for the context tokens; when they hold too few tokens the whole text
# before the match is used, so the reach is always exact.
_WINDOW = 120

# So many matches of a shape are looked up in the text one by one; more are placed by a second pass of the regex.
_LOOKED_UP = 4

DETECTOR = "patterns"


# Working columns next to the caller's own.
_TEXT, _LOW, _RUNS, _MATCHES, _HITS = "_cf_text", "_cf_low", "_cf_runs", "_cf_matches", "_cf_hits"
_RAW, _SORTED, GROUPS = "_cf_raw", "_cf_sorted", "_cf_groups"
_DIGIT_COLUMN = {"#1": "_cf_d1", "#6": "_cf_d6", "#8": "_cf_d8", "#13": "_cf_d13"}


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _raw(regex: str) -> str:
    """A raw SQL string literal: the regex stays a constant, so it is compiled once per task."""
    return 'r"' + regex.replace('"', r"\x22") + '"'


def _presence_sql(shape: Shape) -> str:
    """True when every group of ``shape.needs`` has a member in the text."""
    haystack = _TEXT if shape.case_sensitive else _LOW

    def member(need: str) -> str:
        where = _RUNS if need.startswith("|") else haystack
        return _DIGIT_COLUMN.get(need) or f"contains({where}, {_quoted(need)})"

    groups = [" OR ".join(member(need) for need in group) for group in shape.needs]
    return " AND ".join(f"({g})" for g in groups) or f"{_TEXT} IS NOT NULL"


def _matches_sql(shape: Shape) -> str:
    """The matches of one shape, or null where the presence tests fail."""
    return f"CASE WHEN {_presence_sql(shape)} THEN regexp_extract_all({_TEXT}, {_raw(shape.anchored())}, 0) END"


def _hits_sql(orders: list[int], shapes: list[Shape]) -> str:
    """Of each shape that matches, its matches.  Where a few matched values occur once each in the text their places are
    known; only where one occurs again, or there are more, is the text between the matches (``g``) needed."""
    again = f"size(m) > {_LOOKED_UP} OR exists(m, v -> locate(v, {_TEXT}, instr({_TEXT}, v) + 1) > 0)"
    each = f"array({', '.join(map(str, orders))})"
    regexes = f"array({', '.join(_raw(s.anchored()) for s in shapes)})"
    hit = (f"CASE WHEN size(m) > 0 THEN named_struct('ord', get({each}, i), 'm', m, 'g', "
           f"CASE WHEN {again} THEN split({_TEXT}, get({regexes}, i), -1) END) END")
    # asked twice, so that the optimizer leaves the matches where they are: inside a function with a lambda nothing is
    # compiled
    return (f"CASE WHEN size({_MATCHES}) > 0 THEN filter(transform({_MATCHES}, (m, i) -> {hit}), h -> h IS NOT NULL) END")


def shape_orders() -> dict[tuple[str, str], int]:
    """The position of every shape in the whole table: the order among equals, whatever is selected."""
    pairs = [(e.pii_type, s.name) for e in registered_entities().values() for s in e.shapes]
    return {pair: i for i, pair in enumerate(pairs)}


def _facts() -> Column:
    """What is known of each shape, by its order: one constant array."""
    rows = []
    for e in registered_entities().values():
        # a word of several tokens never fits into one token
        words = ", ".join(_quoted(w.lower()) for w in e.context if " " not in w)
        words = f"array({words})" if words else "cast(array() AS array<string>)"
        for s in e.shapes:
            rows.append(f"named_struct('pii_type', {_quoted(e.pii_type)}, 'shape', {_quoted(s.name)}, "
                        f"'score', {float(s.score)}D, 'boosted', {boosted(s.score)}D, 'context', {words})")
    return F.expr("array(" + ", ".join(rows) + ")")


def with_hits(df: DataFrame, text_col: str, policy: Policy) -> DataFrame:
    """Adds the presence columns and ``_cf_hits``: for every shape that matches, its matches.

    The presence tests are columns of their own, so each is computed once per row and the costly ones
    only where the cheap ones hold.  The expression is handed over as SQL text because it names about
    ninety constant regexes.
    """
    orders = shape_orders()
    shapes = [(orders[(e.pii_type, s.name)], s) for e in policy.selected() for s in e.shapes]
    matches = ",\n".join(_matches_sql(s) for _, s in shapes) or "cast(null AS array<string>)"
    text = F.col(_TEXT)
    d1, d6, d8, d13 = _DIGIT_COLUMN.values()
    lengths = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r).cast("string"))
    return (
        df.withColumn(_TEXT, F.col(text_col))
        .withColumns({_LOW: F.lower(text), d1: text.rlike(DIGIT_CLASSES["#1"])})
        .withColumn(d6, F.col(d1) & text.rlike(DIGIT_CLASSES["#6"]))
        .withColumn(d8, F.col(d6) & text.rlike(DIGIT_CLASSES["#8"]))
        .withColumns({
            d13: F.col(d8) & text.rlike(DIGIT_CLASSES["#13"]),
            _RUNS: F.when(F.col(d1), F.concat(F.lit("|"), F.array_join(lengths, "|"), F.lit("|"))).otherwise(""),
        })
        .withColumn(_MATCHES, F.expr(f"array({matches})"))
        .withColumn(_HITS, F.expr(_hits_sql([o for o, _ in shapes], [s for _, s in shapes])))
    )


def positions(hit: Column, text: Column | None = None) -> Column:
    """Where the matches of one hit start: by their one place in ``text``, or from the lengths of all gaps
    and matches before them."""
    counted = _counted(hit)
    if text is None:
        return counted
    return F.when(hit["g"].isNull(), F.transform(hit["m"], lambda v: F.struct(
        (F.instr(text, v) - 1).alias("start"), v.alias("value")))).otherwise(counted)


def _counted(hit: Column) -> Column:
    steps = F.transform(hit["m"], lambda v, i: F.length(F.get(hit["g"], i)) + F.length(v))
    return let(running_sums(steps), lambda ends: F.transform(hit["m"], lambda v, i: F.struct(
        (F.get(ends, i) - F.length(v)).cast("int").alias("start"), v.alias("value"))))


def _without_title(found: Column) -> Column:
    """A person finding is the name; the title that announced it is left in the text."""
    lead = F.regexp_extract(found["value"], TITLE_LEAD, 0)
    return F.struct(
        (found["start"] + F.length(lead)).alias("start"),
        F.substring(found["value"], F.length(lead) + 1, F.length(found["value"])).alias("value"),
    )


_UNEVEN = ("  ", "\n", "\t", "\r")


def is_even(text: Column) -> Column:
    """Whether single blanks are the only gaps between the tokens."""
    return reduce(and_, (~F.contains(text, F.lit(gap)) for gap in _UNEVEN))


def has_context(points: Column, start: Column, value: Column, words: Column, even: Column | None = None) -> Column:
    """Whether one of the last five tokens before the match, or the token it starts in, holds one of
    the lower-case ``words`` (single tokens).  ``even`` is what ``is_even`` says of the whole text, where it is known."""

    def tokens(text: Column) -> Column:
        return F.filter(F.split(F.translate(text, "\t\r\n", "   "), " ", -1), lambda t: t != "")

    def last(parts: Column, text: Column) -> Column:
        # a piece directly attached to the match counts besides the five
        keep = F.lit(CONTEXT_TOKENS) + (~F.right(text, F.lit(1)).isin(" ", "\t", "\r", "\n", "")).cast("int")
        return F.array_join(F.slice(parts, F.greatest(F.size(parts) - keep + 1, F.lit(1)), keep), " ")

    def split_up(window: Column) -> Column:
        # the first token of the window may be torn, so one more than needed must be there
        return let(tokens(window), lambda t: F.when(
            (F.size(t) > CONTEXT_TOKENS + 1) | (start <= _WINDOW), last(t, window),
        ).otherwise(last(tokens(piece(points, F.lit(0), start)), window)))

    def before(window: Column) -> Column:
        # with single blanks between the tokens the last six pieces are what is looked for, unless the
        # first of them may be torn
        pieces = F.substring_index(window, " ", -(CONTEXT_TOKENS + 1))
        whole = (start <= _WINDOW) | (F.length(pieces) < F.length(window))
        single = is_even(window) if even is None else even | is_even(window)
        return F.when(single & whole, pieces).otherwise(split_up(window))

    own = value
    for gap in (" ", "\n", "\t", "\r"):
        own = F.substring_index(own, gap, 1)
    left = F.greatest(start - _WINDOW, F.lit(0))
    near = F.lower(F.concat(let(piece(points, left, start - left), before), F.lit(" "), own))
    return let(near, lambda s: F.exists(words, lambda w: F.contains(s, w)))


def boosted(score: float) -> float:
    return round(min(max(score + CONTEXT_BOOST, CONTEXT_FLOOR), 1.0), 2)


def _certainty(pii_type: Column, value: Column, entities: tuple[Entity, ...]) -> Column:
    """True/false from the entity's check digits, null where it has none."""
    out = None
    for e in entities:
        if e.check:
            verdict = (e.check if callable(e.check) else checksums.CHECKS[e.check])(value)
            out = F.when(pii_type == e.pii_type, verdict) if out is None else out.when(pii_type == e.pii_type, verdict)
    return F.lit(None).cast("boolean") if out is None else out


def _cards(raw: Column, points: Column) -> Column:
    """Cards among the groups of a run of digits that is none as a whole: every stretch of whole groups that starts in
    the match and whose check digit is right.  Numbers joined by hyphens are cut only where a card's usual grouping
    (four digits first, or one group) begins, so that the inside of another kind of number is none.  Separators are one
    character each; 19 digits that start among the first 19 end within 80 characters."""
    def among(run: Column, groups: Column) -> Column:
        def joined(first: Column, n: Column) -> Column:
            return F.length(F.array_join(F.slice(groups, first, n), " "))

        def stretches(i: Column) -> Column:
            at = F.when(i > 1, joined(F.lit(1), i - 1) + 1).otherwise(0)
            return F.when(at < F.length(raw["value"]), F.transform(
                F.sequence(i, F.least(F.size(groups), i + 18)),
                lambda j: let(joined(i, j - i + 1), lambda n: F.when(
                    F.length(F.get(groups, i - 1)).isin(4, *range(13, 20))
                    | (((i == 1) | (F.substring(run, at, 1) == " ")) & (F.substring(run, at + n + 1, 1) != "-")),
                    F.struct((raw["start"] + at).alias("start"), F.substring(run, at + 1, n).alias("value"))))))

        parts = F.flatten(F.filter(
            F.transform(F.sequence(F.lit(1), F.size(groups)), stretches), lambda x: x.isNotNull()))
        return F.filter(parts, lambda f: f.isNotNull() & f["value"].rlike("^[1-6]") & checksums.card(f["value"]))

    run = F.regexp_extract(piece(points, raw["start"], F.lit(80)), r"^\d(?:[- ]?\d)*", 0)
    return let(run, lambda r: let(F.regexp_extract_all(r, F.lit(r"\d+"), F.lit(0)), lambda g: among(r, g)))


def _with_cards(found: Column, points: Column) -> Column:
    cards = F.array_sort(F.flatten(F.transform(
        found, lambda raw: F.when(checksums.card(raw["value"]), F.array(raw)).otherwise(_cards(raw, points)))))
    return let(cards, lambda c: first_of_runs(c, lambda a, b: (a["start"] == b["start"]) & (a["value"] == b["value"])))


def _scored(hit: Column, fact: Column, points: Column, n_chars: Column, even: Column, entities, with_context: bool,
            short_context: bool) -> Column:
    def finish(found: Column, certain: Column) -> Column:
        # nothing to look for, or nothing to gain
        looked_up = (F.size(fact["context"]) > 0) & ~F.coalesce(certain, F.lit(False)) & (fact["score"] < 1)
        near = F.when(looked_up, has_context(points, found["start"], found["value"], fact["context"], even)).otherwise(False)
        confidence = F.when(certain, F.lit(1.0)).when(near, fact["boosted"]).otherwise(fact["score"])
        end = found["start"] + F.length(found["value"])
        fields = [
            hit["ord"].alias("ord"), fact["pii_type"].alias("pii_type"), found["value"].alias("value"),
            found["start"].alias("start"), end.alias("end"), confidence.alias("confidence"),
            F.lit(DETECTOR).alias("detector"), fact["shape"].alias("shape"),
        ]
        if with_context:
            around = snippet(points, n_chars, found["start"], end)
            fields.append((around if short_context else F.when(n_chars > SHORT, around)).alias("context"))
        return F.struct(*fields)

    def one(raw: Column) -> Column:
        found = F.when(fact["pii_type"] == "PERSON", _without_title(raw)).otherwise(raw)
        return let(found, lambda f: let(
            _certainty(fact["pii_type"], f["value"], entities),
            lambda certain: F.when(F.coalesce(certain, F.lit(True)), finish(f, certain))))

    found = positions(hit, points["text"])
    if any(e.check == "card" for e in entities):
        card_types = [e.pii_type for e in entities if e.check == "card"]
        found = F.when(fact["pii_type"].isin(card_types), _with_cards(found, points)).otherwise(found)
    return F.filter(F.transform(found, one), lambda f: f.isNotNull())


def raw_findings(policy: Policy, with_context: bool = False, short_context: bool = True) -> Column:
    """Every checked and scored match, from the columns of ``with_hits``, before any resolution."""
    entities = policy.selected()

    def located(hits: Column) -> Column:
        points_and_facts = F.struct(
            code_points(F.col(_TEXT)).alias("points"), F.length(F.col(_TEXT)).alias("n"), is_even(F.col(_TEXT)).alias("even"),
            _facts().alias("facts"))
        return let(
            points_and_facts,
            lambda t: F.flatten(F.transform(hits, lambda h: let(
                F.get(t["facts"], h["ord"]),
                lambda fact: _scored(h, fact, t["points"], t["n"], t["even"], entities, with_context, short_context)))),
        )

    none = F.array().cast(findings_type(with_context))
    return let(F.col(_HITS), lambda h: F.when(F.size(h) > 0, located(h)).otherwise(none))


def findings_type(with_context: bool) -> str:
    tail = ",context:string" if with_context else ""
    return ("array<struct<ord:int,pii_type:string,value:string,start:int,end:int,confidence:double,"
            f"detector:string,shape:string{tail}>>")


# ---- what the analysis step keeps ------------------------------------------------------------

def before(a: Column, b: Column) -> Column:
    """Strict order of the analysis: surest first, then leftmost, then longest, then table order."""
    la, lb = a["end"] - a["start"], b["end"] - b["start"]
    return (a["confidence"] > b["confidence"]) | ((a["confidence"] == b["confidence"]) & (
        (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (
            (la > lb) | ((la == lb) & (a["ord"] < b["ord"]))))))


def drop_contained(cluster: Column) -> Column:
    """Removes a span that lies inside an earlier (``before``) span of the same type."""
    few = F.filter(
        cluster,
        lambda f: ~F.exists(cluster, lambda g: (g["pii_type"] == f["pii_type"]) & (g["start"] <= f["start"])
                            & (g["end"] >= f["end"]) & before(g, f)),
    )

    def sorted_of(kind: Column) -> Column:
        # whatever contains a span stands before it here, and of equal spans the one that stays
        return F.transform(F.array_sort(F.transform(F.filter(cluster, lambda f: f["pii_type"] == kind), lambda f: F.struct(
            f["start"].alias("start"), (-f["end"]).alias("end"), (-f["confidence"]).alias("sure"), f["ord"].alias("ord"),
            f.alias("f")))), lambda x: x["f"])

    def free(of_kind: Column, levels: Column) -> Column:
        # for each level of confidence, how far the spans that are at least so sure reach
        reach = F.transform(levels, lambda c: running_max(F.transform(of_kind, lambda f: F.when(
            f["confidence"] >= c, f["end"]).otherwise(-1))))
        return let(reach, lambda r: F.filter(of_kind, lambda f, i: (i == 0) | (
            F.get(F.get(r, F.array_position(levels, f["confidence"]).cast("int") - 1), i - 1) < f["end"])))

    kinds = F.array_distinct(F.transform(cluster, lambda f: f["pii_type"]))
    many = in_merge_order(F.flatten(F.transform(kinds, lambda k: let(sorted_of(k), lambda o: let(
        F.array_distinct(F.transform(o, lambda f: f["confidence"])), lambda levels: free(o, levels))))))
    return F.when(F.size(cluster) < 2, cluster).when(F.size(cluster) <= FEW, few).otherwise(many)


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def is_false_positive(pii_type: Column, value: Column, words: tuple[str, ...]) -> Column:
    """A person whose first word is listed; an organisation, place or group with any listed word."""
    if not words:
        return F.lit(False)
    tokens = F.split(F.lower(stripped(value)), r"\s+", -1)
    listed = F.expr("array(" + ", ".join(_quoted(w.lower()) for w in words) + ")")
    # the first word for a person, every word for the others
    judged = F.when(pii_type == "PERSON", F.slice(tokens, 1, 1)).otherwise(tokens)
    return pii_type.isin("PERSON", "ORGANIZATION", "LOCATION", "NRP") & F.arrays_overlap(listed, judged)


def person_type(pii_type: Column, value: Column, preceding: Column) -> Column:
    """An organisation or place is a person after a title, or when it is one capitalised word that is
    not an acronym.  ``preceding`` is the (up to) ten characters before the finding."""
    last = F.element_at(F.split(F.lower(stripped(preceding)), r"\s+", -1), -1)
    titled = F.regexp_replace(last, r"\.+$", "").isin(*TITLES)
    first = F.substring(value, 1, 1)
    single = (
        ~stripped(value).rlike(r"\s") & (F.upper(first) == first) & (F.lower(first) != first)
        & (F.upper(value) != value) & (F.length(value) > 2)
    )
    return F.when(pii_type.isin("ORGANIZATION", "LOCATION") & (titled | single), F.lit("PERSON")).otherwise(pii_type)


def passes(f: Column, policy: Policy) -> Column:
    """The threshold, the never-reported types and the false-positive words."""
    ok = f["confidence"] >= policy.threshold
    if policy.skipped_types:
        ok = ok & ~f["pii_type"].isin(*policy.skipped_types)
    return ok & ~is_false_positive(f["pii_type"], f["value"], policy.false_positive_words)


def with_groups(df: DataFrame, text_col: str, policy: Policy, with_context: bool = False,
                short_context: bool = True) -> DataFrame:
    """``with_hits`` and the column ``GROUPS``: groups of overlapping findings, left to right, after the analysis step.
    No span of one group touches a span of another, so everything that compares spans can stay inside a group.
    Without ``short_context`` only findings of texts of more than ``SHORT`` characters get their snippet here.

    Each step is a column of its own: the analyzer resolves nested lambdas a level a round, and its rounds are limited.
    """
    df = with_hits(df, text_col, policy).withColumn(_RAW, raw_findings(policy, with_context, short_context))
    df = df.withColumn(_SORTED, clusters(F.col(_RAW))).withColumn(_SORTED, F.transform(_SORTED, drop_contained))
    return df.withColumn(GROUPS, F.transform(_SORTED, lambda c: F.filter(c, lambda f: passes(f, policy))))


def with_findings(df: DataFrame, text_col: str, policy: Policy | None = None, name: str = "findings",
                  with_context: bool = True) -> DataFrame:
    """``df`` with one more column: the array of the row's findings; for places and types, leave out the snippets."""
    groups = with_groups(df, text_col, policy or Policy(), with_context)
    return with_computed(groups, name, F.flatten(GROUPS)).select(*df.columns, name)


def detect(df: DataFrame, text_col: str, ids: list[str], policy: Policy | None = None,
           with_context: bool = True) -> DataFrame:
    """One row per finding: ``ids`` and the findings schema; for counts and values, leave out the snippets."""
    policy = policy or Policy()
    needed = df.select(*dict.fromkeys([*ids, text_col]))
    groups = with_groups(needed, text_col, policy, with_context, short_context=False)
    # a short text goes along with its findings: their snippets are then plain columns, and nobody makes those that are
    # not asked for
    short = [F.when(F.length(_TEXT) <= SHORT, F.col(_TEXT)).alias("_cf_short")] * with_context
    # explode_outer plus a test on its result: a plain explode would add size(...) > 0 below itself and
    # the optimizer would evaluate all regexes once more for it
    found = groups.select(*ids, *short, F.explode_outer(F.flatten(GROUPS)).alias("_f")).where(F.col("_f").isNotNull())
    context = [F.coalesce("_f.context", short_snippet(F.col("_cf_short"), F.col("_f.start"), F.col("_f.end"))).alias(
        "context")] if with_context else []
    return found.select(
        *ids, "_f.pii_type", "_f.value", "_f.start", "_f.end", "_f.confidence",
        *context, "_f.detector", "_f.shape", "_f.ord")
