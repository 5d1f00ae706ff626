"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: which sets of three-character strings a
text must hold for the rule to match.  The index lists, for each trigram that some query names, the texts that hold
it (lower-cased); postings are intersected per clause, and only the candidates are searched with the regex.  Rules
without a mandatory trigram (runs of hex digits) are searched in every text.

Places are code points.  They come from the lengths of the matches and of the pieces between them, so a text with
many matches costs about as much as one with few.

Defined cases: a null text is empty and has no findings; rows that repeat an id share their postings, and each is
verified on its own text; a null id is indexed like any other; the caller's columns travel in one struct ``row``,
whatever their names are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import running_max, running_sums
from cloakframe.functions.text import let, splice, with_computed
from cloakframe.sources.staging import staged


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Matches whose group ``group`` is shorter than this are dropped.
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("login_url", r"[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@]+@"),
)

#: Strings that one stretch of a pattern may stand for before it is given up as open.
_MOST = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of lower-case trigrams: a text that matches holds all trigrams of some clause.  A clause without
    trigrams means that the pattern asks for none."""
    return _clauses(list(sre_parser.parse(pattern)))


def _exact(node) -> list[str] | None:
    """All strings a node can stand for, lower-cased, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None
        return sorted(out)
    if op is sre.SUBPATTERN:
        return _all_exact(arg[3])
    if op is sre.BRANCH:
        parts = [_all_exact(b) for b in arg[1]]
        return None if None in parts else sorted({x for p in parts for x in p})
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        some = _all_exact(arg[2])
        return None if some is None else sorted({"".join(t) for n in range(arg[0], arg[1] + 1)
                                                 for t in product(some, repeat=n)})
    return None


def _all_exact(nodes) -> list[str] | None:
    parts = [_exact(n) for n in nodes]
    if None in parts or reduce(lambda a, p: a * len(p), parts, 1) > _MOST:
        return None
    return sorted({"".join(t) for t in product(*parts)})


def _clauses(nodes: list) -> list[frozenset[str]]:
    every: list[list[frozenset[str]]] = []
    stretch: list[str] = [""]

    def close() -> None:
        every.append([frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in stretch])
        stretch[:] = [""]

    for node in nodes:
        exact = _exact(node)
        if exact is not None and len(stretch) * len(exact) <= _MOST:
            stretch[:] = [a + b for a in stretch for b in exact]
            continue
        close()
        op, arg = node
        if op is sre.SUBPATTERN:
            every.append(_clauses(list(arg[3])))
        elif op is sre.BRANCH:
            every.append([c for b in arg[1] for c in _clauses(list(b))])
        elif op is sre.MAX_REPEAT and arg[0] > 0:
            every.append(_clauses(list(arg[2])))
        elif exact is not None:
            stretch[:] = exact
    close()
    # the stretch that asks for most decides; conjunctions of several would only multiply clauses
    return max(every, key=lambda e: min(map(len, e)))


def _any_of(trigrams: list[str]) -> str:
    """A pattern that captures, without moving on, the trigram that begins at a place, if it is one of these: the three
    sets of characters are looked at first, then the trigrams by their first character."""
    sets = "".join(f"[{''.join(re.escape(c) for c in sorted(set(column)))}]" for column in zip(*trigrams))
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(re.escape(t[1:]))
    return f"(?={sets})(?=({'|'.join(f'{re.escape(a)}(?:{"|".join(b)})' for a, b in by_first.items())}))"


def postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, id) of every text for the trigrams asked for, from one pass over a text."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = F.array_distinct(F.regexp_extract_all(low, F.lit(_any_of(trigrams)), F.lit(1)))
    return docs.select(F.col(id_col).alias("id"), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, kinds): the rules whose trigram query each text satisfies; the index is written first."""
    clauses = [(r.kind, f"{r.kind}{i}", c) for r in rules for i, c in enumerate(trigram_query(r.pattern)) if c]
    index = staged(postings(docs, id_col, text_col, sorted({t for *_, c in clauses for t in c})), "postings")
    asked = docs.sparkSession.createDataFrame(
        [(t, kind, name, len(c)) for kind, name, c in clauses for t in c],
        "trigram string, kind string, clause string, need int")
    met = index.join(F.broadcast(asked), "trigram").groupBy("id", "kind", "clause").agg(
        F.count_distinct("trigram").alias("n"), F.first("need").alias("need"))
    return met.where("n = need").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """All spans of a rule in a text: array of (start, order, end, kind)."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    lengths = F.transform(found, F.length)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    ends = running_sums(F.zip_with(between, lengths, lambda gap, n: gap + F.coalesce(n, F.lit(0))))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    all_ = F.transform(F.arrays_zip(lengths.alias("n"), F.slice(ends, 1, F.size(found)).alias("end"),
                                    F.transform(checked, F.length).alias("size")), lambda x: x)
    return F.transform(F.filter(all_, lambda x: x["size"] >= rule.least), lambda x: F.struct(
        (x["end"] - x["n"]).alias("start"), F.lit(order).alias("order"), x["end"].alias("end"),
        F.lit(rule.kind).alias("kind")))


#: Runs that need not be looked for where no such stretch occurs: cheap to test, and implied by the rule.
_PRESENT = {"hex": "[0-9a-f]{16}"}


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, spans): the columns of ``docs`` in a struct, and an array of (start, order, end, kind), sorted."""
    found = candidates(docs, id_col, text_col, rules).select(F.col("id").alias("_id"), "kinds")
    df = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    df = df.join(found, F.col("_key").eqNullSafe(F.col("_id")), "left")
    text = F.coalesce(F.col("_text"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    parts = []
    for i, rule in enumerate(rules):
        if all(trigram_query(rule.pattern)):
            asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        else:
            asked = text.rlike(_PRESENT.get(rule.kind, rule.pattern))
        parts.append(F.when(asked, spans_of(text, rule, i)).otherwise(none))
    return with_computed(df, "spans", F.sort_array(F.concat(*parts))).select("row", "spans")


def disjoint(spans: Column) -> Column:
    """Sorted spans with overlapping ones joined."""
    def cut(reach: Column) -> Column:
        heads = F.filter(
            F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.get(reach, i - 1).alias("before"))),
            lambda s: s["before"].isNull() | (s["start"] >= s["before"]))
        return let(heads, lambda h: F.transform(h, lambda s, i: F.struct(
            s["start"].alias("start"),
            F.coalesce(F.get(h, i + 1)["before"], F.get(reach, F.size(reach) - 1)).alias("end"))))

    return let(running_max(F.transform(spans, lambda s: s["end"])), cut)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mark``; null where the text is null."""
    whole = F.transform(disjoint(spans), lambda s: F.struct(
        s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return F.when(F.size(spans) == 0, text).otherwise(let(whole, lambda w: splice(text, w, lambda _: F.lit(mark))))
