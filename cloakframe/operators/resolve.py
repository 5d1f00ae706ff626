"""Findings -> the disjoint spans that are rewritten.

Two forms with one rule.  ``kept_spans`` works on the findings of a row and needs no shuffle.
``resolve_table`` works on a findings table that comes from several detectors; it streams the sorted findings of
every stripe of a text, so no task holds more than a current span, however many findings one text (or one hot id) has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrays import first_of_runs, folded, running_max
from cloakframe.functions.text import let
from cloakframe.operators import folds
from cloakframe.policy import Policy


def overlaps(a: Column, b: Column) -> Column:
    """Half open: touching spans do not overlap."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


# ---- allow and deny lists --------------------------------------------------------------------

def is_allowed(value: Column, policy: Policy) -> Column:
    allowed = F.lit(False)
    if policy.allow_values:
        allowed = allowed | value.isin(*policy.allow_values)
    if policy.allow_domains:
        # the part between the first and the next @
        domain = F.get(F.split(value, "@", -1), F.lit(1))
        allowed = allowed | F.coalesce(domain.isin(*policy.allow_domains), F.lit(False))
    for pattern in policy.allow_patterns:
        allowed = allowed | value.rlike(pattern)
    return allowed


def is_denied(value: Column, policy: Policy) -> Column:
    return value.isin(*policy.deny_values) if policy.deny_values else F.lit(False)


def survives_lists(value: Column, policy: Policy) -> Column:
    """A denied value is always rewritten; otherwise an allowed value is left alone."""
    if not policy.apply_lists:
        return F.lit(True)
    return is_denied(value, policy) | ~is_allowed(value, policy)


# ---- spans of one row ------------------------------------------------------------------------

def _leftmost_first(a: Column, b: Column) -> Column:
    """Order of the merge: by start, and among equal starts the order of the analysis."""
    la, lb = a["end"] - a["start"], b["end"] - b["start"]

    def cmp(x: Column, y: Column, otherwise: Column) -> Column:
        return F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(otherwise)

    return cmp(a["start"], b["start"],
               cmp(b["confidence"], a["confidence"], cmp(lb, la, cmp(a["ord"], b["ord"], F.lit(0)))))


def in_merge_order(spans: Column) -> Column:
    return F.when(F.size(spans) < 2, spans).otherwise(F.array_sort(spans, _leftmost_first))


def clusters(spans: Column) -> Column:
    """Sorts the spans and cuts them where a span starts at or after the end of all before it."""

    def cut(o: Column, is_head: Callable[[Column], Column]) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | is_head(i))
        return let(heads, lambda h: F.when(F.size(h) == 1, F.array(o)).otherwise(F.transform(h, lambda i, k: F.slice(
            o, i + 1, F.coalesce(F.get(h, k + 1), F.size(o)) - i))))

    def cut_few(o: Column) -> Column:
        return cut(o, lambda i: ~F.exists(F.slice(o, F.lit(1), i), lambda s: s["end"] > F.get(o, i)["start"]))

    def cut_at_reach(o: Column) -> Column:
        return let(running_max(F.transform(o, lambda s: s["end"])), lambda reach: cut(
            o, lambda i: F.get(o, i)["start"] >= F.get(reach, i - 1)))

    return let(let(spans, in_merge_order), lambda o: F.when(F.size(o) == 0, F.slice(F.array(o), 1, 0)).when(
        F.size(o) == 1, F.array(o)).when(F.size(o) <= FEW, cut_few(o)).otherwise(cut_at_reach(o)))


# Up to so many spans in a cluster are compared each with each; beyond, they are sorted and compared with neighbours.
FEW = 24


def dedup(cluster: Column) -> Column:
    """One finding per (start, end, type); in merge order the first is the surest."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["pii_type"] == b["pii_type"])

    def first_of(f: Column, i: Column) -> Column:
        earlier = F.slice(cluster, F.lit(1), i)
        return F.when(~F.exists(earlier, lambda g: same(g, f)), f)

    few = F.filter(F.transform(cluster, first_of), lambda f: f.isNotNull())
    placed = F.array_sort(F.transform(cluster, lambda f, i: F.struct(
        f["start"].alias("start"), f["end"].alias("end"), f["pii_type"].alias("pii_type"), i.alias("i"))))
    many = F.transform(F.array_sort(F.transform(let(placed, lambda p: first_of_runs(p, same)), lambda p: p["i"])),
                       lambda i: F.get(cluster, i))
    return F.when(F.size(cluster) < 2, cluster).when(F.size(cluster) <= FEW, few).otherwise(many)


def merge(cluster: Column) -> Column:
    """Left to right with one current span: on overlap the surer one wins, at equal confidence the
    longer one, else the current one stays; without overlap the current one is final."""

    def better(n: Column, cur: Column) -> Column:
        return (n["confidence"] > cur["confidence"]) | (
            (n["confidence"] == cur["confidence"]) & ((n["end"] - n["start"]) > (cur["end"] - cur["start"])))

    def step(cur: Column, n: Column) -> Column:
        hit = overlaps(cur, n)
        return F.struct(
            F.when(hit & ~better(n, cur), cur).otherwise(n).alias("cur"),
            F.when(hit, F.slice(cluster, 1, 0)).otherwise(F.array(cur)).alias("done"))

    return F.when(F.size(cluster) < 2, cluster).otherwise(
        folded(F.slice(cluster, F.lit(2), F.size(cluster)), F.get(cluster, F.lit(0)), F.slice(cluster, 1, 0), step))


def kept_spans(found: Column, policy: Policy) -> Column:
    """``found`` as from ``detect.with_groups``: allow and deny lists, then dedupe, then merge."""
    return F.flatten(F.transform(
        found,
        lambda c: let(let(F.filter(c, lambda f: survives_lists(f["value"], policy)), dedup), merge),
    ))


# ---- spans of a findings table ---------------------------------------------------------------

def dedup_table(findings: DataFrame, ids: list[str]) -> DataFrame:
    """One row per (ids, start, end, type): the attributes of the surest finding (the first of equals)
    at the first-seen position ``ord``."""
    rest = [c for c in findings.columns if c not in (*ids, "start", "end", "pii_type", "ord", "confidence")]
    best = F.max_by(F.struct("confidence", *rest), F.struct(F.col("confidence"), -F.col("ord"))).alias("_best")
    return (
        findings.groupBy(*ids, "start", "end", "pii_type")
        .agg(F.min("ord").alias("ord"), best)
        .select(*ids, "pii_type", "start", "end", "ord", "_best.*")
    )


def merge_table(findings: DataFrame, ids: list[str]) -> DataFrame:
    """Dedupe and merge over a findings table, in one sort: equal starts keep the order of ``ord``."""
    return folds.folded(findings, ids)


def resolve_table(findings: DataFrame, ids: list[str], policy: Policy) -> DataFrame:
    listed = findings.where(survives_lists(F.col("value"), policy))
    return merge_table(listed, ids)
