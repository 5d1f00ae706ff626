"""Array expressions whose cost stays near linear in the length of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.text import let

BLOCK = 128


def _blocks(values: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(values, i, BLOCK))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """[v0, join(v0, v1), ...] of an integer array as bigint, for an associative ``join``; null stays null.

    Spark has no scan over an array, and a fold that appends copies what it has so far.  So blocks are folded on
    their own, and each is joined with what came before it: a block's length times n instead of n squared.
    """
    none = F.array().cast("array<bigint>")

    def onto(before: Column, v: Column) -> Column:
        return F.when(before.isNull(), v).otherwise(join(before, v))

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda out, v: F.concat(out, F.array(onto(F.get(out, F.size(out) - 1), v))))

    def total(b: Column) -> Column:
        return F.aggregate(b, F.lit(None).cast("bigint"), onto)

    def in_blocks(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("bigint")), scan(F.transform(blocks, total)))
        lifted = F.zip_with(F.transform(blocks, scan), before, lambda b, c: F.transform(b, lambda v: onto(c, v)))
        return F.flatten(F.filter(lifted, lambda b: b.isNotNull()))

    def either(v: Column) -> Column:
        return F.when(F.size(v) <= BLOCK, scan(v)).otherwise(in_blocks(_blocks(v)))

    longs = F.transform(values, lambda v: v.cast("bigint"))
    return let(longs, lambda v: F.when(v.isNotNull(), either(v)))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b))


def folded(values: Column, first: Column, none: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A fold that gives away values as it goes: ``step`` makes struct(cur, done) of the current state and a value,
    where ``done`` is an array of what is final; the result is all of that and the last state.  ``none`` is an empty
    array of that type.  What is final is gathered by block, so a long array is not copied at every step."""

    def block(cur: Column, xs: Column) -> Column:
        start = F.struct(cur.alias("cur"), none.alias("done"))

        def onto(acc: Column, v: Column) -> Column:
            made = step(acc["cur"], v)
            return F.struct(made["cur"].alias("cur"), F.concat(acc["done"], made["done"]).alias("done"))

        return F.aggregate(xs, start, onto)

    def outer(acc: Column, xs: Column) -> Column:
        return let(block(acc["cur"], xs), lambda b: F.struct(
            b["cur"].alias("cur"), F.concat(acc["done"], F.array(b["done"])).alias("done")))

    start = F.struct(first.alias("cur"), F.slice(F.array(none), 1, 0).alias("done"))
    return F.aggregate(F.when(F.size(values) > 0, _blocks(values)).otherwise(F.slice(F.array(values), 1, 0)), start, outer,
                       lambda acc: F.concat(F.flatten(acc["done"]), F.array(acc["cur"])))


def first_of_runs(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Of each run of neighbours that are the same, the first."""
    return F.filter(ordered, lambda v, i: (i == 0) | ~F.coalesce(same(F.get(ordered, i - 1), v), F.lit(False)))
