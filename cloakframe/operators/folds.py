"""Folds along the sorted findings of a text, in bounded memory.

Findings are dealt by text and stripe (a fixed number of characters), sorted, and streamed: a task keeps the current
span and what starts at one place, never a list of a text's findings.  A span that reaches beyond its stripe sends a
marker to the stripes it reaches, so each stripe knows how far the ones before it reach.  Up to the first place that
nothing before it reaches, the spans of a stripe are *open*: their winner may depend on the stripe before.  They, and
the last winner of a stripe that reaches out of it, are the carry; a second fold, by text, goes along the carry only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloakframe.sources.staging import staged

STRIPE = 1 << 16

#: (start, end, confidence) of the next span and of the current one -> whether the next one wins where they overlap.
Better = Callable[[tuple[int, int, float], tuple[int, int, float]], bool]


def surer(n: tuple[int, int, float], cur: tuple[int, int, float]) -> bool:
    """The surer one, at equal confidence the longer one, else the current one stays."""
    return n[2] > cur[2] or (n[2] == cur[2] and n[1] - n[0] > cur[1] - cur[0])


def first(n: tuple[int, int, float], cur: tuple[int, int, float]) -> bool:
    """The current one: in the order of starts, the longest first, that is leftmost-longest."""
    return False


class _Fold:
    """State of one task: the current span and what starts at one place, as [row, start, end, ord, confidence]."""

    def __init__(self, better: Better, stripe: int | None) -> None:
        self.better, self.stripe = better, stripe
        self.key: tuple | None = None
        self.reach, self.open = -1, False
        self.cur: list | None = None
        self.place: int | None = None
        self.waiting: dict[tuple, list] = {}
        self.out: list[tuple[int, int, bool]] = []

    def begin(self, key: tuple) -> None:
        self.finish()
        self.key, self.reach, self.open, self.cur, self.place = key, -1, True, None, None

    def marker(self, end: int) -> None:
        self.reach = max(self.reach, end)

    def add(self, row: int, start: int, end: int, ord_: int, confidence: float, kind: str | None) -> None:
        if start != self.place:
            self.settle()
            self.place = start
        same = self.waiting.get((end, kind))
        if same is None:
            self.waiting[end, kind] = [row, start, end, ord_, confidence]
        elif confidence > same[4]:
            # the attributes of the surest, at the first-seen position
            same[0], same[4] = row, confidence

    def settle(self) -> None:
        """Folds what starts at one place."""
        for e in self.waiting.values():
            if e[1] >= self.reach:
                self.open = False
            if self.open and self.stripe is not None:
                self.out.append((e[0], e[3], True))
            elif self.cur is None:
                self.cur = e
            elif e[1] < self.cur[2]:
                if self.better((e[1], e[2], e[4]), (self.cur[1], self.cur[2], self.cur[4])):
                    self.cur = e
            else:
                self.out.append((self.cur[0], self.cur[3], False))
                self.cur = e
            self.reach = max(self.reach, e[2])
        self.waiting = {}

    def finish(self) -> None:
        self.settle()
        if self.cur is not None:
            edge = None if self.stripe is None or self.key is None else (self.key[-1] + 1) * self.stripe
            self.out.append((self.cur[0], self.cur[3], edge is not None and self.cur[2] > edge))
            self.cur = None

    def held(self) -> list[list]:
        """What later rows may still change."""
        return ([self.cur] if self.cur is not None else []) + list(self.waiting.values())


def _streamed(n_keys: int, schema: pa.Schema, better: Better,
              stripe: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns in: keys (the last one the stripe, where there are stripes), own, then those of ``schema``."""

    def taken(work: pa.Table, out: list[tuple[int, int, bool]]) -> pa.RecordBatch:
        rows = work.take(pa.array([o[0] for o in out], pa.int64()))
        at = schema.get_field_index("ord")
        columns = [pa.array([o[1] for o in out], schema.field(at).type) if i == at else
                   rows.column(n_keys + 1 + i).combine_chunks() for i in range(len(schema))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([o[2] for o in out], pa.bool_())],
                                          names=[*schema.names, "_open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(better, stripe)
        kept: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            work = pa.concat_tables([kept, new]) if kept is not None else new
            skip = work.num_rows - new.num_rows
            keys = list(zip(*(new.column(i).to_pylist() for i in range(n_keys))))
            own = new.column(n_keys).to_pylist()
            of = {c: new.column(n_keys + 1 + schema.get_field_index(c)).to_pylist()
                  for c in ("start", "end", "ord", "confidence", "pii_type")}
            for i, (key, mine, start, end, ord_, sure, kind) in enumerate(zip(
                    keys, own, of["start"], of["end"], of["ord"], of["confidence"], of["pii_type"]), skip):
                if key != fold.key:
                    fold.begin(key)
                if mine:
                    fold.add(i, start, end, ord_, sure, kind)
                else:
                    fold.marker(end)
            if fold.out:
                yield taken(work, fold.out)
                fold.out = []
            held = fold.held()
            kept = work.take(pa.array([e[0] for e in held], pa.int64())).combine_chunks() if held else None
            for i, e in enumerate(held):
                e[0] = i
        fold.finish()
        if fold.out:
            yield taken(kept, fold.out)

    return run


def folded(findings: DataFrame, ids: list[str], better: Better = surer, order: tuple[str, ...] = ("start", "ord"),
           stripe: int = STRIPE) -> DataFrame:
    """One finding per (ids, start, end, type), the surest at the first-seen ``ord``, and of those that overlap the
    winner of a fold from left to right with one current span.  Rows come from any detectors; columns stay."""
    names = findings.columns
    schema = _arrow(findings)
    out_type = StructType([*findings.schema.fields]).add("_open", "boolean")

    def sort(prefix: list[str]) -> list[Column]:
        return [*(F.col(c) for c in prefix), *(F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order)]

    at = F.floor(F.col("start") / stripe).cast("long")
    last = F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / stripe).cast("long")
    dealt = findings.select("*", F.explode(F.sequence(at, last)).alias("_stripe")).withColumn("_own", F.col("_stripe") == at)
    rows = dealt.repartition(*ids, "_stripe").sortWithinPartitions(*sort([*ids, "_stripe", "_own"])).select(
        *[F.col(c).alias(f"_key_{c}") for c in ids], "_stripe", "_own", *names)
    done = staged(rows.mapInArrow(_streamed(len(ids) + 1, schema, better, stripe), out_type), "folded")
    carry = done.where("_open").drop("_open").repartition(*ids).sortWithinPartitions(*sort(list(ids))).select(
        *[F.col(c).alias(f"_key_{c}") for c in ids], F.lit(True).alias("_own"), *names)
    rest = carry.mapInArrow(_streamed(len(ids), schema, better, None), out_type)
    return done.where("not _open").unionByName(rest).drop("_open")


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
