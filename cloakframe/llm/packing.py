"""Packing texts into training sequences of several permitted lengths, best fit first.

Lengths are packed, not texts: the histogram of piece lengths has no more entries than the longest sequence has
tokens, whatever the size of the corpus, so the packing of all pieces is planned at once on the driver.  From long
to short, pieces go to the open bins with the least room that still takes them; bins alike in size and content are
one *kind* with a count, so that equal pieces are placed together.  When nothing fits, the length whose cost for
each token it will hold is least is opened, given what is left to fill it with.  At the end each bin shrinks to the
shortest permitted length that holds its contents.

Then every piece gets its place by its rank among pieces of its length; ranks come from counts by length and salt
and a numbering inside each.  There are as many salts as the number of pieces asks for, so a length that most pieces
share is spread over many tasks, of about ``PER_TASK`` pieces each, at every size of the corpus.

Defined cases: a null or empty text has no tokens and gets one row without a bin; texts longer than the longest
sequence are cut into pieces of that length and a rest; rows with null or repeated ids are packed like others, and
``text_key`` tells the texts of one id apart; extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import words
from cloakframe.sources.staging import staged

LENGTHS = (512, 1024, 2048, 4096)
#: About so many pieces of one length are numbered by one task.
PER_TASK = 1 << 16


def cost(length: int) -> float:
    """Of one sequence: linear work, attention that grows with the square, and a fixed part."""
    return length * (1 + length / 16384) + 48


@dataclass
class Kind:
    """``count`` bins of one size with the same pieces: (length, how many), in the order they were placed."""

    size: int
    room: int
    pieces: tuple[tuple[int, int], ...]
    count: int


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS,
         price: Callable[[int], float] = cost) -> list[Kind]:
    """Kinds of bins that hold every piece of the histogram."""
    lengths = tuple(sorted(lengths))
    open_: dict[int, list[Kind]] = defaultdict(list)
    rooms: list[int] = []
    closed: list[Kind] = []
    left = sum(n * c for n, c in histogram.items())

    def put(kind: Kind) -> None:
        if not kind.count:
            return
        if not kind.room:
            closed.append(kind)
            return
        if not open_[kind.room]:
            bisect.insort(rooms, kind.room)
        open_[kind.room].append(kind)

    def filled(kind: Kind, n: int, each: int, count: int) -> None:
        """``count`` bins of the kind take ``each`` pieces of length n."""
        put(Kind(kind.size, kind.room - n * each, (*kind.pieces, (n, each)), count))
        kind.count -= count

    for n in sorted(histogram, reverse=True):
        todo = histogram[n]
        while todo:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                kind = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                size = min((s for s in lengths if s >= n),
                           key=lambda s: price(s) / min(s, max(n, min(left, s))))
                kind = Kind(size, size, (), -(-todo // (size // n)))
            each = kind.room // n
            full = min(kind.count, todo // each)
            todo -= full * each
            left -= full * each * n
            if full:
                filled(kind, n, each, full)
            if todo and kind.count:
                left -= todo * n
                filled(kind, n, todo, 1)
                todo = 0
            put(kind)
    closed += [k for kinds in open_.values() for k in kinds if k.pieces]
    for k in closed:
        held = k.size - k.room
        k.size = min(s for s in lengths if s >= held)
        k.room = k.size - held
    return closed


class Places:
    """For each length the bins its pieces go to, by rank."""

    def __init__(self, kinds: list[Kind]) -> None:
        runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        base = 0
        self.sizes: list[int] = []
        self.starts: list[int] = []
        for i, kind in enumerate(kinds):
            offset = 0
            for n, each in kind.pieces:
                runs[n].append((each * kind.count, each, i, offset))
                offset += n * each
            self.starts.append(base)
            self.sizes.append(kind.size)
            base += kind.count
        self.runs = {n: (np.cumsum([0] + [r[0] for r in rs]), np.array([r[1:] for r in rs])) for n, rs in runs.items()}

    def of(self, n: int, rank: int) -> tuple[int, int, int]:
        """(bin, size, offset) of the piece of length n with this rank, from 0."""
        ends, rows = self.runs[n]
        at = int(np.searchsorted(ends, rank, "right")) - 1
        each, kind, offset = map(int, rows[at])
        inside = rank - int(ends[at])
        return self.starts[kind] + inside // each, self.sizes[kind], offset + inside % each * n


def word_count(text: Column) -> Column:
    """The default measure: words, and one more for the end of the text."""
    n = F.size(words(text))
    return F.when(n > 0, n + 1).otherwise(0)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS,
           measure: Callable[[Column], Column] = word_count, price: Callable[[int], float] = cost) -> DataFrame:
    """(id, piece, first_token, n_tokens, text_key, bin, sequence_length, offset): one row for each piece of each text."""
    longest = max(lengths)
    texts = docs.select(F.col(id_col).alias("id"), measure(F.col(text_col)).cast("long").alias("tokens"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / longest) - 1, F.lit(0)))
    cut = staged(
        texts.select("id", "tokens", "text_key", F.explode(parts).alias("piece")).select(
            "id", "piece", (F.col("piece") * longest).alias("first_token"),
            F.least(F.col("tokens") - F.col("piece") * longest, F.lit(longest)).alias("n_tokens"), "text_key"), "pieces")
    salts = max(1, -(-cut.count() // PER_TASK))
    pieces = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "text_key"), F.lit(salts)))
    counts = pieces.where("n_tokens > 0").groupBy("n_tokens", "salt").agg(F.count("*").alias("n")).collect()
    histogram: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["n_tokens"], r["salt"])):
        before[r["n_tokens"], r["salt"]] = histogram[r["n_tokens"]]
        histogram[r["n_tokens"]] += r["n"]
    shared = docs.sparkSession.sparkContext.broadcast((before, Places(plan(histogram, lengths, price))))
    order = Window.partitionBy("n_tokens", "salt").orderBy("id", "piece", "text_key")
    ranked = pieces.where("n_tokens > 0").withColumn("rank", F.row_number().over(order) - 1)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier, places = shared.value
        for batch in batches:
            n, salt, rank = (batch.column(c).to_pylist() for c in (3, 5, 6))
            out = [places.of(a, earlier[a, s] + r) for a, s, r in zip(n, salt, rank)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *(pa.array([o[i] for o in out], pa.int64()) for i in range(3))],
                names=["id", "piece", "first_token", "n_tokens", "text_key", "bin", "sequence_length", "offset"])

    schema = (f"id {kind}, piece long, first_token long, n_tokens long, text_key long, bin long, sequence_length long, offset long")
    return ranked.select("id", F.col("piece").cast("long").alias("piece"), F.col("first_token").cast("long").alias(
        "first_token"), "n_tokens", "text_key", "salt", "rank").mapInArrow(run, schema).unionByName(
        pieces.where("n_tokens = 0").select(
            "id", F.col("piece").cast("long").alias("piece"), F.lit(0).cast("long").alias("first_token"), "n_tokens", "text_key",
            *(F.lit(None).cast("long").alias(c) for c in ("bin", "sequence_length", "offset"))))


def sequences(packing: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin, sequence_length, text): the words of each bin's pieces joined, pieces in order of their offsets.  A bin
    holds at most the longest sequence, so what meets in one row is bounded.  Measured in words, as by default."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"), words(text).alias("w")).dropDuplicates(["_id", "_key"])
    part = F.array_join(F.slice("w", (F.col("first_token") + 1).cast("int"), F.col("n_tokens").cast("int")), " ")
    return packing.where("bin is not null").join(
        texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select(
        "bin", "sequence_length", F.struct("offset", part.alias("text")).alias("p")).groupBy(
        "bin", "sequence_length").agg(F.sort_array(F.collect_list("p")).alias("p")).select(
        "bin", "sequence_length", F.array_join("p.text", "\n").alias("text"))
