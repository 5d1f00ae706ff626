"""Which filters remove what, in which order: an audit of five filters over all of their orders.

Every text is read by one table-driven byte transducer.  Its states are: outside a word, inside a word, and inside a
word with one to three bytes of a character still to come; each step looks up (state, byte) in one table for the next
state and in another for what the byte means (a word opens, a word closes, a code point, a capital, a symbol).  Texts
of a batch lie behind each other, each closed by 0xFF, a byte that UTF-8 never has, and are walked in many lanes at
once.  A lane starts in the state that the four bytes before it lead to: after four bytes of any kind the state no
longer depends on where one began (``_synchronised`` proves it for the table in use).

The word spans go into an open-addressing hash table, all words of a batch at once: a word claims an empty place or
meets its owner, whose text and bytes are compared in full; what differs goes on to its next place.  So words are
equal only where their bytes are.

What remains of a document is a mask of the filters it fails, its part, two labels and the digest of its text.  Copies
are found by digest on counts that are added up first, so a text that makes up a third of all rows costs no more than
a single one.  The 120 orders of the filters are worked out on counts by part and mask, 32 masks for each part.

Filters: A fewer than 100 words; B distinct words under 80 % of the words; C capitals A-Z over 10 % of the code
points; D one of ``#$%&*|``; E the text equals that of a smaller id.  Words are maximal runs without space and the
control characters from tab to carriage return, case-sensitive.

Defined cases: a null text is empty, a null part or language the empty string; an empty text has no words and fails A
only, or A and E; a document without id is smaller than none and larger than all with one, without labels; rows that
repeat an id and a text are counted each, and none is smaller than the other; several labels of a document count as
the highest; a text takes about 40 times its length of memory while it is walked, and is walked whole; extra columns
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.sources.staging import staged

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]

# What a byte means in a state.
OPEN, CLOSE, POINT, CAPITAL, SYMBOL, STRAY = 1, 2, 4, 8, 16, 32
_END = 0xFF
_GAPS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#$%&*|"
_STATES, _BEFORE = 5, 4
_LANES, _CHUNK = 8192, 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, meaning) by state * 256 + byte.  States: 0 outside, 1 inside, 1 + k inside with k bytes due."""
    step, says = np.zeros((_STATES, 256), np.uint16), np.zeros((_STATES, 256), np.uint8)
    for state in range(_STATES):
        due = max(state - 1, 0)
        for byte in range(256):
            follows = 0x80 <= byte < 0xC0
            if byte in _GAPS or byte == _END:
                step[state, byte] = 0
                says[state, byte] = (CLOSE if state else 0) | (POINT if byte != _END else 0) | (STRAY if due else 0)
                continue
            opens = OPEN if state == 0 else 0
            if follows and due:
                step[state, byte] = state - 1
                continue
            wide = 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
            step[state, byte] = 1 + wide
            says[state, byte] = (opens | POINT | (CAPITAL if 65 <= byte <= 90 else 0)
                                 | (SYMBOL if byte in _SYMBOLS else 0) | (STRAY if due or follows else 0))
    return step, says


_NEXT, _SAYS = _tables()
_STEP, _MEANING = (_NEXT << 8).ravel(), _SAYS.ravel()


def _synchronised() -> bool:
    """Whether the state after any four bytes is the same from every state: over all columns of the table that differ."""
    kinds = np.unique(_NEXT, axis=1).T
    states = {tuple(range(_STATES))}
    for _ in range(_BEFORE):
        states = {tuple(int(k[s]) for s in now) for now in states for k in kinds}
    return all(len(set(now)) == 1 for now in states)


def transduced(data: np.ndarray, lanes: int = _LANES) -> np.ndarray:
    """The meaning of every byte of ``data``, which starts at a text."""
    n = len(data)
    long = -(-n // lanes)
    padded = np.full(_BEFORE + lanes * long, _END, np.uint8)
    padded[_BEFORE:_BEFORE + n] = data
    state = np.zeros(lanes, np.uint16)
    at = np.arange(lanes) * long
    for i in range(_BEFORE):
        state = _STEP[state + padded[at + i]]
    columns = np.ascontiguousarray(padded[_BEFORE:].reshape(lanes, long).T)
    out = np.empty((long, lanes), np.uint8)
    for i in range(long):
        both = state + columns[i]
        np.take(_MEANING, both, out=out[i])
        state = _STEP[both]
    return np.ascontiguousarray(out.T).ravel()[:n]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each span, the sum of byte * r^i from its own start, modulo 2^64: a difference of running sums times r^-start."""
    powers = np.full(len(data), _ODD, np.uint64)
    powers[:1] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(powers * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    back = np.full(len(data), pow(_ODD, -1, 1 << 64), np.uint64)
    back[:1] = 1
    np.cumprod(back, out=back)
    return (sums[end] - sums[start]) * back[start]


def _same_bytes(eights: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans at ``a`` and ``b`` of equal ``length`` hold the same bytes, eight at a time."""
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    at = 0
    while len(left):
        rest = length[left] - at
        cut = (np.uint64(64) - np.minimum(rest, 8).astype(np.uint64) * np.uint64(8))
        equal = ((eights[a[left] + at] ^ eights[b[left] + at]) << cut) == 0
        same[left[~equal]] = False
        left, at = left[equal & (rest > 8)], at + 8
    return same


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray,
                   hashes: np.ndarray | None = None) -> np.ndarray:
    """Which spans are the first of their word in their text: the owners of places of a verified hash table."""
    n, length = len(start), end - start
    if hashes is None:
        hashes = _hashes(data, start, end)
    eights = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    key = (hashes ^ (text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(_ODD)
    bits = max(4, int(2 * n).bit_length())
    key >>= np.uint64(64 - bits)
    places = np.full(1 << bits, -1, np.int64)
    first, left, probe = np.zeros(n, bool), np.arange(n), key.astype(np.int64)
    while len(left):
        at = probe[left]
        free = places[at] < 0
        places[at[free][::-1]] = left[free][::-1]
        owner = places[at]
        own = owner == left
        first[left[own]] = True
        like = ~own & (text[owner] == text[left]) & (length[owner] == length[left]) & (hashes[owner] == hashes[left])
        pairs = np.flatnonzero(like)
        like[pairs] = _same_bytes(eights, start[owner[pairs]], start[left[pairs]], length[left[pairs]])
        left = left[~own & ~like]
        probe[left] = (probe[left] + 1) & ((1 << bits) - 1)
    return first


def counted(texts: list[bytes]) -> np.ndarray:
    """texts x (words, distinct words, code points, capitals, symbols)."""
    out = np.zeros((len(texts), 5), np.int64)
    if not texts:
        return out
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    says = transduced(data)
    start, end = np.flatnonzero(says & OPEN), np.flatnonzero(says & CLOSE)
    text = np.searchsorted(begin, start, "right") - 1
    out[:, 0] = np.bincount(text, minlength=len(texts))
    out[:, 1] = np.bincount(text[distinct_words(data, start, end, text)], minlength=len(texts))
    for column, bit in ((2, POINT), (3, CAPITAL), (4, SYMBOL)):
        out[:, column] = np.add.reduceat((says & bit) != 0, begin[:-1], dtype=np.int64)
    return out


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of texts of about ``_CHUNK`` bytes together."""
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > _CHUNK:
            yield slice(first, i)
            first, held = i, 0
        held += size
    if len(sizes):
        yield slice(first, len(sizes))


STATISTICS = ("n_words", "n_distinct", "n_points", "n_capitals", "n_symbols")


def statistics(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (which have names) and what the transducer counts, ``STATISTICS``, of every text."""
    kept = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names))
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)) if len(
                texts) else np.zeros(0, np.int32)
            for part in _chunks(sizes):
                found = counted(texts.slice(part.start, part.stop - part.start).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(part.start, part.stop - part.start) for c in batch.columns[:-1]),
                     *(pa.array(found[:, i]) for i in range(5))], names=[*names, *STATISTICS])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
                       + [f"{c} long" for c in STATISTICS])
    return kept.mapInArrow(run, schema)


def failed() -> Column:
    """The filters A to D that a text fails, as bits, from ``STATISTICS``."""
    n, distinct, points, capitals, symbols = (F.col(c) for c in STATISTICS)
    conditions = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * points, symbols > 0]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just the filters of ``mask``."""
    walked = statistics(docs, [
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")], text_col)
    rows = staged(walked.select("id", "part", "digest", failed().alias("mask")), "masks")
    label = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    labelled = rows.where("id is not null").join(label, "id", "left").select(
        "id", "part", "digest", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    # rows that repeat a document lie together already: dealt by id for the join
    single = labelled.groupBy("id", "part", "digest", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    nameless = rows.where("id is null").withColumns({"good": no, "toxic": no}).groupBy(
        "id", "part", "digest", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    at = F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("id"))
    grouped = single.unionByName(nameless).groupBy("part", "digest", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.struct(at.alias("at"), F.col("n").alias("n"))).alias("first"))
    least = F.min("first.at").over(Window.partitionBy("digest"))
    fresh = F.when(F.col("first.at") == F.col("least"), F.col("first.n")).otherwise(0)
    split = grouped.withColumn("least", least).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask").alias("mask"), fresh.alias("n")),
            F.struct((F.col("mask") + F.lit(16)).alias("mask"), (F.col("n") - fresh).alias("n")))).alias("m"))
    return split.where("m.n > 0").groupBy("part", F.col("m.mask").alias("mask"), "good", "toxic").agg(
        F.sum("m.n").alias("n"))


def audit(found: DataFrame) -> DataFrame:
    """For every part, order of the filters and step what the filter of that step does, from ``masks``."""
    def earlier_bits(order: Column, step: Column) -> Column:
        return sum((F.when(F.instr(order, f) < step, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    cells = found.select(
        "*", F.explode(F.split(F.lit(" ".join(ORDERS)), " ")).alias("filter_order")).select(
        "*", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])).alias("step"))
    cells = cells.withColumns({
        "filter": F.substring(F.col("filter_order"), F.col("step"), F.lit(1)),
        "before": earlier_bits(F.col("filter_order"), F.col("step")),
        "upto": earlier_bits(F.col("filter_order"), F.col("step") + 1)}).withColumn("bit", F.col("upto") - F.col("before"))
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long").alias(name)

    counts = cells.groupBy("part", "filter_order", "step", "filter").agg(
        total(~earlier & ~fails, "kept"), total(~earlier & fails, "removed"), total(earlier & fails, "redundant"),
        total(F.col("mask") == F.col("bit"), "unique_fails"), total(~earlier & fails & F.col("good"), "good_lost"),
        total(~earlier & fails & F.col("toxic"), "toxic_lost"))
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")
