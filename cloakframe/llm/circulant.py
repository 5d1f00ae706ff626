"""Near duplicates by circulant MinHash: two permutations make the whole signature.

A text is the set of its distinct five-word shingles.  One permutation of 2^20 places scatters the hashed
shingles, a second one, shifted circularly by k, gives coordinate k as the least value over the set; coordinates make
bands of five.  The least Jaccard similarity of a link is a parameter, in per cent, and everything follows from it:
there are as many bands as two sets at just that similarity need to miss each other in all of them with a probability
below 1e-6 (24 at 85, 35 at 80), more similar ones with less.  Every link is confirmed on the full sets.

Texts with equal sets are one *class*, whatever their ids, before anything is compared; only classes are banded, each
under a number of its own, and fetch their set by the smallest id and the digest of the set.  Inside a band's bucket every member is compared with the hub, the one that meets most
others over all its bands, so a group of near copies costs as many pairs as it has members.  Where a bucket's
members still lie in different components, the rest is found by an exact prefix join on their rarest shingles.

Defined cases: a null or empty text and one without words has no shingles, links with nothing and is kept; fewer
than five words are one shingle; a row with a null id links with nothing, its component is null and it is kept;
rows that repeat an id and a text have the same class; rows that share an id but not the text are compared and linked
each by its own text.  Other columns are never read, so clashing names don't
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.sources.staging import staged

WIDTH, ROWS = 5, 5
#: The least similarity of a link, in per cent, where none is given.
SIMILARITY = 85
#: Shingles are hashed into this many places, which both permutations rearrange.
PLACES = 1 << 20
_STEP = np.uint64(0x9FB21C651E98DF25)


@functools.cache
def band_count(similarity: int) -> int:
    """The least number of bands that miss a pair at ``similarity`` per cent with a probability below 1e-6."""
    if not 1 <= similarity <= 100:
        raise ValueError(f"a similarity of 1 to 100 per cent is needed, not {similarity}")
    hit = (similarity / 100) ** ROWS
    return 1 if hit == 1 else math.ceil(math.log(1e-6) / math.log1p(-hit))


@functools.cache
def agree_floor(similarity: int) -> int:
    """Coordinates that must agree before full sets are fetched: fewer come about once in 10^8 pairs."""
    p, n = similarity / 100, ROWS * band_count(similarity)
    if p == 1:
        return n
    below = floor = 0
    while (below := below + math.exp(
            math.lgamma(n + 1) - math.lgamma(floor + 1) - math.lgamma(n - floor + 1)
            + floor * math.log(p) + (n - floor) * math.log1p(-p))) <= 1e-8:
        floor += 1
    return floor


COORDINATES = ROWS * band_count(SIMILARITY)


@functools.cache
def _permutations(coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the second one at all its shifts: row i has coordinate k at place i + k."""
    draw = np.random.default_rng(20240229)
    scatter, order = draw.permutation(PLACES), draw.permutation(PLACES).astype(np.uint32)
    around = np.concatenate([order, order[:coordinates]])
    return scatter, np.lib.stride_tricks.sliding_window_view(around, coordinates)


@functools.cache
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, and which bytes separate words."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64), space


@functools.lru_cache(4)
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _STEP)]))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lowered: a sum of its bytes' numbers, times powers of an odd step."""
    value, space = _byte_values()
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    gap = space[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    letters = raw[~gap]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    longest = 1 << int(lengths.max()).bit_length()
    h = np.add.reduceat(value[letters] * _powers(longest)[place], first)
    h ^= h >> np.uint64(32)
    return h * _STEP + lengths.astype(np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    h = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out *= _STEP
        out += h[i:i + n]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Coordinate k: the least of the second permutation, shifted by k, over the scattered shingles."""
    scatter, shifted = _permutations(coordinates)
    at = scatter[(found >> np.uint64(44)).view(np.int64)]
    least = np.full(coordinates, PLACES, np.uint32)
    for i in range(0, len(at), 512):
        np.minimum(least, shifted[at[i:i + 512]].min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[i * 4 * ROWS:(i + 1) * 4 * ROWS]) - (1 << 63) for i in range(len(least) // ROWS)]


_SKETCH = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()),
                     ("bands", pa.list_(pa.int64())), ("low", pa.list_(pa.int16())), ("text_digest", pa.binary())])
_SKETCH_COLUMNS = "id long, n long, same binary, bands array<long>, low array<short>, text_digest binary"
_SET_COLUMNS = "id long, same binary, set array<long>"


def _sketch(batches: Iterator[pa.RecordBatch], coordinates: int = COORDINATES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], [], [], []]
        for key, text, digest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            found = shingles(text.as_py())
            least = signature(found, coordinates) if len(found) and key is not None else None
            for out, v in zip(rows, (
                key, len(found), _digest(found), None if least is None else bands(least),
                None if least is None else least.astype(np.uint16).view(np.int16), digest,
            )):
                out.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(rows, _SKETCH)], schema=_SKETCH)


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(found.tobytes())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("same", pa.binary()), ("set", pa.list_(pa.int64()))])
    for batch in batches:
        found = [shingles(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, found), pa.binary()), pa.array(
            [f.view(np.int64) for f in found], schema.field(2).type)], schema=schema)


def _agree(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _plausible(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link."""
    of = {s: reps.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("low").alias(f"low_{s}"))
          for s in "ab"}
    return (
        pairs.join(of["a"], "a").join(of["b"], "b")
        .where(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
        .where(_agree(F.col("low_a"), F.col("low_b")) >= agree_floor(similarity)).select("a", "b", "n_a", "n_b")
    )


def _sets_of(nodes: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, set) of the classes ``nodes``: by the id of a text of the class, and told by the digest from other texts
    of that id."""
    wanted = staged(reps.select("node", "id", "same").join(nodes, "node", "left_semi"), "wanted")
    found = texts.select("id", "text").join(wanted.select("id").distinct(), "id", "left_semi").mapInArrow(_sets, _SET_COLUMNS)
    return staged(found.join(wanted, ["id", "same"]).select("node", "set"), "shingle-sets").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Links among plausible pairs, by the full sets of both texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets_of(wanted, reps, texts)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        .where(100 * both >= similarity * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for ids that have a link.

    Large stars and small stars in turn: each node's neighbours are hung on the least of them, first the larger
    ones, then the smaller ones, until nothing moves.  Sums and minima are combined before they are shuffled; every
    round is written, so a lost executor repeats one round at most.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = staged(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now


def _labelled(reps: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).withColumnRenamed("id", "node")
    return reps.select("node").join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def _smallest_ids(reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, group, component): the number of the node's component, and its smallest id."""
    named = reps.select("node", "id").join(labels, "node")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    return named.join(least, "component").select("node", F.col("component").alias("group"), F.col("least").alias("component"))


def _buckets(members: DataFrame) -> DataFrame:
    """Buckets of at least two members: (key, size)."""
    return members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 similarity: int = SIMILARITY) -> DataFrame:
    """(id, text_digest, n_shingles, group, component, representative): one row for each row of ``docs``; a link is a
    Jaccard similarity of at least ``similarity`` per cent.  ``text_digest`` is ``text_digest()`` of the row's text,
    ``group`` tells components apart also where they share their smallest id; null for what links with nothing."""
    sketch = functools.partial(_sketch, coordinates=ROWS * band_count(similarity))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                        text_digest(F.col(text_col)).alias("text_digest"))
    sketches = staged(texts.mapInArrow(sketch, _SKETCH_COLUMNS), "sketches")
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    # once written, the numbers stay what they are
    reps = staged(sketches.where(linked).groupBy("same", "n").agg(
        F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("low").alias("low")).withColumn(
        "node", F.monotonically_increasing_id()), "classes")

    members = reps.select("node", F.posexplode("bands").alias("band", "key")).select(
        "node", F.xxhash64("band", "key").alias("key"))
    members = staged(members.join(_buckets(members), "key"), "buckets")
    # the member that meets most others over all its bands: of copies of one text, mostly that text
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    hubs = members.join(company, "node").groupBy("key").agg(
        F.max(F.struct("company", (-F.col("node")).alias("node"))).alias("hub")).select(
        "key", (-F.col("hub.node")).alias("hub"))
    members = staged(members.join(hubs, "key"), "buckets")
    first = members.where("node <> hub").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = staged(_confirmed(staged(_plausible(first, reps, similarity), "pairs"), reps, texts, similarity), "confirmed")
    links = _rest(reps, members, links, texts, similarity)

    labels = _smallest_ids(reps, _labelled(reps, links))
    classes = reps.select("node", "id", "same", "n").join(labels, "node").select(
        "same", "n", "group", "component", F.col("id").alias("representative"))
    alone = sketches.where(~linked).select(
        "id", "text_digest", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("group"),
        F.col("id").alias("component"), F.col("id").alias("representative"))
    return sketches.where(linked).select("id", "text_digest", "same", "n").join(classes, ["same", "n"]).select(
        "id", "text_digest", F.col("n").alias("n_shingles"), "group", "component", "representative").unionByName(alone)


def text_digest(text: Column) -> Column:
    """What tells the texts of one id apart; the same for null and empty texts."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of its texts in the component the one with the
    smallest digest, of equal rows one.  Rows without id or words all stay; columns are as they were."""
    found = staged(near_classes(docs, id_col, text_col, similarity), "near-classes").where("group is not null")
    first = found.where(F.col("id") == F.col("component")).groupBy("group").agg(F.min("text_digest").alias("first"))
    goes = found.join(first, "group").where(
        (F.col("id") != F.col("component")) | (F.col("text_digest") != F.col("first")))
    key = F.struct(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("text_digest"))
    # under names of our own, so that no column of the caller's is in the way
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    dropped = goes.select(F.struct("id", "text_digest").alias("key")).distinct()
    rest = rows.join(dropped, "key", "left_anti")
    again = staged(found.groupBy("id", "text_digest").count().where("count > 1").select(
        F.struct("id", "text_digest").alias("key")), "repeated")
    if not again.isEmpty():
        rest = rest.join(again, "key", "left_anti").unionByName(
            rest.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return rest.select("row.*")


def _rest(reps: DataFrame, members: DataFrame, links: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """All links, those included that the comparison with hubs did not find.

    Members of buckets that still hold several components are compared by an exact rule: order all shingles from
    rare to frequent; sets of n shingles that are linked share one of their first n - s n + 1
    at a similarity of s.  Edited copies
    differ by rare shingles, so those that are too far from each other hardly ever meet.
    """
    labels = staged(_labelled(reps, links), "components")
    open_ = members.where("size > 2").select("key", "node").join(labels, "node")
    mixed = open_.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d")
    nodes = staged(open_.join(mixed.select("key"), "key").select("node", "component").distinct(), "open")
    if nodes.isEmpty():
        return links
    sets = _sets_of(nodes.select("node"), reps, texts)
    each = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(1)), "shingle"))
    head = staged(each.join(often, "shingle", "left").withColumn("at", rank)
                  .where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1).where("often > 1")
                  .join(nodes, "node").select("shingle", "node", "n", "at", "component"), "prefixes")
    x, y = head.alias("x"), head.alias("y")
    pairs = x.join(y, F.expr(
        "x.shingle = y.shingle and x.node < y.node and x.component <> y.component "
        f"and 100 * least(x.n, y.n) >= {similarity} * greatest(x.n, y.n) "
        f"and {100 + similarity} * (1 + least(x.n - x.at, y.n - y.at)) >= {similarity} * (x.n + y.n)"
    )).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return links.unionByName(
        staged(_confirmed(staged(_plausible(pairs, reps, similarity), "pairs"), reps, texts, similarity), "confirmed"))
