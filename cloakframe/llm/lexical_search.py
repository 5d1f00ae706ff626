"""Ranked lexical search, reversed: the items wait in an inverted index and the documents stream past it.

The items' terms become an inverted index (term -> items with counts).  Every document is read once: its terms are
counted and the counts of those that some item asks for are written, by term number.  Document frequencies, the
number of documents and of all their terms are sums over that table.  Then the counts stream through the broadcast
index, each task keeps a heap of the ``k`` best documents for each item, and the heaps are merged in two levels (by
item and salt, then by item), so no task reads the heaps of all tasks for one item.

The index is broadcast in blocks of items of at most about ``block_bytes`` and ``block_items``; more items mean more
blocks, each of which sees every document.  The heaps of a task hold k times the items of a block.

Score: terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased;
``weights``, ``norm`` and the sum are 64-bit integers as stated there.

Defined cases: a null or empty text has no terms and is neither counted nor found; an item without terms, or whose
terms occur nowhere, has no rows; rows of one item id (null included) are one item, their terms added; rows that
repeat a document are documents of their own; at equal scores the smaller id is first, documents without id last;
texts are read whole; extra columns are not looked at; an empty table of either kind gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.sources.staging import staged

TOP = 20
BLOCK_BYTES, BLOCK_ITEMS = 16 << 20, 4096
MERGE_SALTS = 32
_CELLS = 1 << 21
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: bytes | None) -> list[bytes]:
    """In UTF-8 the bytes from 0x80 are exactly those of characters beyond ASCII, and lower() of bytes is that of A-Z."""
    return _TERM.findall(text.lower()) if text else []


def weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * frequency + 1.0))).astype(np.int64)


def norm(n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L: 100 for a document of average length."""
    return 75 + (25 * n_terms * n_docs) // max(all_terms, 1)


@dataclass
class Index:
    """Postings of one block: of term t the places ``starts[t]`` to ``starts[t + 1]`` of ``items`` and ``counts``."""

    number: dict[bytes, int]
    names: list
    starts: np.ndarray
    items: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(rows: list) -> Index:
        """From rows (item, term, n)."""
        names: dict = {}
        number: dict[bytes, int] = {}
        found = [(number.setdefault(bytes(r["term"]), len(number)), names.setdefault(r["item"], len(names)), r["n"])
                 for r in rows]
        found.sort()
        table = np.array(found, np.int64).reshape(-1, 3)
        starts = np.searchsorted(table[:, 0], np.arange(len(number) + 1))
        return Index(number, list(names), starts, table[:, 1].copy(), table[:, 2].copy())

    def scores(self, docs: int, at: np.ndarray, term: np.ndarray, part: np.ndarray) -> np.ndarray:
        """docs x items: ``part`` of each (document place, term) pair times the item's count of the term."""
        each = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(each)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each, each) + np.repeat(self.starts[term], each)
        out = np.zeros(docs * len(self.names), np.int64)
        np.add.at(out, np.repeat(at, each) * len(self.names) + self.items[place], np.repeat(part, each) * self.counts[place])
        return out.reshape(docs, len(self.names))


class Heaps:
    """The ``k`` best (score, has id, -id) of each item."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.least = np.ones(n, np.int64)

    def update(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        passed = scores >= self.least
        for item in np.flatnonzero(passed.any(axis=0)).tolist():
            at = np.flatnonzero(passed[:, item])
            s = scores[at, item]
            heap = self.heaps[item]
            for i in np.lexsort((ids[at], ~known[at], -s))[:self.k].tolist():
                entry = (int(s[i]), bool(known[at[i]]), -int(ids[at[i]]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                else:
                    break
            if len(heap) == self.k:
                self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, known, minus in heap:
                yield item, -minus if known else None, score


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term, n), rows of one item added up."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(terms(t)) for t in batch.column(1).to_pylist()]
            of = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array([t for c in counted for t in c], pa.binary()),
                 pa.array([n for c in counted for n in c.values()], pa.int64())], names=["item", "term", "n"])

    texts = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("t"))
    return texts.mapInArrow(run, f"item {kind}, term binary, n long").groupBy("item", "term").agg(F.sum("n").alias("n"))


def _counted(docs: DataFrame, number, id_col: str, text_col: str) -> DataFrame:
    """(id, n, term, tf): of each text with terms their number and the counts of those in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            keep, n, offsets, term, tf = [], [], [0], [], []
            for i, text in enumerate(batch.column(1)):
                found = terms(text.as_py())
                if not found:
                    continue
                keep.append(i)
                n.append(len(found))
                for t, c in Counter(found).items():
                    at = known.get(t)
                    if at is not None:
                        term.append(at)
                        tf.append(c)
                offsets.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, kind))
                     for v, kind in ((term, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists],
                names=["id", "n", "term", "tf"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return texts.mapInArrow(run, "id long, n long, term array<int>, tf array<long>")


def _best(counted: DataFrame, index, weight: np.ndarray, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """(item_no, id, score): the heaps of all tasks."""
    spark = counted.sparkSession
    shared = spark.sparkContext.broadcast((index, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, w = shared.value
        heaps = Heaps(len(postings.names), k)
        step = max(1, _CELLS // max(len(postings.names), 1))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                lists = batch.column(2)
                each = np.diff(lists.offsets.to_numpy())
                term = lists.flatten().to_numpy(zero_copy_only=False)
                tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
                m = norm(batch.column(1).to_numpy(), n_docs, all_terms)
                at = np.repeat(np.arange(batch.num_rows), each)
                part = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[at]))
                ids = batch.column(0)
                heaps.update(postings.scores(batch.num_rows, at, term, part),
                             ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))
        found = list(heaps.rows())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))],
            names=["item_no", "id", "score"])

    found = counted.select("id", "n", "term", "tf").mapInArrow(run, "item_no int, id long, score long")

    def merged(heaps: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    salted = merged(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_SALTS))), "item_no", "salt")
    return merged(salted.drop("rank", "salt"), "item_no")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
           block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, rank, id, score): for each item its ``k`` documents of highest score above 0, best first."""
    spark = docs.sparkSession
    asked = staged(_item_terms(items, item_col, item_text_col), "item-terms")
    size = asked.agg(F.coalesce(F.sum(F.length("term") + 48), F.lit(0)).alias("bytes"),
                     F.countDistinct(F.struct("item")).alias("items")).first()
    blocks = max(1, -(-size["bytes"] // block_bytes), -(-size["items"] // block_items))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        index = Index.of(asked.where(F.col("block") == block).select("item", "term", "n").collect())
        counted = staged(_counted(docs, spark.sparkContext.broadcast(index.number), id_col, text_col), "term-counts")
        total = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        frequency = np.zeros(len(index.number), np.int64)
        for r in counted.select(F.explode("term").alias("term")).groupBy("term").count().collect():
            frequency[r["term"]] = r["count"]
        index.number = {}
        best = _best(counted, index, weights(total["docs"], frequency), total["docs"], total["terms"], k)
        names = spark.createDataFrame(
            pa.table({"item_no": pa.array(range(len(index.names)), pa.int32()),
                      "item": pa.array(index.names, pa.array(index.names).type if index.names else pa.int64())}))
        named = best.join(names, "item_no").select(
            F.col("item").cast(items.schema[item_col].dataType).alias("item"), F.col("rank").cast("int").alias("rank"),
            "id", "score")
        out = named if out is None else out.unionByName(named)
    return out
