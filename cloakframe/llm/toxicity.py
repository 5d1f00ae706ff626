"""Toxicity by classifier chains.

Categories are predicted one after another by linear models on a text's words and their beginnings; each model
also sees the probabilities of the categories before it.  While the chain is fitted, those probabilities come from
models that did not see the row (out of fold), as they will be when new texts are scored.

Where labels give ``toxic`` only, two finer categories are derived for the chain from the labelled sample itself:
words and beginnings that nearly always stand in toxic texts are markers, and a toxic text is *heavy* with three
markers or more and *light* with one or two.

Defined cases: null and empty texts have no features and are never toxic; rows with null ids or labels teach
nothing; labels of one kind only, or none, give a constant chain that calls nothing toxic (or, where all labels are
toxic, every text with a word); rows that repeat an id are scored each by its own text; texts are read whole.  The
caller's columns travel in one struct ``row``, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cloakframe.llm.common import hash_sample
from cloakframe.llm.linear import Logistic, Rows, among, fit as fit_linear, logit, telling

CHAIN = ("heavy", "light", "toxic")
_EDGES = ".,;:!?\"'()[]{}*#%&$|<>-_"


def keys_of(text: str | None) -> np.ndarray:
    """The hashed words of a text and the beginnings (four and five characters) of longer ones."""
    words = {w.strip(_EDGES) for w in set(text.lower().split())} if text else set()
    parts = words.union([w[:4] + "~" for w in words if len(w) > 3], [w[:5] + "~" for w in words if len(w) > 4])
    parts.discard("")
    return np.fromiter(map(xxhash.xxh32_intdigest, parts), np.int64, len(parts))


@dataclass
class Chain:
    """Models in the order of the categories; the last one decides."""

    names: tuple[str, ...] = CHAIN
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    models: list[Logistic] = field(default_factory=list)
    threshold: float = 0.5

    def prob(self, rows: Rows) -> np.ndarray:
        """Probabilities (rows, categories); zero for rows without features."""
        known = among(rows, self.keys)
        out = np.zeros((len(rows), len(self.models)))
        for i, model in enumerate(self.models):
            out[:, i] = model.prob(known, logit(out[:, :i]))
        return out * (np.diff(rows.start) > 0)[:, None]


def _derived(rows: Rows, toxic: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(rows, categories) labels of heavy, light and toxic."""
    known = among(rows, keys)
    with_, without = (known.take(np.flatnonzero(side)).present(len(keys)) for side in (toxic, ~toxic))
    rate = (with_ + 0.5) / (toxic.sum() + 1), (without + 0.5) / ((~toxic).sum() + 1)
    n = known.times((rate[0] > 20 * rate[1]).astype(float))
    return np.stack([toxic & (n >= 3), toxic & (n >= 1) & (n < 3), toxic], axis=1).astype(float)


def fit_chain(rows: Rows, toxic: np.ndarray, names: tuple[str, ...] = CHAIN, folds: int = 4) -> Chain:
    """Models of all categories on the keys that tell toxic from other rows.  The threshold is the best F1 of the
    last category out of fold."""
    keys = telling(rows, toxic)
    labels = _derived(rows, toxic, keys)
    fold = np.arange(len(rows)) % folds
    held = np.zeros(labels.shape)
    models = []
    for i in range(labels.shape[1]):
        before = logit(held[:, :i])
        for k in range(folds if len(rows) >= 2 * folds else 0):
            seen, aside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            own = telling(rows.take(seen), toxic[seen])
            model = fit_linear(among(rows.take(seen), own), labels[seen, i], len(own), before[seen])
            held[aside, i] = model.prob(among(rows.take(aside), own), before[aside])
        models.append(fit_linear(among(rows, keys), labels[:, i], len(keys), before))
    return Chain(names, keys, models, _best_f1(held[:, -1], toxic) if len(rows) else 0.5)


def _best_f1(p: np.ndarray, y: np.ndarray) -> float:
    best = max(((2 * float(y[p >= t].sum()) / (float((p >= t).sum()) + float(y.sum()) or 1.0), -abs(t - 0.6), t)
                for t in np.linspace(0.3, 0.95, 27)))
    return float(best[2])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
            [keys_of(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))], names=["y", "at"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = 6_000) -> Chain:
    """A chain from about ``sample`` labelled texts, chosen by a hash of the id; only their hashed features reach
    the driver, and only ids and labels of the sample are broadcast."""
    given = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(
        "_y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    given = hash_sample(given, "_id", sample)
    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(
        F.broadcast(given), "_id").select("_y", "_t").mapInArrow(_features, "y int, at array<long>").toArrow()
    rows = Rows.of([np.asarray(a.values) for a in got["at"]])
    toxic = np.asarray(got["y"].to_pylist(), int) == 1
    return fit_chain(rows, toxic) if len(rows) else Chain()


def scored(docs: DataFrame, chain: Chain, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """(row, probabilities by category, is_toxic): ``row`` is a struct of the columns ``keep`` of ``docs``, or of all."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kept = docs.select(*(F.col(f"`{c}`") for c in keep)) if keep else docs
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row"), F.col(text_col).alias("text"))
    schema = StructType([StructField("row", kept.schema)])
    for n in chain.names:
        schema = schema.add(f"p_{n}", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            p = np.zeros((batch.num_rows, len(chain.names)))
            if chain.models:
                p = chain.prob(Rows.of([keys_of(t.as_py()) for t in batch.column(1)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(p[:, i]) for i in range(p.shape[1])),
                 pa.array(p[:, -1] >= chain.threshold)],
                names=["row", *(f"p_{n}" for n in chain.names), "is_toxic"])

    return given.mapInArrow(run, schema.add("is_toxic", "boolean"))
