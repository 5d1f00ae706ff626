"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

The text view has the shapes of words (letters, capitals, digits and signs, runs shortened), how often words and
lines come again, and telling words; the metadata view has source, language, length and layout.  Both start from a
bounded sample of labelled texts; each round, each view scores every text without a label and labels those it is surest
about, for the other view to learn from.  Texts stay in Spark: features that are frequent enough to tell anything are
written once as numbers, confidences are counted in a histogram, features in counts, and refitting takes sums of
gradients, all over the whole corpus.  At the end both are calibrated on labelled texts kept aside, and one more
logistic regression weighs them; it scores every text.

Defined cases: null and empty texts have no text features and are scored by their metadata; missing metadata columns
or null values are a value of their own; rows with null ids or labels teach nothing; labels of one kind only, or
none, score every text 1 (or 0 if all are low).  Only id, text and the named metadata columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import hash_sample
from cloakframe.llm.linear import (
    Logistic, Rows, among, dependent, fit as fit_linear, logit, sigmoid, telling,
)
from cloakframe.sources.staging import staged

METADATA = ("source", "lang", "n_chars")
_RUNS = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "a"), (re.compile(r"\d+"), "9"))


def _keys(parts: set[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, parts), np.int64, len(parts))


def _tenth(a: float, b: float) -> int:
    return int(10 * a / b) if b else -1


def text_keys(text: str | None) -> np.ndarray:
    """Hashed features of the content."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    distinct = set(words)
    marks = {w for w in distinct if not w.isalpha()}
    shapes = set()
    for w in marks:
        for pattern, to in _RUNS:
            w = pattern.sub(to, w)
        shapes.add(w[:12])
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    parts = {f"shape {s}" for s in shapes} | {f"word {w}" for w in distinct - marks} | {
        f"marked {_tenth(sum(w in marks for w in words), len(words))}",
        f"distinct {_tenth(len(distinct), len(words))} {int(log2(len(words)))}",
        f"again {_tenth(again, len(words))}",
        f"lines again {_tenth(len(lines) - len(set(lines)), len(lines))}",
        f"capitals {_tenth(sum(w.isupper() for w in words), len(words))}",
    }
    return _keys(parts)


def metadata_keys(text: str | None, values: tuple) -> np.ndarray:
    """Hashed features of where a page comes from and how it is laid out."""
    text = text or ""
    lines = text.count("\n") + 1
    parts = {f"{i} {v if not isinstance(v, (int, float)) else int(log2(abs(v) + 1))}" for i, v in enumerate(values)}
    parts |= {f"chars {int(log2(len(text) + 1))}", f"lines {int(log2(lines))}",
              f"chars a line {int(log2(len(text) / lines + 1))}", f"blanks {_tenth(text.count(' '), len(text))}",
              f"bytes a char {_tenth(len(text.encode()), len(text) or 1)}"}
    return _keys(parts)


@dataclass
class View:
    """A linear model of one view, its keys, and the slope and offset that calibrate its margins."""

    keys: np.ndarray
    model: Logistic
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, rows: Rows) -> np.ndarray:
        return self.slope * self.model.margin(among(rows, self.keys)) + self.offset

    def prob(self, rows: Rows) -> np.ndarray:
        return sigmoid(self.margin(rows))


@dataclass
class CoTrained:
    """Two views and their weights; without views the score is a constant."""

    views: list[View] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2))
    offset: float = 0.0
    constant: float = 1.0
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def scores(self, texts: Rows, metadata: Rows) -> np.ndarray:
        """(rows, 3): text, metadata, both."""
        if not self.views:
            return np.full((len(texts), 3), self.constant)
        p = [v.prob(r) for v, r in zip(self.views, (texts, metadata))]
        both = sigmoid(sum(w * logit(x) for w, x in zip(self.weights, p)) + self.offset)
        return np.stack([*p, both], axis=1)


def _calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, kept from growing without bound by one pseudo-row
    of either kind at the middle."""
    x = np.concatenate([margin, [0.0, 0.0]])
    t = np.concatenate([y, [0.0, 1.0]])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([np.sum((p - t) * x) + 0.01 * (a - 1), np.sum(p - t)])
        h = np.array([[np.sum(w * x * x) + 0.01, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


#: A view is a linear model of at most so many features, those that depend most on the label: a bound of the model's
#: size, the same at every size of the corpus.  All texts are counted to choose them.
FEATURES = 4000
#: Confidences are counted in so many steps for 1 of margin, from the margin of ``sure`` up to 32 above it.
_STEPS, _BINS = 128, 4096
_CHANCE = 1 << 30


@dataclass
class Line:
    """A linear model over numbered features: places, their weights, and an intercept."""

    at: np.ndarray
    w: np.ndarray
    b: float

    def margin(self, rows: Rows, places: int) -> np.ndarray:
        dense = np.zeros(places)
        dense[self.at] = self.w
        return rows.times(dense) + self.b


@dataclass
class Passed:
    """What a round passes on: the views as they were; of each view and label the least bin of confidence, and how
    many of ``_CHANCE`` ids of that bin are taken."""

    views: list[Line]
    least: np.ndarray
    part: np.ndarray


def _bins(margin: np.ndarray, sure: float) -> np.ndarray:
    """The bin of confidence, -1 below ``sure``."""
    above = margin - log(sure / (1 - sure))
    return np.where(above < 0, -1, np.minimum(np.maximum(above, 0) * _STEPS, _BINS - 1)).astype(np.int64)


def _received(rows: tuple[Rows, Rows], chance: np.ndarray, places: tuple[int, int], rounds: list[Passed],
              sure: float) -> list[np.ndarray]:
    """The label that each view has from the other one after ``rounds``, -1 without."""
    got = [np.full(len(chance), -1, np.int8) for _ in (0, 1)]
    for r in rounds:
        for i in (0, 1):
            margin, other = r.views[i].margin(rows[i], places[i]), got[1 - i]
            for label, m in ((1, margin), (0, -margin)):
                bin_ = _bins(m, sure)
                new = (bin_ > r.least[i, label]) | ((bin_ == r.least[i, label]) & (chance < r.part[i, label]))
                other[new & (other < 0)] = label
    return got


def _rows(column: pa.ListArray) -> Rows:
    start = column.offsets.to_numpy().astype(np.int64)
    return Rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), start - start[0])


def _lists(rows: Rows) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(rows.start, pa.int32()), pa.array(rows.at, pa.int32()))


def _summed(df: DataFrame, of: Callable[[pa.RecordBatch], Iterator[tuple]], names: tuple[str, ...], at: int) -> DataFrame:
    """(names ..., sums): ``of`` gives arrays for a batch, the first ``at`` are keys (0 or 1, the last one of 32 bits),
    the others are added up in the task and then over all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def added() -> list[np.ndarray]:
            all_ = np.concatenate(held, axis=1)
            code = np.zeros(all_.shape[1], np.int64)
            for k in all_[:at - 1]:
                code = 2 * code + k.astype(np.int64)
            _, first, place = np.unique((code << 33) + all_[at - 1].astype(np.int64), return_index=True,
                                        return_inverse=True)
            return [np.concatenate([all_[:at, first], np.stack([np.bincount(place, v) for v in all_[at:]])])]

        size, limit = 0, 1 << 21
        for batch in batches:
            for arrays in of(batch):
                held.append(np.stack([np.asarray(x, float) for x in arrays]))
                size += held[-1].shape[1]
            if size > limit:
                held = added()
                size = held[0].shape[1]
                if size > limit // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=list(names))
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()[0]], names=list(names))

    return df.mapInArrow(run, ", ".join(f"{n} double" for n in names)).groupBy(*names[:at]).agg(
        *(F.sum(n).alias(n) for n in names[at:]))


def _dense(df: DataFrame, names: tuple[str, ...], shape: tuple[int, ...]) -> np.ndarray:
    """Sums at their keys, the last axis over the summed columns."""
    got, out = df.toArrow(), np.zeros(shape)
    keys = [got[n].to_numpy().astype(np.int64) for n in names[:len(shape) - 1]]
    out[tuple(keys)] = np.stack([got[n].to_numpy() for n in names[len(shape) - 1:]], axis=1)
    return out


@dataclass
class _Corpus:
    """Unlabelled texts as numbered features (chance, a, b), and how many features there are of either view."""

    rows: DataFrame
    n: int
    places: tuple[int, int]
    sure: float

    def confidence(self, rounds: list[Passed], views: list[Line]) -> np.ndarray:
        """(view, label, bin): texts that the other view has no label for."""
        sure, places = self.sure, self.places

        def of(batch):
            rows = (_rows(batch.column(1)), _rows(batch.column(2)))
            got = _received(rows, batch.column(0).to_numpy(), places, rounds, sure)
            for i in (0, 1):
                margin = views[i].margin(rows[i], places[i])[got[1 - i] < 0]
                for label, m in ((1, margin), (0, -margin)):
                    n = np.bincount(_bins(m, sure) + 1, minlength=1)[1:]
                    at = np.flatnonzero(n)
                    if len(at):
                        yield np.full(len(at), i), np.full(len(at), label), at, n[at]

        names = ("view", "label", "bin", "n")
        return _dense(_summed(self.rows, of, names, 3), names, (2, 2, _BINS, 1))[..., 0]

    def counts(self, rounds: list[Passed]) -> np.ndarray:
        """(view, feature, [texts, positive texts]) of what the views received; the place behind the last feature has
        the number of texts."""
        sure, places = self.sure, self.places

        def of(batch):
            rows = (_rows(batch.column(1)), _rows(batch.column(2)))
            got = _received(rows, batch.column(0).to_numpy(), places, rounds, sure)
            for i in (0, 1):
                known = got[i] >= 0
                each = np.repeat(known, np.diff(rows[i].start))
                at = np.concatenate([rows[i].at[each], np.full(known.sum(), max(places))])
                y = np.concatenate([np.repeat(got[i], np.diff(rows[i].start))[each], got[i][known]])
                n = np.bincount(at, minlength=1)
                held = np.flatnonzero(n)
                if len(held):
                    yield np.full(len(held), i), held, n[held], np.bincount(at, y)[held]

        names = ("view", "feature", "n", "n1")
        return _dense(_summed(self.rows, of, names, 2), names, (2, max(places) + 1, 2))

    def taught(self, rounds: list[Passed], keys: list[np.ndarray]) -> DataFrame:
        """(ya, yb, a, b): texts with a label for a view (-1 without), their features among ``keys``."""
        sure, places = self.sure, self.places

        def run(batches):
            for batch in batches:
                rows = (_rows(batch.column(1)), _rows(batch.column(2)))
                got = _received(rows, batch.column(0).to_numpy(), places, rounds, sure)
                some = np.flatnonzero((got[0] >= 0) | (got[1] >= 0))
                if len(some):
                    own = [among(r.take(some), k) for r, k in zip(rows, keys)]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(g[some]) for g in got), *map(_lists, own)], names=["ya", "yb", "a", "b"])

        return staged(self.rows.mapInArrow(run, "ya byte, yb byte, a array<int>, b array<int>"), "taught")


def _gradients(taught: DataFrame, lines: list[Line], weights: list[tuple[float, float]]) -> list[np.ndarray]:
    """Of each view: the sum over all its texts of error times feature, and, last, of the errors."""
    most = max(len(x.at) for x in lines)

    def of(batch):
        for i in (0, 1):
            y, rows = batch.column(i).to_numpy(), _rows(batch.column(2 + i))
            weight = np.select([y > 0, y == 0], weights[i][::-1], 0.0)
            error = weight * (sigmoid(rows.times(lines[i].w) + lines[i].b) - y)
            g = np.concatenate([rows.transposed_times(error, most), [error.sum()]])
            at = np.flatnonzero(g)
            if len(at):
                yield np.full(len(at), i), at, g[at]

    names = ("view", "place", "g")
    got = _dense(_summed(taught, of, names, 2), names, (2, most + 1, 1))[..., 0]
    return [np.concatenate([g[:len(x.at)], g[-1:]]) for g, x in zip(got, lines)]


def _refitted(corpus: _Corpus, rounds: list[Passed], views: list[Line], own: tuple[Rows, Rows], y: np.ndarray,
              steps: int, rate: float = 0.15, l2: float = 1e-3) -> list[Line]:
    """Both views fitted on the labelled rows ``own`` and on all texts they have labels for, from where they were."""
    counts, keys, weights = corpus.counts(rounds), [], []
    for i in (0, 1):
        n, n1 = counts[i, :, 0].copy(), counts[i, :, 1].copy()
        total, positive = n[-1] + len(y), n1[-1] + y.sum()
        label = np.repeat(y, np.diff(own[i].start))
        n[:-1] += np.bincount(own[i].at, minlength=len(n) - 1)
        n1[:-1] += np.bincount(own[i].at, label, len(n) - 1)
        keys.append(dependent(n1[:-1], n[:-1], int(total), float(positive), most=FEATURES))
        weights.append((0.5 / (total - positive), 0.5 / positive))
    taught = corpus.taught(rounds, keys)
    state = []
    for i, v in enumerate(views):
        dense = np.zeros(corpus.places[i])
        dense[v.at] = v.w
        state.append([np.append(dense[keys[i]], v.b), 0.0, 0.0])
    rows = [among(r, k) for r, k in zip(own, keys)]
    for t in range(1, steps + 1):
        lines = [Line(k, x[:-1], float(x[-1])) for k, (x, _, _) in zip(keys, state)]
        for i, g in enumerate(_gradients(taught, lines, weights)):
            x, m, s = state[i]
            error = np.where(y > 0, weights[i][1], weights[i][0]) * (sigmoid(rows[i].times(x[:-1]) + x[-1]) - y)
            g = g + np.append(rows[i].transposed_times(error, len(x) - 1), error.sum())
            g[:-1] += l2 * x[:-1] / max(1, len(x) ** 0.5)
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            state[i] = [x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-6), m, s]
    return [Line(k, x[:-1], float(x[-1])) for k, (x, _, _) in zip(keys, state)]


def _cuts(found: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least bin, part of its ids and expected number for each view and label, so that about ``most`` texts pass."""
    least, part, passed = np.zeros((2, 2), np.int64), np.full((2, 2), _CHANCE), np.zeros((2, 2))
    for i, label in np.ndindex(2, 2):
        down = np.cumsum(found[i, label][::-1])
        passed[i, label] = min(most, down[-1])
        if down[-1] > most:
            k = int(np.searchsorted(down, most))
            least[i, label] = _BINS - 1 - k
            inside = down[k] - (before := down[k - 1] if k else 0)
            part[i, label] = int((most - before) / inside * _CHANCE)
    return least, part, passed


def co_train(texts: Rows, metadata: Rows, y: np.ndarray, numbered: Callable[[list[np.ndarray]], tuple],
             rounds: int = 3, share: float = 0.05, sure: float = 0.95, steps: int = 8) -> CoTrained:
    """``y``: labels of the rows; ``numbered`` gives, for keys that must be among them, the keys of both views and the
    unlabelled texts by their numbers.  Each round a view passes on at most about ``share`` of those texts for either
    label, and only what it gives a probability of ``sure``."""
    if not len(y) or y.all() or not y.any():
        return CoTrained(constant=float(y[0]) if len(y) else 1.0)
    aside = np.arange(len(y)) % 4 == 0
    if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    seen = np.flatnonzero(~aside)
    rows = (texts, metadata)
    own = [r.take(seen) for r in rows]
    first = [telling(r, y[seen] > 0, most=FEATURES) for r in own]
    keys, unlabelled, n = numbered(first)
    corpus = _Corpus(unlabelled, n, (len(keys[0]), len(keys[1])), sure)
    views = []
    for r, k, all_ in zip(own, first, keys):
        model = fit_linear(among(r, k), y[seen], len(k))
        views.append(Line(np.searchsorted(all_, k), model.w, model.b))
    own = tuple(among(r, k) for r, k in zip(own, keys))
    done, exchanged = [], []
    for _ in range(rounds if n else 0):
        least, part, passed = _cuts(corpus.confidence(done, views), max(1, int(share * n)))
        exchanged.append((int(passed[0].sum()), int(passed[1].sum())))
        if not passed.any():
            break
        done.append(Passed(views, least, part))
        views = _refitted(corpus, done, views, own, y[seen], steps)
    views = [View(k[v.at], Logistic(v.w, np.zeros(0), v.b)) for k, v in zip(keys, views)]
    judge = np.flatnonzero(aside) if aside.any() else seen
    for v, r in zip(views, rows):
        v.slope, v.offset = _calibration(v.margin(r.take(judge)), y[judge])
    both = np.stack([logit(v.prob(r.take(judge))) for v, r in zip(views, rows)], axis=1)
    last = fit_linear(Rows(np.empty(0, np.int64), np.zeros(len(judge) + 1, np.int64)), y[judge], 0, both, steps=200)
    return CoTrained(views, np.maximum(last.dense, 0), last.b, exchanged=exchanged)


def _given(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    values = [F.col(c).alias(f"m{i}") if c in docs.columns else F.lit(None).cast("string").alias(f"m{i}")
              for i, c in enumerate(metadata)]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *values)


def _both(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features of both views of a batch (id, text, metadata ...)."""
    values = list(zip(*(c.to_pylist() for c in batch.columns[2:]))) or [()] * batch.num_rows
    texts = [t.as_py() for t in batch.column(1)]
    return [text_keys(t) for t in texts], [metadata_keys(t, v) for t, v in zip(texts, values)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", metadata: tuple[str, ...] = METADATA, labelled: int = 4_000,
        rare: int = 4_000) -> CoTrained:
    """The labelled sample is chosen by a hash of the id; only its hashed features reach the driver, and only its ids
    and labels are broadcast.  All texts without a label are exchanged; features in fewer than one in ``rare`` of all
    texts, which can tell nothing, are left out."""
    given = _given(docs, id_col, text_col, metadata)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        "y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    some = hash_sample(known, "id", labelled)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            y = batch.column(batch.num_columns - 1)
            a, b = _both(pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]))
            yield pa.RecordBatch.from_arrays([y, pa.array(a, kind), pa.array(b, kind)], names=["y", "a", "b"])

    def gathered(df: DataFrame) -> tuple[Rows, Rows, np.ndarray]:
        got = df.mapInArrow(features, "y int, a array<long>, b array<long>").toArrow()
        rows = [Rows.of([np.asarray(v.values) for v in got[c]]) for c in "ab"]
        return rows[0], rows[1], np.array([float(v or 0) for v in got["y"].to_pylist()])

    texts, pages, y = gathered(given.join(F.broadcast(some), "id"))

    def numbered(needed: list[np.ndarray]) -> tuple[list[np.ndarray], DataFrame, int]:
        some = given.where(F.col("id").isNotNull())

        def present(batch):
            for i, v in enumerate(_both(batch)):
                keys, n = np.unique(np.concatenate(v), return_counts=True)
                yield np.full(len(keys), i), keys, n

        frequent = _summed(some, present, ("view", "key", "n"), 2).where(
            F.col("n") >= max(4, some.count() // rare)).toArrow()
        view, key = (frequent[c].to_numpy().astype(np.int64) for c in ("view", "key"))
        keys = [np.union1d(key[view == i], needed[i]) for i in (0, 1)]
        shared = docs.sparkSession.sparkContext.broadcast(keys)

        def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chance = batch.column(1)
                ids = pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:]], names=[
                    "id", *batch.schema.names[2:]])
                own = [among(Rows.of(v), k) for v, k in zip(_both(ids), shared.value)]
                yield pa.RecordBatch.from_arrays([batch.column(0), chance, *map(_lists, own)],
                                                 names=["id", "chance", "a", "b"])

        kind = docs.schema[id_col].dataType.simpleString()
        chance = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(_CHANCE)).alias("chance")
        features = some.select("id", chance, *some.columns[1:]).mapInArrow(
            compact, f"id {kind}, chance long, a array<int>, b array<int>")
        rest = staged(features.join(known.select("id").hint("shuffle_hash"), "id", "left_anti").select("chance", "a", "b"), "features")
        n = rest.count()
        # every task passes on sums of its own for all features, so tasks follow the texts, not the files
        return keys, rest.coalesce(max(1, n // 20_000)), n

    return co_train(texts, pages, y, numbered)


def scored(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text",
           metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """(id, text_score, metadata_score, score): one row for each of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _both(batch)
            p = shared.value.scores(Rows.of(a), Rows.of(b))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(3))],
                                             names=["id", "text_score", "metadata_score", "score"])

    return _given(docs, id_col, text_col, metadata).mapInArrow(
        run, f"id {kind}, text_score double, metadata_score double, score double")
