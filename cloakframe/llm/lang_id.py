"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Letters are lower-cased, every run of other characters becomes one blank, and the n-grams of one to four characters
are hashed into a fixed number of places.  Document frequencies are counted over all texts that may be learned
from; weights are learned on a bounded sample of them, one text at a time, by follow-the-regularised-leader with
L1 and L2 penalties, which leaves most weights at zero; on texts of the sample kept aside one temperature is
fitted, so that the highest probability can be read as a chance of being right.  Every text is then scored whole.

Defined cases: a null text and one without letters is ``und`` with score 0; rows without an id or a language are
scored but teach nothing; with nothing to learn from every text is ``und`` with score 0; with one language only,
it is predicted everywhere.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PLACES, LONGEST = 1 << 15, 4
UNKNOWN = "und"
_STEP = np.uint32(0x9E3779B1)


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the n-grams of a text, sorted by place; empty if it has no letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    known = code < len(_letters())
    letter = np.zeros(len(code), bool)
    letter[known] = _letters()[code[known]]
    letter[~known] = [chr(c).isalpha() for c in code[~known]]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.float32)
    code = np.where(letter, code, np.uint32(32))
    code = code[letter | np.concatenate([[True], letter[:-1]])]
    code = np.concatenate([[np.uint32(32)], code, [np.uint32(32)]]).astype(np.uint32)
    count = np.zeros(PLACES, np.int64)
    h = np.zeros(len(code), np.uint32)
    for n in range(1, LONGEST + 1):
        h = h[:len(code) - n + 1]
        if not len(h):
            break
        h = (h + code[n - 1:] + np.uint32(n)) * _STEP
        h ^= h >> np.uint32(15)
        count += np.bincount(h & np.uint32(PLACES - 1), minlength=PLACES)
    at = np.flatnonzero(count)
    return at, count[at].astype(np.float32)


_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x3000)]))
    return _TABLE[0]


def weighed(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic counts, of length one."""
    v = (1 + np.log(count)) * idf[at]
    return v / (math.sqrt(float(v @ v)) or 1.0)


@dataclass
class Model:
    """What a worker needs: a bounded table of places by languages."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        if not text or not self.languages:
            return None
        at, count = places(text)
        if not len(at):
            return None
        return weighed(at, count, self.idf) @ self.weights[at] + self.weights[PLACES]

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text)
        if z is None:
            return UNKNOWN, 0.0
        p = _softmax(z / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, passes: int = 3, alpha: float = 1.0,
         beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Weights (places + 1, classes) by follow-the-regularised-leader, one row at a time in shuffled order.

    ``z`` gathers gradients less what learning rates have already moved; a weight is zero while |z| stays below
    ``l1``.  The last place is the intercept, which is not penalised.
    """
    z = np.zeros((PLACES + 1, n_classes))
    n = np.zeros((PLACES + 1, n_classes))

    def leader(at: np.ndarray) -> np.ndarray:
        some, free = z[at], (at == PLACES)[:, None]
        shrunk = np.sign(some) * np.maximum(np.abs(some) - np.where(free, 0, l1), 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + np.where(free, 0, l2))

    draw = np.random.default_rng(seed)
    rows = [(np.append(at, PLACES), np.append(v, 1.0), y) for at, v, y in rows]
    for _ in range(passes):
        for i in draw.permutation(len(rows)):
            at, v, y = rows[i]
            w = leader(at)
            error = _softmax(v @ w)
            error[y] -= 1
            g = v[:, None] * error
            square = g * g
            z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / alpha * w
            n[at] += square
    return leader(np.arange(PLACES + 1)).astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""
    def loss(t: float) -> float:
        return -float(np.log(_softmax(logits / math.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    low, high, ratio = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(PLACES, np.int64)
    for batch in batches:
        for text in batch.column(0):
            total[places(text.as_py())[0]] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [places(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([a for a, _ in both], pa.list_(pa.int64())),
            pa.array([c for _, c in both], pa.list_(pa.float32())), batch.column(2)],
            names=["lang", "at", "count", "at_random"])


def _shares(counts: dict[str, int], sample: int, least: int) -> dict[str, float]:
    """The part of each language's rows that is drawn: that of the sample, or what gives ``least`` rows."""
    total = sum(counts.values())
    return {k: min(1.0, max(sample / total, least / n)) for k, n in counts.items()}


def fit(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = 4_000, least: int = 64) -> Model:
    """A model from the rows where ``may_learn`` holds and the language is given.

    Languages and document frequencies cover all of them; weights and temperature come from about ``sample`` rows
    chosen by a hash of the id, and of a rarer language from about ``least`` of its rows, or all it has, so that no
    language of the table is unknown.  Every fifth row of a language is kept aside for the temperature.  Only counts
    by language and hashed counts of the sample reach the driver.
    """
    known = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    df = np.zeros(PLACES)
    for r in known.select("text").mapInArrow(_count_texts, "place long, n long").groupBy("place").agg(
            F.sum("n").alias("n")).collect():
        df[r["place"]] = r["n"]
    counts = {r["lang"]: r["count"] for r in known.where("id is not null").groupBy("lang").count().collect()}
    idf = np.log((1 + df.max()) / (1 + df)) + 1
    languages = sorted(counts)
    if not languages:
        return Model([], idf, np.zeros((PLACES + 1, 0), np.float32))
    shares = docs.sparkSession.createDataFrame(pa.table({
        "lang": languages, "below": [int(_shares(counts, sample, least)[k] * (1 << 30)) for k in languages]}))
    drawn = known.where("id is not null").join(F.broadcast(shares), "lang").where(
        F.pmod(F.xxhash64("id", F.lit(0)), F.lit(1 << 30)) < F.col("below"))
    rows = drawn.select("lang", "text", F.xxhash64("id", "text").alias("at_random")).mapInArrow(
        _features, "lang string, at array<long>, count array<float>, at_random long").toArrow().sort_by("at_random")
    order = {name: i for i, name in enumerate(languages)}
    data, aside, seen = [], [], dict.fromkeys(languages, 0)
    for lang, at, count in zip(rows["lang"].to_pylist(), rows["at"], rows["count"]):
        at, count = np.asarray(at.values), np.asarray(count.values)
        if len(at):
            seen[lang] += 1
            (data if seen[lang] % 5 or len(rows) < 50 else aside).append((at, weighed(at, count, idf), order[lang]))
    if not data:
        return Model([], idf, np.zeros((PLACES + 1, 0), np.float32))
    weights = ftrl(data, len(languages))
    model = Model(languages, idf, weights)
    if aside:
        z = np.array([v @ weights[at] + weights[PLACES] for at, v, _ in aside])
        model.temperature = temperature(z, np.array([y for *_, y in aside]))
    return model


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([o[0] for o in out], pa.string()),
                pa.array([o[1] for o in out], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double")
