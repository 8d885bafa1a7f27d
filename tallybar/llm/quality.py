"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = logistic(w . x - t_k) with one weight vector w for all grades and ordered thresholds t_0 < t_1 < ...
A text's features x are the presence of its words and of their heads, and of its shape (shares of capitals, symbols, digits, repeated words
and lines, word lengths, each in steps), hashed into a table of fixed size. The expected grade is the sum of the tail
probabilities; a document is kept if the probability of the best grade reaches a bound.

Weights are fitted by accelerated proximal gradient steps with an L1 penalty, on a sample of labelled documents of at most
``sample`` (those with the smallest hash of their id). Features of the sample are made where its texts are read; the fit is
one task of an executor, since its rows are bounded, and the driver gets nothing but the weights that are not zero.

Defined results: a null or empty text has only shape features; labels without grade or document count for nothing, nor does
a label of good quality without toxicity; of repeated labels of one document the smallest grade counts, and of documents
with one id the one whose features come first; without any label, or with labels of a single grade, nothing can be told
and every document is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybar.llm.common import by_row, columns
from tallybar.llm.license_scan import words_of

SAMPLE = 10_000
BITS = 18
PENALTY = 1e-4
STEPS = 250
#: Added to a feature's frequency in the length of its steps.
RARE = 0.005
#: Bytes of a word's head, which is a feature too.
HEAD = 4
BOUND = 0.5
GRADES = 3
#: Classes of bytes whose shares are features: capitals, digits, closing marks, other ASCII symbols, beyond ASCII.
_CLASS = np.array([0 if 65 <= b <= 90 else 1 if 48 <= b <= 57 else 2 if b in b".,;:?'\"()-" else 4 if b >= 128 else 3 if 33 <= b <= 126 and not 97 <= b <= 122 else 5 for b in range(256)])
_STEPS = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])


class _Hashed(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        at = self[word] = xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)
        return at


_AT = _Hashed()


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for low quality, 1 for good but toxic, 2 for good."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def shape(text: str, words: list[bytes]) -> list[bytes]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(len(raw), 1)
    by_class = np.bincount(_CLASS[raw], minlength=6)[:5] / n
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words)) / max(len(words), 1)
    repeats = sum(map(bytes.__eq__, words, words[1:])) / max(len(words), 1)
    again = 1 - len(set(lines)) / max(len(lines), 1)
    tokens = text.split()
    marked = sum(not t[-1].isalnum() for t in tokens) / max(len(tokens), 1)
    length = len(raw) / max(len(tokens), 1) / 40
    shares = [*by_class.tolist(), 1 - distinct, repeats, again, marked, length]
    return [b"\0%d:%d" % (i, s) for i, s in enumerate(np.searchsorted(_STEPS, shares, side="right").tolist())] + [b"\0size:%d" % len(words).bit_length()]


def features(text: str | None) -> np.ndarray:
    """Places of the features that a text has, each once."""
    words = words_of(text).split()
    distinct = set(words)
    heads = {b"\1" + w[:HEAD] for w in distinct}
    return np.unique(np.fromiter(map(_AT.__getitem__, [*distinct, *heads, *shape(text or "", words)]), np.int64))


@dataclass
class Model:
    """The weights that are not zero, by place, and the thresholds."""

    places: np.ndarray
    values: np.ndarray
    thresholds: np.ndarray

    @cached_property
    def weights(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.places] = self.values
        return out

    def tails(self, places: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) by row and k."""
        size = np.array([len(p) for p in places])
        flat = np.concatenate(places) if len(places) else np.empty(0, np.int64)
        score = np.bincount(np.repeat(np.arange(len(places)), size), weights=self.weights[flat], minlength=len(places))
        return logistic(score[:, None] - self.thresholds[None, :])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then logarithms of the gaps."""
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def fit(places: list[np.ndarray], grades: np.ndarray, penalty: float = PENALTY, steps: int = STEPS, n_grades: int = GRADES) -> Model:
    """Maximum likelihood under an L1 penalty; words that few rows have are left out by it."""
    n = len(places)
    size = np.array([len(p) for p in places])
    flat, begin = np.concatenate(places).astype(np.int32, copy=False), np.cumsum(size) - size  # every text has features
    used = np.flatnonzero(np.bincount(flat, minlength=1 << BITS))
    number = np.zeros(1 << BITS, np.int32)
    number[used] = np.arange(len(used))
    at, owner = number[flat], np.repeat(np.arange(n, dtype=np.int32), size)
    del flat, number
    w, raw = np.zeros(len(used)), np.zeros(n_grades - 1)
    tail = np.array([np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(n_grades - 1)])
    start = -np.log(tail / (1 - tail))
    raw[0], raw[1:] = start[0], np.log(np.maximum(np.diff(start), 0.05))
    curve = np.bincount(at, minlength=len(used)) / n  # of each coordinate: how often the feature occurs
    rate = 1.0 / (curve + RARE)  # coordinate-wise steps; halved whenever the loss rises
    wy, ry, t, scale, last = w.copy(), raw.copy(), 1.0, 0.25, np.inf
    for _ in range(steps):
        score = np.add.reduceat(wy[at], begin)
        theta = _thresholds(ry)
        upper = np.concatenate([np.full((n, 1), 40.0), score[:, None] - theta[None, :], np.full((n, 1), -40.0)], axis=1)
        f = logistic(upper)
        i = np.arange(n)
        mass = np.maximum(f[i, grades] - f[i, grades + 1], 1e-12)
        slope = f * (1 - f)
        slope[:, 0] = slope[:, -1] = 0
        loss = -np.log(mass).mean() + penalty * np.abs(wy).sum()
        if loss > last:
            scale, wy, ry, t = max(scale * 0.7, 1e-3), w.copy(), raw.copy(), 1.0
        last = loss
        d_score = -(slope[i, grades] - slope[i, grades + 1]) / mass / n
        d_theta = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            d_theta[k] = (slope[i, k + 1] * ((grades == k + 1) / mass - (grades == k) / mass)).sum() / n
        d_raw = np.concatenate([[d_theta.sum()], np.exp(ry[1:]) * np.cumsum(d_theta[::-1])[::-1][1:]])
        g = np.bincount(at, weights=d_score[owner], minlength=len(used))
        step = scale * rate
        moved = wy - step * g
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_raw = ry - scale * 4 * d_raw
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        wy, ry = new + (t - 1) / after * (new - w), new_raw + (t - 1) / after * (new_raw - raw)
        w, raw, t = new, new_raw, after
    told = np.flatnonzero(w)
    return Model(used[told], w[told], _thresholds(raw))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a sample of labelled documents; None if they have fewer than two grades."""
    rows = columns(labels, doc_id="long", quality="int", toxic="int").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")).dropna()
    chosen = rows.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = columns(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")  # `chosen` has `sample` rows at most
    marked = by_row(met.select("doc_id", "grade", "text"), lambda texts: {"places": [features(t).astype(np.int32).tobytes() for t in texts]}, "doc_id long, grade int, places binary", ("doc_id", "grade"))
    once = marked.groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("places").alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = sorted(row for batch in batches for row in zip(batch["doc_id"].tolist(), batch["grade"].tolist(), batch["places"].tolist(), strict=True))
        grades = np.array([g for _, g, _ in found], np.int64)
        if len(np.unique(grades)) < 2:
            return
        places = [np.frombuffer(p, np.int32) for _, _, p in found]
        del found
        model = fit(places, grades)
        yield pd.DataFrame({"places": [model.places.astype(np.int32).tobytes()], "values": [model.values.tobytes()], "thresholds": [model.thresholds.tobytes()]})

    got = once.coalesce(1).mapInPandas(run, "places binary, values binary, thresholds binary").collect()  # one row
    return Model(np.frombuffer(got[0]["places"], np.int32), np.frombuffer(got[0]["values"]), np.frombuffer(got[0]["thresholds"])) if got else None


def scored(docs: DataFrame, model: Model | None, bound: float = BOUND) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the best grade) and keep of every row."""

    def make(texts: list) -> dict:
        tails = np.ones((len(texts), GRADES - 1)) if model is None else model.tails([features(t) for t in texts])
        return {"expected_grade": tails.sum(1), "tail_probability": tails[:, -1], "keep": tails[:, -1] >= bound}

    return by_row(columns(docs, doc_id="long", text="string"), make, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def kept(docs: DataFrame, model: Model | None, bound: float = BOUND) -> DataFrame:
    """The documents that the model keeps, with all their columns."""
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(model.tails([features(t) for t in text])[:, -1] >= bound)

    return docs.where(good(F.col("text").cast("string")))
