"""Toxicity by non-negative positive-unlabelled learning.

Numpy logistic classifiers are trained from confirmed toxic texts and unlabelled ones.
With prior p, logistic loss l and scores g, their risk is
``p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])``: what the unlabelled texts cost as
negatives, less what the toxic ones among them cost, never below zero. Whenever the
second term falls below zero, a step undoes it instead. The prior is the toxic share
of all labelled training rows; labels of clean texts are used for nothing else.

A text is described by its distinct words (lower-cased A-Z, cut at other ASCII
characters) and their first 3 to 6 bytes. Document frequencies among toxic and
unlabelled training texts choose the features that take part. The classifiers differ
in the toxic and unlabelled texts they are shown; a score is their mean probability.

Training reads a bounded sample by hash of the id: POSITIVES toxic and UNLABELLED other
texts at most. Scoring reads every whole text. Null and empty texts have no features
and get the score of the bias alone. Null labels teach nothing; of a repeated label
row the most toxic one counts. Without a toxic training row every score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspool.llm.common import FOLD, REMEMBERED_WORDS, extended, fresh, pieces, share, stage, utf8

#: Toxic and unlabelled training texts at most.
POSITIVES, UNLABELLED = 8_000, 16_000
#: Features that a task counts before it sends what it has.
COUNTED = 300_000
#: Tasks that the sample is spread over.
SPREAD = 48
#: Features that take part, and classifiers in the mean.
FEATURES, CLASSIFIERS = 4_096, 3
#: A feature takes part if its shares of the two kinds of texts differ by so many standard errors and so many times.
LEAST_Z, LEAST_LIFT = 5.0, 1.5
#: Share of every class of texts shown to one classifier.
SHOWN = 0.8
STEPS, RATE, DECAY = 300, 0.05, 1e-3
#: Documents with at least this score are rejected.
THRESHOLD = 0.3
PREFIXES = (3, 4, 5, 6)


def feature_keys(word: bytes) -> list[int]:
    """Hashes of a word and its beginnings."""
    keys = [xxhash.xxh3_64_intdigest(word, 1)]
    keys += [xxhash.xxh3_64_intdigest(word[:n], 1 + n) for n in PREFIXES if len(word) > n]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


class WordFeatures(dict):
    """Features of words, remembered up to a bound; ``index`` keeps those in it as their places."""

    def __init__(self, index: dict[int, int] | None = None):
        self.index = index

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        keys = feature_keys(word)
        if self.index is not None:
            keys = [i for k in keys if (i := self.index.get(k)) is not None]
        self[word] = keys
        return keys

    def of(self, raw: bytes | None) -> Iterator[int]:
        """The features of every distinct word of a text."""
        return chain.from_iterable(map(self.__getitem__, set((raw or b"").translate(FOLD).split())))


@dataclass
class Model:
    """Weights by feature and classifier; keys are feature hashes."""

    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, rows: Iterable[bytes | None]) -> Iterator[float]:
        words = WordFeatures({int(k): i for i, k in enumerate(self.keys)})
        nothing = np.zeros(len(self.bias))
        for raw in rows:
            if not len(self.bias):
                yield 0.0
                continue
            found = Counter(words.of(raw))
            z = self.bias + (
                np.log1p(np.fromiter(found.values(), float, len(found))) @ self.weights[list(found)] if found else nothing
            )
            yield float(np.mean(1 / (1 + np.exp(-np.clip(z, -50, 50)))))


def held_out(doc_id: Column | str) -> Column:
    """Rows that no label is learned from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature the toxic and unlabelled documents of this task that have it."""
    toxic, other, words = Counter(), Counter(), WordFeatures()

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list({**toxic, **other})
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([toxic[k] for k in keys], pa.int64()),
             pa.array([other[k] for k in keys], pa.int64())], ["feature", "toxic", "other"],
        )
        toxic.clear()
        other.clear()

    for batch in pieces(batches):
        for raw, positive in zip(utf8(batch.column("text")), batch.column("positive").to_pylist(), strict=True):
            (toxic if positive else other).update(set(words.of(raw)))
            if len(toxic) + len(other) > COUNTED:
                yield from flush()
    yield from flush()


def _train(rows: list, n_features: int, prior: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the classifiers, from rows (positive, features, counts)."""
    sizes = np.array([len(r["features"]) for r in rows])
    place = np.repeat(np.arange(len(rows)), sizes)
    feature = np.concatenate([np.asarray(r["features"], np.int64) for r in rows]) if sizes.sum() else np.zeros(0, np.int64)
    value = np.log1p(np.concatenate([np.asarray(r["counts"], float) for r in rows])) if sizes.sum() else np.zeros(0)
    positive = np.array([r["positive"] for r in rows])
    weights, biases = [], []
    for k in range(CLASSIFIERS):
        shown = np.random.default_rng([seed, k]).random(len(rows)) < SHOWN
        up, uu = positive & shown, ~positive & shown
        if not up.any() or not uu.any():
            up, uu = positive, ~positive
        n_p, n_u = up.sum(), max(1, uu.sum())
        w, b = np.zeros(n_features), np.log(prior / (1 - prior))
        m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
        for step in range(1, STEPS + 1):
            g = np.bincount(place, value * w[feature], len(rows)) + b
            p = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
            cost = np.logaddexp(0, g)  # of calling it clean
            negative = cost[uu].mean() - prior * cost[up].mean() if uu.any() else 0.0
            d = np.where(up, prior * (p - 1) / n_p, 0.0)
            as_negative = np.where(uu, p / n_u, 0.0) - np.where(up, prior * p / n_p, 0.0)
            d = d + as_negative if negative >= 0 else -as_negative
            grad = np.bincount(feature, value * d[place], n_features) + DECAY * w * prior
            db = d.sum()
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            mb, vb = 0.9 * mb + 0.1 * db, 0.999 * vb + 0.001 * db**2
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            w = w - RATE * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
            b = b - RATE * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
        weights.append(w)
        biases.append(b)
    return np.array(weights).T, np.array(biases)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 42) -> Model:
    """Train on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), outside of the held-out rows."""
    empty = Model(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total, n_toxic = known.agg(F.count(F.lit(1)), F.sum(F.expr("int(toxic = 1)"))).first()
    if not n_toxic:
        return empty
    prior = min(0.9, n_toxic / total)

    def hashed(share: float, salt: int) -> Column:
        return (F.pmod(F.xxhash64("doc_id", F.lit(seed + salt)), F.lit(1 << 30)) / float(1 << 30)) < share

    chosen = known.where((F.col("toxic") == 1) & hashed(min(1.0, POSITIVES / n_toxic), 0))
    chosen = chosen.select("doc_id", F.lit(True).alias("positive"))  # about POSITIVES ids at most: broadcast
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n_docs = narrow.count()
    unlabelled = ~held_out("doc_id") & hashed(min(1.0, UNLABELLED / max(1, n_docs)), 1)
    sample = narrow.join(F.broadcast(chosen), "doc_id", "left").withColumn("unlabelled", unlabelled)
    sample = sample.where(F.col("positive") | F.col("unlabelled")).withColumn(
        "positive", F.explode(F.expr("array_compact(array(positive, if(unlabelled, false, null)))"))
    )
    sample = stage(sample.select("text", "positive").repartition(SPREAD), "toxicity")  # bounded, costly rows

    counts = sample.mapInArrow(_count_features, "feature long, toxic long, other long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), max(1, sizes.get(False, 0))
    if not n_p:
        return empty
    in_toxic, in_other = F.col("toxic") / float(n_p), F.col("other") / float(n_u)
    share = (F.col("toxic") + F.col("other")) / float(n_p + n_u)
    z = (in_toxic - in_other) / F.sqrt(share * (1 - share) * (1.0 / n_p + 1.0 / n_u) + 1e-9)
    telling = (F.abs(z) >= LEAST_Z) & ((in_toxic >= LEAST_LIFT * in_other) | (in_other >= LEAST_LIFT * in_toxic))
    top = counts.where(telling).orderBy(F.abs(z).desc(), "feature").limit(FEATURES)
    keys = np.array([r["feature"] for r in top.select("feature").collect()], np.int64)
    index = {int(k): i for i, k in enumerate(keys)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordFeatures(index)
        for batch in pieces(batches):
            found = [Counter(words.of(raw)) for raw in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), pa.array([[*f] for f in found], pa.list_(pa.int32())),
                 pa.array([[*f.values()] for f in found], pa.list_(pa.int32()))], ["positive", "features", "counts"],
            )

    rows = sample.mapInArrow(features, "positive boolean, features array<int>, counts array<int>")
    rows = sorted(rows.collect(), key=lambda r: (r["positive"], r["features"], r["counts"]))
    weights, bias = _train(rows, len(keys), prior, seed)
    return Model(keys, weights, bias)


def with_score(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) and the score from 0 to 1; ``text`` is read whole."""
    keep = docs.columns if keep is None else keep
    shared = share(docs.sparkSession, model)
    schema = extended(docs.schema, f"`{name}` double", keep)
    keep = schema.fieldNames()[:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in pieces(batches):
            values = pa.array(model.scores(utf8(batch.column("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), values], [*keep, name])

    return docs.mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold."""
    name = fresh("score", docs.columns)
    return with_score(docs, model, name).where(F.col(name) < threshold).drop(name)
