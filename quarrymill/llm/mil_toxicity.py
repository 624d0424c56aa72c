"""Toxicity: multiple-instance learning over the sentences of a document.

A sentence has the probability sigmoid(bias + sum of the weights of its distinct words), where
a word weighs what it and its stems (prefixes) weigh; the document's probability is their
noisy-or, 1 - prod(1 - p). Only documents carry labels:
gradients flow through the noisy-or to the sentences, which are then located by their own
probability.

Defined cases: null or empty texts have no sentence and score 0; without labels every
sentence gets the weightless prior; each row gets a row, repeated ids and null ids too (a null
id is never learned from); an id on several rows is learned once; very long texts are read
whole; other columns are not read, and `keep_clean` returns them as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, forget_kept, in_split, labelled_texts, share, slices

#: Labelled documents that a model is fitted on, at most, and characters of their texts.
MAX_TRAIN_ROWS, MAX_TRAIN_CHARS = 8_000, 48_000_000
#: Words and stems that fewer sampled documents contain get no weight.
MIN_DOCS = 5
#: Lengths of the prefixes that count as stems; a "*" marks them among the features.
STEMS = (4, 5, 6, 7)
#: Word weights, or counted features, that a worker holds before it starts anew.
CACHE = 150_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans (code points, end exclusive) between sentence ends and line breaks."""
    return [m.span() for m in _SENTENCE.finditer(text) if m[0].strip()]


def words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class _Remembered(dict):
    """Weights of words, from those of their features."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        get = self.weights.get
        w = sum(get(x, 0.0) for x in word_features(word))
        if len(word) < 64:
            self[word] = w
        return w


@dataclass
class InstanceModel:
    bias: float
    weights: dict[str, float]

    def scorer(self):
        """A function of (text, spans) that gives the sentences' probabilities."""
        weight_of = _Remembered(self.weights).__getitem__

        def scores(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
            lower = text.lower()
            if len(lower) == len(text):
                found = (_WORD.findall(lower, a, b) for a, b in spans)
            else:  # a few letters change length; then each sentence is lowered alone
                found = (_WORD.findall(text[a:b].lower()) for a, b in spans)
            margins = np.array([sum(map(weight_of, set(x))) for x in found], dtype=np.float64)
            return 1 / (1 + np.exp(-np.clip(margins + self.bias, -40, 40)))

        return scores


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) + 0.0  # of no sentence: 0, not -0


def telling(a, b, n1, n0, least):
    """Whether a feature's rates among n1 and n0 documents, of which a and b hold it, differ by over 2.5 standard errors. Of columns or arrays."""
    mean = (a + b) / (n0 + n1)
    return (a + b >= least) & ((a / n1 - b / n0) * (a / n1 - b / n0) > 6.25 * mean * (1 - mean) * (1 / n0 + 1 / n1))


def fit_weights(ids: np.ndarray, sent: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, n_features: int, epochs: int = 150, rate: float = 0.1, l2: float = 3e-4) -> np.ndarray:
    """Adam on the noisy-or likelihood; ids: features, sent: the sentence of each, doc: the document of each sentence. The last weight is the bias."""
    weight = weight / weight.sum()
    params = np.zeros(n_features + 1)
    params[-1] = -5.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sent, params[ids], len(doc)) + params[-1], -30, 30)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        any_ = np.maximum(-np.expm1(none), 1e-9)
        # d log-likelihood / d margin of a sentence: p * (y * (1 - P) / P - (1 - y))
        pull = (weight * np.where(y == 1, np.exp(none) / any_, -1.0))[doc] * p
        grad = np.append(np.bincount(ids, pull[sent], n_features), pull.sum())
        grad[:-1] -= l2 * params[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - 0.9 * t / epochs)
    return params


def feature_ids(text: str, place: dict[str, int]) -> tuple[list[int], list[int]]:
    """The known features of a text's sentences, one after the other, and how many each sentence has."""
    ids, sizes = [], []
    for a, z in sentences(text):
        known = [place[f] for w in sorted(words(text[a:z])) for f in word_features(w) if f in place]
        ids += known
        sizes.append(len(known))
    return ids, sizes


def document_features(text: str) -> set[str]:
    return {f for w in words(text) for f in word_features(w)}


def model_of(rows: list[tuple[list[int], list[int], float, float]], features: list[str]) -> InstanceModel:
    """rows: of each document, its features' ids, its sentences' sizes, label and weight."""
    if not rows:
        return InstanceModel(-6.0, {})
    ids = np.concatenate([np.asarray(r[0], dtype=np.int32) for r in rows])
    sizes = np.concatenate([np.asarray(r[1], dtype=np.int64) for r in rows])
    sent, doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    params = fit_weights(ids, sent, doc, np.array([r[2] for r in rows], dtype=np.float64), np.array([r[3] for r in rows], dtype=np.float64), len(features))
    return InstanceModel(float(params[-1]), {x: float(params[i]) for i, x in enumerate(features) if abs(params[i]) > 1e-3})


def count_features(rows: DataFrame) -> DataFrame:
    """(feature, n1, n0): how many documents of either label hold each feature; summed up within a task first."""

    def run(batches):
        forget_kept()
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def batch():
            names = list(found[0].keys() | found[1].keys())
            columns = pa.array(names, pa.string()), pa.array([found[1][x] for x in names], pa.int64()), pa.array([found[0][x] for x in names], pa.int64())
            found[0].clear()
            found[1].clear()
            return pa.RecordBatch.from_arrays(list(columns), names=["feature", "n1", "n0"])

        for b in slices(batches, "text"):
            for t, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                found[int(label == 1)].update(document_features(t))
                if len(found[0]) + len(found[1]) > CACHE:
                    yield batch()
        yield batch()

    return rows.select("text", "label").mapInArrow(run, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, held_out=None, label: str = "toxic") -> InstanceModel:
    """Fit on at most `max_rows` labelled documents outside `held_out`, half of each label where there are so many, and MAX_TRAIN_CHARS of their texts.

    Features are counted and chosen where the texts are; only chosen ones reach the driver, all of
    them: each is in MIN_DOCS of these texts at least, so that the bounds on rows and characters hold.
    """
    sample = bounded_labels(labels, label, max_rows, F.lit(False) if held_out is None else held_out, balanced=True)
    rows = labelled_texts(docs, sample, MAX_TRAIN_CHARS)
    n1, n0 = (max(1, n or 0) for n in rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)).first())
    told = count_features(rows).filter(telling(F.col("n1"), F.col("n0"), float(n1), float(n0), MIN_DOCS))
    features = sorted(r["feature"] for r in told.select("feature").collect())
    shared = share(docs.sparkSession, {x: i for i, x in enumerate(features)})

    def run(batches):
        forget_kept()
        place = shared()
        for b in slices(batches, "text"):
            ids, sizes = zip(*(feature_ids(t, place) for t in b.column("text").to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("label"), b.column("weight"), pa.array(ids, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], names=["_id", "label", "weight", "ids", "sizes"])

    got = rows.select("_id", "label", "weight", "text").mapInArrow(run, "_id long, label int, weight double, ids array<int>, sizes array<int>").orderBy("_id").toArrow()
    columns = [got.column(c) for c in ("ids", "sizes", "label", "weight")]
    return model_of([(i.values, s.values, y.as_py(), w.as_py()) for i, s, y, w in zip(*columns, strict=True)], features)


def score_toxicity(docs: DataFrame, model: InstanceModel, threshold: float = 0.3, locate: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, offending): offending lists the sentences at or above `locate`."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        forget_kept()
        score = shared().scorer()
        for b in slices(batches, "text"):
            scores, found = [], []
            for t in b.column("text").to_pylist():
                spans = sentences(t) if t else []
                p = score(t, spans) if spans else np.zeros(0)
                scores.append(noisy_or(p))
                found.append([{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= locate)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "offending"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = in_split(F.col("doc_id"), 4, 2)
    model = train_toxicity(docs, labels, held_out=held_out)
    return score_toxicity(docs, model).select("doc_id", in_split(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted", "offending")


def keep_clean(docs: DataFrame, model: InstanceModel, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below `threshold`."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        forget_kept()
        score = shared().scorer()
        for b in slices(batches, "text"):
            keep = [not t or noisy_or(score(t, sentences(t))) < threshold for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
