"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn. Each visit fits a shallow tree to the gradient
over that feature's bins and adds it, shrunk, to the feature's lookup table; pairs that still
explain the residual get two-dimensional tables in a second phase. A score is the sum of
table entries, looked up for whole batches at once.

Defined cases: null and empty texts have all features 0 and get a score like any other text;
without labels of both classes the score is the share of label 1 (0.5 without any label); each
row gets a row, repeated ids and null ids too (a null id is never learned from); an id on several
rows is learned once; very long texts are read whole; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, in_split, labelled_texts, share, slices

FEATURES = ("words", "word_len", "upper", "symbols", "digits", "marks", "distinct", "top_word", "repeated_lines", "line_words", "packed", "wide", "long_words", "ends")
#: Labelled rows that a model is fitted on, at most.
MAX_TRAIN_ROWS = 12_000
#: Characters of their texts, at most.
MAX_TRAIN_CHARS = 64_000_000
_SYMBOLS = re.compile(r"[#$%&*|<>{}\[\]^~=\\@_!]")
_PACK_BLOCK = 1 << 16


def text_features(text: str) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    n, words, lines = len(text), text.split(), [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    counts = Counter(words)
    letters = sum(map(len, words))
    upper = len(text) - len(re.sub(r"[A-Z]+", "", text))
    raw = text.encode("utf-8", "replace")
    packed = sum(len(zlib.compress(raw[i : i + _PACK_BLOCK], 1)) for i in range(0, len(raw), _PACK_BLOCK))
    return [
        float(np.log1p(len(words))),
        letters / w,
        upper / n,
        len(_SYMBOLS.findall(text)) / w,
        len(re.findall(r"[0-9]", text)) / n,
        sum(map(text.count, ".,;:")) / w,
        len(counts) / w**0.9,
        counts.most_common(1)[0][1] / w if counts else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words) / max(1, len(lines)))),
        packed / len(raw),
        (len(raw) - n) / n,
        sum(len(x) > 15 for x in counts) / max(1, len(counts)),
        sum(x.rstrip().endswith((".", "!", "?", ":")) for x in lines) / max(1, len(lines)),
    ]


def feature_batches(batches, keep: tuple[str, ...]):
    for b in slices(batches, "text"):
        x = np.array([text_features(t or "") for t in b.column("text").to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
        cells = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), cells], names=[*keep, "features"])


def _split_means(grad: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow tree over ordered bins: at most `leaves` runs with one Newton step each."""
    runs = [(0, len(grad))]
    step = lambda a, b: grad[a:b].sum() / (weight[a:b].sum() + 1.0)
    gain = lambda a, b: grad[a:b].sum() ** 2 / (weight[a:b].sum() + 1.0)
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for a, b in runs:
            if b - a < 2:
                continue
            g, h = np.cumsum(grad[a:b])[:-1], np.cumsum(weight[a:b])[:-1]
            all_g, all_h = grad[a:b].sum(), weight[a:b].sum()
            won = g**2 / (h + 1.0) + (all_g - g) ** 2 / (all_h - h + 1.0) - gain(a, b)
            k = int(np.argmax(won))
            if won[k] > best[0]:
                best = (won[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        a, b = best[1]
        runs[runs.index(best[1]) : runs.index(best[1]) + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in runs:
        out[a:b] = step(a, b)
    return out


@dataclass
class AdditiveModel:
    """score = sigmoid(intercept + sum of main tables + sum of pair tables)."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    main: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        if not len(x) or not self.main:
            return out
        fine, coarse = self.bins(x, self.cuts), self.bins(x, self.pair_cuts)
        for j, lookup in enumerate(self.main):
            out += lookup[fine[:, j]]
        for (i, j), lookup in zip(self.pairs, self.pair_tables, strict=True):
            out += lookup[coarse[:, i], coarse[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(x: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.15, leaves: int = 3) -> AdditiveModel:
    """Cyclic boosting of the main tables, then of the pairs with the largest residual gain."""
    rate_1 = float(y.mean()) if len(y) else 0.5
    model = AdditiveModel(float(np.log(max(rate_1, 1e-6) / max(1 - rate_1, 1e-6))))
    if len(y) == 0 or rate_1 in (0.0, 1.0):
        return model
    model.cuts, model.pair_cuts = _cuts(x, bins), _cuts(x, pair_bins)
    fine, coarse = model.bins(x, model.cuts), model.bins(x, model.pair_cuts)
    model.main = [np.zeros(len(c) + 1) for c in model.cuts]
    f = np.full(len(y), model.intercept)

    def gradient():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, lookup in enumerate(model.main):
            g, h = gradient()
            step = rate * _split_means(np.bincount(fine[:, j], g, len(lookup)), np.bincount(fine[:, j], h, len(lookup)), leaves)
            lookup += step
            f += step[fine[:, j]]
    g, h = gradient()
    gains = []
    for i, j in combinations(range(x.shape[1]), 2):
        width = len(model.pair_cuts[j]) + 1
        cell = coarse[:, i] * width + coarse[:, j]
        gains.append((float((np.bincount(cell, g) ** 2 / (np.bincount(cell, h) + 1.0)).sum()), (i, j)))
    model.pairs = [p for _, p in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), lookup in zip(model.pairs, model.pair_tables, strict=True):
            g, h = gradient()
            cell, n = coarse[:, i] * lookup.shape[1] + coarse[:, j], lookup.size
            gs, hs = (np.bincount(cell, v, n).reshape(lookup.shape) for v in (g, h))
            rows = _split_means(gs.sum(1), hs.sum(1), 2)  # one cut along the first feature, then one along the second in each part
            step = np.zeros_like(lookup)
            for part in np.unique(rows):
                at = rows == part
                step[at] = _split_means(gs[at].sum(0), hs[at].sum(0), 2)
            lookup += rate * step
            f += rate * step[coarse[:, i], coarse[:, j]]
    return model


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, held_out=None, label: str = "quality") -> AdditiveModel:
    """Fit on at most `max_rows` labelled documents outside `held_out`; only features reach the driver."""
    sample = bounded_labels(labels, label, max_rows, F.lit(False) if held_out is None else held_out)
    rows = labelled_texts(docs, sample, MAX_TRAIN_CHARS).mapInArrow(lambda it: feature_batches(it, ("_id", "label")), "_id long, label int, features array<double>").orderBy("_id").toArrow()
    x = np.array(rows.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows.column("label").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every document; one narrow pass over the texts."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        model = shared()
        for b in feature_batches(batches, ("doc_id",)):
            x = b.column("features").values.to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = in_split(F.col("doc_id"), 5, 0)
    model = train_quality(docs, labels, held_out=held_out)
    return score_quality(docs, model).select("doc_id", in_split(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
