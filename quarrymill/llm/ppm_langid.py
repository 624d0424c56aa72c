"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts is counted on a bounded sample and
then frozen. A byte costs -log2 of its probability under escape method C with exclusions, so
that each context gives a true distribution over the 256 bytes; a text's language is the one
whose tree codes it in the fewest bits. Under frozen counts, the cost of a byte depends only
on the longest context known, so the trees become one automaton: a transition and one cost
per language for each state and byte, walked by all segments of a batch in lockstep.

Every language gets a tree, and its contexts do not depend on what other languages there are.
Languages are dealt into blocks of LANGUAGES_PER_BLOCK, each with an automaton of its own: more
languages take more walks over a text. One automaton is at work at a time.

Texts are lower-cased and their white space is collapsed first. Defined cases: a text that is
null or has no letter is `und` with score 0, and so is every text if nothing could be learned;
ties go to the language that sorts first; repeated rows and rows without an id get their own
row each, and the latter are never learned from; very long texts are coded whole, in segments;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_split, materialize, slices

ORDER = 4
#: Sampled documents of a language, about.
DOCS_PER_LANGUAGE = 1_500
#: Contexts of a language's tree, at most; rarer ones are pruned from it.
MAX_STATES = 6_000
#: Languages of one automaton.
LANGUAGES_PER_BLOCK = 4
SEGMENT = 512
_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; signs that only count, as ½ and Ⅷ, are none."""
    return bool(text) and any(any(map(str.isalpha, m[0])) for m in _WORD.finditer(text))


def normal_bytes(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").split())


def grams(data: bytes, order: int = ORDER) -> np.ndarray:
    """Each byte with the `order` bytes before it, as integers; spaces stand before the text."""
    b = np.frombuffer(b" " * order + data, dtype=np.uint8).astype(np.int64)
    out = np.zeros(len(data), dtype=np.int64)
    for j in range(order + 1):
        out = out << 8 | b[j : j + len(data)]
    return out


@dataclass
class ByteAutomaton:
    languages: list[str]
    classes: np.ndarray  # byte -> class; the last class stands for each byte never seen
    step: np.ndarray  # [state * classes + class] -> state
    cost: np.ndarray  # [state * classes + class, language] -> bits
    start: int
    order: int

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language, each byte counted once."""
        out = np.zeros((len(texts), len(self.languages)))
        rows, group, size = [], [], 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), SEGMENT):
                rows.append(t[max(0, a - self.order) : a] .rjust(self.order, b" ") + t[a : a + SEGMENT])
                group.append(i)
                if len(rows) == 8192:
                    self._walk(rows, group, out)
                    rows, group = [], []
        if rows:
            self._walk(rows, group, out)
        return out

    def _walk(self, rows: list[bytes], group: list[int], out: np.ndarray) -> None:
        rows, group = zip(*sorted(zip(rows, group, strict=True), key=lambda x: -len(x[0])), strict=True)
        lengths = np.array([len(x) for x in rows])
        width, n_classes = int(lengths[0]), int(self.classes.max()) + 1
        flat = np.frombuffer(b"".join(x.ljust(width, b" ") for x in rows), dtype=np.uint8).reshape(len(rows), width)
        symbols = np.ascontiguousarray(self.classes[flat].T)
        alive = np.searchsorted(-lengths, -np.arange(width), side="left")  # rows longer than t, as they are sorted
        state = np.full(len(rows), self.start, dtype=np.int32)
        bits = np.zeros((len(rows), len(self.languages)), dtype=np.float64)
        for t in range(width):
            n = int(alive[t])
            at = state[:n] * np.int32(n_classes) + symbols[t, :n]
            if t >= self.order:
                bits[:n] += self.cost[at]
            state[:n] = self.step[at]
        np.add.at(out, np.array(group), bits)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in sorted `keys`, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, max_states: int = MAX_STATES) -> ByteAutomaton | None:
    """counts: language -> (grams, how often). Returns None without any."""
    languages = sorted(k for k, (g, _) in counts.items() if len(g))
    if not languages:
        return None
    seen = np.unique(np.concatenate([counts[k][0] & 255 for k in languages]))
    classes = np.full(256, len(seen), dtype=np.int32)
    classes[seen] = np.arange(len(seen))
    n_classes = len(seen) + 1
    by_order = {}  # language, k -> contexts of k bytes, their totals
    for k in languages:
        for n in range(order + 1):
            ctx, inverse = np.unique((counts[k][0] >> 8) & ((1 << 8 * n) - 1), return_inverse=True)
            by_order[k, n] = ctx, np.bincount(inverse, counts[k][1])
    kept: dict[tuple[str, int], np.ndarray] = {}
    for k in languages:
        least = 2
        while True:
            kept[k, 0] = by_order[k, 0][0]
            for n in range(1, order + 1):
                ctx, total = by_order[k, n]
                ctx = ctx[total >= least]
                closed = (_lookup(kept[k, n - 1], ctx >> 8) >= 0) & (_lookup(kept[k, n - 1], ctx & ((1 << 8 * (n - 1)) - 1)) >= 0)
                kept[k, n] = ctx[closed]
            if sum(len(kept[k, n]) for n in range(order + 1)) <= max_states:
                break
            least = int(np.ceil(least * 1.3))
    union = [np.unique(np.concatenate([kept[k, n] for k in languages])) for n in range(order + 1)]
    first = np.cumsum([0, *map(len, union)])
    n_states = int(first[-1])
    # Transitions: the longest known suffix of context + byte.
    step = np.zeros((n_states, n_classes), dtype=np.int32)
    for n, ctx in enumerate(union):
        for s, byte in enumerate(seen):
            longer, found = (ctx << 8) | int(byte), np.zeros(len(ctx), dtype=np.int64)
            for m in range(min(n + 1, order) + 1):
                at = _lookup(union[m], longer & ((1 << 8 * m) - 1))
                found = np.where(at >= 0, first[m] + at, found)
            step[first[n] : first[n + 1], s] = found
    cost = np.zeros((n_states, n_classes, len(languages)), dtype=np.float32)
    for li, k in enumerate(languages):
        g, c = counts[k]
        tables = []
        for n in range(order + 1):
            at = _lookup(kept[k, n], (g >> 8) & ((1 << 8 * n) - 1))
            dense = np.zeros((len(kept[k, n]), n_classes))
            np.add.at(dense, (at[at >= 0], classes[g & 255][at >= 0]), c[at >= 0])
            tables.append(dense)
        for n, ctx in enumerate(union):
            escape, done = np.ones(len(ctx)), np.zeros((len(ctx), n_classes), dtype=bool)
            p = np.zeros((len(ctx), n_classes))
            for m in range(n, -1, -1):
                at = _lookup(kept[k, m], ctx & ((1 << 8 * m) - 1))
                has = np.where(at[:, None] >= 0, tables[m][np.maximum(at, 0)], 0.0) * ~done
                total, distinct = has.sum(1), (has > 0).sum(1)
                some = total > 0
                share_ = np.where(some, escape / np.maximum(total + distinct, 1), 0.0)
                p += has * share_[:, None]
                escape = np.where(some, distinct * share_, escape)
                done |= has > 0
            left = 256 - done.sum(1)
            p = np.where(done, p, (escape / np.maximum(left, 1))[:, None])
            cost[first[n] : first[n + 1], :, li] = -np.log2(np.maximum(p, 1e-30))
    spaces = [int(a) for m in range(order + 1) if (a := _lookup(union[m], np.array([int.from_bytes(b" " * m, "big")]))[0]) >= 0 and (a := first[m] + a) >= 0]
    return ByteAutomaton(languages, classes, step.ravel(), cost.reshape(-1, len(languages)), spaces[-1], order)


def train_language_trees(docs: DataFrame, train: "F.Column", docs_per_language: int = DOCS_PER_LANGUAGE) -> list:
    """Broadcast automata, a block of languages each, counted on about `docs_per_language` documents of each language where `train` holds.

    The sample is drawn by a hash of the id; grams are counted where the texts are, and only
    sums over the sample reach the driver, one block at a time.
    """
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    slots = 1_000_000
    most = F.floor(F.least(F.lit(1.0), F.lit(docs_per_language) / F.col("_n")) * slots)
    sample = rows.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < most).select("lang", "text")

    def count(batches):
        for b in slices(batches, "text"):
            found: dict[str, list[np.ndarray]] = {}
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found.setdefault(lang, []).append(grams(normal_bytes(t)))
            for lang, parts in found.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    if len(languages) > LANGUAGES_PER_BLOCK:
        counted = materialize(counted, "grams")
    sent = []
    for a in range(0, len(languages), LANGUAGES_PER_BLOCK):
        block = languages[a : a + LANGUAGES_PER_BLOCK]
        got = counted.filter(F.col("lang").isin(block)).orderBy("lang", "gram").toArrow()
        langs, keys, n = got.column("lang").to_numpy(), got.column("gram").to_numpy(), got.column("n").to_numpy()
        model = build({k: (keys[langs == k], n[langs == k]) for k in block})
        if model is not None:
            sent.append(docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model)))
    return sent


def identify(docs: DataFrame, sent: list) -> DataFrame:
    """(doc_id, lang_pred, score): score is the posterior of the language under equal priors."""

    def run(batches):
        def block(s):
            model = pickle.loads(s.value)
            s.__dict__.pop("_value", None)  # read again from the executor's file when needed: one block is held at a time
            return model

        only = [block(sent[0])] if len(sent) == 1 else None
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            letters = [bool(sent) and has_letter(t) for t in texts]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            known = np.flatnonzero(letters)
            if len(known):
                data = [normal_bytes(texts[i]) for i in known]
                names, parts = [], []
                for model in only or map(block, sent):
                    names += model.languages
                    parts.append(model.code_lengths(data))
                bits = np.hstack(parts)
                best = bits.argmin(1)
                rest = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                scores[known] = 1 / rest
                for i, k in zip(known, best, strict=True):
                    langs[i] = names[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    held_out = in_split(F.col("doc_id"), 3, 1)
    sent = train_language_trees(docs, ~held_out & F.col("doc_id").isNotNull())
    return identify(docs, sent).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
