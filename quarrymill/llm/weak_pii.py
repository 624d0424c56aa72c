"""Personal data by aggregated weak supervision.

Candidates are spans that a broad pattern finds: the four base kinds, and weaker ones (mail
addresses written out, numbers without a country code, account and identity numbers, names
behind a title). Labelers of three families vote on a candidate: strict patterns and
checksums, gazetteers (top-level domains, country codes, given titles), and words of the context. A
voter says 1, 0 or abstains. Expectation-maximisation over the votes estimates each voter's
reliability and each candidate's probability without any label; a logistic classifier on span
and context features is then trained on those probabilities and decides. Base spans, which
are a contract, are always reported.

Both are fitted on every candidate of every document. What they see of a candidate is a pattern
of few values (kind, votes, length up to 60, digit share in steps of 1/16, neighbours up to 4),
so patterns are counted where the texts are, and only patterns with their counts are fitted.

Defined cases: null texts count as empty; offsets are code points, ends exclusive; rows stay
one to one with the documents, repeated ones and those without an id too; very long texts are
read whole; other columns are not read, and `mask` returns them as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest_columns, share, slices

KINDS = ("email", "ip", "card", "phone")
WEAK_KINDS = ("email_words", "account", "identity", "phone_local", "person")
#: Steps of what the classifier sees of a candidate: its length, its share of digits, its neighbours.
LENGTHS, SHARES, NEAR = 60, 16, 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Each starts with a plain class, which the regex engine skips to; what stands before a match is checked after it.
_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)
_EMAIL_WORDS = re.compile(r"(?<![\w.])[A-Za-z0-9][A-Za-z0-9._-]{1,40} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{2,40}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z]{2,12}|\.[A-Za-z]{2,12})+", re.I)
_WEAK = {
    "account": re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "identity": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone_local": re.compile(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    "person": re.compile(r"[MDPHFS][a-z]{1,4}\. [A-Z][a-z]{2,20}(?: [A-Z][a-z]{2,20})?"),
}
#: Gazetteers (fixed values).
_TLDS = frozenset("com org net edu gov io info biz de fr es uk us eu it nl ch at be pt pl ru jp cn br in ca au test example".split())
_COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "61", "81", "82", "86", "91")
_TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Mme Sr Sra".split())
_CONTEXT = {
    "email": "mail email e-mail contact write correo courriel adresse",
    "ip": "ip host server address addr login client",
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment",
    "phone": "phone tel call mobile cell fax telefon teléfono téléphone contact whatsapp",
    "account": "iban account konto compte cuenta bank transfer",
    "identity": "ssn social security id identity passport",
    "person": "name from dear by contact signed",
}
_CONTEXT = {k: frozenset(v.split()) for k, v in _CONTEXT.items()}
_GROUP = {"email_words": "email", "phone_local": "phone"}
_NEGATIVE = frozenset("version release chapter section page figure table isbn order invoice build commit license".split())
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches without scanning long runs again and again: each @ is met once."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by start and then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):  # the next match begins after the last one's fourth part
            value = ".".join(parts[i : i + 4])
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in parts[i : i + 4]):
                out.append(("ip", at, at + len(value)))
            at += len(value) + 1
    for m in _CARD.finditer(text):
        if len(m[0]) >= 14:
            digits = re.sub(r"[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates, none overlapping a base span or an earlier candidate."""
    found = [("email_words", *m.span()) for m in _EMAIL_WORDS.finditer(text)] if _AT.search(text) else []
    for kind, pattern in _WEAK.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            before = text[a - 1] if a else " "
            if kind == "phone_local":
                if before == "(":
                    a, before = a - 1, text[a - 2] if a > 1 else " "
                elif ")" in m[0]:
                    continue
                wanted = before not in "+.-"
            else:
                wanted = kind != "person" or m[0].split(".")[0] in _TITLES
            if wanted and not before.isalnum() and before not in ".-"[: 2 * (kind == "identity")]:
                found.append((kind, a, b))
    if not found:
        return []
    out, taken = [], sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    furthest = list(accumulate((b for _, b in taken), max))  # where the spans that begin so far end at most
    for k, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        i = bisect_left(starts, b)
        if (i and furthest[i - 1] > a) or (out and out[-1][2] > a):
            continue
        out.append((k, a, b))
    return out


VOTERS = ("pattern", "checksum", "gazetteer", "context", "negative_context", "neighbour", "shape")


def votes(text: str, span: tuple[str, int, int], near: int) -> list[int]:
    """1, 0 or -1 (abstains) for each of VOTERS; near: other candidates within the window."""
    kind, a, b = span
    value, group = text[a:b], _GROUP.get(kind, kind)
    digits = re.sub(r"[^0-9]", "", value)
    around = set(re.findall(r"[^\W\d_]+", (text[max(0, a - WINDOW) : a] + " " + text[b : b + WINDOW]).lower()))
    pattern = 1 if kind in KINDS else -1
    if kind == "identity":
        pattern = int(value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000")
    checksum = -1
    if kind == "card":
        checksum = int(luhn(digits))
    elif kind == "account":
        packed = value.replace(" ", "")
        checksum = int(int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1)
    gazetteer = -1
    if group == "email":
        gazetteer = int(re.split(r"[^A-Za-z0-9]+", value.rstrip(")]"))[-1].lower() in _TLDS)
    elif kind == "phone":
        gazetteer = int(digits.startswith(_COUNTRY_CODES))
    elif kind == "person":
        gazetteer = int(value.split(".")[0] in _TITLES)
    elif kind == "ip":
        gazetteer = int(digits != "0000" and not value.startswith("0."))
    context = 1 if around & _CONTEXT.get(group, frozenset()) else -1
    negative = 0 if around & _NEGATIVE else -1
    shape = int(len(set(digits)) > 2) if digits else -1
    return [pattern, checksum, gazetteer, context, negative, 1 if near else -1, shape]


def pattern(text: str, span: tuple[str, int, int], near: int) -> int:
    """All that the fit and the classifier see of a candidate, as one number."""
    kind, a, b = span
    value = text[a:b]
    key = (*KINDS, *WEAK_KINDS).index(kind)
    for v in votes(text, span, near):
        key = key * 3 + v + 1
    key = key * (LENGTHS + 1) + min(len(value), LENGTHS)
    key = key * (SHARES + 1) + round(SHARES * sum(c.isdigit() for c in value) / len(value))
    return key * (NEAR + 1) + min(near, NEAR)


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, features) of each pattern."""
    rest, near = np.divmod(keys, NEAR + 1)
    rest, digits = np.divmod(rest, SHARES + 1)
    rest, length = np.divmod(rest, LENGTHS + 1)
    v = np.zeros((len(keys), len(VOTERS)), dtype=np.int64)
    for j in reversed(range(len(VOTERS))):
        rest, v[:, j] = np.divmod(rest, 3)
    v -= 1
    kinds = rest[:, None] == np.arange(len(KINDS) + len(WEAK_KINDS))
    return v, np.column_stack([kinds, v == 1, v == 0, length / LENGTHS, digits / SHARES, near, np.ones(len(keys))]).astype(float)


@dataclass
class SpanModel:
    reliability: np.ndarray  # [voter, (P(1 | span), P(0 | span), P(1 | not), P(0 | not))]
    prior: float
    weights: np.ndarray

    def keep(self, text: str, spans: list[tuple[str, int, int]], near: list[int], threshold: float) -> list[tuple[str, int, int]]:
        if not spans:
            return []
        x = unpacked(np.array([pattern(text, s, n) for s, n in zip(spans, near, strict=True)], dtype=np.int64))[1]
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
        return [s for s, q in zip(spans, p, strict=True) if q >= threshold]


def aggregate_votes(v: np.ndarray, rounds: int = 50, count: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation: (reliabilities, prior, probability of each candidate); a row stands for `count` candidates.

    It starts from the share of votes for; counts are smoothed towards voters that are right
    more often than not, which also fixes which of the two classes is which.
    """
    said, count = v >= 0, np.ones(len(v)) if count is None else count
    q = np.where(said.any(1), (np.where(said, v, 0).sum(1) + 0.5) / (said.sum(1) + 1), 0.5) if len(v) else np.zeros(0)
    theta, prior = np.full((v.shape[1], 2), 0.5), 0.5
    for _ in range(rounds):
        prior = float(((count * q).sum() + 1) / (count.sum() + 2))
        yes, no = count * q, count * (1 - q)
        for j in range(v.shape[1]):
            s = said[:, j]
            theta[j, 0] = ((yes[s] * v[s, j]).sum() + 4) / (yes[s].sum() + 5)  # P(vote 1 | span, votes)
            theta[j, 1] = ((no[s] * v[s, j]).sum() + 1) / (no[s].sum() + 5)  # P(vote 1 | none, votes)
        log = np.full(len(q), np.log(prior) - np.log1p(-prior))
        for j in range(v.shape[1]):
            one, zero = np.log(theta[j, 0] / theta[j, 1]), np.log((1 - theta[j, 0]) / (1 - theta[j, 1]))
            log += np.where(v[:, j] == 1, one, np.where(v[:, j] == 0, zero, 0.0))
        q = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return theta, prior, q


def fit_classifier(x: np.ndarray, q: np.ndarray, count: np.ndarray, l2: float = 4.0) -> np.ndarray:
    """Logistic regression on soft targets, by Newton steps that are halved while they gain nothing.

    A row stands for `count` candidates. The penalty is on their sum, not their mean: the weight
    of a rare kind is not held down the more the larger the corpus is.
    """
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float((count * (np.logaddexp(0, z) - q * z)).sum() + l2 / 2 * w @ w)

    least = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (count * p * (1 - p))) @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (count * (q - p)) - l2 * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > least:
            size /= 2
        if size <= 1e-4 or np.abs(step).max() < 1e-8:
            break
        w += size * step
        least = loss(w)
    return w


def neighbours(spans: list[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> list[int]:
    starts = np.sort(np.array([a for _, a, _ in others], dtype=np.int64))
    return [int(np.searchsorted(starts, b + WINDOW) - np.searchsorted(starts, a - WINDOW)) - 1 for _, a, b in spans]


def count_patterns(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The patterns of all candidates of all documents, in order, and how many candidates have each."""

    def run(batches):
        found: Counter[int] = Counter()
        for b in slices(batches, "text"):
            for t in b.column("text").to_pylist():
                if t:
                    base = base_spans(t)
                    spans = [*base, *weak_spans(t, base)]
                    found.update(pattern(t, s, k) for s, k in zip(spans, neighbours(spans, spans), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])

    rows = docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    keys, n = rows.column("pattern").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def fit_spans(docs: DataFrame) -> SpanModel:
    """Fit voters and classifier on the counted patterns of all candidates."""
    keys, n = count_patterns(docs)
    v, x = unpacked(keys)
    theta, prior, q = aggregate_votes(v, count=n)
    return SpanModel(theta, prior, fit_classifier(x, q, n))


def find_spans(text: str, model: SpanModel, threshold: float) -> tuple[list, list]:
    base = base_spans(text)
    weak = weak_spans(text, base)
    return base, model.keep(text, weak, neighbours(weak, [*base, *weak]), threshold) if weak else []


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def detect(docs: DataFrame, model: SpanModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans): every base span and each weak candidate that the classifier accepts."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        model = shared()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for b in slices(batches, "text"):
            out = []
            for t in b.column("text").to_pylist():
                base, more = find_spans(t, model, threshold) if t else ([], [])
                out.append([{"kind": k, "start": s, "end": e, "base": own} for own, spans in ((True, base), (False, more)) for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {_SPANS}")


def mask(docs: DataFrame, model: SpanModel, threshold: float = 0.5) -> DataFrame:
    """`docs`, all rows and columns, with each span in `text` replaced by its kind in brackets."""
    shared = share(docs.sparkSession, model)
    at = docs.columns.index("text")

    def run(batches):
        model = shared()
        for b in slices(batches, "text"):
            texts = []
            for t in b.column(at).to_pylist():
                if t:
                    base, more = find_spans(t, model, threshold)
                    parts, free = [], 0
                    for k, s, e in sorted([*base, *more], key=lambda x: (x[1], -x[2])):
                        if s >= free:
                            parts += [t[free:s], f"[{k.upper()}]"]
                        free = max(free, e)
                    t = "".join([*parts, t[free:]])
                texts.append(t)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def pii_query(docs: DataFrame) -> DataFrame:
    return digest_columns(detect(docs, fit_spans(docs)), KINDS)
