"""How removal filters interact, by the multilinear extension of what they remove.

Each document fails a set of the five filters. A part's counts of these sets give one polynomial
with a variable for each filter: the expected number of documents removed when each filter is
applied with the probability that its variable has,

    R(x) = sum over T of a(T) * product of x_i in T,   a(T) = (-1)^(|T| + 1) * documents that fail all of T.

At a corner it is the number that a set of filters removes, from which every order's survivors
follow. The integral of its partial derivative along the diagonal is a filter's Shapley value, the
mean of what it removes over all orders; times 120 it is the sum over them, a whole number.

Texts never leave their rows: a row becomes a mask and a digest, equal digests are grouped after
combining on the map side, and masks are counted for each part.

Defined cases: a null text is an empty one, a null source is the part ''; text without a word fails
A alone, unless E; a null doc_id is neither smaller nor larger than another, and has no label; rows
that share a doc_id are one document each, and none of them is smaller than the other; of several
labels of a doc_id any 1 counts; very long texts are taken whole; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, materialize

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Partitions over which rows without an id are dealt where rows meet their labels.
NULL_SALTS = 1024
_WHITE = r"[\x20\x09-\x0D]+"


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of each row; bits 0 to 3 of the mask are failures of A to D. One narrow pass."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", _WHITE), "")
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * upper.cast("long") > 2 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents that fail exactly the filters of each mask, and those labelled good and toxic.

    Only texts that occur more than once, and labels that are 1, have to meet the rows again: they
    are written and counted, broadcast up to a bound, else joined with plain sides, so that adaptive
    execution can split a text that many rows share.
    """
    rows = materialize(marked(docs), "marked")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null")
    firsts = counted(firsts.select("digest", "first"), "firsts")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    flags = counted(flags.filter("good + toxic > 0").withColumn("salt", F.lit(0)), "flags")
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SALTS))).otherwise(F.lit(0)).cast("int")
    rows = rows.join(firsts, "digest", "left").withColumn("salt", salt).join(flags, ["doc_id", "salt"], "left")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << 4)).otherwise(F.lit(0))
    return rows.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficient of each product of variables, from the number of documents that fail exactly each set."""
    over = list(counts)
    for i in range(len(FILTERS)):
        for s in range(SETS):
            if not s >> i & 1:
                over[s] += over[s | 1 << i]  # at last: documents that fail at least the set
    return [0] + [(-1) ** (t.bit_count() + 1) * over[t] for t in range(1, SETS)]


def corner(polynomial: list[int], filters: int) -> int:
    """The polynomial where the variables of `filters` are 1 and all others 0."""
    return sum(a for t, a in enumerate(polynomial) if t & ~filters == 0)


def shapley(polynomial: list[int], i: int) -> Fraction:
    """The integral from 0 to 1 of the i-th partial derivative with all variables equal."""
    return sum((Fraction(a, t.bit_count()) for t, a in enumerate(polynomial) if t >> i & 1), Fraction(0))


def _steps() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All orders, and for each of their steps: the filters before it, with it, and its own."""
    orders = list(permutations(range(len(FILTERS))))
    own = np.array(orders)
    through = np.cumsum(1 << own, axis=1)
    return ["".join(FILTERS[i] for i in o) for o in orders], through - (1 << own), through, own


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: what its filter removes there, and what that costs."""
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def run(frames):
        orders, before, through, own = _steps()
        steps = own.shape[1]
        for frame in frames:
            for part, held in zip(frame["part"], frame["counts"], strict=True):
                of = {k: [0] * SETS for k in ("n", "good", "toxic")}
                for x in held:
                    for k, counts in of.items():
                        counts[x["mask"]] += int(x[k])
                polynomials = {k: removal_polynomial(counts) for k, counts in of.items()}
                at = {k: np.array([corner(p, s) for s in range(SETS)], dtype=np.int64) for k, p in polynomials.items()}
                gone = {k: a[through] - a[before] for k, a in at.items()}
                summed = [120 * shapley(polynomials["n"], i) for i in range(steps)]
                single = 1 << own
                yield pd.DataFrame(
                    {
                        "part": part,
                        "filter_order": np.repeat(orders, steps),
                        "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders)),
                        "kept": (sum(of["n"]) - at["n"][through]).ravel(),
                        "removed": gone["n"].ravel(),
                        "redundant": (at["n"][single] - gone["n"]).ravel(),
                        "unique_fails": np.array(of["n"], dtype=np.int64)[single].ravel(),
                        "good_lost": gone["good"].ravel(),
                        "toxic_lost": gone["toxic"].ravel(),
                        "shapley": np.array([int(x) for x in summed], dtype=np.int64)[own].ravel(),
                    }
                )

    return parts.mapInPandas(run, SCHEMA)


#: Every document is taken through every order, one filter after the other.
AUDIT_SQL = r"""WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, k.i AS step, o[k.i] AS own, o[1 : k.i - 1] AS before FROM o, i k),
x AS (SELECT part, o, step, own, n, good, toxic, fails[own] AS fail, len(list_filter(before, lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda b: b)) AS all_fails FROM c, s),
r AS (SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', j::INT, 1)), '') AS filter_order, step::INT AS step, own, sum(n) FILTER (NOT gone AND NOT fail) AS kept, sum(n) FILTER (fail AND NOT gone) AS removed,
  sum(n) FILTER (fail AND gone) AS redundant, sum(n) FILTER (fail AND all_fails = 1) AS unique_fails, sum(good) FILTER (fail AND NOT gone) AS good_lost, sum(toxic) FILTER (fail AND NOT gone) AS toxic_lost FROM x GROUP BY part, o, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r"""
