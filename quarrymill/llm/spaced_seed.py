"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask of ones and zeros is laid over every run of tokens; only the positions under ones are
hashed, so that a changed token under a zero does not hide a copy. Benchmark and training
hashes of the same mask are joined; around each hit the two texts are compared token by token
along the hit's diagonal, and enough equal tokens confirm an overlap in spite of substitutions.

The hashes of the benchmark are broadcast in slices of a fixed number of rows, each with only
the tokens around its place: a larger benchmark takes more passes over the texts, never more
memory. The texts are not shuffled.

Short items get lighter masks too and are compared whole: an item of 5 to 16 tokens is found
wherever PART of its tokens, rounded up, stand in their places, whichever the others are.

Defined cases: an item of fewer than SHORTEST tokens is too common to be sought inside texts and
is found where it is the whole text; null and empty texts and items have no tokens and are never
found; a (document, item) pair is reported once, with its best overlap, however often the row or
the passage repeats, and of equal ones the first; texts without an id share the null id; very
long texts are read whole; other columns are not read, and `keep_uncontaminated` returns them as
they are; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted

#: Masks of span 12, two of weight 8 that share few shifted positions and two of weight 6 (fixed values).
MASKS = ("110110010111", "111010011011", "110010001011", "101001100101")
SPAN = len(MASKS[0])
#: Items of SHORTEST tokens, but fewer than WHOLE, get these as well. Whichever tokens of an item of up to 16 are
#: changed, one of these is left untouched if PART of the tokens is (tested for all choices).
LIGHT = ("11101", "100111", "1101001", "11000101", "1010011", "1111", "11011", "10111")
SHORTEST, WHOLE = 5, 24
#: Tokens compared on each side of a hit; equal tokens that confirm it, their part of a shorter item, and their least share.
AROUND, EQUAL, PART, SHARE = 8, 12, 0.7, 0.5
#: Rows of benchmark hashes in one broadcast, of at most 28 tokens each: about 30 MB.
SLICE = 100_000


def tokens(text: Column) -> Column:
    """Lower-cased runs between white space and ASCII punctuation."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+"), "")


def hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def seed(family: int, mask: str, h: Column, i: Column) -> Column:
    return F.xxhash64(F.lit(family), *(F.get(h, i + k) for k, bit in enumerate(mask) if bit == "1"))


def benchmark_seeds(benchmark: DataFrame, families: list[tuple[int, str]]) -> DataFrame:
    """(seed, item_id, j, left, size, near): every masked position of every item, with the hashes of the tokens around it, `left` of them before."""
    items = benchmark.select("item_id", hashes(F.col("text")).alias("other")).filter(F.size("other") >= SHORTEST)
    rows = []
    for family, mask in families:
        fit = F.size("other") >= len(mask)
        if family >= len(MASKS):
            fit &= F.size("other") < WHOLE
        at = items.filter(fit).select("item_id", "other", F.explode(F.sequence(F.lit(0), F.size("other") - len(mask))).alias("j"))
        left = F.least(F.col("j"), F.when(F.size("other") < WHOLE, WHOLE).otherwise(AROUND))
        near = F.slice("other", F.col("j") - left + 1, F.when(F.size("other") < WHOLE, WHOLE).otherwise(left + SPAN + AROUND))
        rows.append(at.select(seed(family, mask, F.col("other"), F.col("j")).alias("seed"), "item_id", "j", left.alias("left"), F.size("other").alias("size"), near.alias("near")))
    return reduce(DataFrame.unionByName, rows)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, equal, compared, doc_at, item_at): one row for each pair with a confirmed overlap."""
    sizes = F.size(tokens(F.col("text")))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    known = benchmark.select(sizes.alias("n")).agg(count(F.col("n") >= SPAN).alias("all"), count(F.col("n").between(SHORTEST, WHOLE - 1)).alias("short"), count(F.col("n").between(1, SHORTEST - 1)).alias("whole")).first()
    families = [*enumerate(MASKS), *((len(MASKS) + k, m) for k, m in enumerate(LIGHT) if known["short"])]
    least = min(len(m) for _, m in families)
    slices = max(1, -(-(len(MASKS) * known["all"] + len(LIGHT) * known["short"]) // SLICE))
    h, i = F.col("h"), F.col("i")
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashes(F.col("text")).alias("h"))
    runs = hashed.select("doc_id", "h", F.explode(F.when(F.size("h") >= least, F.sequence(F.lit(0), F.size("h") - least))).alias("i"))
    masked = [F.when(i + len(m) <= F.size(h), seed(f, m, h, i)) if len(m) > least else seed(f, m, h, i) for f, m in families]
    runs = runs.select("doc_id", "h", "i", F.explode(F.array(*masked)).alias("seed"))
    seeds = benchmark_seeds(benchmark, families)
    found = []
    for s in range(slices):
        part = seeds if slices == 1 else seeds.filter(F.pmod(F.xxhash64("item_id", "j"), F.lit(slices)) == s)
        found.append(_confirmed(runs.join(F.broadcast(part), "seed")))
    if known["whole"]:
        short = lambda df: df.filter(F.size("h").between(1, SHORTEST - 1))
        items = short(benchmark.select("item_id", hashes(F.col("text")).alias("h"))).distinct()
        size, zero = F.size("h").alias("equal"), F.lit(0)
        found.append(short(hashed).join(items, "h").select("doc_id", "item_id", F.size("h").alias("compared"), zero.alias("doc_at"), zero.alias("item_at"), size))
    best = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max(F.struct("equal", F.negative("compared").alias("less"), F.negative("doc_at").alias("doc"), F.negative("item_at").alias("item"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.equal").alias("equal"), (-F.col("b.less")).alias("compared"), (-F.col("b.doc")).alias("doc_at"), (-F.col("b.item")).alias("item_at"))


def _confirmed(hits: DataFrame) -> DataFrame:
    """Hits whose surroundings hold enough equal tokens at equal places."""
    back = F.least("i", "left")
    ahead = F.least(F.size("h") - F.col("i"), F.size("near") - F.col("left"))
    hits = hits.withColumn("doc_at", F.col("i") - back).withColumn("item_at", F.col("j") - back).withColumn("from", F.col("left") - back + 1).withColumn("compared", back + ahead)
    # Only the surroundings leave the join, not the text; explode keeps the optimizer from moving the slice past it.
    hits = hits.select("doc_id", "item_id", "compared", "doc_at", "item_at", "size", "near", "from", F.explode(F.array(F.slice("h", F.col("doc_at") + 1, F.col("compared")))).alias("mine"))
    same = F.zip_with("mine", F.slice("near", F.col("from"), F.col("compared")), lambda a, b: (a == b).cast("int"))
    hits = hits.withColumn("equal", F.aggregate(same, F.lit(0), lambda acc, x: acc + x))
    enough = (F.col("equal") >= F.least(F.lit(EQUAL), F.ceil(F.lit(PART) * F.col("size")))) & (F.col("equal") >= SHARE * F.col("compared"))
    return hits.filter(enough).select("doc_id", "item_id", "compared", "doc_at", "item_at", "equal")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs`, all columns, without the rows whose texts overlap an item.

    Rows are judged by a hash of their texts, not by their ids: a row without an id goes if its
    text overlaps, and of rows that share an id only those whose own texts do.
    """
    key = F.xxhash64("text")
    gone = counted(overlaps(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(gone, F.xxhash64(docs["text"]) == gone["gone"], "left_anti")
