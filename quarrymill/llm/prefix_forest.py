"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a long hash string, the signs of random projections, and keeps the
strings in a sorted array. A query descends to its longest prefix match in every tree, then
ascends in all trees together, one bit at a time, until a neighbour as near as the k-th found so far
would hardly have been missed by so long a prefix; candidates are scored by their exact cosine. What
share of a block that is depends on how near the neighbours are, not on the number of rows.

The rows are dealt into blocks by a hash of the id, each with a forest of its own that is built
once, by the task that then streams all queries past it: a stated query set against all rows. A
task holds one block and a batch of queries. The merge keeps k rows of each block for a query.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components take
no part; vectors of different lengths are never compared; equal scores go to the smaller vec_id;
if a vec_id is on several rows, it is one candidate at its best score, never its own neighbour,
and asks once, with the first of its vectors; where there are fewer than k candidates, all are
found; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES, BITS = 64, 32
#: Tasks that the blocks are dealt to, at most; a task takes its blocks one after the other.
MAX_TASKS = 20_000
#: Probability that a neighbour as far as the k-th candidate is missed, at which the ascent stops.
MISS = 0.05
#: Bytes of a block's vectors, its rows at most and at least; queries that a task takes at once.
BLOCK_BYTES, BLOCK_ROWS, BLOCK_LEAST, QUERY_ROWS = 16 << 20, 16_384, 512, 2_048


class Forest:
    """Sorted hash strings of one block of vectors."""

    def __init__(self, unit: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7):
        self.unit, self.trees, self.bits = unit, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((unit.shape[1], trees * bits)).astype(np.float32)
        codes = self.codes(unit)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """[tree, vector] strings as integers, first bit highest."""
        signs = (unit.astype(np.float32) @ self.planes > 0).reshape(len(unit), self.trees, self.bits)
        weights = np.left_shift(np.uint64(1), np.arange(self.bits - 1, -1, -1, dtype=np.uint64))
        return np.ascontiguousarray((signs * weights).sum(axis=2, dtype=np.uint64).T)

    def ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where, in each tree, the strings lie that share `depth` bits with each query."""
        shift = np.uint64(self.bits - depth)
        low = (codes >> shift) << shift
        high = low + (np.uint64(1) << shift)
        first = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, low, strict=True)])
        last = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, high, strict=True)])
        return first, last

    def candidates(self, queries: np.ndarray, own: list[np.ndarray], k: int, miss: float):
        """Places of each query's candidates, by descending and then ascending in step; `own` are the places of its own rows.

        The ascent ends where a vector at the angle of the k-th best candidate so far would be missed
        with a probability of at most `miss`: a prefix of `depth` bits is shared in one tree with
        (1 - angle / pi)^depth. Near neighbours end it early, far ones go on, to all rows if need be.
        """
        codes = self.codes(queries)
        open_ = np.arange(len(queries))
        out: list = [None] * len(queries)
        for depth in range(min(self.bits, max(1, 2 * len(self.unit).bit_length())), -1, -1):
            first, last = self.ranges(codes[:, open_], depth)
            left = np.ones(len(open_), dtype=bool)
            for at in np.flatnonzero(((last - first).sum(axis=0) > k) | (depth == 0)):
                q = open_[at]
                if depth:
                    some = np.unique(np.concatenate([self.order[t, a:b] for t, (a, b) in enumerate(zip(first[:, at].tolist(), last[:, at].tolist(), strict=True)) if a < b]))
                else:
                    some = np.arange(len(self.unit))
                some = some[~np.isin(some, own[q])]
                if depth and len(some) < k:
                    continue
                if depth:
                    kth = np.partition(self.unit[some] @ queries[q], -k)[-k]
                    shared = (1 - np.arccos(np.clip(kth, -1, 1)) / np.pi) ** depth
                    if (1 - shared) ** self.trees > miss:
                        continue
                out[q] = some
                left[at] = False
            open_ = open_[left]
            if not len(open_):
                break
        return out


class Block:
    """One block of vectors with its forest, built once."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids = rows[order], ids[order]
        self.norm = np.sqrt((self.rows**2).sum(axis=1))
        self.forest = Forest(self.rows / self.norm[:, None])

    def nearest(self, queries: np.ndarray, query_ids: np.ndarray, k: int, miss: float = MISS):
        """(query place, row place, cosine) of each query's k nearest found."""
        norm = np.sqrt((queries**2).sum(axis=1))
        unit = queries / norm[:, None]
        low, high = np.searchsorted(self.ids, query_ids, side="left"), np.searchsorted(self.ids, query_ids, side="right")
        own = [np.arange(a, b) for a, b in zip(low, high, strict=True)]
        for i, found in enumerate(self.forest.candidates(unit, own, k, miss)):
            if len(found) > k:
                rough = self.forest.unit[found] @ unit[i]
                found = found[rough >= np.partition(rough, -k)[-k] - 1e-9]  # ties stay in
            score = (self.rows[found] * queries[i]).sum(axis=1) / (self.norm[found] * norm[i])
            best = []
            for j in np.lexsort((self.ids[found], -score)):
                if len(best) == k:
                    break
                if int(self.ids[found[j]]) not in best:
                    best.append(int(self.ids[found[j]]))
                    yield i, int(found[j]), float(score[j])


def search(vectors: DataFrame, is_query, k: int = 5, miss: float = MISS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `is_query` holds, against all other rows."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.size("embedding").alias("dim"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n = F.col("n")
    block_rows = F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))), F.ceil(n / (2 * cores))))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).filter("asking > 0").select("dim", F.ceil(n / block_rows).cast("int").alias("blocks"))
    sizes = materialize(sizes, "blocks")
    tasks = min(MAX_TASKS, sizes.agg(F.sum("blocks")).first()[0] or 1)
    dealt = rows.join(sizes, "dim")
    stored = dealt.select("dim", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v", F.lit(0).alias("turn"))
    asking = dealt.filter("asks").groupBy("dim", "vec_id", "blocks").agg(F.min("v").alias("v"))
    asked = asking.select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v", F.lit(1).alias("turn"))
    met = stored.unionByName(asked).repartition(tasks, "dim", "block").sortWithinPartitions("dim", "block", "turn", "vec_id")

    def run(batches):
        held, parts, block = None, [], None
        for b in batches:
            dim, place, turn, ids = (b.column(c).to_numpy() for c in ("dim", "block", "turn", "vec_id"))
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (place[1:] != place[:-1]) | (turn[1:] != turn[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if a == z:
                    continue
                v = b.column("v").slice(a, z - a).flatten().to_numpy(zero_copy_only=False).reshape(z - a, -1)
                if held != (dim[a], place[a]):
                    held, parts, block = (dim[a], place[a]), [], None
                if not turn[a]:
                    parts.append((v.copy(), ids[a:z].copy()))
                    continue
                if not parts and block is None:
                    continue
                if block is None:
                    block, parts = Block(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])), []
                for q in range(0, z - a, QUERY_ROWS):
                    asks = ids[a:z][q : q + QUERY_ROWS]
                    found = list(block.nearest(v[q : q + QUERY_ROWS], asks, k, miss))
                    i, j, s = zip(*found, strict=True) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(asks[list(i)], pa.int64()), pa.array(block.ids[list(j)], pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbours_query(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 50 == 0)
