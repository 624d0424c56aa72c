"""Product codes of vectors, their codebooks found by Lloyd's rounds with the filtering method.

Components become whole numbers, floor(1024 * x), and vectors are cut into equal consecutive
parts. A task gathers its rows into blocks of bounded size and builds a balanced kd-tree over each
position's parts: every node holds its bounding box, and the sum of its parts. The trees are
written once; each round reads them again, whatever executors were lost in between.

In a round the codebook's entries go down a tree together. In a node the entry nearest to the
middle of the box is compared with each other entry: one that is nowhere in the box nearer (or as
near with a smaller index) goes. A node with one entry left gives it all of its parts at once, by
the cached sum; only parts of leaves that still have several entries are compared one by one. All
arithmetic is in whole numbers, so every assignment is the exact nearest entry, ties to the lower
index. Tasks send the sums and counts of entries, bounded by the codebooks, never parts.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped, as are
empty ones, and those whose length is not that of the first kept vector; a length that four does
not divide is an error, and so are components so large that squared distances leave 64 bits (over
131,000 in parts of 16); fewer than 256 kept vectors make smaller codebooks; rows that share a
vec_id are a vector each, in the order of their components; a null vec_id is coded, and comes last
where the first entries are chosen; null labels are one label; other columns are not read; a table
without a kept vector gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, give_back, materialize, share, spread

POSITIONS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts of a leaf; numbers in the parts of a block's position; numbers compared at once in leaves.
LEAF, BLOCK_NUMBERS, AT_ONCE = 8, 1 << 16, 1 << 20


def _starts(n: int, level: int) -> np.ndarray:
    """First row of each node of a level; the tree's shape follows from its number of rows."""
    return n * np.arange((1 << level) + 1) >> level


def _levels(n: int) -> int:
    level = 0
    while n >> level > LEAF:
        level += 1
    return level + 1


class Tree:
    """A balanced kd-tree over one position of a block: parts in tree order, boxes and sums of all nodes."""

    def __init__(self, parts: np.ndarray, order: np.ndarray, boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.parts, self.order, self.boxes = parts, order, boxes

    @classmethod
    def built(cls, parts: np.ndarray) -> Tree:
        n, boxes = len(parts), []
        order = np.arange(n)
        for level in range(_levels(n)):
            starts = _starts(n, level)
            held = parts[order]
            low, high = (f.reduceat(held, starts[:-1], axis=0) for f in (np.minimum, np.maximum))
            boxes.append((low, high, np.add.reduceat(held, starts[:-1], axis=0)))
            node = np.repeat(np.arange(len(low)), np.diff(starts))
            order = order[np.lexsort((held[np.arange(n), np.argmax(high - low, axis=1)[node]], node))]
        return cls(parts[order], order, boxes)  # the last order sorts rows within leaves only

    def packed(self) -> dict:
        join = lambda k, kind: np.concatenate([b[k] for b in self.boxes]).astype(kind).tobytes()
        return {"parts": self.parts.astype(np.int32).tobytes(), "rows": self.order.astype(np.int32).tobytes(), "low": join(0, np.int32), "high": join(1, np.int32), "total": join(2, np.int64)}

    @classmethod
    def unpacked(cls, x: dict, width: int) -> Tree:
        of = lambda k, kind=np.int32: np.frombuffer(x[k], dtype=kind).astype(np.int64).reshape(-1, width)
        parts = of("parts")
        ends = np.cumsum([1 << level for level in range(_levels(len(parts)))])[:-1]
        boxes = zip(*(np.split(of(k, kind), ends) for k, kind in (("low", np.int32), ("high", np.int32), ("total", np.int64))), strict=True)
        return cls(parts, np.frombuffer(x["rows"], dtype=np.int32), list(boxes))

    def filtered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of each part in tree order, and the sums and counts of entries."""
        n, k = len(self.parts), len(entries)
        nearest = np.empty(n, dtype=np.int64)
        sums, counts = np.zeros_like(entries), np.zeros(k, dtype=np.int64)
        squares = (entries * entries).sum(axis=1)
        node, entry = np.zeros(k, dtype=np.int64), np.arange(k)  # ordered by node, then entry
        for level, (low, high, total) in enumerate(self.boxes):
            middle = low[node] + high[node]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            size = np.diff(np.append(first, len(node)))
            best = np.repeat(_first_least(((2 * entries[entry] - middle) ** 2).sum(axis=1), first, size), size)
            best = entry[best]
            apart = entries[entry] - entries[best]
            least = squares[entry] - squares[best] - 2 * np.maximum(low[node] * apart, high[node] * apart).sum(axis=1)
            stay = (least < 0) | ((least == 0) & (entry <= best))
            node, entry = node[stay], entry[stay]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            size = np.diff(np.append(first, len(node)))
            starts = _starts(n, level)
            whole = first[size == 1]
            np.add.at(sums, entry[whole], total[node[whole]])
            np.add.at(counts, entry[whole], np.diff(starts)[node[whole]])
            for i, e in zip(node[whole].tolist(), entry[whole].tolist(), strict=True):
                nearest[starts[i] : starts[i + 1]] = e
            open_ = np.repeat(size > 1, size)
            node, entry = node[open_], entry[open_]
            if not len(node):
                break
            if level + 1 < len(self.boxes):
                both = np.concatenate([2 * node, 2 * node + 1])
                by_node = np.argsort(both, kind="stable")
                node, entry = both[by_node], np.concatenate([entry, entry])[by_node]
                continue
            for i in self._one_by_one(node, entry, starts, entries, nearest):
                np.add.at(sums, nearest[i], self.parts[i])
                np.add.at(counts, nearest[i], 1)
        return nearest, sums, counts

    def _one_by_one(self, node: np.ndarray, entry: np.ndarray, starts: np.ndarray, entries: np.ndarray, nearest: np.ndarray):
        """Assign the parts of leaves with several entries; gives the rows, some at a time."""
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(first, len(node)))
        leaf = node[first]
        held = starts[leaf + 1] - starts[leaf]
        row = np.repeat(starts[leaf] - np.append(0, np.cumsum(held)[:-1]), held) + np.arange(held.sum())
        at, many = np.repeat(first, held), np.repeat(size, held)
        step = max(1, AT_ONCE // (len(entries) * entries.shape[1]))
        for a in range(0, len(row), step):
            r, m = row[a : a + step], many[a : a + step]
            begin = np.append(0, np.cumsum(m)[:-1])
            e = entry[np.repeat(at[a : a + step] - begin, m) + np.arange(m.sum())]
            d = ((np.repeat(self.parts[r], m, axis=0) - entries[e]) ** 2).sum(axis=1)
            nearest[r] = e[_first_least(d, begin, m)]
            yield r


def _first_least(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each run of values, the place of its first least one."""
    at = np.flatnonzero(values == np.repeat(np.minimum.reduceat(values, first), size))
    return at[np.searchsorted(at, first)]


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the vectors that take part, but for their length."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    scaled = np.floor(vectors * SCALE)
    if len(scaled) and np.abs(scaled).max() >= min(2.0**30, (2.0**58 / scaled.shape[1]) ** 0.5):
        raise ValueError("components are too large for squared distances in 64 bits")
    return scaled.astype(np.int64)


_TREE = "struct<parts:binary,rows:binary,low:binary,high:binary,total:binary>"


def trees(vectors: DataFrame, length: int) -> DataFrame:
    """One row for each block of rows: their ids and labels, and a tree for each position."""
    width, kind = length // POSITIONS, dict(vectors.dtypes)["label"]
    most = max(LEAF, BLOCK_NUMBERS // width)
    tree = pa.struct([(k, pa.binary()) for k in ("parts", "rows", "low", "high", "total")])

    def block(t: pa.Table) -> pa.RecordBatch:
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        whole = whole_numbers(flat.reshape(-1, length))
        packed = [Tree.built(whole[:, p * width : (p + 1) * width]).packed() for p in range(POSITIONS)]
        lists = [pa.ListArray.from_arrays([0, t.num_rows], t.column(c).combine_chunks()) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.list_(tree))], names=["vec_ids", "labels", "trees"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, most - rows)
                held.append(piece)
                rows += piece.num_rows
                at += piece.num_rows
                if rows == most:
                    yield block(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield block(pa.Table.from_batches(held))
        give_back()

    return vectors.mapInArrow(run, f"vec_ids array<long>, labels array<{kind}>, trees array<{_TREE}>")


def entry_sums(blocks: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(position, entry, n, totals): what the parts nearest to each entry sum to, over all blocks."""
    sent, width = share(blocks.sparkSession, codebooks), codebooks[0].shape[1]

    def run(batches):
        books = sent()
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for b in batches:
            for row in b.column("trees"):
                for p, x in enumerate(row.as_py()):
                    _, s, c = Tree.unpacked(x, width).filtered(books[p])
                    sums[p] += s
                    counts[p] += c
        place = np.array([(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c)], dtype=np.int32).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place[:, 0]), pa.array(place[:, 1]), pa.array([counts[p][e] for p, e in place], pa.int64()), pa.array([sums[p][e].tolist() for p, e in place], pa.list_(pa.int64()))],
            names=["position", "entry", "n", "totals"],
        )

    of_task = blocks.select("trees").mapInArrow(run, "position int, entry int, n long, totals array<long>")
    return of_task.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("totals")[i]) for i in range(width))).alias("totals"))


def codes(blocks: DataFrame, codebooks: list[np.ndarray], label: str) -> DataFrame:
    """(vec_id, label, code, error) of each row."""
    sent, width = share(blocks.sparkSession, codebooks), codebooks[0].shape[1]

    def run(batches):
        books = sent()
        for b in batches:
            for ids, labels, row in zip(b.column("vec_ids"), b.column("labels"), b.column("trees"), strict=True):
                n = len(ids)
                entry, error = np.empty((n, POSITIONS), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                for p, x in enumerate(row.as_py()):
                    tree = Tree.unpacked(x, width)
                    nearest, _, _ = tree.filtered(books[p])
                    entry[tree.order, p] = nearest
                    error[tree.order] += ((tree.parts - books[p][nearest]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([bytes(e).hex() for e in entry]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def first_codebooks(vectors: DataFrame) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids: at most ENTRIES rows come to the driver. None where no vector is kept."""
    length = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("n")).first()
    if length is None:
        return []
    if length["n"] % POSITIONS:
        raise ValueError(f"vectors of {length['n']} components can't be cut into {POSITIONS} equal parts")
    first = vectors.filter(F.size("embedding") == length["n"]).orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(ENTRIES).collect()
    return np.split(whole_numbers(np.array([r["embedding"] for r in first])), POSITIONS, axis=1)


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in codebooks for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    vectors = kept_vectors(embeddings)
    books = first_codebooks(vectors)
    kind = dict(vectors.dtypes)["label"]
    if not books:
        return vectors.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256")).limit(0)
    length = POSITIONS * books[0].shape[1]
    blocks = materialize(trees(spread(vectors.filter(F.size("embedding") == length)), length), "trees")
    for _ in range(ROUNDS):
        for r in entry_sums(blocks, books).collect():  # a row for each entry that has parts
            books[r["position"]][r["entry"]] = np.array(r["totals"], dtype=np.int64) // r["n"]
    coded = materialize(codes(blocks, books, kind), "codes")
    of_label = counted(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = coded.join(of_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def codes_sql(width: int = 16) -> str:
    """Every part against every entry, in whole numbers, for vectors of POSITIONS parts of `width`."""
    dims = range(1, width + 1)
    nearest = lambda r: f"""a{r} AS MATERIALIZED (SELECT p.r, p.j, min({{'d': p.s + c.s - 2 * list_dot_product(p.v, c.v), 'e': c.e}}) AS best FROM p JOIN c{r} c ON p.j = c.j GROUP BY 1, 2)"""
    square = "list_dot_product(v, v)"
    rounds = ""
    for r in range(ROUNDS):
        means = ", ".join(f"floor(sum(p.v[{i}]) / count(*))" for i in dims)
        rounds += f""", {nearest(r)},
m{r} AS (SELECT a.j, a.best.e AS e, [{means}] AS v FROM a{r} a JOIN p ON a.r = p.r AND a.j = p.j GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT j, e, v, {square} AS s FROM (SELECT c.j, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.j = m.j AND c.e = m.e))"""
    return f"""WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, j, v, {square} AS s FROM (SELECT r, j, v[j * {width} + 1 : j * {width} + {width}] AS v FROM k, range({POSITIONS}) t(j))),
c0 AS MATERIALIZED (SELECT j, r - 1 AS e, v, s FROM p WHERE r <= {ENTRIES}){rounds}, {nearest(ROUNDS)},
f AS (SELECT vec_id, label, string_agg(printf('%02x', best.e::INT), '' ORDER BY j) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} JOIN k USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY j, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM f"""
