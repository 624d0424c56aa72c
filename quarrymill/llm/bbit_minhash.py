"""Near-duplicates by b-bit MinHash.

A document's set is its distinct five-word shingles. K minima of independent hashes of the set
are cut into bands; documents that share a band are candidates. Of each minimum only b low bits
are kept, packed into words: counting equal lanes of two packed signatures, corrected for
chance collisions, estimates the similarity of a candidate pair, and pairs far below the
threshold go. What is left is confirmed on the full sets, so that a link is exact.

Texts with equal word sequences are one node from the start. Then two steps:

1. Each node is paired with the first node of each of its bands, and with no other. Pairs that
   the estimate lets pass are confirmed on full sets, a centre's members being streamed past it.
   This is linear, and connects dense groups of copies.
2. Only bands that still span several components are left. Pairs within one component need no
   look. In such a band the members of its largest component meet only the others, never each
   other; nodes with an estimate above the cutoff across components are confirmed, in blocks of
   bounded rows and bytes, the largest estimates first, until they are connected.

Tasks emit spanning forests of what they found, never the pairs. Pairs that are alike by the
estimate, yet not linked, have to be looked at one by one in step 2, as exactness demands: that
work, in a task's memory, is quadratic in the number of such strays.

Defined cases: a null or wordless text has an empty set and links with nothing; fewer than five
words make one shingle; a doc_id on several rows is one document that has all their texts; a
null doc_id links with nothing, has a null component and is kept; very long texts are whole sets,
and blocks are dealt by bytes; other columns of `docs`, whatever their names, are not read, and
`keep_representatives` returns them as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, kept_by_worker, materialize, release, shuffled, slices

WORDS = 5
#: Bands and rows: a pair at similarity 0.75 misses every band with probability 2e-5; K = BANDS * ROWS.
BANDS, ROWS, BITS = 40, 5, 4
#: Estimates below are dropped: 0.15 under the threshold is over 4.5 standard deviations at K = 200.
SLACK = 0.15
#: Members in one block of packed signatures; of full sets, which may be long, also bytes. Members in one part of a centre's.
SIGNATURE_BLOCK, SET_BLOCK, SET_BYTES, STAR_PART = 4_096, 512, 16 << 20, 4_096
CACHE = 150_000
_LANES = np.uint64(0x1111111111111111)
_MUL = [np.uint64(int.from_bytes(hashlib.blake2b(f"shingle {i}".encode(), digest_size=8).digest(), "little") | 1) for i in range(WORDS)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash_parameters(k: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(hashlib.blake2b(f"minimum {i}".encode(), digest_size=16).digest() for i in range(k)), dtype=np.uint64).reshape(k, 2)
    return raw[:, 0] | np.uint64(1), raw[:, 1]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space; A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_set(words: list[bytes], hash_of) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hash_of, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, len(h) if len(h) < WORDS else WORDS, dtype=np.uint64)
    for i in range(min(WORDS, len(h))):
        out = _mixed(out + h[i : i + n] * _MUL[i])
    return np.unique(out)


def minima(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    out = np.full(len(mul), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 512):
        np.minimum(out, ((shingles[a : a + 512, None] ^ add) * mul).min(axis=0), out=out)
    return out


def packed_bits(m: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen lanes to a word. Taken from the middle, where products are well mixed."""
    lanes = np.zeros(-(-len(m) // 16) * 16, dtype=np.uint64)
    lanes[: len(m)] = (m >> np.uint64(24)) & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(BITS)
    return (lanes.reshape(-1, 16) << shifts).sum(axis=1, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Collision-corrected similarity of rows of packed signatures."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    unequal = np.bitwise_count(x & _LANES).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((k - unequal) / k - chance) / (1 - chance)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, print, bands, bits) of each row: one narrow pass."""
    k = bands * rows

    def run(batches):
        mul, add = _hash_parameters(k)
        hash_of = kept_by_worker("word_hashes", _WordHashes).__getitem__
        for b in slices(batches, "text"):
            n, prints, keys, bits = [], [], [], []
            for text in b.column("text").to_pylist():
                words = text_words(text)
                s = shingle_set(words, hash_of)
                n.append(len(s))
                if not len(s):
                    prints.append(None)
                    keys.append(None)
                    bits.append(None)
                    continue
                prints.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                m = minima(s, mul, add)
                key = np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    key = _mixed(key * _MUL[0] + m[r::rows])
                keys.append(key.view(np.int64))
                bits.append(packed_bits(m).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["doc_id", "n_shingles", "print", "bands", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, print binary, bands array<long>, bits binary")


class Joined:
    """Which nodes of a batch are connected so far: a label for each place, and the edges that span it."""

    def __init__(self, node: np.ndarray):
        self.node = node
        ids, self.place = np.unique(node, return_inverse=True)
        self.label = np.arange(len(ids))
        self.edges: tuple[list, list] = ([], [])

    def apart(self, at: np.ndarray, d: int) -> np.ndarray:
        """Of places, those whose d-th next row is not connected to them yet."""
        return at[self.label[self.place[at]] != self.label[self.place[at + d]]]

    def add(self, at: np.ndarray, d: int) -> None:
        """Connect rows to their d-th next ones; an edge is kept only if it connects anything."""
        if not len(at):
            return
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        x, y = self.label[self.place[at]].tolist(), self.label[self.place[at + d]].tolist()
        for i, u, v in zip(at.tolist(), x, y, strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
                self.edges[0].append(int(self.node[i]))
                self.edges[1].append(int(self.node[i + d]))
        new = np.arange(len(self.label))
        moved = list(root)
        new[moved] = [find(m) for m in moved]
        self.label = new[self.label]


def _meetings(df: DataFrame, key: str) -> DataFrame:
    """Rows for each pair of blocks that a member belongs to, within the groups of `key`.

    `df` has `_major`, whether the member is of its group's largest component, and `_majors` and
    `_strays`, the numbers of blocks of these and of all others. Blocks of the largest component
    meet blocks of strays only; blocks of strays also each other and themselves. `_own` is the
    member's block, `_one` whether the pair is a block with itself.
    """
    h, p, q = F.xxhash64(F.lit(7), "node"), F.col("_majors").cast("int"), F.col("_strays").cast("int")
    df = df.withColumn("_own", F.when(F.col("_major"), F.pmod(h, p)).otherwise(p + F.pmod(h, q)).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.when(F.col("_major"), p).otherwise(F.lit(0)), p + q - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return df.withColumn("_pair", F.xxhash64(key, low, high)).withColumn("_one", F.col("_own") == F.col("_other")).drop("_other", "_major", "_majors", "_strays")


def _meeting(at: np.ndarray, d: int, own: np.ndarray, one: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Of places whose row and the d-th after it share a pair of blocks, those that meet in this pair and no other, across components."""
    return at[(one[at] | (own[at] != own[at + d])) & (comp[at] != comp[at + d])]


def _runs(batches, key: str, most: int = 1 << 15, most_bytes: int = SET_BYTES):
    """Batches, in the order they come, cut between groups of equal keys; groups are whole."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
        if rows < most and size < most_bytes:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(np.cumsum(np.append(True, k[1:] != k[:-1])), np.sum(k[1:] != k[:-1]) + 1, side="left"))
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held, rows, size = t.slice(cut).to_batches(), t.num_rows - cut, t.slice(cut).nbytes
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _packed(column, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(rows, -1)


def _alike(s: np.ndarray, u: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets pass the threshold, exactly."""
    both = len(np.intersect1d(s, u, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(u) - both)


def estimated(pairs: DataFrame, nodes: DataFrame, k: int, cutoff: float, percent: int) -> DataFrame:
    """Of (a, b), the pairs whose set sizes and estimate allow a link."""
    of = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    def run(batches):
        for b in batches:
            if b.num_rows:
                good = estimate(*(_packed(b.column(c), b.num_rows) for c in ("bits_a", "bits_b")), k) >= cutoff
                yield b.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(shuffled(of("b")), "b").join(shuffled(of("a")), "a").filter(near).select("a", "b", "bits_a", "bits_b").mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n_shingles, bits, shingles) of the wanted nodes, from their texts; written, as it is read several times."""

    def run(batches):
        hash_of = kept_by_worker("word_hashes", _WordHashes).__getitem__
        for b in slices(batches, "text"):
            words = [text_words(t) for t in b.column("text").to_pylist()]
            prints = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(prints, pa.binary()), pa.array([shingle_set(w, hash_of).tobytes() for w in words], pa.binary())], names=["node", "print", "shingles"])

    ids = wanted.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(counted(ids, "wanted"), "doc_id", "left_semi")
    sets = texts.select(F.col("doc_id").alias("node"), "text").mapInArrow(run, "node long, print binary, shingles binary").dropDuplicates(["node", "print"])
    return materialize(sets.join(shuffled(nodes.select("node", "print", "n_shingles", "bits")), ["node", "print"]).select("node", "n_shingles", "bits", "shingles"), "sets")


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those that are linked; a is a centre.

    A centre's members are dealt into parts. A task holds the set of one centre and streams its
    members' sets past it, so that no group is ever held.
    """
    parts = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_PART).cast("int").alias("parts")), "parts")
    one = sets.select("node", "shingles")
    member = pairs.join(shuffled(parts), "a").select("a", F.pmod(F.xxhash64(F.lit(3), "b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node")).join(shuffled(one), "node")
    centre = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node")).join(shuffled(one), "node")
    rows = member.withColumn("turn", F.lit(1)).unionByName(centre.withColumn("turn", F.lit(0)))

    def run(batches):
        held, centres = None, []
        for b in batches:
            found: tuple[list, list] = ([], [])
            column = b.column("shingles")
            for i, (a, part, turn, node) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "part", "turn", "node")), strict=True)):
                if held != (a, part):
                    held, centres = (a, part), []
                s = np.frombuffer(column[i].as_buffer(), dtype=np.uint64)
                if not turn:
                    centres.append(s.copy())
                elif any(_alike(s, c, percent) for c in centres):
                    found[0].append(a)
                    found[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return rows.select("a", "part", "turn", "node", "shingles").repartition("a", "part").sortWithinPartitions("a", "part", "turn").mapInArrow(run, "a long, b long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of (a, b), a > b, is either once an `a` or only ever a `b`."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low")).filter("up > 1 or (up = 1 and low = 0)").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): smallest node reachable over `edges` (a, b), for nodes with an edge.

    Alternating star rounds: each node links its larger neighbours to its smallest one, then
    its smaller ones. The graph shrinks towards stars; each round's edges are written, and the
    rounds end when only stars are left. What a hub's neighbours are joined with is written first, so
    that the join has plain sides and adaptive execution can split the hub.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), name)
    while not _are_stars(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-low")
        large = both.filter("b > a").join(shuffled(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(least), "a").select("a", "b", "m")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, materialize(small, name)
        release(before, low)
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _named(df: DataFrame, roots: DataFrame) -> DataFrame:
    """`df` with each node's component: its root, or itself."""
    return df.join(shuffled(roots), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _spanning(rows: DataFrame, key: str, block: int, size: str | None = None) -> DataFrame:
    """For each group of `key` with several components: its largest one, and the blocks of that and of the others."""
    weight = F.sum(size) if size else F.lit(0).cast("long")
    of = rows.groupBy(key, "comp").agg(F.count("*").alias("n"), weight.alias("bytes"))
    groups = of.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "comp")).alias("most"))
    blocks = lambda n, z: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(z / SET_BYTES)).cast("int")
    several = groups.filter(F.col("n") > F.col("most.n"))
    return several.select(key, F.col("most.comp").alias("_largest"), blocks(F.col("most.n"), F.col("most.bytes")).alias("_majors"), blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("_strays"))


def _dealt(rows: DataFrame, spanning: DataFrame, key: str) -> DataFrame:
    return _meetings(rows.join(shuffled(spanning), key).withColumn("_major", F.col("comp") == F.col("_largest")).drop("_largest"), key)


def loose_links(shared: DataFrame, nodes: DataFrame, roots: DataFrame, k: int, cutoff: float, percent: int) -> DataFrame:
    """(a, b): within each band that spans components, a spanning forest of the pairs across them whose estimate passes `cutoff`."""
    rows = materialize(_named(shared.filter("size > 2").select("band", "node"), roots), "labelled")  # two in a band have met
    spanning = materialize(_spanning(rows, "band", SIGNATURE_BLOCK), "spanning")
    dealt = _dealt(rows, spanning, "band").join(shuffled(nodes.select("node", "n_shingles", "bits")), "node")
    dealt = dealt.select("_pair", "node", "comp", "_own", "_one", "n_shingles", "bits").repartition("_pair").sortWithinPartitions("_pair", "node")

    def run(batches):
        for t in _runs(batches, "_pair"):
            key, node, comp, n = (t.column(c).to_numpy() for c in ("_pair", "node", "comp", "n_shingles"))
            own, one = t.column("_own").to_numpy(), t.column("_one").to_numpy(zero_copy_only=False)
            bits = _packed(t.column("bits"), len(key))
            joined = Joined(node)
            at = np.arange(len(key) - 1)
            for d in range(1, len(key)):
                at = at[: np.searchsorted(at, len(key) - d)]
                at = at[key[at] == key[at + d]]
                if not len(at):
                    break
                near = joined.apart(_meeting(at, d, own, one, comp), d)
                near = near[100 * np.minimum(n[near], n[near + d]) >= percent * np.maximum(n[near], n[near + d])]
                joined.add(near[estimate(bits[near], bits[near + d], k) >= cutoff], d)
            if joined.edges[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in joined.edges], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def confirmed_links(clusters: DataFrame, sets: DataFrame, roots: DataFrame, k: int, cutoff: float, percent: int) -> DataFrame:
    """(a, b): components that exact links connect, within each loose cluster: spanning forests.

    A task holds pairs of blocks of clusters. It walks estimates from the largest down and
    intersects full sets only where the two components are not connected yet.
    """
    rows = materialize(_named(clusters, roots).join(shuffled(sets.select("node", F.octet_length("shingles").alias("size"))), "node"), "members")
    spanning = materialize(_spanning(rows, "cluster", SET_BLOCK, "size"), "clusters")
    dealt = _dealt(rows.select("cluster", "node", "comp").distinct(), spanning, "cluster").join(shuffled(sets), "node")
    dealt = dealt.select("_pair", "node", "comp", "_own", "_one", "n_shingles", "bits", "shingles").repartition("_pair").sortWithinPartitions("_pair", "node")

    def run(batches):
        for t in _runs(batches, "_pair", 4 * SET_BLOCK):
            key, comp, n = (t.column(c).to_numpy() for c in ("_pair", "comp", "n_shingles"))
            own, one = t.column("_own").to_numpy(), t.column("_one").to_numpy(zero_copy_only=False)
            bits = _packed(t.column("bits"), len(key))
            column = t.column("shingles").combine_chunks()
            set_of = lambda i: np.frombuffer(column[i].as_buffer(), dtype=np.uint64)
            left, right, guess = [], [], []
            at = np.arange(len(key) - 1)
            for d in range(1, len(key)):
                at = at[: np.searchsorted(at, len(key) - d)]
                at = at[key[at] == key[at + d]]
                if not len(at):
                    break
                near = _meeting(at, d, own, one, comp)
                near = near[100 * np.minimum(n[near], n[near + d]) >= percent * np.maximum(n[near], n[near + d])]
                e = estimate(bits[near], bits[near + d], k)
                good = e >= cutoff
                left.append(near[good].astype(np.int32))
                right.append((near[good] + d).astype(np.int32))
                guess.append(e[good].astype(np.float32))
            if not left:
                continue
            a, b, e = np.concatenate(left), np.concatenate(right), np.concatenate(guess)
            ids, place = np.unique(comp, return_inverse=True)
            root = list(range(len(ids)))

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            found: tuple[list, list] = ([], [])
            for i in np.argsort(-e, kind="stable"):
                x, y = find(place[a[i]]), find(place[b[i]])
                if x != y and _alike(set_of(int(a[i])), set_of(int(b[i])), percent):
                    root[max(x, y)] = min(x, y)
                    found[0].append(int(comp[a[i]]))
                    found[1].append(int(comp[b[i]]))
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs` (doc_id, text)."""
    k = bands * rows
    if percent < 75:
        raise ValueError("bands are chosen for links from 75 percent on")
    cutoff = percent / 100 - SLACK
    marked = materialize(signatures(docs, bands, rows), "signatures")
    with_set = marked.filter("doc_id is not null and print is not null")
    classes = with_set.groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    nodes = materialize(with_set.join(shuffled(classes), ["print", "doc_id"]).dropDuplicates(["print", "doc_id"]).withColumnRenamed("doc_id", "node"), "nodes")
    # Step 1: each node against the first of its bands.
    entries = nodes.select("node", F.explode("bands").alias("band"))
    crowded = materialize(entries.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("centre")).filter("size > 1"), "crowded")
    shared = materialize(entries.join(shuffled(crowded), "band"), "shared")
    pairs = shared.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    pairs = materialize(estimated(pairs, nodes, k, cutoff, percent), "pairs")
    sets = full_sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    links = materialize(star_links(pairs, sets, percent), "links")
    release(pairs, sets, crowded)
    roots = materialize(components(links, "first"), "roots")
    # Step 2: what bands still hold of several components.
    loose = materialize(components(loose_links(shared, nodes, roots, k, cutoff, percent), "loose").select("node", F.col("root").alias("cluster")), "loose-roots")
    sets = full_sets(docs, nodes, loose)
    links = confirmed_links(loose, sets, roots, k, cutoff, percent)
    # A doc_id with several texts connects their classes, as one document.
    several = with_set.groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low <> high")
    texts = with_set.select("doc_id", "print").join(shuffled(several.select("doc_id")), "doc_id").distinct()
    classes = texts.join(shuffled(nodes.select("print", "node")), "print").select("doc_id", "node").distinct()
    classes = _named(classes, roots)
    links = links.unionByName(classes.join(shuffled(classes.groupBy("doc_id").agg(F.min("comp").alias("b"))), "doc_id").select(F.col("comp").alias("a"), "b"))
    joined = components(links, "second").withColumnRenamed("node", "comp").withColumnRenamed("root", "further")
    named = materialize(_named(nodes.select("print", "node"), roots).join(shuffled(joined), "comp", "left").select("print", F.coalesce("further", "comp").alias("component_id")), "named")
    release(sets, shared, nodes, loose, roots)
    out = marked.select("doc_id", "n_shingles", "print").join(shuffled(named), "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, percent: int = 75) -> DataFrame:
    """`docs`, all columns, without the documents whose component has a smaller id."""
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    gone = counted(gone, "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
