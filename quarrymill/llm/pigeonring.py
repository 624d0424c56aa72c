"""Near-duplicates by SimHash fingerprints, searched by pigeonring filtering.

A fingerprint's 64 bits lie on a ring of SEGMENTS segments. If two fingerprints differ in at most
D bits, then some segment starts a chain in which the differences of the first l consecutive
segments together are at most l * D / SEGMENTS, for every l. With D = 4 and five segments the
budgets along a chain are 0, 1, 2, 3 and 4. The first two make the candidates: the segment is
equal, and the next one differs in at most one bit, so that of its PIECES pieces all but one are
equal. Fingerprints therefore meet under SEGMENTS * PIECES keys of about 22 bits, which are plain
columns. Of the fingerprints that meet, those whose chain runs over a later budget are pruned
before all 64 bits are compared; what remains is linked exactly, and no link is lost.

Equal fingerprints are one node from the start. Then, as with any keys that many may share:

1. Each node is compared with the first node of each of its keys, and with no other. This is
   linear and native, and connects dense groups of near copies.
2. Only keys that still span several components are left: there the members of the largest
   component meet only the others, never each other, in blocks of bounded rows.

Tasks emit spanning forests of what they found, never the pairs.

Defined cases: a null text is an empty one; text without a word has fingerprint zero and links
like any other; fewer than four words make one shingle; a doc_id on several rows gives a row each,
which are linked by that id; a null doc_id has a fingerprint, links with nothing and has a null
component; very long texts are whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bbit_minhash import Joined, _dealt, _meeting, _named, _runs, _spanning, components
from .common import materialize, release, shuffled, slices

WORDS, SEED = 4, 42
#: Bits that linked fingerprints may differ in.
DISTANCE = 4
#: Segments of the ring as (first bit, bits), and the pieces that a chain's second segment is cut into.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PIECES = 4
#: Members of one block of a crowded key.
BLOCK = 4_096
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 15


def fingerprint(text: str | None) -> int:
    """Bits that are set in over half of the hashes of the text's four-word shingles."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    stops = ends[min(WORDS, len(words)) - 1 :].tolist()
    of, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for a in range(0, n, _AT_ONCE):
        h = np.array([of(line[i:j], SEED) for i, j in zip(starts[a : a + _AT_ONCE], stops[a : a + _AT_ONCE], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, node) of each row: its fingerprint as a signed long. One narrow pass."""

    def run(batches):
        for b in slices(batches, "text"):
            found = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long")


def _mask(first: int, bits: int) -> int:
    return ((1 << bits) - 1) << first


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_masks(start: int) -> list[int]:
    """Bits of the chains that begin at a segment, from one segment to all."""
    out, mask = [], 0
    for k in range(len(SEGMENTS)):
        mask |= _mask(*SEGMENTS[(start + k) % len(SEGMENTS)])
        out.append(mask)
    return out


def budgets() -> list[int]:
    """Differences that a chain of one segment, of two and so on may have in all."""
    return [(k + 1) * DISTANCE // len(SEGMENTS) for k in range(len(SEGMENTS))]


def key_masks() -> list[tuple[int, int]]:
    """(starting segment, bits that are equal) of each key: the segment, and the next one without one piece."""
    out = []
    for i in range(len(SEGMENTS)):
        first, bits = SEGMENTS[(i + 1) % len(SEGMENTS)]
        cuts = [first + bits * p // PIECES for p in range(PIECES + 1)]
        for p in range(PIECES):
            out.append((i, _mask(*SEGMENTS[i]) | _mask(first, bits) & ~_mask(cuts[p], cuts[p + 1] - cuts[p])))
    return out


def keyed(nodes: DataFrame) -> DataFrame:
    """(band, start, node): the keys of each node, hashed with their numbers; start is the chain's first segment."""
    keys = [F.struct(F.xxhash64(F.lit(k), F.col("node").bitwiseAND(F.lit(_signed(mask)))).alias("band"), F.lit(start).alias("start")) for k, (start, mask) in enumerate(key_masks())]
    return nodes.select("node", F.explode(F.array(*keys)).alias("k")).select("k.band", "k.start", "node")


def chained(a: Column, b: Column, start: Column) -> Column:
    """Whether the chain from `start` keeps its budgets, and so whether all bits do: the last budget is the distance itself."""
    differ = a.bitwiseXOR(b)
    within = F.lit(False)
    for i in range(len(SEGMENTS)):
        steps = [F.bit_count(differ.bitwiseAND(F.lit(_signed(m)))) <= most for m, most in zip(chain_masks(i), budgets(), strict=True)]
        for step in steps[1:]:
            steps[0] = steps[0] & step
        within = F.when(start == i, steps[0]).otherwise(within)
    return within


def crossing_links(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): within each key that spans components, a spanning forest of the links across them."""
    rows = materialize(_named(shared.filter("size > 2").select("band", "start", "node"), roots), "labelled")  # two in a key have met
    spanning = materialize(_spanning(rows, "band", BLOCK), "spanning")
    dealt = _dealt(rows, spanning, "band").select("_pair", "node", "comp", "start", "_own", "_one")
    dealt = dealt.repartition("_pair").sortWithinPartitions("_pair", "node")

    def run(batches):
        masks = np.array([chain_masks(i) for i in range(len(SEGMENTS))], dtype=np.uint64)
        most = budgets()
        for t in _runs(batches, "_pair"):
            key, node, comp, start = (t.column(c).to_numpy() for c in ("_pair", "node", "comp", "start"))
            own, one = t.column("_own").to_numpy(), t.column("_one").to_numpy(zero_copy_only=False)
            bits = node.view(np.uint64)
            joined = Joined(node)
            at = np.arange(len(key) - 1)
            for d in range(1, len(key)):
                at = at[: np.searchsorted(at, len(key) - d)]
                at = at[key[at] == key[at + d]]
                if not len(at):
                    break
                near = joined.apart(_meeting(at, d, own, one, comp), d)
                for k in range(len(SEGMENTS)):
                    near = near[np.bitwise_count((bits[near] ^ bits[near + d]) & masks[start[near], k]) <= most[k]]
                joined.add(near, d)
            if joined.edges[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in joined.edges], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def linked(nodes: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(node, root) of nodes within DISTANCE bits of any other, with the edges of `also` (a, b): the smallest node reachable."""
    entries = keyed(nodes)
    crowded = materialize(entries.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("centre")).filter("size > 1"), "crowded")
    shared = materialize(entries.join(shuffled(crowded), "band"), "shared")
    links = shared.filter("node <> centre").filter(chained(F.col("node"), F.col("centre"), F.col("start"))).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    roots = materialize(components(links if also is None else links.unionByName(also), "first"), "roots")
    further = materialize(crossing_links(shared, roots), "crossing")
    # What the second step found lies between components: their roots are the nodes now.
    name = lambda c: shuffled(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")))
    between = further.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = materialize(components(between, "second"), "joined")
    release(crowded, shared, further)
    up = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.join(shuffled(up), "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(joined.join(shuffled(roots), "node", "left_anti"))


def near_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs` (doc_id, text)."""
    marked = materialize(fingerprints(docs), "fingerprints")
    with_id = marked.filter("doc_id is not null")
    nodes = materialize(with_id.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    # A doc_id with several texts connects their fingerprints, as one document.
    several = with_id.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).filter("b <> high")
    same = with_id.join(shuffled(several), "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()
    roots = materialize(linked(nodes.select("node"), same), "linked")
    # Only nodes with a link or with several rows have to meet their rows again.
    named = nodes.join(shuffled(roots), "node", "left")
    least = named.filter("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(shuffled(least), "root", "left").filter("root is not null or rows > 1").select("node", F.coalesce("component_id", "least").alias("component_id"))
    known = materialize(known, "known")
    out = marked.join(shuffled(known), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
