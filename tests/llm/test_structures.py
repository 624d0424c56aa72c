"""Operators 11 to 13 against brute force, and their defined edge cases."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import filter_audit as audit
from quarrymill.llm import filtering_lloyd as lloyd
from quarrymill.llm import pigeonring as ring

WORD = r"[^\x20\x09-\x0D]+"


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


# -- 11 ----------------------------------------------------------------------------------------


def _audited(docs, labels):
    """Every document through every order, one filter after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    of = {}
    for doc_id, text, source in docs:
        t = text or ""
        w = re.findall(WORD, t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in docs)
        of.setdefault(source or "", []).append((doc_id, {k for k, v in fails.items() if v}))
    out = []
    for part, rows in of.items():
        removed = {}
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                left = [(i, m) for i, m in rows if not m & before]
                here = [i for i, m in left if f in m]
                removed[order, k] = len(here)
                out.append([part, "".join(order), k + 1, len(left) - len(here), len(here), sum(f in m for _, m in rows) - len(here), sum(m == {f} for _, m in rows), sum(i in good for i in here), sum(i in toxic for i in here)])
        for x in out[-600:]:
            x.append(sum(removed[o, o.index(x[1][x[2] - 1])] for o in itertools.permutations("ABCDE")))
    return sorted(map(tuple, out))


def _audit(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for c in ("digest", "mask", "part", "first", "good", "salt", "n"):
        docs = docs.withColumn(c, F.lit(1))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("salt", F.lit(2)).withColumn("good", F.lit("x"))
    names = [c.split()[0] for c in audit.SCHEMA.split(", ")]
    return sorted(tuple(r[c] for c in names) for r in audit.audit(docs, labels).collect())


def test_audit_matches_every_order_brute_force(spark):
    rng = random.Random(3)
    long_text = " ".join(f"w{i % 90}" for i in range(210))
    texts = [None, "", " \t\n", "one", "A B", "a#b", long_text, " ".join(f"word{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), "é " * 300, "long " * 40_000, " ".join(f"x{i} $" for i in range(150))]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(70)]
    docs += [(None, "one", "s"), (None, None, "t"), (3, "again", "s"), (3, "again", "s"), (3, "again", "u"), (4, "again", "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert _audit(spark, docs, labels) == _audited(docs, labels)


def test_audit_of_nothing_and_of_one_document(spark):
    assert _audit(spark, [], []) == []
    one = _audit(spark, [(1, "a", None)], [])
    assert one == _audited([(1, "a", None)], []) and len(one) == 600


def test_polynomial_at_its_corners_and_inside():
    rng = random.Random(1)
    counts = [rng.randrange(50) for _ in range(audit.SETS)]
    p = audit.removal_polynomial(counts)
    for s in range(audit.SETS):
        assert audit.corner(p, s) == sum(c for m, c in enumerate(counts) if m & s)
    assert sum(audit.shapley(p, i) for i in range(5)) == sum(counts[1:])


# -- 12 ----------------------------------------------------------------------------------------


def _fingerprint(text):
    import xxhash

    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _grouped(pairs):
    """component of each row of (id, fingerprint), by comparing all of them."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(pairs), 2):
        if a is not None and b is not None and (a == b or ((x ^ y) & (2**64 - 1)).bit_count() <= 4):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (a, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), a), a) if a is not None else None
    return [least[find(i)] for i in range(len(pairs))]


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", " \t\r\n", "one two", "One TWO", "É é", "É É", "one two three four", "one two three four five", "long " * 50_000]
    for _ in range(12):
        base = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randint(40, 300))]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = [*enumerate(texts), (None, texts[20]), (None, None), (7, texts[30]), (7, texts[30]), (500, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("node", "band", "root", "fingerprint", "component_id", "size"):
        df = df.withColumn(c, F.lit(1))
    want = [(i, _fingerprint(t)) for i, t in rows]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in ring.near_fingerprints(df).collect()), key=str)
    assert got == sorted(((i, f"{f:016x}", c) for (i, f), c in zip(want, _grouped(want), strict=True)), key=str)
    assert len({c for _, _, c in got}) < len(got) - 30
    assert ring.near_fingerprints(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [3, 4096])
def test_links_of_dense_and_crossing_fingerprints(spark, monkeypatch, block):
    """Chains of flips around a few centres: most keys are crowded, and components meet through few links."""
    monkeypatch.setattr(ring, "BLOCK", block)
    rng = random.Random(2)
    bits = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 7)):
                y ^= 1 << b
            bits.add(y)
            x = y if rng.random() < 0.3 else x
    bits |= {0, 1 << 63, (1 << 63) | 7, (1 << 63) | 31, 2**64 - 1, 2**64 - 1 - 15}
    nodes = sorted(b - (1 << 64) if b >> 63 else b for b in bits)
    groups = _grouped(list(enumerate(nodes)))
    roots = {r["node"]: r["root"] for r in ring.linked(spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    got = [roots.get(n, n) for n in nodes]
    assert len(set(groups)) > 5
    assert [nodes[g] for g in groups] == got


def test_every_close_pair_shares_a_key():
    rng = random.Random(4)
    masks = [m for _, m in ring.key_masks()]
    assert len(masks) == 20 and ring.budgets() == [0, 1, 2, 3, 4]
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        good = [i for i in range(5) if all((differ & m).bit_count() <= most for m, most in zip(ring.chain_masks(i), ring.budgets(), strict=True))]
        assert good and any(not differ & m for i, m in ring.key_masks() if i in good)
    assert all(m.bit_count() >= 21 for m in masks)


# -- 13 ----------------------------------------------------------------------------------------


def _coded(rows):
    """(vec_id, label, vector) of kept rows: codes and errors with every part against every entry."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    whole = np.floor(np.array([r[2] for r in rows], dtype=np.float64) * 1024).astype(np.int64)
    parts = np.split(whole, 4, axis=1)
    books = [p[:256].copy() for p in parts]

    def nearest(p, b):
        return np.array([int(np.argmin(((b - x) ** 2).sum(axis=1))) for x in p])

    for _ in range(4):
        for p, b in zip(parts, books, strict=True):
            at = nearest(p, b)
            for e in set(at.tolist()):
                b[e] = p[at == e].sum(axis=0) // (at == e).sum()
    at = [nearest(p, b) for p, b in zip(parts, books, strict=True)]
    error = [sum(int(((p[i] - b[a[i]]) ** 2).sum()) for p, b, a in zip(parts, books, at, strict=True)) for i in range(len(rows))]
    total = {}
    for (_, label, _), e in zip(rows, error, strict=True):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{a[i]:02x}" for a in at), error[i], total[r[1]], sha) for i, r in enumerate(rows)), key=str)


def _vectors(n, rng, length=8):
    centres = rng.normal(size=(6, length)) * 0.3
    return [(int(i), int(i) % 3, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=length) * rng.choice([0.0, 0.002, 0.1])]) for i in range(n)]


@pytest.mark.parametrize("n", [1, 5, 300, 900])
def test_codes_match_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(lloyd, "BLOCK_NUMBERS", 200)
    monkeypatch.setattr(lloyd, "AT_ONCE", 4096)
    rows = _vectors(n, np.random.default_rng(n))
    rows += [(7, None, rows[0][2]), (7, 1, rows[0][2]), (None, None, rows[-1][2])] if n > 1 else []
    bad = [(1, 1, None), (2, 1, []), (3, 1, [math.nan] * 8), (4, 1, [math.inf] + [0.0] * 7), (5, 1, [None] + [0.0] * 7), (6, 1, [0.5] * 4)]
    bad = bad if n > 1 else bad[:-1]
    df = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<float>")
    for c in ("code", "error", "of", "trees", "labels"):
        df = df.withColumn(c, F.lit("x"))
    got = lloyd.compressed(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _coded(rows)


def test_codes_of_nothing_and_of_unfit_vectors(spark):
    schema = "vec_id long, label string, embedding array<double>"
    assert lloyd.compressed(spark.createDataFrame([], schema)).collect() == []
    assert lloyd.compressed(spark.createDataFrame([(1, "a", None)], schema)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        lloyd.compressed(spark.createDataFrame([(1, "a", [0.1] * 6)], schema))
    with pytest.raises(ValueError, match="too large"):
        lloyd.compressed(spark.createDataFrame([(1, "a", [1e9] * 8)], schema))


def test_tree_gives_subtrees_to_single_entries():
    """Filtering assigns clustered parts without looking at each, and its sums are those of the parts."""
    rng = np.random.default_rng(0)
    parts = np.floor((rng.permutation(np.repeat(np.arange(4), 512))[:, None] * 3.0 + rng.normal(size=(2048, 8)) * 0.01) * 1024).astype(np.int64)
    entries = np.array([[1024 * 3 * k] * 8 for k in (0, 1, 2, 3, 3)], dtype=np.int64)
    tree = lloyd.Tree.unpacked(lloyd.Tree.built(parts).packed(), 8)
    looked = []
    tree._one_by_one = lambda *a: looked.append(1) or iter(())
    nearest, sums, counts = tree.filtered(entries)
    assert not looked and counts[4] == 0 and counts.sum() == 2048
    want = np.argmin(((parts[:, None] - entries[None]) ** 2).sum(axis=2), axis=1)
    assert (nearest == want[tree.order]).all()
    assert all((sums[e] == parts[want == e].sum(axis=0)).all() for e in range(5))
