"""Operators 1, 2, 5, 9, 10, 3: learning on small data, brute-force twins, defined edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import gam_quality as gam
from quarrymill.llm import mil_toxicity as mil
from quarrymill.llm import pow2_packing as packing
from quarrymill.llm import ppm_langid as ppm
from quarrymill.llm import trie_counts as trie
from quarrymill.llm import weak_pii as pii

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text of a null id", "en", "s", 17), (3, "same", "en", "s", 4), (3, "same", "en", "s", 4), (4, "word " * 40_000, "en", "s", 200_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns with names that operators use."""
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("x")).withColumn("label", F.lit(7)).withColumn("spans", F.lit(None).cast("string")).withColumn("node", F.lit(1)).withColumn("h", F.lit(2)).withColumn("_id", F.lit(3))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_gam_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit(x[:2000], y[:2000], rounds=40, pair_rounds=80)
    p = m.score(x[2000:])
    assert (0, 1) in m.pairs and ((p > 0.5) == (y[2000:] == 1)).mean() > 0.9


def test_gam_is_a_sum_of_tables():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    m = gam.fit(x, (x[:, 0] > 0.3).astype(float), rounds=20, pair_rounds=5, n_pairs=2)
    row = x[:1]
    total = m.intercept + sum(t[np.searchsorted(c, row[0, j], side="right")] for j, (t, c) in enumerate(zip(m.main, m.cuts)))
    for (i, j), t in zip(m.pairs, m.pair_tables):
        total += t[np.searchsorted(m.pair_cuts[i], row[0, i], side="right"), np.searchsorted(m.pair_cuts[j], row[0, j], side="right")]
    assert abs(m.margin(row)[0] - total) < 1e-12


@pytest.mark.parametrize("query", [gam.quality_query, mil.toxicity_query])
def test_scores_of_odd_rows(spark, odd, empty, query):
    known = labels(spark, [(3, 1, 0), (4, 0, 1), (4, 0, 1), (9, 1, None), (None, 1, 1)])
    rows = query(odd, known).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert query(empty, known.limit(0)).count() == 0
    assert query(odd, known.limit(0)).count() == len(ODD)


def test_held_out_quality_and_toxicity(spark):
    docs, known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    q = gam.quality_query(docs, known).join(known, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in q) / len(q) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in q)
    t = mil.toxicity_query(docs, known).join(known, "doc_id").filter("held_out and toxic is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in t)
    toxic, clean = [r for r in t if r.toxic], [r for r in t if not r.toxic]
    assert toxic and sum(r.predicted for r in toxic) / len(toxic) > 0.85 and sum(r.predicted for r in clean) / len(clean) < 0.03


def test_toxicity_locates_sentences():
    texts = ["The cat sat. You vile beast!"] * 30 + ["The cat sat. A calm day."] * 60 + ["vile"] * 10
    y = np.array([1.0] * 30 + [0.0] * 60 + [1.0] * 10)
    held = [mil.document_features(t) for t in texts]
    told = sorted(f for f in set().union(*held) if mil.telling(sum(f in h for h in held[:30] + held[90:]), sum(f in h for h in held[30:90]), 40, 60, 5))
    m = mil.model_of([(*mil.feature_ids(t, {f: i for i, f in enumerate(told)}), label, 1.0) for t, label in zip(texts, y)], told)
    text = "The cat sat. You vile beast! A calm day."
    spans = mil.sentences(text)
    p = m.scorer()(text, spans)
    assert p.argmax() == 1 and text[slice(*spans[1])].strip() == "You vile beast" and p[0] < 0.3
    assert abs(mil.noisy_or(p) - (1 - np.prod(1 - p))) < 1e-9 and mil.noisy_or(np.zeros(0)) == 0


def _ppm_bits(train: bytes, text: bytes, order: int) -> float:
    """PPM with escape method C and exclusions, symbol by symbol."""
    counts: dict = {}
    padded = b" " * order + train
    for i in range(order, len(padded)):
        for n in range(order + 1):
            c = counts.setdefault(padded[i - n : i], {})
            c[padded[i]] = c.get(padded[i], 0) + 1
    keep = {b""}
    for n in range(1, order + 1):
        keep |= {c for c, v in counts.items() if len(c) == n and sum(v.values()) >= 2 and c[1:] in keep and c[:-1] in keep}
    bits, padded = 0.0, b" " * order + text
    for i in range(order, len(padded)):
        p, out, n = 1.0, set(), order
        while padded[i - n : i] not in keep:
            n -= 1
        for m in range(n, -1, -1):
            c = {s: v for s, v in counts[padded[i - m : i]].items() if s not in out}
            total = sum(c.values())
            if padded[i] in c:
                p *= c[padded[i]] / (total + len(c))
                break
            if total:
                p *= len(c) / (total + len(c))
            out |= set(c)
        else:
            p /= 256 - len(out)
        bits -= np.log2(p)
    return bits


def test_ppm_code_lengths_match_brute_force():
    a, b = b"the rain in spain stays mainly in the plain and the train", b"der hund und die katze und der hund in dem haus"
    model = ppm.build({k: np.unique(ppm.grams(t, 3), return_counts=True) for k, t in (("a", a), ("b", b))}, order=3)
    texts = [b"the cat and the hund \xc3\xa9 xyz", b"", b"und " * 400]
    got = model.code_lengths(texts)
    for i, t in enumerate(texts):
        for j, train in enumerate((a, b)):
            assert got[i, j] == pytest.approx(_ppm_bits(train, t, 3), rel=1e-4, abs=1e-3)


def test_ppm_is_a_distribution():
    model = ppm.build({"a": np.unique(ppm.grams(b"abracadabra abracadabra", 2), return_counts=True)}, order=2)
    n = int(model.classes.max()) + 1
    p = 2.0 ** -model.cost[:, 0].reshape(-1, n).astype(float)
    many = np.append(np.ones(n - 1), 256 - (n - 1))
    assert np.allclose((p * many).sum(axis=1), 1, atol=1e-4)


def test_languages(spark, odd, empty):
    rows = ppm.language_query(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    got = ppm.language_query(odd).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert ppm.language_query(empty).count() == 0


def test_letters():
    assert [ppm.has_letter(t) for t in (None, "", "12 ½ ² Ⅷ ① _", "x", "日", "ß1")] == [False, False, False, True, True, True]


def test_every_language_gets_a_tree(spark):
    """70 languages, the last of them with fewer documents than any other."""
    words = lambda k: [chr(97 + k % 26) + chr(97 + k // 26) + c + chr(97 + (k * 7) % 26) for c in "aeiou"]
    rows = [(100 * k + i, " ".join(np.random.default_rng(100 * k + i).choice(words(k), 30)), f"l{k:02d}") for k in range(70) for i in range(8 - (k == 69))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = ppm.language_query(docs).filter("held_out").join(docs, "doc_id").collect()
    assert {r.lang for r in got} == {r.lang_pred for r in got} and "l69" in {r.lang for r in got}
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_trees_do_not_depend_on_other_languages():
    rng = np.random.default_rng(4)
    texts = {k: bytes(rng.choice(list(letters.encode()), 4000)) for k, letters in (("a", "abcd "), ("b", "efgh "), ("c", "ijkl "))}
    counts = {k: np.unique(ppm.grams(t), return_counts=True) for k, t in texts.items()}
    alone, among = ppm.build({"a": counts["a"]}, max_states=200), ppm.build(counts, max_states=200)
    data = [b"abba dab cab", b"efgh abcd", texts["a"][:600]]
    assert np.allclose(alone.code_lengths(data)[:, 0], among.code_lengths(data)[:, 0], rtol=1e-5)


def _unigram(token, lexicon, byte):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        n = len(token[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, best[end - 1][1] - n)]
        options += [(best[b][0] + lexicon[token[b:end]], best[b][1] - 1) for b in range(end) if token[b:end] in lexicon]
        best.append(max(options))
    return -best[-1][1]


def test_trie_counts_match_brute_force(spark, odd, empty):
    lexicon = {p: -float(i + 1) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "abab", "c", "▁ab", "é"])}
    tokens = ["▁" + w for w in ("a", "ab", "aba", "abab", "ababc", "b", "ba", "xé", "日本", "")]
    t = trie.ScoringTrie(lexicon, -20.0)
    t.insert(sorted(tokens))
    assert [t.terminals[x] for x in tokens] == [_unigram(x, lexicon, -20.0) for x in tokens]
    fresh = trie.ScoringTrie(lexicon, -20.0)
    assert [fresh.one(x) for x in tokens] == [t.terminals[x] for x in tokens]
    few = trie.ScoringTrie(lexicon, -20.0)
    old, trie.CACHE = trie.CACHE, 4
    try:
        for a in range(0, len(tokens), 3):  # generations change, counts stay
            few.know({*tokens[a : a + 3], "▁ab"})
            assert [few.one(x) for x in tokens] == [t.terminals[x] for x in tokens] and few.count(tokens) == sum(t.terminals[x] for x in tokens)
    finally:
        trie.CACHE = old
    assert trie.pre_tokens(" a  b\n") == ["▁a", "▁b"] and trie.pre_tokens(" \n") == []
    import public_tokenizers as P

    rows = trie.count_tokens(odd, P.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.n_pretokens for r in rows}[4] == 40_000 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert trie.count_tokens(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_packing_round_trip(spark, odd, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["It's <|endoftext|> a b c I'LL don't 'tis", "Übergrößen ÉCOLE İstanbul ǅ é ́x", "a_b c-d 3.14 ½ x² 日本語 🙂🙂!!! \x1c\x1d", "word" * 40, "'s's ''re"]
    df = spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows = packing.pack(df, path).collect()
    seen: dict = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        seen.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in enumerate([*texts, ODD[-1][1]]):
        doc = 10 + i if i < len(texts) else 4
        ids = b"".join(x for _, x in sorted(seen[doc]))
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    q = packing.packing_query(df, path).filter("doc_id = 10").collect()
    assert all(zlib.crc32(dict(seen[10])[r.start]) == r.ids_crc32 for r in q)
    assert packing.packing_query(empty, path).count() == 0
    assert packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]


def test_packing_looks_words_up_in_bulk():
    """CPU time was spent on each word: many different words of few pre-tokens cost hardly a Python call each."""
    import cProfile
    import itertools

    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    words = ["-".join(x) for x in itertools.product(("Red", "blue", "été", "don't", "7th", "''s"), repeat=5)]
    ids_of, text, profile = packing.WordIds(path), " ".join(words), cProfile.Profile()
    ids = profile.runcall(ids_of.text, text)
    assert ids_of.plain and sum(x.callcount for x in profile.getstats()) < len(words) // 2
    tokenizer = Tokenizer.from_file(path)
    assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    # Caches that change generations all the time, words that are no plain ones, empty texts and bytes that are no text.
    small, some = packing.WordIds(path, 3), ["It's  THE\tend", "", "日本 <|endoftext|> x² W\u030a", " \n", "a b c d e f a b"]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in small.texts(pa.array(some)).to_pylist()] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    broken = pa.array([b"one \xff\xfetwo", b"three"]).cast(pa.binary()).view(pa.string())
    assert np.frombuffer(small.texts(broken)[0].as_py(), dtype="<u4").tolist() == tokenizer.encode("one \ufffd\ufffdtwo", add_special_tokens=False).ids
    assert max(len(small.parts), len(small.parts.old), len(small.others), len(small.others.old)) <= 3


def _base_sha(text):
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            found.append((m.start(), 2, "card", m.end()))
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)).encode()).hexdigest()


def test_personal_data(spark, odd, empty):
    texts = ["a@b.c d@e a@@b.c x@y.z.w@q.r é.x@y.de", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (234) 567-8901 + +12 +1-2", "card 5500005555555559 mail me@x.org from 10.0.0.1", "😀 a@b.co"]
    df = spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pii_query(df).collect()}
    assert all(rows[10 + i].base_sha256 == _base_sha(t) for i, t in enumerate(texts))
    assert rows[15].spans == "email:2:8"
    got = pii.pii_query(odd).collect()
    assert len(got) == len(ODD) and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.pii_query(empty).count() == 0
    masked = pii.mask(df.withColumn("lang", F.lit("en")), pii.fit_spans(df)).filter("doc_id = 14").first()
    assert masked.text == "card [CARD] mail [EMAIL] from [IP]" and masked.lang == "en"


def test_weak_spans_keep_off_base_spans():
    text = "123-45-6789." + "1.2.3.4 " * 9
    assert pii.weak_spans("a123-45-6789 x", []) == []
    base = [("email", 0, 60), *(("ip", a, a + 2) for a in range(5, 40, 5))]
    assert pii.weak_spans("x" * 45 + " 123-45-6789 " + "y" * 20, base) == [] and pii.weak_spans(text, pii.base_spans(text)) == [("identity", 0, 11)]


def test_long_texts_are_cut_at_white_space():
    from quarrymill.llm.common import cut

    text = " ".join("abc" * (1 + i % 5) for i in range(999)) + "\x1c tail"
    for most in (1, 7, 100, 10**6):
        assert [w for part in cut(text, most) for w in part.split()] == text.split()


def test_votes_find_the_reliable():
    rng = np.random.default_rng(3)
    truth = rng.random(2000) < 0.4
    v = np.stack([np.where(rng.random(2000) < acc, truth, ~truth) for acc in (0.9, 0.85, 0.6)], axis=1).astype(int)
    v[rng.random(v.shape) < 0.2] = -1
    theta, prior, q = pii.aggregate_votes(v)
    assert ((q > 0.5) == truth).mean() > 0.85 and theta[0, 0] - theta[0, 1] > theta[2, 0] - theta[2, 1]


def test_voters_are_fitted_on_all_candidates(spark):
    """A kind in one document of 2,500, behind 40 base spans, is counted and weighted."""
    many = " ".join(f"u{i}@mail.example" for i in range(40))
    texts = ["write to a@b.com"] * 9_996 + [f"{many} ssn 123-45-678{i}" for i in range(4)]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    keys, n = pii.count_patterns(docs)
    v, x = pii.unpacked(keys)
    kinds = (*pii.KINDS, *pii.WEAK_KINDS)
    of = {k: int(n[x[:, i] == 1].sum()) for i, k in enumerate(kinds)}
    assert of == {**dict.fromkeys(kinds, 0), "email": 9_996 + 160, "identity": 4}
    assert pii.fit_spans(docs).weights[kinds.index("identity")] != 0
    t, span = texts[-1], pii.find_spans(texts[-1], pii.fit_spans(docs), 0.0)[1][0]
    v, x = pii.unpacked(np.array([pii.pattern(t, span, 3)]))
    assert v[0].tolist() == pii.votes(t, span, 3) and x[0, kinds.index("identity")] == 1 and x[0, -2] == 3


def test_counted_rows_fit_as_repeated_rows():
    rng = np.random.default_rng(5)
    v = rng.integers(-1, 2, (40, 4))
    x, n = np.column_stack([v == 1, v == 0, np.ones(40)]).astype(float), rng.integers(1, 9, 40)
    once, again = pii.aggregate_votes(v, count=n), pii.aggregate_votes(np.repeat(v, n, axis=0))
    assert np.allclose(once[0], again[0]) and np.allclose(np.repeat(once[2], n), again[2])
    assert np.allclose(pii.fit_classifier(x, once[2], n), pii.fit_classifier(np.repeat(x, n, axis=0), again[2], np.ones(n.sum())))


@pytest.mark.parametrize("place", [0, 17, 49])
def test_a_text_over_the_bound_keeps_no_other_out(spark, place):
    from quarrymill.llm.common import labelled_texts

    docs = spark.createDataFrame([(i, "x" * (600 if i == place else 10)) for i in range(50)], "doc_id long, text string")
    sample = spark.createDataFrame([(i, i % 2) for i in range(50)], "_id long, label int")
    assert {r["_id"] for r in labelled_texts(docs, sample, 550).collect()} == set(range(50)) - {place}
    some = labelled_texts(docs, sample, 95).collect()
    assert len(some) == 9 and place not in {r["_id"] for r in some}


def test_no_sentence_scores_zero():
    import math

    from quarrymill.llm.mil_toxicity import noisy_or

    assert math.copysign(1, noisy_or(np.zeros(0))) == 1
