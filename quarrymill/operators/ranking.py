"""Retrieval algebra: dense and sparse search, fusion, name lookup, budgets.

Every result is (query_id, node_id, score, rank) with ties broken by id, so that it is the same
on any cluster. Query sets are stated and their size is checked before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalars import dot, identifiers, normalised, relevance_verdict
from ..sources.sinks import written

#: Queries in one block; rows of a query set that may be broadcast (64 dimensions: about 15 MB).
BLOCK, BROADCAST_ROWS = 512, 20_000
#: Characters of texts that may be broadcast; words in the key of an item's text, and in that of a short one.
BROADCAST_CHARS, RUNS = 32_000_000, (8, 2)
#: Bytes of a query set's vectors, as doubles, that are sent to every task.
BROADCAST_BYTES = 32 << 20


def rank_by(df: DataFrame, partition: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """k best rows of each query, by score rounded to 6 digits and then id; a partial top-k runs before the shuffle."""
    scored = scored.withColumn("score", F.round("score", 6))
    return rank_by(scored, ["query_id"], [F.desc("score"), F.asc("node_id")]).filter(F.col("rank") <= k)


def against_all(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every row of a stated query set beside every row of `rows`: the set is dealt into blocks by a hash of `key`.

    Up to BROADCAST_ROWS, counted first, the set is broadcast; beyond, both sides meet by block.
    """
    n = asked.count()
    blocks = max(1, -(-n // BLOCK))
    q = asked.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    v = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return v.join(F.broadcast(q) if n <= BROADCAST_ROWS else q, "_block").drop("_block")


def whole_items(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id) of every row of (doc_id, text) whose text holds the text of a row of (item_id, text) as it stands.

    An item's first and last word may be cut from longer ones, those between are whole words of the
    text. Their first 8, or 2 where there are fewer, are hashed and joined with the hashes of the
    text's runs; hits are compared. Items with under 2 such words are sought in every text, by
    blocks. Up to BROADCAST_ROWS items and BROADCAST_CHARS of their texts, counted first, are
    broadcast and no text moves; beyond, runs meet by hash and texts by their digest.
    Null texts hold nothing and are in nothing; an empty item is in every text; repeated rows count each.
    """
    words = F.split("text", r"\s+", -1)
    inner = F.size(words) - 2
    asked = items.filter("text is not null").select("item_id", F.col("text").alias("_item"), F.slice(words, 2, F.greatest(inner, F.lit(0))).alias("_inner"))
    run = F.when(F.size("_inner") >= RUNS[0], RUNS[0]).when(F.size("_inner") >= RUNS[1], RUNS[1])
    asked = asked.withColumn("_run", run).withColumn("_key", F.when(F.col("_run").isNotNull(), F.xxhash64(F.slice("_inner", 1, F.col("_run"))))).drop("_inner")
    found = {r["_run"]: r for r in asked.groupBy("_run").agg(F.count("*").alias("n"), F.sum(F.length("_item")).alias("chars")).collect()}
    texts = texts.select("doc_id", "text").filter("text is not null")
    runs = [r for r in RUNS if r in found]
    parts = []
    if None in found or not runs:
        parts.append(against_all(asked.filter("_run is null"), texts, "item_id"))
    if runs:
        keyed = asked.filter("_run is not null").select("item_id", "_item", "_key")
        starts = lambda n: F.when(F.size("_words") >= n, F.transform(F.sequence(F.lit(1), F.size("_words") - (n - 1)), lambda i: F.xxhash64(F.slice("_words", i, n))))
        hashes = F.array_distinct(F.flatten(F.array_compact(F.array(*map(starts, runs)))))
        small = sum(found[r]["n"] for r in runs) <= BROADCAST_ROWS and sum(found[r]["chars"] for r in runs) <= BROADCAST_CHARS
        if small:
            hits = texts.withColumn("_words", words).select("doc_id", "text", F.explode(hashes).alias("_key")).join(F.broadcast(keyed), "_key")
        else:
            digest = F.sha2("text", 256).alias("_digest")
            near = texts.select("text", digest).withColumn("_words", words).select("_digest", F.explode(hashes).alias("_key")).join(keyed.select("_key").distinct(), "_key").distinct()
            hits = texts.select("doc_id", "text", digest).join(near, "_digest").join(keyed, "_key")
        parts.append(hits)
    return reduce(DataFrame.unionByName, [p.filter(F.contains("text", "_item")).select("item_id", "doc_id") for p in parts])


def _best(scores: np.ndarray, by_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, and of those that may tie with them; of one score the k first by `by_id`."""
    least = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
    some = np.flatnonzero((scores >= least - 2e-6) & (scores > -np.inf))
    some = some[np.lexsort((by_id[some], -scores[some]))]
    x = scores[some]
    first = np.maximum.accumulate(np.where(np.append(True, x[1:] != x[:-1]), np.arange(len(x)), 0)) if len(x) else x
    return some[np.arange(len(x)) - first < k]


def _nearest(asked: dict[int, tuple[list, np.ndarray]], k: int, exclude_self: bool):
    """A function over Arrow batches (node_id, vector): of each batch, the k best rows of each query, and those that may tie with them.

    `asked` has query ids and unit vectors by length; rows of other lengths are not compared. Rows of
    one score are kept up to the k smallest ids, so that ties, as of zero vectors, don't grow a result.
    """
    places: dict[int, dict] = {n: {} for n in asked}
    for n, (ids, _) in asked.items():
        for i, q in enumerate(ids):
            places[n].setdefault(q, []).append(i)

    def run(batches):
        for b in batches:
            column, nodes = b.column("vector"), b.column("node_id").to_pylist()
            lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
            out: tuple[list, list, list] = ([], [], [])
            for n, (ids, unit) in asked.items():
                rows = np.flatnonzero(lengths == n)
                if not len(rows) or not n:
                    continue
                m = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
                size = np.sqrt((m * m).sum(axis=1))
                scores = unit @ (m / np.where(size > 0, size, 1.0)[:, None]).T
                scores[np.isnan(scores)] = -np.inf
                held = [nodes[r] for r in rows]
                if exclude_self:
                    for at, node in enumerate(held):
                        if node in places[n]:
                            scores[places[n][node], at] = -np.inf
                by_id = np.empty(len(held), dtype=np.int64)
                by_id[sorted(range(len(held)), key=held.__getitem__)] = np.arange(len(held))
                for q, row in enumerate(scores):
                    some = _best(row, by_id, k)
                    out[0].extend([ids[q]] * len(some))
                    out[1].extend(held[a] for a in some)
                    out[2].extend(row[some].tolist())
            yield out

    return run


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """Cosine top-k of each query (query_id, vector) among (node_id, vector) (RET-01, JOIN-16).

    Filters on `vectors` belong below this call, so that they apply before the top-k. A query set of up to
    BROADCAST_BYTES, counted first, is sent to every task, which multiplies it with its Arrow batches and
    keeps the best of each; larger ones meet the vectors by blocks. Null vectors and null ids take no part,
    nor do vectors with null components; a zero vector's score is 0 with any other; only vectors of one length are
    compared. All queries of a repeated id are one set of hits.
    """
    whole = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    queries, vectors = queries.filter(whole).select("query_id", "vector"), vectors.filter(whole & F.col("node_id").isNotNull()).select("node_id", "vector")
    size = queries.agg(F.sum(F.size("vector")).alias("n")).first()["n"] or 0
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["node_id"]
    if 8 * size > BROADCAST_BYTES:
        q = queries.select("query_id", normalised(F.col("vector")).alias("_q"))
        pairs = against_all(q, vectors.select("node_id", normalised(F.col("vector")).alias("_v")), "query_id").filter(F.size("_q") == F.size("_v"))
        if exclude_self:
            pairs = pairs.filter(F.col("query_id") != F.col("node_id"))
        return top_k(pairs.select("query_id", "node_id", dot(F.col("_q"), F.col("_v")).alias("score")), k).select("query_id", "node_id", "score", "rank")
    asked: dict[int, tuple[list, list]] = {}
    for r in queries.collect():
        ids, rows = asked.setdefault(len(r["vector"]), ([], []))
        ids.append(r["query_id"])
        rows.append(r["vector"])
    unit = {}
    for n, (ids, rows) in asked.items():
        m = np.array(rows, dtype=np.float64).reshape(-1, n)
        length = np.sqrt((m * m).sum(axis=1))
        unit[n] = (ids, m / np.where(length > 0, length, 1.0)[:, None])
    sent = queries.sparkSession.sparkContext.broadcast(unit)

    def run(batches):
        for ids, nodes, scores in _nearest(sent.value, k, exclude_self)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, query_type), pa.array(nodes, node_type), pa.array(scores, pa.float64())], names=["query_id", "node_id", "score"])

    query_type, node_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((queries, "query_id"), (vectors, "node_id")))
    scored = vectors.mapInArrow(run, f"query_id {kinds[0]}, node_id {kinds[1]}, score double")
    return top_k(scored, k).select("query_id", "node_id", "score", "rank")


def postings(docs: DataFrame, terms: Column, wanted: DataFrame | None = None) -> DataFrame:
    """(node_id, term, weight): the count of each term; of the terms of `wanted` (term) alone, if it is given (AGG-07).

    Up to BROADCAST_ROWS wanted terms, counted first, are broadcast: others then go before anything is grouped.
    """
    found = docs.select("node_id", F.explode(terms).alias("term"))
    if wanted is not None:
        w = wanted.select("term").distinct()
        found = found.join(F.broadcast(w) if w.count() <= BROADCAST_ROWS else w, "term", "left_semi")
    return found.groupBy("node_id", "term").agg(F.count("*").cast("double").alias("weight"))


def token_weights(tokens: DataFrame, special: list[str] = ()) -> DataFrame:
    """(node_id, term, weight): a model's weights of tokens (node_id, term, weight), the largest of repeated ones, special ones gone (AGG-07)."""
    return tokens.filter(~F.col("term").isin(*special) if special else F.lit(True)).groupBy("node_id", "term").agg(F.max("weight").alias("weight"))


#: Rows whose tokens are counted at once.
ROWS = 1_000


def first_places(docs: DataFrame, tokens: Column) -> DataFrame:
    """(node_id, term, place): each distinct token of a row's array `tokens`, at its first place, from 1; within the row, nothing is grouped."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                b = whole.slice(a, ROWS)
                lists = pc.fill_null(pc.list_value_length(b.column("tokens")), 0).to_numpy(zero_copy_only=False)
                row, known = np.repeat(np.arange(b.num_rows), lists), b.column("tokens").flatten().dictionary_encode()
                _, at = np.unique(row * len(known.dictionary) + np.asarray(known.indices), return_index=True)
                place = at - (np.cumsum(lists) - lists)[row[at]] + 1
                yield pa.RecordBatch.from_arrays([b.column("node_id").take(pa.array(row[at])), known.dictionary.take(known.indices.take(pa.array(at))), pa.array(place)], names=["node_id", "term", "place"])

    rows = docs.select("node_id", F.array_compact(tokens).alias("tokens"))
    return rows.mapInArrow(run, f"node_id {dict(docs.dtypes)['node_id']}, term string, place long")


def sparse_topk(query_terms: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """Dot product over shared terms (RET-02): (query_id, term, weight) against (node_id, term, weight).

    Up to BROADCAST_ROWS query terms, counted first, are broadcast, so that a frequent term's
    postings stay where they are; beyond, both sides meet by term, which adaptive execution can split.
    """
    q = query_terms.select("query_id", "term", F.col("weight").alias("_qw"))
    scored = index.join(F.broadcast(q) if q.count() <= BROADCAST_ROWS else q, "term").groupBy("query_id", "node_id").agg(F.sum(F.col("_qw") * F.col("weight")).alias("score"))
    return top_k(scored, k).select("query_id", "node_id", "score", "rank")


def by_row(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of (node_id, ...) whose id stands on no other row, and the others, if there are any; only ids are counted.

    What is grouped by id can be done within a row of the first part.
    """
    several = docs.groupBy("node_id").agg(F.count("*").alias("_n")).filter("_n > 1 or node_id is null").select("node_id")
    several = written(several, "several")
    if several.isEmpty():
        return docs, None
    same = docs["node_id"].eqNullSafe(several["node_id"])
    return docs.join(several, same, "left_anti"), docs.join(several, same, "left_semi")


#: Scores of documents and queries that a task holds at once.
SCORES = 2 << 20


def sparse_topk_of(query_terms: DataFrame, docs: DataFrame, terms: Column, k: int = 10) -> DataFrame:
    """`sparse_topk` against the counted `terms` of documents (node_id, ...), whose postings are never written.

    Up to BROADCAST_ROWS query terms, counted first, are sent to every task. It counts the terms of an Arrow
    batch and keeps the k best documents of each query, so that neither postings nor scores are grouped;
    documents on several rows, and larger query sets, are.
    """
    q = query_terms.filter("query_id is not null and term is not null").select("query_id", "term", F.col("weight").cast("double").alias("weight"))
    grouped = lambda rows: sparse_topk(query_terms, postings(rows, terms, query_terms), k)
    if query_terms.count() != (n := q.filter("weight is not null").count()) or n > BROADCAST_ROWS:
        return grouped(docs)
    single, several = by_row(docs)
    found = q.collect()
    asked = sorted({r["query_id"] for r in found})
    place, vocabulary = {x: i for i, x in enumerate(asked)}, sorted({r["term"] for r in found})
    at = {t: i for i, t in enumerate(vocabulary)}
    found.sort(key=lambda r: at[r["term"]])
    first = np.searchsorted([at[r["term"]] for r in found], np.arange(len(vocabulary) + 1))
    sent = q.sparkSession.sparkContext.broadcast((pa.array(vocabulary, pa.string()), first, np.array([place[r["query_id"]] for r in found], dtype=np.int64), np.array([r["weight"] for r in found], dtype=np.float64)))
    query_type, node_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((q, "query_id"), (docs, "node_id")))

    def run(batches):
        vocabulary, first, of, weight = sent.value
        queries, most = len(asked), max(1, SCORES // max(1, len(asked)))
        for whole in batches:
            for a in range(0, whole.num_rows, most):
                b = whole.slice(a, most)
                lists = pc.fill_null(pc.list_value_length(b.column("terms")), 0).to_numpy(zero_copy_only=False)
                codes = pc.index_in(b.column("terms").flatten(), value_set=vocabulary)
                known = np.asarray(codes.is_valid())
                row = np.repeat(np.arange(b.num_rows), lists)[known]
                pairs, counts = np.unique(row * len(vocabulary) + np.asarray(codes.drop_null(), dtype=np.int64), return_counts=True)
                row, term = np.divmod(pairs, max(1, len(vocabulary)))
                size = first[term + 1] - first[term]  # a term's queries follow one another
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[term], size)
                cell = of[step] * b.num_rows + np.repeat(row, size)
                score = np.bincount(cell, weights=weight[step] * np.repeat(counts, size), minlength=queries * b.num_rows)
                score[np.bincount(cell, minlength=queries * b.num_rows) == 0] = -np.inf
                nodes = b.column("node_id").to_pylist()
                by_id = np.empty(len(nodes), dtype=np.int64)
                by_id[sorted(range(len(nodes)), key=nodes.__getitem__)] = np.arange(len(nodes))
                out: tuple[list, list, list] = ([], [], [])
                for i, scores in enumerate(score.reshape(queries, b.num_rows)):
                    some = _best(scores, by_id, k)
                    out[0].extend([asked[i]] * len(some))
                    out[1].extend(nodes[x] for x in some)
                    out[2].extend(scores[some].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], query_type), pa.array(out[1], node_type), pa.array(out[2], pa.float64())], names=["query_id", "node_id", "score"])

    kinds = dict(q.dtypes) | dict(docs.dtypes)
    scored = single.select("node_id", terms.alias("terms")).mapInArrow(run, f"query_id {kinds['query_id']}, node_id {kinds['node_id']}, score double")
    if several is not None:
        scored = scored.unionByName(grouped(several).drop("rank"))
    return top_k(scored, k).select("query_id", "node_id", "score", "rank")


#: Documents, sets of query terms and bytes of marks that a task counts at once.
DOCS, SETS, MARKS = 4_096, 256, 64 << 20


def shared_terms_topk(query_terms: DataFrame, docs: DataFrame, terms: Column, k: int = 3) -> DataFrame:
    """(query_id, node_id, rank): the k documents (node_id, ...) with most distinct `terms` that are also the query's (query_id, term), then the smallest ids.

    Queries of the same terms are one set. Sets are sent to every task, in turns of BROADCAST_CHARS; documents,
    coded by their terms, are dealt by ranges of ids. A task takes them in the order of ids and adds the marks
    of a set's terms over DOCS documents at once; a set is passed over where so few of its terms occur that no
    document can have more of them than the set's k-th one so far. No pair is a row. Documents on several
    rows count each, and are joined.
    """
    sets = written(query_terms.filter("term is not null").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms")), "sets")
    classes = written(sets.groupBy("terms").agg(F.min("query_id").alias("first")), "classes")
    single, several = by_row(docs.select("node_id", terms.alias("terms")))
    chars = classes.agg(F.sum(F.length(F.array_join("terms", " ")))).first()[0] or 0
    turns = max(1, -(-chars // BROADCAST_CHARS))
    parts = [_most_shared(classes.filter(F.pmod(F.xxhash64("terms"), F.lit(turns)) == t), single, k) for t in range(turns)]
    order = [F.desc("n"), F.asc("node_id")]
    best = rank_by(reduce(DataFrame.unionByName, parts), ["first"], order).filter(F.col("rank") <= k).drop("rank")
    found = best.join(classes, "first").join(sets, "terms").select("query_id", "node_id", "n")
    if several is not None:
        index = several.select("node_id", F.explode(F.array_distinct("terms")).alias("term"))
        found = found.unionByName(index.join(sets.select("query_id", F.explode("terms").alias("term")), "term").groupBy("query_id", "node_id").agg(F.count("*").alias("n")))
    return rank_by(found, ["query_id"], order).filter(F.col("rank") <= k).select("query_id", "node_id", "rank")


def _most_shared(classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(first, node_id, n): for each set of (terms, first), the k documents of each task with most of its terms."""
    types = {c: to_arrow_type(df.schema[c].dataType) for df, c in ((classes, "first"), (docs, "node_id"))}
    kinds = dict(classes.dtypes) | dict(docs.dtypes)
    asked = classes.orderBy(F.size("terms"), "first").select("first", "terms").toArrow().combine_chunks()
    lists = asked["terms"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, dtype=np.int64)
    known = lists.flatten().dictionary_encode()
    width = int(sizes.max()) if len(sizes) else 0
    codes = np.full((len(sizes), width), len(known.dictionary), dtype=np.int32)
    codes[np.arange(width) < sizes[:, None]] = np.asarray(known.indices)
    context = classes.sparkSession.sparkContext
    words, sent = context.broadcast(known.dictionary), context.broadcast((asked["first"].combine_chunks(), codes, sizes))
    total = len(known.dictionary)

    def coded(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                b = whole.slice(a, ROWS)
                row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(b.column("terms")), 0).to_numpy(zero_copy_only=False))
                found = pc.index_in(b.column("terms").flatten(), value_set=words.value)
                row, code = np.divmod(np.unique(row[np.asarray(found.is_valid())] * max(1, total) + np.asarray(found.drop_null(), dtype=np.int64)), max(1, total))
                ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("node_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(code.astype(np.int32)))], names=["node_id", "codes"])

    def run(batches):
        first, codes, sizes = sent.value
        most = np.zeros((len(sizes), k), dtype=np.int32)
        nodes = np.empty((len(sizes), k), dtype=object)

        def take(ids, row, code):
            occurring, at = np.unique(code, return_inverse=True)
            marks = np.zeros((len(occurring) + 1, len(ids)), dtype=np.uint8 if width < 256 else np.uint32)
            marks[at, row] = 1
            place = np.full(total + 1, len(occurring), dtype=np.int32)
            place[occurring] = np.arange(len(occurring))
            local = place[codes]
            hopeful = np.flatnonzero((local < len(occurring)).sum(axis=1) > most[:, -1])
            for a in range(0, len(hopeful), SETS):
                some = hopeful[a : a + SETS]
                counts = np.zeros((len(some), len(ids)), dtype=marks.dtype)
                for j in range(int(sizes[some[-1]])):  # sets stand by size
                    counts += marks[local[some, j]]
                better = counts.max(axis=1) > most[some, -1]
                some, counts = some[better], counts[better]
                each = np.arange(len(some))
                new, named = np.zeros((len(some), k), dtype=np.int32), np.empty((len(some), k), dtype=object)
                for i in range(k):  # the first of equals has the smallest id
                    x = counts.argmax(axis=1)
                    new[:, i], named[:, i] = counts[each, x], ids[x]
                    counts[each, x] = 0
                both, which = np.hstack([most[some], new]), np.hstack([nodes[some], named])
                order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                most[some], nodes[some] = np.take_along_axis(both, order, axis=1), np.take_along_axis(which, order, axis=1)

        for whole in batches:
            ids = np.array(whole.column("node_id").to_pylist(), dtype=object)
            code = whole.column("codes").flatten().to_numpy()
            ends = np.append(0, np.cumsum(whole.column("codes").value_lengths().to_numpy()))
            a = 0
            while a < len(ids):
                b = min(len(ids), a + DOCS)
                while b - a > 1 and (b - a) * min(total, int(ends[b] - ends[a])) > MARKS:
                    b = a + (b - a) // 2
                take(ids[a:b], np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), code[ends[a] : ends[b]])
                a = b
        at, of = np.nonzero(most)
        yield pa.RecordBatch.from_arrays([first.take(pa.array(at)), pa.array(nodes[at, of].tolist(), types["node_id"]), pa.array(most[at, of].astype(np.int64))], names=["first", "node_id", "n"])

    rows = written(docs.mapInArrow(coded, f"node_id {kinds['node_id']}, codes array<int>").filter(F.size("codes") > 0), "coded")
    rows = rows.repartitionByRange("node_id").sortWithinPartitions("node_id")
    return rows.mapInArrow(run, f"first {kinds['first']}, node_id {kinds['node_id']}, n long")


def rrf(rankings: list[DataFrame], k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion; ties keep the order of first appearance: list, then rank (RET-04, AGG-08)."""
    both = reduce(DataFrame.unionByName, [r.select("query_id", "node_id", "rank", F.lit(i).alias("_list")) for i, r in enumerate(rankings)])
    fused = both.groupBy("query_id", "node_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))
    out = rank_by(fused, ["query_id"], [F.desc("score"), F.asc("_first"), F.asc("node_id")])
    return (out.filter(F.col("rank") <= limit) if limit else out).select("query_id", "node_id", "score", "rank")


def with_visual(text_hits: DataFrame, visual_hits: DataFrame, nodes: DataFrame, limit: int, pixels_only: bool = False) -> DataFrame:
    """Text hits fused with hits on pictures and pages, scores to 5 digits (RET-10).

    `pixels_only` first takes image and figure nodes (node_id, node_type) off the text hits and
    closes the ranks up, so that pictures are found by their pixels alone.
    """
    if pixels_only:
        drawn = nodes.filter(F.col("node_type").isin("image", "figure")).select("node_id")
        kept = text_hits.join(drawn, "node_id", "left_anti").withColumnRenamed("rank", "_r")
        text_hits = rank_by(kept, ["query_id"], [F.asc("_r")])
    return rrf([text_hits, visual_hits], limit=limit).withColumn("score", F.round("score", 5))


def hybrid(dense: DataFrame, sparse: DataFrame, limit: int = 10) -> DataFrame:
    """Fusion of two prefetches of max(5 * limit, 50) rows each (RET-03)."""
    most = max(5 * limit, 50)
    return rrf([dense.filter(F.col("rank") <= most), sparse.filter(F.col("rank") <= most)], limit=limit)


#: Best products of token and item that a task holds before it hands them on.
HELD = 4 << 20


def max_similarity(query_tokens: DataFrame, item_vectors: DataFrame, k: int = 10) -> DataFrame:
    """Late interaction (JOIN-24): sum over a query's token vectors of the largest dot product in an item.

    Token vectors of up to BROADCAST_BYTES, counted first, are sent to every task, which multiplies them with its
    Arrow batches and holds the largest product of each token and item: no pair is a row. Larger sets meet
    the vectors by blocks. Vectors of different lengths, and null ones, have no product.
    """
    q = query_tokens.select("query_id", F.col("token").alias("_t"), normalised(F.col("vector")).alias("_q"))
    i = item_vectors.select("node_id", normalised(F.col("vector")).alias("_v"))
    if 8 * (q.agg(F.sum(F.size("_q"))).first()[0] or 0) > BROADCAST_BYTES:
        best = against_all(q, i, "_t").select("query_id", "node_id", "_t", dot(F.col("_q"), F.col("_v")).alias("m"))
    else:
        best = _products(q, i)
    best = best.groupBy("query_id", "node_id", "_t").agg(F.max("m").alias("m"))
    return top_k(best.groupBy("query_id", "node_id").agg(F.sum("m").alias("score")), k).select("query_id", "node_id", "score", "rank")


def _products(q: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, _t, node_id, m): of each token's unit vector `_q` and each item of a task, the largest dot product with its vectors `_v`."""
    asked = q.collect()
    by_length: dict[int, list[int]] = {}
    for at, r in enumerate(asked):
        if r["_q"] is not None:
            by_length.setdefault(len(r["_q"]), []).append(at)
    unit = {n: (np.array(rows), np.array([asked[at]["_q"] for at in rows], dtype=np.float64).reshape(-1, n)) for n, rows in by_length.items()}
    types = {c: to_arrow_type(df.schema[c].dataType) for df, c in ((q, "query_id"), (q, "_t"), (items, "node_id"))}
    ids = {c: pa.array([r[c] for r in asked], types[c]) for c in ("query_id", "_t")}
    sent = q.sparkSession.sparkContext.broadcast((unit, ids))

    def run(batches):
        unit, ids = sent.value
        tokens, held = len(ids["_t"]), {}

        def handed():
            at = pa.array(np.tile(np.arange(tokens), len(held)))
            m = np.concatenate(list(held.values()))
            nodes = pa.array(list(held), types["node_id"]).take(pa.array(np.repeat(np.arange(len(held)), tokens)))
            return pa.RecordBatch.from_arrays([ids["query_id"].take(at), ids["_t"].take(at), nodes, pa.array(m, mask=m == -np.inf)], names=["query_id", "_t", "node_id", "m"])

        for b in batches:
            column, named = b.column("_v"), b.column("node_id").dictionary_encode(null_encoding="encode")
            names, codes = named.dictionary.to_pylist(), np.asarray(named.indices)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
            for name in names:
                held.setdefault(name, np.full(tokens, -np.inf))
            for n, (places, vectors) in unit.items():
                rows = np.flatnonzero(lengths == n)
                rows = rows[np.argsort(codes[rows], kind="stable")]
                if not len(rows):
                    continue
                m = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                starts = np.flatnonzero(np.append(True, np.diff(codes[rows]) != 0))
                for at in range(0, len(places), BLOCK):
                    largest = np.maximum.reduceat(vectors[at : at + BLOCK] @ m.T, starts, axis=1)
                    some = places[at : at + BLOCK]
                    for column_at, code in enumerate(codes[rows[starts]]):
                        mine = held[names[code]]
                        mine[some] = np.maximum(mine[some], largest[:, column_at])
            if len(held) * tokens > HELD:
                yield handed()
                held.clear()
        if held and tokens:
            yield handed()

    kinds = dict(q.dtypes) | dict(items.dtypes)
    return items.mapInArrow(run, f"query_id {kinds['query_id']}, _t {kinds['_t']}, node_id {kinds['node_id']}, m double")


def ordered_union(frames: list[DataFrame], key: list[str], order: str) -> DataFrame:
    """Rows of all frames in turn, each key at its first place only (SET-01, WIN-09)."""
    both = reduce(DataFrame.unionByName, [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)])
    return rank_by(both, key, [F.asc("_frame"), F.asc(order)], "_first").filter("_first = 1").drop("_first", "_frame")


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return rank_by(df, key, order, "_n").filter("_n = 1").drop("_n")


def within_budget(ranked: DataFrame, size: str, budget: int, partition: list[str], order: str = "rank") -> DataFrame:
    """The longest prefix whose sizes fit the budget; the first row always stays (CHK-18, WIN-11)."""
    w = Window.partitionBy(*partition).orderBy(order)
    return ranked.withColumn("_sum", F.sum(size).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def name_candidates(questions: DataFrame, symbols: DataFrame, calls: DataFrame, nodes: DataFrame, pool: int = 40) -> DataFrame:
    """Fragments that define, then call, a name the question mentions (RET-05, JOIN-03/04).

    questions (query_id, text); symbols (name_lc, file_path, line_start, line_end); calls
    (name_lc, file_path, line); nodes (node_id, file_path, line_start, line_end, ord).

    A name's places of the same lines, and fragments of the same lines, meet once: a question's spans get
    their best place first, and of a span's fragments only the first `pool` can be among its candidates.
    """
    asked = questions.select("query_id", F.posexplode(identifiers(F.col("text"))).alias("_pos", "_name")).select("query_id", "_pos", F.lower("_name").alias("name_lc"))
    overlap = (F.col("n.line_start") <= F.col("s.line_end")) & (F.col("n.line_end") >= F.col("s.line_start"))
    places = symbols.select("name_lc", "file_path", "line_start", "line_end", F.lit(0).alias("_kind")).unionByName(calls.select("name_lc", "file_path", F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.lit(1).alias("_kind")))
    span = ["file_path", "line_start", "line_end"]
    named = asked.select("name_lc").distinct()
    places = places.join(named, "name_lc", "left_semi").groupBy("name_lc", *span).agg(F.min("_kind").alias("_kind"))
    best = asked.join(places, "name_lc").groupBy("query_id", *span).agg(F.min(F.struct("_kind", "_pos")).alias("_place"))
    found = best.alias("s").join(nodes.select(*span).distinct().alias("n"), (F.col("s.file_path") == F.col("n.file_path")) & overlap)
    found = found.groupBy("s.query_id", "n.file_path", "n.line_start", "n.line_end").agg(F.min("s._place").alias("_place"))
    first = rank_by(nodes.groupBy(*span, "node_id").agg(F.min("ord").alias("ord")), span, [F.asc("ord"), F.asc("node_id")], "_n").filter(F.col("_n") <= pool).drop("_n")
    one = found.join(first, span).groupBy("query_id", "node_id").agg(F.min(F.struct("_place._kind", "_place._pos", "file_path", "ord")).alias("_at"))
    return rank_by(one, ["query_id"], [F.asc("_at"), F.asc("node_id")]).filter(F.col("rank") <= pool).select("query_id", "node_id", "rank")


def hard_negatives(vectors: DataFrame, group: str) -> DataFrame:
    """The most similar other row of the same group (JOIN-21); groups are files, of bounded size."""
    a, b = vectors.alias("a"), vectors.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.node_id") != F.col("b.node_id")))
    s = F.round(dot(normalised(F.col("a.vector")), normalised(F.col("b.vector"))), 6)
    best = pairs.groupBy("a.node_id").agg(F.max(F.struct(s.alias("s"), (-F.col("b.node_id")).alias("i"))).alias("m"))
    return best.select("node_id", (-F.col("m.i")).alias("negative_id"), F.col("m.s").alias("score"))


def rerank(hits: DataFrame, scorer, question: str = "question", passage: str = "passage") -> DataFrame:
    """Score (question, passage) with an injected Arrow-batched scorer and rank again (RET-07)."""

    @F.pandas_udf("double")
    def score(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), p.tolist()), dtype="float64")

    return rank_by(hits.drop("rank").withColumn("score", score(question, passage)), ["query_id"], [F.desc("score"), F.asc("node_id")])


def word_overlap_scorer(questions: list[str], passages: list[str]) -> list[float]:
    """0.9 where the passage holds a word of the question, else 0.02: the stand-in for a cross-encoder."""
    import re

    return [0.9 if any(w in (p or "").lower() for w in re.findall(r"\w{2,}", (q or "").lower())) else 0.02 for q, p in zip(questions, passages, strict=True)]


def hash_embedding(docs: DataFrame, dims: int = 128) -> DataFrame:
    """(node_id, vector): L2-normalised counts of words by crc32 modulo `dims` (RET-08); zeros for a text without words."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    counts = docs.select("node_id", words.alias("w")).groupBy("node_id", F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(dims)).cast("int").alias("d")).agg(F.count("*").cast("double").alias("c"))
    as_map = counts.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "c"))).alias("m"))
    every = docs.select("node_id").distinct().join(as_map, "node_id", "left")
    counted = normalised(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))))
    return every.select("node_id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dims)).otherwise(counted).alias("vector"))


def search(hits: DataFrame, exact: DataFrame | None, top_k_: int, pool: int, reranked: DataFrame | None = None) -> DataFrame:
    """Order of the fusion (RET-06): re-rank the union first, then fuse the exact names; the cut comes last."""
    base = reranked if reranked is not None else hits
    if exact is not None:
        base = rrf([base, exact], limit=pool)
    return base.filter(F.col("rank") <= top_k_)


def corrective_search(questions: DataFrame, search: Callable[[DataFrame], DataFrame], relevance: Callable[[DataFrame], DataFrame], rewrite: Callable[[Column], Column]) -> DataFrame:
    """(query_id, node_id, rank, round, best, verdict): hits of each question, found again with a rewritten one where the first are irrelevant (RET-11).

    `search` takes (query_id, text) and gives (query_id, node_id, rank); `relevance` takes (query_id,
    question, node_id) and adds `relevance`; `rewrite` is a column function. Only questions whose best
    relevance is below the verdict's lower bound enter the second round, by a semi-join; its hits are judged
    against the question as it was asked, and replace the first ones if their best is better. A question that
    is irrelevant still keeps no hit: it has one row, without a node, that tells the verdict, as has one
    without any hit. All questions are in the same few jobs.
    """
    asked = questions.select("query_id", "text")

    def judged(hits: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        hits = written(hits.select("query_id", "node_id", "rank").withColumn("round", F.lit(number)), f"round-{number}")
        pairs = hits.select("query_id", "node_id").join(asked.withColumnRenamed("text", "question"), "query_id")
        return hits, relevance(pairs).groupBy("query_id").agg(F.max("relevance").alias(f"best{number}"))

    first, best = judged(search(asked), 1)
    best = written(asked.select("query_id").join(best, "query_id", "left").withColumn("best1", F.coalesce("best1", F.lit(0.0))), "best")
    again = best.filter(relevance_verdict(F.col("best1")) == "incorrect").select("query_id")
    second, better = judged(search(asked.join(again, "query_id", "left_semi").withColumn("text", rewrite(F.col("text")))), 2)
    both = best.join(better, "query_id", "left").withColumn("round", F.when(F.coalesce("best2", F.lit(0.0)) > F.col("best1"), 2).otherwise(1)).withColumn("best", F.greatest("best1", F.coalesce("best2", F.lit(0.0))))
    told = both.select("query_id", "round", "best", relevance_verdict(F.col("best")).alias("verdict"))
    kept = first.unionByName(second).join(told.filter("verdict <> 'incorrect'").select("query_id", "round"), ["query_id", "round"], "left_semi")
    return told.join(kept, ["query_id", "round"], "left").select("query_id", "node_id", "rank", "round", "best", "verdict")
