"""Retrieval queries. Query sets are the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import ranking as R
from .registry import register, read

NORM = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"


def vectors(s, d):
    return read(s, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"), "label")


def asked(v):
    return v.filter(F.col("node_id") % 100 == 0).select(F.col("node_id").alias("query_id"), "vector")


DENSE = f"""
v AS (SELECT vec_id AS node_id, label, {NORM} AS e FROM embeddings),
scored AS (SELECT q.node_id AS query_id, v.node_id, round(list_dot_product(q.e, v.e), 6) AS score, v.label, q.label AS query_label
           FROM v q JOIN v ON q.node_id <> v.node_id WHERE q.node_id % 100 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM scored)"""


@register("dense_topk", f"""WITH {DENSE}
SELECT query_id, node_id AS vec_id, score, rank, round(sum(CAST(label = query_label AS INT)) OVER (PARTITION BY query_id ORDER BY rank) * 1.0
  / (SELECT count(*) FROM embeddings o WHERE o.label = query_label AND o.vec_id <> query_id), 6) AS recall_so_far
FROM dense WHERE rank <= 10""")
def dense_topk(s, d):
    v = vectors(s, d)
    labels = v.select("node_id", "label")
    hits = R.dense_topk(asked(v), v, 10)
    relevant = v.groupBy("label").agg(F.count("*").alias("n"))
    rows = hits.join(labels, "node_id").join(labels.select(F.col("node_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    from pyspark.sql import Window

    found = F.sum((F.col("label") == F.col("wanted")).cast("int")).over(Window.partitionBy("query_id").orderBy("rank"))
    rows = rows.withColumn("found", found).join(relevant.select(F.col("label").alias("wanted"), "n"), "wanted")
    return rows.select("query_id", F.col("node_id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"), F.round(F.col("found") / F.nullif(F.col("n") - 1, F.lit(0)), 6).alias("recall_so_far"))


@register("dense_topk_filtered", f"""WITH v AS (SELECT vec_id AS node_id, label, {NORM} AS e FROM embeddings),
scored AS (SELECT q.node_id AS query_id, v.node_id, round(list_dot_product(q.e, v.e), 6) AS score FROM v q JOIN v ON q.node_id <> v.node_id
           WHERE q.node_id % 100 = 0 AND v.label IN (1, 3, 5))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM scored) WHERE rank <= 10""")
def dense_topk_filtered(s, d):
    v = vectors(s, d)
    return R.dense_topk(asked(v), v.filter(F.col("label").isin(1, 3, 5)), 10).withColumn("rank", F.col("rank").cast("long"))


def _truncated(v):
    return v.withColumn("vector", F.slice("vector", 1, 16))


TRUNCATED = """
t AS (SELECT vec_id AS node_id, list_slice(embedding::DOUBLE[], 1, 16) AS f FROM embeddings),
tn AS (SELECT node_id, list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS e FROM t),
tscored AS (SELECT q.node_id AS query_id, v.node_id, round(list_dot_product(q.e, v.e), 6) AS score FROM tn q JOIN tn v ON q.node_id <> v.node_id WHERE q.node_id % 100 = 0),
trunc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM tscored)"""


@register("dense_topk_truncated", f"WITH {TRUNCATED} SELECT query_id, node_id, score, rank FROM trunc WHERE rank <= 10")
def dense_topk_truncated(s, d):
    v = _truncated(vectors(s, d))
    return R.dense_topk(asked(v), v, 10).withColumn("rank", F.col("rank").cast("long"))


@register("hybrid_rrf", f"""WITH {DENSE}, {TRUNCATED},
two AS (SELECT query_id, node_id, rank, 0 AS list FROM dense WHERE rank <= 50 UNION ALL SELECT query_id, node_id, rank, 1 FROM trunc WHERE rank <= 50),
fused AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM two GROUP BY 1, 2)
SELECT query_id, node_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, node_id) AS rank FROM fused) WHERE rank <= 10""")
def hybrid_rrf(s, d):
    v, t = vectors(s, d), _truncated(vectors(s, d))
    return R.hybrid(R.dense_topk(asked(v), v, 50), R.dense_topk(asked(t), t, 50), 10).withColumn("rank", F.col("rank").cast("long"))


WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


def _terms(df, key):
    return df.select(F.col(key).alias("node_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("term")).groupBy("node_id", "term").agg(F.count("*").cast("double").alias("weight"))


@register("sparse_topk", f"""WITH d AS (SELECT doc_id AS node_id, term, count(*)::DOUBLE AS w FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY 1, 2),
q AS (SELECT item_id AS query_id, term, count(*)::DOUBLE AS w FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, node_id, round(sum(q.w * d.w), 6) AS score FROM q JOIN d USING (term) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) WHERE rank <= 10""")
def sparse_topk(s, d):
    q = _terms(read(s, d, "benchmark"), "item_id").withColumnRenamed("node_id", "query_id")
    docs = read(s, d, "documents").select(F.col("doc_id").alias("node_id"), "text")
    return R.sparse_topk_of(q, docs, F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)), 10).withColumn("rank", F.col("rank").cast("long"))


@register("rrf_three_lists", """WITH l AS (SELECT o_custkey AS query_id, o_orderkey AS node_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, 0 AS list FROM orders
UNION ALL SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey), 1 FROM orders
UNION ALL SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey), 2 FROM orders),
f AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000000 + rank) AS first FROM l GROUP BY 1, 2)
SELECT query_id, node_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, node_id) AS rank FROM f) WHERE rank <= 5""")
def rrf_three_lists(s, d):
    o = read(s, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("node_id"), "o_totalprice", "o_orderdate", "o_orderpriority")
    lists = [R.rank_by(o, ["query_id"], [c, F.asc("node_id")]) for c in (F.desc("o_totalprice"), F.desc("o_orderdate"), F.asc("o_orderpriority"))]
    return R.rrf(lists, limit=5).withColumn("rank", F.col("rank").cast("long"))


@register("retrieval_metrics", f"""WITH {DENSE},
hits AS (SELECT query_id, node_id, rank FROM dense WHERE rank <= 10),
refs AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id FROM embeddings q JOIN embeddings r ON q.label = r.label AND q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
fm AS (SELECT refs.query_id, ref_id, min(rank) AS fr FROM refs LEFT JOIN hits ON hits.query_id = refs.query_id AND hits.node_id = ref_id GROUP BY 1, 2)
SELECT query_id, count(*) AS n_refs, {', '.join(f'round(avg(CASE WHEN fr <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_{k}' for k in E.KS)},
{', '.join(f'max(CASE WHEN fr <= {k} THEN 1.0::DOUBLE ELSE 0 END) AS hit_{k}' for k in E.KS)}, round(coalesce(1.0::DOUBLE / min(fr), 0), 6) AS mrr,
round(coalesce(sum(CASE WHEN fr <= 10 THEN 1.0::DOUBLE / log2(fr + 1) END), 0) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg_10
FROM fm GROUP BY query_id""")
def retrieval_metrics(s, d):
    v = vectors(s, d)
    hits = R.dense_topk(asked(v), v, 10)
    q = v.filter(F.col("node_id") % 100 == 0).select(F.col("node_id").alias("query_id"), "label")
    refs = q.join(v.select(F.col("node_id").alias("ref_id"), "label"), "label").filter("query_id <> ref_id").select("query_id", "ref_id")
    m = E.retrieval_metrics(E.first_matches(hits, refs, F.col("h.node_id") == F.col("r.ref_id")))
    return m.select("query_id", "n_refs", *(F.round(c, 6).alias(c) if not c.startswith("hit") else c for c in m.columns[2:]))


@register("hard_negatives", f"""WITH v AS (SELECT vec_id, label, {NORM} AS e FROM embeddings),
p AS (SELECT a.vec_id AS node_id, b.vec_id AS negative_id, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT node_id, negative_id, score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, negative_id) AS r FROM p) WHERE r = 1""")
def hard_negatives(s, d):
    v = vectors(s, d)
    a = v.filter(F.col("node_id") % 100 == 0).select(F.col("node_id").alias("query_id"), "label", S.normalised(F.col("vector")).alias("q"))
    p = v.select(F.col("node_id"), "label", S.normalised(F.col("vector")).alias("v")).join(a, "label").filter("query_id <> node_id")
    best = R.top_k(p.select("query_id", "node_id", S.dot(F.col("q"), F.col("v")).alias("score")), 1)
    return best.select(F.col("query_id").alias("node_id"), F.col("node_id").alias("negative_id"), "score")


@register("maxsim", f"""WITH v AS (SELECT vec_id, label, {NORM} AS e FROM embeddings),
best AS (SELECT q.vec_id // 1000 AS query_id, i.label AS node_id, q.vec_id AS t, max(list_dot_product(q.e, i.e)) AS m FROM v q, v i WHERE q.vec_id % 100 = 0 GROUP BY 1, 2, 3),
s AS (SELECT query_id, node_id, round(sum(m), 6) AS score FROM best GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) WHERE rank <= 10""")
def maxsim(s, d):
    v = vectors(s, d)
    q = v.filter(F.col("node_id") % 100 == 0).select(F.floor(F.col("node_id") / 1000).alias("query_id"), F.col("node_id").alias("token"), "vector")
    return R.max_similarity(q, v.select(F.col("label").alias("node_id"), "vector"), 10).withColumn("rank", F.col("rank").cast("long"))


@register("crag_threshold_table", f"""WITH {DENSE}, b AS (SELECT query_id, max(score) AS score, min(query_label) % 2 = 0 AS answerable FROM dense WHERE rank <= 10 GROUP BY 1)
SELECT t AS threshold, count(*) FILTER (score < t AND NOT answerable) AS caught, count(*) FILTER (score < t AND answerable) AS refused,
round(count(*) FILTER (score < t AND NOT answerable) / nullif(count(*) FILTER (score < t), 0), 6) AS precision FROM b, (SELECT unnest([0.3::DOUBLE, 0.35, 0.4, 0.45, 0.5]) AS t) GROUP BY t""")
def crag_threshold_table(s, d):
    v = vectors(s, d)
    best = R.dense_topk(asked(v), v, 10).groupBy("query_id").agg(F.max("score").alias("score")).join(v.select(F.col("node_id").alias("query_id"), (F.col("label") % 2 == 0).alias("answerable")), "query_id")
    return E.threshold_table(best, [0.3, 0.35, 0.4, 0.45, 0.5]).withColumn("precision", F.round("precision", 6))


@register("hash_embed")
def hash_embed(s, d):
    docs = read(s, d, "documents").select(F.col("doc_id").alias("node_id"), "text")
    return R.hash_embedding(docs).select("node_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))
