"""Queries that call the engine's operators over relations derived from the driver's tables: fragments, hits, runs, files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assembly as B
from ..operators import catalog as C
from ..operators import code as A
from ..operators import evaluation as E
from ..operators import grounding as G
from ..operators import monitoring as M
from ..operators import ranking as R
from ..operators import web as W
from .registry import read, register

#: Fragments: files are sources, cells, pages and lines come from the id.
NODES = """n AS (SELECT doc_id AS node_id, source AS file_path, doc_id AS ord, CAST(doc_id % 7 AS INT) AS cell, CAST(doc_id % 5 AS INT) AS page, CAST(doc_id % 5 AS INT) AS page_end,
lang AS section, text, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'output' ELSE 'code' END AS node_type, CAST(doc_id % 40 AS INT) AS line_start, CAST(doc_id % 40 + 4 AS INT) AS line_end FROM documents)"""
#: Two rankings of fifty queries: the longest texts first, and the shortest first.
HITS = """h AS (SELECT doc_id % 50 AS query_id, doc_id AS node_id, round(n_chars / 20000, 6) AS score, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
h2 AS (SELECT doc_id % 50 AS query_id, doc_id AS node_id, round(1.0 / (1 + n_chars), 6) AS score, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY n_chars, doc_id) AS rank FROM documents)"""


def nodes(s, d):
    i = F.col("doc_id")
    return read(s, d, "documents").select(
        i.alias("node_id"), F.col("source").alias("file_path"), i.alias("ord"), (i % 7).cast("int").alias("cell"), (i % 5).cast("int").alias("page"), (i % 5).cast("int").alias("page_end"),
        F.col("lang").alias("section"), "text", "n_chars", F.when(i % 3 == 0, "output").otherwise("code").alias("node_type"), (i % 40).cast("int").alias("line_start"), (i % 40 + 4).cast("int").alias("line_end"),
    )


def hits(s, d, shortest=False):
    order = F.col("n_chars") if shortest else F.desc("n_chars")
    score = F.round(F.lit(1.0) / (1 + F.col("n_chars")), 6) if shortest else F.round(F.col("n_chars") / 20000, 6)
    rows = read(s, d, "documents").select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("node_id"), score.alias("score"), "n_chars")
    return R.rank_by(rows, ["query_id"], [order, F.asc("node_id")]).drop("n_chars")


def longs(df, *names):
    return df.select(*(F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns))


# --- between retrieval and answer


@register("upload_hits", f"""WITH {HITS}, e AS (SELECT query_id, node_id, coalesce((SELECT max(score) + 1 FROM h WHERE h.query_id = h2.query_id AND h.rank <= 10), 1.0) AS score, rank, 0 AS f FROM h2 WHERE rank <= 2),
u AS (SELECT * FROM e UNION ALL SELECT *, 1 FROM h WHERE rank <= 10), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY f, rank) AS k FROM u),
r AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM o WHERE k = 1) SELECT * FROM r WHERE rank <= 8""")
def upload_hits(s, d):
    out = B.upload_hits(hits(s, d, True).filter("rank <= 2"), hits(s, d).filter("rank <= 10"))
    return longs(out, "rank").select("query_id", "node_id", "score", "rank")


@register("lead_with", f"""WITH {HITS}, u AS (SELECT *, 0 AS f FROM h2 WHERE rank <= 3 UNION ALL SELECT *, 1 FROM h WHERE rank <= 5),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY f, rank) AS k FROM u) SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY f, rank, node_id) AS rank FROM o WHERE k = 1""")
def lead_with(s, d):
    return longs(B.lead_with(hits(s, d, True).filter("rank <= 3"), hits(s, d).filter("rank <= 5")), "rank")


@register("evidence_pool", f"""WITH {HITS}, u AS (SELECT query_id, node_id, score, 1 AS step FROM h2 WHERE rank <= 4 UNION ALL SELECT query_id, node_id, score, 2 FROM h WHERE rank <= 6),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY step) AS k FROM u), r AS (SELECT query_id, node_id, score, step, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, step, node_id) AS rank FROM o WHERE k = 1)
SELECT query_id, node_id, score, rank FROM r WHERE (score >= 0.02 OR rank = 1) AND rank <= 8""")
def evidence_pool(s, d):
    seen = hits(s, d, True).filter("rank <= 4").withColumn("step", F.lit(1)).unionByName(hits(s, d).filter("rank <= 6").withColumn("step", F.lit(2)))
    return longs(B.evidence_pool(seen.drop("rank")).select("query_id", "node_id", "score", "rank"), "rank")


@register("upload_route", """SELECT doc_id, CASE WHEN n_chars > 2000 AND lang = 'en' AND source <> 'src3' THEN 'overview' WHEN n_chars <= 2000 AND source <> 'src3' THEN 'whole' WHEN source = 'src4' THEN 'parts' WHEN source <> 'src3' AND NOT n_chars < 8000 THEN 'index+parts' ELSE 'index' END AS route FROM documents""")
def upload_route(s, d):
    """Source 3 is only searched, source 4 always read whole; fragments answer questions about texts of under 8,000 characters."""
    question = F.when(F.col("lang") == "en", "Give me an overview").otherwise("what is the value")
    mode = F.when(F.col("source") == "src3", "index").when(F.col("source") == "src4", "whole").otherwise("self_route")
    return read(s, d, "documents").select("doc_id", B.upload_route(question, F.col("n_chars"), 2000, F.col("n_chars") < 8000, mode).alias("route"))


@register("page_fragments", f"""WITH {NODES}, {HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY file_path, page ORDER BY ord) AS k FROM n), v AS (SELECT query_id, file_path, page, min(rank) AS rank FROM h JOIN n USING (node_id) WHERE rank <= 3 GROUP BY ALL)
SELECT query_id, f.node_id, row_number() OVER (PARTITION BY query_id ORDER BY v.rank, f.k) AS rank FROM v JOIN f USING (file_path, page) WHERE k <= 2""")
def page_fragments(s, d):
    pages = hits(s, d).filter("rank <= 3").join(nodes(s, d).select("node_id", "file_path", "page"), "node_id").groupBy("query_id", "file_path", "page").agg(F.min("rank").alias("rank"))
    return longs(B.page_fragments(pages, nodes(s, d)), "rank")


@register("round_trip", f"""WITH {HITS} SELECT item_id % 50 AS query_id, item_id AS own_id FROM benchmark WHERE EXISTS (SELECT 1 FROM h WHERE h.query_id = item_id % 50 AND h.node_id = item_id AND rank <= 5)""")
def round_trip(s, d):
    questions = read(s, d, "benchmark").select((F.col("item_id") % 50).alias("query_id"), F.col("item_id").alias("own_id"))
    return B.round_trip(questions, hits(s, d), 5)


@register("provenance_nodes", f"""WITH {NODES}, r AS (SELECT DISTINCT file_path AS path, cell, min(ord) OVER (PARTITION BY file_path, cell) AS pos FROM n WHERE ord < 40), p AS (SELECT * FROM r ORDER BY pos LIMIT 5),
m AS (SELECT path, p.cell, pos, node_id, row_number() OVER (PARTITION BY path, p.cell ORDER BY node_type = 'output' DESC, ord) AS k FROM p JOIN n ON path = file_path AND p.cell = n.cell) SELECT path, cell, node_id, pos FROM m WHERE k = 1""")
def provenance_nodes(s, d):
    rows = nodes(s, d).filter("ord < 40").select(F.col("file_path").alias("path"), "cell", F.col("ord").alias("pos"))
    return B.provenance_nodes(rows, nodes(s, d))


@register("context_blocks", f"""WITH {NODES}, {HITS}, b AS (SELECT query_id, rank, '<source id="' || rank || '" ref="' || file_path || ', page ' || page || ', cell ' || cell || ', lines ' || line_start || '-' || line_end || '">' || chr(10)
|| CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END || chr(10) || '</source>' AS b FROM h JOIN n USING (node_id) WHERE rank <= 3 AND text IS NOT NULL)
SELECT query_id, string_agg(b, chr(10) ORDER BY rank) AS context FROM b GROUP BY query_id""")
def context_blocks(s, d):
    label = S.location_label(F.col("file_path"), F.col("page"), F.lit(None).cast("string"), F.col("cell"), F.col("line_start"), F.col("line_end"))
    rows = hits(s, d).filter("rank <= 3").join(nodes(s, d).filter("text is not null").withColumn("label", label), "node_id")
    return B.context_blocks(rows, 80)


@register("compact_history", """WITH e AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'tool' ELSE role END AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS e FROM conversations)
SELECT conv_id AS run_id, turn AS pos, role, CASE WHEN e > 3 AND role = 'tool' AND len(string_split(text, chr(10))) > 2 THEN array_to_string(string_split(text, chr(10))[1:2], chr(10)) || chr(10) || '…' ELSE text END AS text FROM e""")
def compact_history(s, d):
    m = read(s, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), "text")
    return B.compact_history(m, 3)


@register("numbered_view", """SELECT path, line_no, line FROM (SELECT url AS path, unnest(string_split(html, chr(10))) AS line, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line_no FROM pages) WHERE line_no BETWEEN 3 AND 22""")
def numbered_view(s, d):
    return longs(B.numbered_view(read(s, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("text")), 3, 20), "line_no")


@register("partition_by_budget", """WITH RECURSIVE l AS (SELECT source AS file, list(doc_id ORDER BY doc_id) AS o, list(n_chars ORDER BY doc_id) AS a FROM documents GROUP BY 1),
r AS (SELECT file, o, a, 1 AS i, 0 AS part, a[1]::BIGINT AS total FROM l UNION ALL SELECT file, o, a, i + 1, CASE WHEN total + a[i + 1] > 9000 THEN part + 1 ELSE part END, CASE WHEN total + a[i + 1] > 9000 THEN a[i + 1] ELSE total + a[i + 1] END FROM r WHERE i < len(a))
SELECT file, o[i] AS ord, a[i] AS size, CAST(part AS BIGINT) AS part FROM r""")
def partition_by_budget(s, d):
    rows = read(s, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("size"))
    return longs(B.partition_by_budget(rows, 9000), "part", "size")


# --- catalog


FILES = """f AS (SELECT source AS path, CASE WHEN source LIKE '%1' THEN 'error' ELSE 'ok' END AS status, CASE WHEN source LIKE '%1' THEN 'broken' END AS error, lang AS file_type, CAST(sum(n_chars) AS BIGINT) AS size FROM documents WHERE lang = 'en' GROUP BY ALL)"""


def files(s, d):
    bad = F.col("source").like("%1")
    rows = read(s, d, "documents").filter("lang = 'en'").groupBy("source", "lang").agg(F.sum("n_chars").alias("size"))
    return rows.select(F.col("source").alias("path"), F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, "broken").alias("error"), F.col("lang").alias("file_type"), "size")


@register("file_counts", f"""WITH {FILES}, {NODES} SELECT path, file_type, size AS size_bytes, (SELECT count(*) FROM n WHERE file_path = path)::BIGINT AS n_fragments, status FROM f""")
def file_counts(s, d):
    n = nodes(s, d).withColumn("cell_type", F.lit("code")).withColumn("execution_count", F.col("ord"))
    return longs(C.analytics_views(n, files(s, d))["files"], "n_fragments")


@register("cell_sources", f"""WITH {NODES}, g AS (SELECT file_path AS path, cell, string_agg(left(text, 50), chr(10) ORDER BY ord) FILTER (node_type <> 'output') AS source, nullif(string_agg(left(text, 50), '' ORDER BY ord) FILTER (node_type = 'output'), '') AS output FROM n WHERE text IS NOT NULL GROUP BY 1, 2)
SELECT path, CAST(cell AS BIGINT) AS cell, coalesce(source, '') AS source, output FROM g""")
def cell_sources(s, d):
    n = nodes(s, d).filter("text is not null").withColumn("text", F.left("text", F.lit(50))).withColumn("cell_type", F.lit("code")).withColumn("execution_count", F.col("ord"))
    return longs(C.analytics_views(n, files(s, d))["cells"].select("path", "cell", "source", "output"), "cell")


@register("notebook_counts", f"""WITH {NODES}, e AS (SELECT file_path AS path, cell, max(ord) FILTER (node_type <> 'output') AS ec FROM n GROUP BY 1, 2), c AS (SELECT *, last_value(ec IGNORE NULLS) OVER (PARTITION BY path ORDER BY cell) AS carried FROM e),
l AS (SELECT *, lag(carried) OVER (PARTITION BY path ORDER BY cell) > ec AS fell FROM c) SELECT path, count(*) AS n_cells, count(ec) AS n_code_cells, max(coalesce(fell, false)::INT)::BIGINT AS out_of_order FROM l GROUP BY 1""")
def notebook_counts(s, d):
    n = nodes(s, d).withColumn("cell_type", F.lit("code")).withColumn("execution_count", F.col("ord"))
    return longs(C.analytics_views(n, files(s, d))["notebooks"].drop("title"), "n_cells", "n_code_cells", "out_of_order")


@register("extraction_todo", f"""WITH {FILES} SELECT path, status, size AS content_hash FROM f WHERE status = 'ok' AND NOT (path LIKE '%2' AND size % 2 = 0)""")
def extraction_todo(s, d):
    books = files(s, d).select("path", "status", F.col("size").alias("content_hash"))
    done = books.filter(F.col("path").like("%2")).select(F.col("path").alias("file_path"), (F.col("content_hash") - F.col("content_hash") % 2).alias("content_hash"), F.lit("m").alias("model"))
    return C.extraction_todo(books, done, "m")


@register("mark_error", f"""WITH {FILES} SELECT path, CASE WHEN path LIKE '%3' THEN 'error' ELSE status END AS status, CASE WHEN path LIKE '%3' THEN 'lost' ELSE error END AS error, file_type, size FROM f""")
def mark_error(s, d):
    return C.mark_error(files(s, d), files(s, d).filter(F.col("path").like("%3")).select("path", F.lit("lost").alias("error")))


@register("replace_files", f"""WITH {NODES} SELECT node_id, file_path, n_chars FROM n WHERE file_path NOT LIKE '%4' UNION ALL SELECT node_id + 1000000, file_path, n_chars FROM n WHERE file_path LIKE '%4' AND cell = 0
UNION ALL SELECT node_id, file_path, n_chars FROM n WHERE file_path LIKE '%4' AND file_path NOT IN (SELECT file_path FROM n WHERE file_path LIKE '%4' AND cell = 0)""")
def replace_files(s, d):
    now = nodes(s, d).select("node_id", "file_path", "n_chars")
    new = nodes(s, d).filter(F.col("file_path").like("%4") & (F.col("cell") == 0)).select((F.col("node_id") + 1000000).alias("node_id"), "file_path", "n_chars")
    return C.replace_files(now, new)


@register("remove_files", f"""WITH {NODES} SELECT node_id, file_path FROM n WHERE file_path NOT LIKE '%5'""")
def remove_files(s, d):
    now = nodes(s, d).select("node_id", "file_path")
    return C.remove_files(now, now.filter(F.col("file_path").like("%5")))


@register("update_nodes", f"""WITH {NODES} SELECT node_id AS id, CASE WHEN cell = 0 THEN 'changed' ELSE section END AS section, n_chars FROM n""")
def update_nodes(s, d):
    n = nodes(s, d).select(F.col("node_id").alias("id"), "section", "n_chars")
    changes = nodes(s, d).filter("cell < 2").select(F.col("node_id").alias("id"), F.when(F.col("cell") == 0, "changed").alias("section"))
    return C.update_nodes(n, changes)


@register("file_problems", f"""WITH {FILES} SELECT path, status FROM f WHERE status <> 'ok' OR size % 3 = 0""")
def file_problems(s, d):
    warned = files(s, d).withColumn("warnings", F.when(F.col("size") % 3 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")))
    return C.problems(warned).select("path", "status")


@register("experiment_summary", """WITH e AS (SELECT c_custkey AS id, c_name FROM customer), m AS (SELECT o_custkey, count(*) AS n, string_agg(o_orderpriority || '=' || CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderpriority, o_orderkey) AS t FROM orders GROUP BY 1)
SELECT id, c_name, coalesce(n, 0) AS n_metrics, t AS metrics FROM e LEFT JOIN m ON id = o_custkey""")
def experiment_summary(s, d):
    metrics = read(s, d, "orders").select(F.col("o_custkey").alias("experiment_id"), F.col("o_orderpriority").alias("name"), F.lit("").alias("split"), F.col("o_orderkey").alias("value"))
    none = metrics.limit(0).select("experiment_id", "name", "value")
    out = C.experiment_summary(read(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), metrics, none)
    shown = F.array_join(F.transform("metrics", lambda m: F.concat(m["name"], F.lit("="), m["value"].cast("string"))), ",")
    return out.select("id", "c_name", F.coalesce(F.size("metrics"), F.lit(0)).cast("long").alias("n_metrics"), shown.alias("metrics"))


PLACES = "p AS (SELECT item_id AS place_id, 'src' || (item_id % 20) AS file_path, CASE WHEN item_id % 2 = 0 THEN CAST(item_id % 7 AS INT) END AS cell, CAST(item_id % 40 AS INT) AS line_start, CAST(item_id % 40 + 3 AS INT) AS line_end FROM benchmark)"


@register("nodes_at", f"""WITH {NODES}, m AS (SELECT * REPLACE (CASE WHEN ord % 2 = 0 THEN cell END AS cell) FROM n), {PLACES} SELECT place_id, node_id, ord FROM p JOIN m USING (file_path) WHERE m.line_start <= p.line_end AND m.line_end >= p.line_start AND ((p.cell = m.cell AND node_type <> 'output') OR (p.cell IS NULL AND m.cell IS NULL))""")
def nodes_at(s, d):
    i = F.col("item_id")
    places = read(s, d, "benchmark").select(i.alias("place_id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("file_path"), F.when(i % 2 == 0, (i % 7).cast("int")).alias("cell"), (i % 40).cast("int").alias("line_start"), (i % 40 + 3).cast("int").alias("line_end"))
    return C.nodes_at(nodes(s, d).withColumn("cell", F.when(F.col("ord") % 2 == 0, F.col("cell"))), places)


@register("sql_tool", """SELECT n_name, count(*) AS n, max(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name ILIKE '%a%' GROUP BY n_name""")
def sql_tool(s, d):
    """A written statement through the read-only tool: translated, validated, limited, run."""
    for t in ("customer", "nation"):
        read(s, d, t).createOrReplaceTempView(t)
    sql = "SELECT n_name, count(*) AS n, max(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%a%' GROUP BY n_name"
    return s.sql(C.validate_sql(s, C.translate_dialect(sql), {"customer", "nation"}))
