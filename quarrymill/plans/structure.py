"""Queries over structured documents: sections, figures, vectors, extracted values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import documents as D
from ..operators import ranking as R
from ..sources import files as X
from .engine import HITS, NODES, hits, longs, nodes
from .registry import read, register

#: Conversations read as documents: every fourth turn is a figure, each third turn on is a heading. Pages read as documents: their tags give the kinds.
CONVERSED = """i AS (SELECT conv_id AS doc_id, turn AS ord, CASE WHEN turn % 4 = 3 THEN 'figure' WHEN (conv_id + turn) % 3 = 0 THEN 'heading' ELSE 'text' END AS kind, 1 + CAST(turn % 2 AS INT) AS level, left(text, 40) AS text FROM conversations)"""
TAGGED = """t AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<(h1|b|p|li|div|footer)[^>]*>([^<]*)', 1)) AS tag, unnest(regexp_extract_all(html, '<(h1|b|p|li|div|footer)[^>]*>([^<]*)', 2)) AS text, unnest(range(1, len(regexp_extract_all(html, '<(h1|b|p|li|div|footer)[^>]*>([^<]*)')) + 1)) AS ord FROM pages),
i AS (SELECT doc_id, ord, CASE tag WHEN 'h1' THEN 'title' WHEN 'b' THEN 'heading' WHEN 'li' THEN 'list_item' WHEN 'div' THEN 'figure' WHEN 'footer' THEN 'page_header' ELSE 'text' END AS kind, 1 AS level, left(text, 60) AS text, CAST(1 + ord // 5 AS INT) AS page FROM t)"""
#: An item after the other: the stack of open headings, the number of the open chunk and its size; limit 100.
FOLDED = """n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS pos, trim(text) AS bare, kind IN ('title', 'heading') AND trim(text) <> '' AS head,
  CASE WHEN kind IN ('title', 'heading', 'text') AND trim(text) <> '' THEN trim(text) WHEN kind = 'list_item' AND trim(text) <> '' THEN '- ' || trim(text) END AS body FROM i),
r AS (SELECT DISTINCT doc_id, 0::BIGINT AS pos, 0::BIGINT AS chunk, 0::BIGINT AS size, []::STRUCT(l INT, t VARCHAR)[] AS stack FROM i
  UNION ALL SELECT n.doc_id, n.pos, CASE WHEN n.body IS NULL THEN r.chunk WHEN n.head OR r.chunk = 0 OR r.size + length(n.body) > 100 THEN r.chunk + 1 ELSE r.chunk END,
  CASE WHEN n.body IS NULL THEN r.size WHEN n.head OR r.chunk = 0 OR r.size + length(n.body) > 100 THEN length(n.body) ELSE r.size + length(n.body) END,
  CASE WHEN n.head THEN list_append(list_filter(r.stack, lambda x: x.l < CASE n.kind WHEN 'title' THEN 0 ELSE n.level END), {'l': CASE n.kind WHEN 'title' THEN 0 ELSE n.level END, 't': n.bare}) ELSE r.stack END
  FROM r JOIN n ON n.doc_id = r.doc_id AND n.pos = r.pos + 1),
f AS (SELECT n.*, r.chunk, nullif(array_to_string(list_transform(r.stack, lambda x: x.t), ' > '), '') AS section, CASE WHEN len(r.stack) > 0 THEN r.stack[-1].t ELSE 'text' END AS inner_title FROM n JOIN r ON n.doc_id = r.doc_id AND n.pos = r.pos)"""


def items(s, d):
    t, c = F.col("turn"), F.col("conv_id")
    kind = F.when(t % 4 == 3, "figure").when((c + t) % 3 == 0, "heading").otherwise("text")
    return read(s, d, "conversations").select(c.alias("doc_id"), t.alias("ord"), kind.alias("kind"), (1 + t % 2).cast("int").alias("level"), F.left("text", F.lit(40)).alias("text"))


def page_items(s, d):
    of = lambda i: F.regexp_extract_all("html", F.lit("<(h1|b|p|li|div|footer)[^>]*>([^<]*)"), F.lit(i))
    rows = read(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.arrays_zip(of(1).alias("tag"), of(2).alias("text"))).alias("p", "x"))
    kinds = F.create_map(*(F.lit(x) for kv in {"h1": "title", "b": "heading", "li": "list_item", "div": "figure", "footer": "page_header", "p": "text"}.items() for x in kv))
    ord_ = F.col("p") + 1
    return rows.select("doc_id", ord_.cast("long").alias("ord"), kinds[F.col("x.tag")].alias("kind"), F.lit(1).alias("level"), F.left("x.text", F.lit(60)).alias("text"), F.when(F.col("x.tag") == "div", F.left("x.text", F.lit(60))).alias("caption"), (1 + F.floor(ord_ / 5)).cast("int").alias("page"))


@register("document_sections", f"""WITH RECURSIVE {CONVERSED}, {FOLDED}
SELECT doc_id, chunk, arg_max(section, ord) AS section, string_agg(body, chr(10) ORDER BY ord) AS text, min(ord) AS first, max(ord) AS last FROM f WHERE body IS NOT NULL GROUP BY 1, 2""")
def document_sections(s, d):
    return longs(D.document_sections(items(s, d), 100), "chunk").select("doc_id", "chunk", "section", "text", "first", "last")


@register("figure_edges", f"""WITH RECURSIVE {CONVERSED}, {FOLDED}, m AS (SELECT doc_id, max(chunk) AS most FROM f GROUP BY 1)
SELECT doc_id, ord AS figure, greatest(chunk, 1) AS chunk FROM f JOIN m USING (doc_id) WHERE kind = 'figure' AND most > 0""")
def figure_edges(s, d):
    return longs(D.figure_edges(items(s, d), D.chunk_rows(items(s, d), 100)), "chunk")


@register("document_nodes", f"""WITH RECURSIVE {TAGGED}, {FOLDED}
SELECT doc_id, 's' || chunk AS id, 'section' AS node_type, arg_max(section, ord) AS section, arg_max(inner_title, ord) AS title, string_agg(body, chr(10) ORDER BY ord) AS text, min(page) AS page, max(page) AS page_end, true AS embed FROM f WHERE body IS NOT NULL GROUP BY doc_id, chunk
UNION ALL SELECT doc_id, 'fig' || row_number() OVER (PARTITION BY doc_id ORDER BY ord), 'figure', section, CASE bare WHEN '' THEN 'figure ' || row_number() OVER (PARTITION BY doc_id ORDER BY ord) ELSE bare END, bare, page, page, bare <> '' FROM f WHERE kind = 'figure'""")
def document_nodes(s, d):
    return D.document_nodes(page_items(s, d), 100)


@register("document_files", f"""WITH RECURSIVE {TAGGED}, {FOLDED}
SELECT doc_id, coalesce(arg_max(bare, ord) FILTER (kind = 'title' AND bare <> ''), arg_min(inner_title, ord) FILTER (body IS NOT NULL AND inner_title <> 'text'), '') AS title, count(DISTINCT chunk) FILTER (body IS NOT NULL) AS n_sections, 0::BIGINT AS n_tables,
count(*) FILTER (kind = 'figure') AS n_figures, coalesce(list_sort(list(DISTINCT bare) FILTER (kind = 'page_header' AND bare <> ''))[:5], []) AS page_headers FROM f GROUP BY 1""")
def document_files(s, d):
    rows = page_items(s, d)
    return D.document_files(rows, D.document_nodes(rows, 100))


@register("markdown_sections", """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, no, line, no % 5 = 1 AND trim(line) <> '' AS head FROM l), r AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY no) AS run, max(CASE WHEN head THEN no END) OVER (PARTITION BY doc_id ORDER BY no) AS at FROM m),
b AS (SELECT r.doc_id, run, coalesce((SELECT rtrim(left(trim(regexp_replace(x.line, '#', '', 'g')), 10)) FROM m x WHERE x.doc_id = r.doc_id AND x.no = r.at), '') AS section, r.no, length(regexp_replace(r.line, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS size FROM r WHERE NOT head AND trim(line, ' ') <> ''),
a AS (SELECT doc_id, run, section, list(no ORDER BY no) AS n, list(size ORDER BY no) AS z FROM b GROUP BY 1, 2, 3),
p AS (SELECT *, 1 AS i, 0 AS part, z[1]::BIGINT AS total FROM a UNION ALL SELECT doc_id, run, section, n, z, i + 1, CASE WHEN total + z[i + 1] > 300 THEN part + 1 ELSE part END, CASE WHEN total + z[i + 1] > 300 THEN z[i + 1] ELSE total + z[i + 1] END FROM p WHERE i < len(z))
SELECT doc_id, section, part::BIGINT AS part, min(n[i])::BIGINT AS line_start, max(n[i])::BIGINT AS line_end, sum(z[i])::BIGINT AS size FROM p GROUP BY doc_id, run, section, part""")
def markdown_sections(s, d):
    """Every fifth line that is not blank is made a heading of its first ten characters."""
    line = lambda x, i: F.when((i % 5 == 0) & (F.trim(x) != ""), F.concat(F.lit("# "), F.left(F.trim(F.regexp_replace(x, "#", "")), F.lit(10)))).otherwise(x)
    docs = read(s, d, "documents").filter("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))
    return longs(D.markdown_sections(docs, 300), "part", "line_start", "line_end", "size")


@register("image_nodes", """WITH f AS (SELECT DISTINCT url AS path FROM pages) SELECT path AS id, path AS file_path, 'file' AS node_type, list_extract(string_split(path, '/'), -1) AS title, false AS embed FROM f UNION ALL SELECT path || '#image', path, 'image', list_extract(string_split(path, '/'), -1), false FROM f""")
def image_nodes(s, d):
    return D.image_nodes(read(s, d, "pages").select(F.col("url").alias("path")).distinct())


@register("upsert_points", """SELECT vec_id AS node_id, CASE WHEN vec_id % 3 = 0 THEN 100 + label ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 100 + label FROM embeddings WHERE vec_id % 3 = 1""")
def upsert_points(s, d):
    now = read(s, d, "embeddings").select(F.col("vec_id").alias("node_id"), "label")
    new = now.filter("node_id % 3 = 0").unionByName(now.filter("node_id % 3 = 1").withColumn("node_id", F.col("node_id") + 1000000)).withColumn("label", F.col("label") + 100)
    return D.upsert_points(D.upsert_points(now, new), new)


@register("resolved_hits", f"""WITH {HITS} SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM h WHERE rank <= 10 AND node_id % 4 <> 1""")
def resolved_hits(s, d):
    return longs(D.resolve_hits(hits(s, d), nodes(s, d).filter("node_id % 4 <> 1"), 10), "rank")


@register("extracted_metrics", """WITH o AS (SELECT o_custkey AS experiment, o_totalprice AS value, o_orderkey AS item_id, o_orderkey % 4 AS k FROM orders WHERE o_orderkey % 5 <> 0)
SELECT item_id, 'f' || experiment AS file_path, experiment, CASE k WHEN 0 THEN 'roc_auc' WHEN 1 THEN 'accuracy' WHEN 2 THEN 'f1' ELSE 'rmse' END AS name, CASE k WHEN 0 THEN 'val' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'none' END AS split, 'v' || item_id AS variant, value, CAST(item_id AS BIGINT) AS cell FROM o""")
def extracted_metrics(s, d):
    """Names, splits and prefixes in four spellings, each value twice, first with the cell that shows it; values of keys that divide by five are shown nowhere."""
    o, k = read(s, d, "orders"), F.col("o_orderkey")
    one = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % 4 + 1).cast("int"))
    path = F.concat(F.lit("f"), F.col("o_custkey").cast("string"))
    rows = o.select((2 * k).alias("item_id"), path.alias("file_path"), F.col("o_custkey").alias("experiment"), one(["ROC-AUC", "val_acc", "F1 macro", "RMSE"]).alias("name"), one(["validation", "", "Test", "none"]).alias("split"), F.concat(F.lit(" v"), k.cast("string")).alias("variant"), F.col("o_totalprice").alias("value"), k.alias("cell"))
    cells = o.filter("o_orderkey % 5 <> 0").select(path.alias("file_path"), k.alias("cell"), F.concat(F.lit("score "), F.format_string("%.2f", F.col("o_totalprice"))).alias("text"))
    again = rows.withColumn("item_id", F.col("item_id") + 1).withColumn("cell", F.lit(-1).cast("long"))
    return longs(D.extracted_metrics(rows.unionByName(again), cells), "cell").withColumn("item_id", F.expr("item_id div 2"))


@register("private_in", """SELECT conv_id * 1000 + turn AS id, w AS name FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS w FROM conversations) WHERE w IN (SELECT lower(regexp_extract(text, '[A-Za-z]{3,}')) FROM benchmark)""")
def private_in(s, d):
    names = read(s, d, "benchmark").select(F.regexp_extract("text", "[A-Za-z]{3,}", 0).alias("name"))
    return D.private_in(read(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), names)


@register("grounded_flags", """SELECT doc_id, doc_id % 3 > 0 OR doc_id % 2 = 0 AS grounded FROM documents""")
def grounded_flags(s, d):
    return read(s, d, "documents").select("doc_id", D.grounded(F.col("doc_id") % 3, F.col("doc_id") % 2 == 1).alias("grounded"))


@register("point_ids", f"""WITH h AS (SELECT doc_id, sha1(unhex('{S.POINT_SPACE}') || encode(source || '#' || doc_id)) AS h FROM documents WHERE source IS NOT NULL)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def point_ids(s, d):
    docs = read(s, d, "documents").filter("source is not null")
    return docs.select("doc_id", S.point_id(F.concat(F.col("source"), F.lit("#"), F.col("doc_id").cast("string"))).alias("point_id"))


@register("picture_sizes", f"""WITH a AS (SELECT p_partkey, p_partkey % 4001 AS w, p_partkey * 7 % 3001 AS h FROM part), b AS (SELECT *, least(1.0::DOUBLE, {S.MAX_SIDE} / greatest(w, h), sqrt({float(S.MAX_AREA)} / (w::DOUBLE * h))) AS k, CASE WHEN greatest(w, h) < 1024 THEN 1024.0::DOUBLE / greatest(w, h) ELSE least(1.0::DOUBLE, 1344.0::DOUBLE / greatest(w, h)) END AS z FROM a WHERE w > 0 AND h > 0)
SELECT p_partkey, greatest(256, (round_even(w * k / 32, 0) * 32)::INT) AS width, greatest(256, (round_even(h * k / 32, 0) * 32)::INT) AS height, greatest(256, (floor(floor(w * z) / 32) * 32)::INT) AS source_width, greatest(256, (floor(floor(h * z) / 32) * 32)::INT) AS source_height,
greatest(9, least(241, (round_even((w / 100.0::DOUBLE * 24 - 1) / 8, 0) * 8 + 1)::INT)) AS frames, round(p * (1 + p / 4.4::DOUBLE), 9) AS cost FROM (SELECT *, w::DOUBLE * h / 1000000.0::DOUBLE * CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS p FROM b)""")
def picture_sizes(s, d):
    k = F.col("p_partkey")
    sized = read(s, d, "part").select(k, (k % 4001).alias("w"), (k * 7 % 3001).alias("h")).filter("w > 0 AND h > 0")
    sized = sized.select(k, "w", "h", S.grid_size(F.col("w"), F.col("h")).alias("g"), S.source_size(F.col("w"), F.col("h")).alias("f"))
    return sized.select(k, "g.width", "g.height", F.col("f.width").alias("source_width"), F.col("f.height").alias("source_height"), S.clip_frames(F.col("w") / 100, 24, 121).alias("frames"), F.round(S.step_cost(F.col("w"), F.col("h"), k % 2 == 0), 9).alias("cost"))


@register("pages_without_text", """SELECT conv_id AS file_path, count(*) AS n_pages, array_to_string(list(turn ORDER BY turn) FILTER (length(regexp_replace(coalesce(text, ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) < 40), ',') AS empty FROM conversations GROUP BY 1""")
def pages_without_text(s, d):
    """Turns as pages."""
    pages = read(s, d, "conversations").select(F.col("conv_id").alias("file_path"), F.col("turn").alias("page"), "text")
    found = X.pages_without_text(pages, 40)
    return found.withColumn("empty", F.when(F.size("empty") > 0, F.array_join(F.transform("empty", lambda x: x.cast("string")), ",")))


@register("stratified_sample", """SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(lang, '?') ORDER BY md5('7:' || doc_id), doc_id) <= 25""")
def stratified_sample(s, d):
    return X.stratified_sample(read(s, d, "documents").select("doc_id", "lang", "source"), "lang", "doc_id", 25, seed=7)


@register("parsed_files", """WITH f AS (SELECT conv_id, turn, 'c' || conv_id || '/' || turn || CASE turn % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.ipynb' WHEN 2 THEN '.PNG' ELSE '.exe' END AS path, turn % 4 AS k, coalesce(text, '') AS text FROM conversations),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ord FROM f WHERE k = 0)
SELECT path, ord::BIGINT AS ord, 'line' AS kind, text, 'ok' AS status, NULL AS error FROM l WHERE trim(text, ' ') <> '' UNION ALL SELECT path, 1, 'cell', text, 'ok', NULL FROM f WHERE k = 1
UNION ALL SELECT path, 1, 'image', NULL, 'ok', NULL FROM f WHERE k = 2 UNION ALL SELECT path, 0, 'file', NULL, 'error', 'no parser for .exe' FROM f WHERE k = 3""")
def parsed_files(s, d):
    """Turns as files of four extensions: notes, notebooks of one cell, pictures, and one that no parser takes."""
    t, text = F.col("turn"), F.coalesce("text", F.lit(""))
    ext = F.element_at(F.array(*map(F.lit, (".md", ".ipynb", ".PNG", ".exe"))), (t % 4 + 1).cast("int"))
    cell = F.to_json(F.struct(F.array(F.struct(F.lit("code").alias("cell_type"), F.array(text).alias("source"), F.array().cast("array<string>").alias("outputs"))).alias("cells")))
    path = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), t.cast("string"), ext)
    files = read(s, d, "conversations").select(path.alias("path"), F.when(t % 4 == 1, cell).otherwise(text).cast("binary").alias("content"))
    return longs(X.parse_files(files).drop("level"), "ord")


@register("visual_fusion", f"""WITH {HITS}, t AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, 0 AS list FROM h WHERE rank <= 20 AND node_id % 3 <> 0), v AS (SELECT query_id, node_id, rank, 1 AS list FROM h2 WHERE rank <= 10),
f AS (SELECT query_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, node_id) AS rank FROM f) SELECT query_id, node_id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""")
def visual_fusion(s, d):
    kinds = read(s, d, "documents").select(F.col("doc_id").alias("node_id"), F.when(F.col("doc_id") % 3 == 0, "image").otherwise("text").alias("node_type"))
    return longs(R.with_visual(hits(s, d).filter("rank <= 20"), hits(s, d, shortest=True).filter("rank <= 10"), kinds, 10, pixels_only=True), "rank")
