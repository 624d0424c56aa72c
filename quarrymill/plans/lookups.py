"""Queries of look-ups, incremental tables, supported answers and the policy over relations derived from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chunking as K
from ..operators import grounding as G
from ..operators import lookup as L
from ..operators import policy as P
from ..operators import ranking as R
from ..sources.merge_table import MergeTable
from ..sources.sinks import scratch_folder
from .engine import NODES, longs, nodes
from .registry import read, register

WORDS = r"[\p{L}\p{N}_]"


# --- exact and close look-ups


@register("exact_search", """WITH q AS (SELECT DISTINCT lower(n) AS needle FROM (SELECT substr(text, 3, 12) AS n FROM benchmark UNION ALL SELECT substr(text, 40, 5) FROM benchmark UNION ALL SELECT left(text, 2) FROM benchmark WHERE item_id < 3) WHERE length(n) > 0)
SELECT needle, doc_id AS node_id FROM q JOIN documents ON contains(lower(text), needle)""")
def exact_search(s, d):
    b = read(s, d, "benchmark")
    asked = b.select(F.substring("text", 3, 12).alias("needle")).union(b.select(F.substring("text", 40, 5))).union(b.filter("item_id < 3").select(F.left("text", F.lit(2))))
    return L.exact_search(asked, read(s, d, "documents").select(F.col("doc_id").alias("node_id"), "text"))


@register("exact_matches", f"""WITH {NODES}, q AS (SELECT DISTINCT source AS file_path, lower(w) AS key FROM (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')) AS w FROM documents WHERE doc_id % 50 = 0)),
w AS (SELECT file_path, ord, unnest(list_distinct(regexp_extract_all(lower(text), '{WORDS}+'))) AS key FROM n), f AS (SELECT file_path, ord, key FROM w JOIN q USING (file_path, key)), z AS (SELECT file_path, greatest(1, floor(count(*) * 0.2)) AS most FROM n GROUP BY 1),
k AS (SELECT file_path, key FROM f JOIN z USING (file_path) GROUP BY file_path, key, most HAVING count(DISTINCT ord) <= most), g AS (SELECT file_path, ord, count(*) AS n_keys FROM f JOIN k USING (file_path, key) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY n_keys DESC, ord) AS rank FROM g) SELECT file_path AS file, ord, n_keys, rank FROM r WHERE rank <= 8""")
def exact_matches(s, d):
    keys = read(s, d, "documents").filter("doc_id % 50 = 0").select(F.col("source").alias("file"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("key"))
    return longs(L.exact_matches(nodes(s, d).withColumnRenamed("file_path", "file"), keys), "rank")


#: Questions are items of the benchmark, values the first words of pages' titles; a pair of words is compared by matching blocks, the longest first, as a stack of ranges.
CLOSE_SQL = """q AS (SELECT item_id AS query_id, lower(text) AS t FROM benchmark), v AS (SELECT DISTINCT 'pages' AS "table", 'title' AS "column", array_to_string(string_split(regexp_extract(html, '<title>([^<]*)', 1), ' ')[1:2], ' ') AS value FROM pages),
k AS (SELECT * FROM v WHERE length(value) >= 2), b AS (SELECT value, unnest(regexp_split_to_array(lower(value), '[\\s_\\-=]+')) AS b FROM k), a AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(t, '[\\p{L}\\p{N}_\\-]+'))) AS a FROM q),
w AS (SELECT DISTINCT a, b FROM (SELECT DISTINCT a FROM a) JOIN (SELECT DISTINCT b FROM b WHERE length(b) >= 4) ON 2 * least(length(a), length(b)) >= 0.85 * (length(a) + length(b)) - 0.000001
  WHERE 2 * list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least(len(list_filter(string_split(a, ''), lambda x: x = c)), len(list_filter(string_split(b, ''), lambda x: x = c))))) >= 0.85 * (length(a) + length(b)) - 0.000001),
r AS (SELECT a, b, 0::BIGINT AS m, [[0, length(a), 0, length(b)]]::BIGINT[][] AS stack FROM w
  UNION ALL SELECT a, b, m + best[1], stack[2:] || CASE WHEN best[1] > 0 THEN list_filter([[s[1], -best[2], s[3], -best[3]], [-best[2] + best[1], s[2], -best[3] + best[1], s[4]]], lambda x: x[1] < x[2] AND x[3] < x[4]) ELSE [] END
  FROM (SELECT *, stack[1] AS s, (SELECT max([list_max(list_filter(range(0, least(stack[1][2] - i, stack[1][4] - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n))), -i, -j])
    FROM (SELECT unnest(range(stack[1][1], stack[1][2])) AS i), (SELECT unnest(range(stack[1][3], stack[1][4])) AS j)) AS best FROM r WHERE len(stack) > 0)),
c AS (SELECT a, b FROM r WHERE len(stack) = 0 AND 2.0 * m / (length(a) + length(b)) >= 0.85)"""


@register("value_hints", f"""WITH RECURSIVE {CLOSE_SQL}, flat AS (SELECT query_id, regexp_replace(t, '[\\s_\\-]+', '', 'g') AS t FROM q), n AS (SELECT value, regexp_replace(lower(value), '[\\s_\\-]+', '', 'g') AS needle FROM k),
h AS (SELECT query_id, value FROM flat JOIN n ON length(needle) >= 3 AND contains(t, needle) UNION SELECT query_id, value FROM c JOIN a USING (a) JOIN b USING (b)),
o AS (SELECT query_id, "table", "column", value, row_number() OVER (PARTITION BY query_id ORDER BY "table", "column", value) AS rank FROM h JOIN k USING (value)) SELECT query_id, "table", "column", value FROM o WHERE rank <= 25""")
def value_hints(s, d):
    title = F.array_join(F.slice(F.split(F.regexp_extract("html", "<title>([^<]*)", 1), " "), 1, 2), " ")
    values = read(s, d, "pages").select(F.lit("pages").alias("table"), F.lit("title").alias("column"), title.alias("value"))
    return L.value_hints(read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), values)


@register("read_file", f"""WITH {NODES}, q AS (SELECT item_id AS query_id, 'src' || (item_id % 25) AS path, CASE WHEN item_id % 3 = 0 THEN item_id % 7 END AS cell, CASE WHEN item_id % 3 = 1 THEN item_id % 5 END AS page FROM benchmark),
r AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY ord, node_id) AS rank FROM q JOIN n ON n.file_path = q.path AND (q.cell IS NULL OR n.cell = q.cell) AND (q.page IS NULL OR q.page BETWEEN n.page AND n.page_end)) SELECT * FROM r WHERE rank <= 6""")
def read_file(s, d):
    i = F.col("item_id")
    asked = read(s, d, "benchmark").select(i.alias("query_id"), F.concat(F.lit("src"), (i % 25).cast("string")).alias("path"), F.when(i % 3 == 0, i % 7).alias("cell"), F.when(i % 3 == 1, i % 5).alias("page"))
    return longs(L.read_file(asked, nodes(s, d)), "rank")


@register("list_folder", """WITH f AS (SELECT regexp_extract(url, '^https?://(.*)$', 1) AS path FROM pages), q AS (SELECT 0 AS query_id, '' AS path UNION ALL SELECT page_id + 1, split_part(path, '/', 1) FROM (SELECT page_id, regexp_extract(url, '^https?://(.*)$', 1) AS path FROM pages WHERE page_id < 20)),
r AS (SELECT query_id, f.path, row_number() OVER (PARTITION BY query_id ORDER BY f.path) AS rank FROM q JOIN f ON q.path = '' OR starts_with(f.path, q.path || '/')) SELECT query_id::BIGINT AS query_id, path, rank FROM r WHERE rank <= 60""")
def list_folder(s, d):
    pages = read(s, d, "pages").select("page_id", F.regexp_extract("url", "^https?://(.*)$", 1).alias("path"))
    asked = pages.filter("page_id < 20").select((F.col("page_id") + 1).alias("query_id"), F.concat(F.lit("/"), F.substring_index("path", "/", 1), F.lit("/")).alias("path"))
    return longs(L.list_folder(asked.union(s.createDataFrame([(0, "")], "query_id long, path string")), pages.select("path")), "rank")


# --- incremental table


@register("merged_files", """WITH v AS (SELECT 1 AS v, source AS path, doc_id, n_chars FROM documents WHERE lang IN ('de', 'en') UNION ALL SELECT 2, source, doc_id, n_chars FROM documents WHERE lang = 'fr' AND regexp_matches(source, '[02468]$')
UNION ALL SELECT 3, source, doc_id, n_chars FROM documents WHERE lang = 'es' AND regexp_matches(source, '^src1.$')), k AS (SELECT path, v FROM v UNION SELECT 'src1', 2), m AS (SELECT path, max(v) AS v FROM k GROUP BY 1) SELECT path, doc_id, n_chars FROM v JOIN m USING (path, v)""")
def merged_files(s, d):
    """Three batches, the second one also takes a file away; a compaction between the second and the third."""
    docs = read(s, d, "documents").select(F.col("source").alias("path"), "doc_id", "n_chars", "lang")
    table = MergeTable(s, f"{scratch_folder(s)}/merged-{uuid.uuid4().hex}")
    table.replace(docs.filter("lang in ('de', 'en')").drop("lang"))
    table.replace(docs.filter("lang = 'fr' and path rlike '[02468]$'").drop("lang"), s.createDataFrame([("src1",)], "path string"))
    table.compact()
    table.replace(docs.filter("lang = 'es' and path rlike '^src1.$'").drop("lang"))
    return table.read()


# --- answers and their support


#: Answers: texts whose first full stop gets a citation, and each whole number a source of its own, that holds every other word.
ANSWERS = """a AS (SELECT doc_id AS answer_id, regexp_replace(replace(text, ', ', ' [1, 9], '), '\\. ', ' 2024 [2]. ') AS text, [left(text, 400), right(text, 400)] AS sources FROM documents WHERE n_chars < 3000 AND text IS NOT NULL)"""


def answers(s, d):
    text = F.concat(F.regexp_extract(F.replace("text", F.lit(", "), F.lit(" [1, 9], ")), r"(?s)^(.*?)(\. .*|$)$", 1), F.regexp_replace(F.regexp_extract(F.replace("text", F.lit(", "), F.lit(" [1, 9], ")), r"(?s)^(.*?)(\. .*|$)$", 2), r"^\. ", " 2024 [2]. "))
    sources = F.create_map(F.lit(1), F.left("text", F.lit(400)), F.lit(2), F.right("text", F.lit(400)))
    return read(s, d, "documents").filter("n_chars < 3000 and text is not null").select(F.col("doc_id").alias("answer_id"), text.alias("text"), sources.alias("sources"))


@register("citations", f"""WITH {ANSWERS} SELECT answer_id, replace(text, '[1, 9]', '[1]') AS text, array_to_string(list_transform(list_sort([x FOR x IN [[strpos(text, '[1, 9]'), 1], [strpos(text, '[2]'), 2]] IF x[1] > 0]), lambda x: x[2]), ',') AS cited FROM a""")
def citations(s, d):
    out = G.citations(answers(s, d).withColumn("valid", F.array(F.lit(1), F.lit(2))))
    return out.select("answer_id", "text", F.array_join(F.transform("cited", lambda n: n.cast("string")), ",").alias("cited"))


@register("supported_answers", f"""WITH {ANSWERS}, l AS (SELECT answer_id, sources, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS no FROM (SELECT answer_id, sources, regexp_replace(replace(text, '[1, 9]', '[1]'), '^\\s+|\\s+$', '', 'g') AS t FROM a)),
b AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM l), f AS (SELECT *, count(*) FILTER (starts_with(bare, '```')) OVER (PARTITION BY answer_id ORDER BY no) AS fences FROM b),
k AS (SELECT *, CASE WHEN starts_with(bare, '```') OR fences % 2 = 1 THEN 'code' WHEN starts_with(bare, '|') THEN 'table' ELSE 'prose' END AS kind FROM f),
s AS (SELECT answer_id, no, sources, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS j FROM (SELECT *, string_split(regexp_replace(line, '([.!?])(\\s+)([A-ZА-ЯЁ0-9«"(])', '\\1\\2' || chr(1) || '\\3', 'g'), chr(1)) AS p FROM k WHERE kind = 'prose' AND line <> '')),
t AS (SELECT *, regexp_extract_all(piece, '\\[([0-9]+)\\]', 1) AS cited, regexp_replace(regexp_replace(regexp_replace(regexp_replace(piece, '\\[[0-9]+\\]', '', 'g'), '^\\s+|\\s+$', '', 'g'), '^[-*#>0-9. ]+', ''), '^\\s+|\\s+$', '', 'g') AS body FROM s),
u AS (SELECT *, array_to_string(list_transform(cited, lambda n: coalesce(sources[n::INT], '')), ' ') AS pool FROM t),
v AS (SELECT *, [n FOR n IN regexp_extract_all(body, '[0-9]+(?:[.,][0-9]+)*') IF length(regexp_replace(n, '[.,]', '', 'g')) >= 2 AND NOT contains(pool, n) AND NOT contains(pool, replace(n, ',', '.')) AND NOT contains(pool, replace(n, ',', ''))] AS gone FROM u),
w AS (SELECT answer_id, CASE WHEN length(body) < 25 OR ends_with(body, ':') THEN NULL WHEN len(cited) = 0 OR len(gone) > 0 THEN 0 ELSE 1 END AS ok FROM v)
SELECT answer_id, coalesce(count(*) FILTER (ok = 1), 0) AS supported, coalesce(count(*) FILTER (ok = 0), 0) AS unsupported FROM a LEFT JOIN w USING (answer_id) GROUP BY 1""")
def supported_answers(s, d):
    cited = G.citations(answers(s, d).withColumn("valid", F.array(F.lit(1), F.lit(2))))
    marked = G.mark_unsupported(cited.select("answer_id", "text").join(answers(s, d).select("answer_id", "sources"), "answer_id"))
    return marked.select("answer_id", "supported", "unsupported")


# --- logs


@register("log_series", """WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
p AS (SELECT user_id, 'score' AS metric, k, CASE WHEN k % 4 <> 0 THEN k END AS step, printf('%.3f', value)::DOUBLE AS v FROM e UNION ALL SELECT user_id, 'val/err', k, CASE WHEN k % 4 <> 0 THEN k END, printf('%.2f', value / 7)::DOUBLE FROM e),
n AS (SELECT user_id, metric, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id, metric, CASE metric WHEN 'score' THEN 'max' ELSE 'min' END AS direction, CASE metric WHEN 'score' THEN max(v) ELSE min(v) END AS best, (CASE metric WHEN 'score' THEN arg_min(coalesce(step, -1), {'a': -v, 'k': k}) ELSE arg_min(coalesce(step, -1), {'a': v, 'k': k}) END)::DOUBLE AS best_step,
arg_max(v, k) AS last, (arg_max(coalesce(step, -1), k))::DOUBLE AS last_step, n FROM p JOIN n USING (user_id, metric) GROUP BY user_id, metric, n""")
def log_series(s, d):
    """A log for each user, a line for each event; every fourth line has no step. A missing step is shown as -1."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = read(s, d, "events").select("user_id", "value", k.alias("k"))
    line = F.concat(F.when(F.col("k") % 4 != 0, F.format_string("epoch=%d ", "k")).otherwise("eval "), F.format_string("score=%.3f val/err: %.2f", F.col("value"), F.col("value") / 7))
    logs = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    out = K.metric_summary(K.log_metrics(logs, key="user_id"), ["user_id", "metric"])
    return out.select("user_id", "metric", "direction", "best", F.coalesce("best_step", F.lit(-1.0)).alias("best_step"), "last", F.coalesce("last_step", F.lit(-1.0)).alias("last_step"), "n")


# --- tokens, addresses, intents


TOKEN = "[\\p{L}\\p{N}_][\\p{L}\\p{N}_.\\-]*[\\p{L}\\p{N}_]|[\\p{L}\\p{N}_]"


@register("distinctive_tokens", f"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{TOKEN}'))) AS t FROM documents)
SELECT DISTINCT doc_id, lower(t) AS token FROM t WHERE (regexp_matches(t, '\\p{{L}}') AND length(t) >= 5 AND (regexp_matches(t, '\\p{{Nd}}|_|[a-z][A-Z]|[A-Za-z]-[A-Z0-9]') OR (upper(t) = t AND lower(t) <> t AND length(t) >= 6)))
OR (NOT regexp_matches(t, '\\p{{L}}') AND length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) >= 4 AND NOT regexp_matches(t, '^(19[0-9][0-9]|20[0-9][0-9]|2100)$'))""")
def distinctive_tokens(s, d):
    return read(s, d, "documents").select("doc_id", F.explode(S.distinctive_tokens(F.col("text"))).alias("token"))


@register("normal_urls", """WITH u AS (SELECT page_id, rtrim(unnest(regexp_extract_all('See ' || url || '/#top, or <' || replace(url, 'http', 'HTTP') || '> and ' || url || '!', 'https?://[^\\s<>()"''`\\]]+')), '.,;:!?') AS u FROM pages)
SELECT DISTINCT page_id, lower(regexp_extract(u, '^([^:/?#]+)://([^/?#]*)([^?#]*)(\\?[^#]+)?', 1)) || '://' || lower(regexp_extract(u, '^([^:/?#]+)://([^/?#]*)([^?#]*)(\\?[^#]+)?', 2)) || rtrim(regexp_extract(u, '^([^:/?#]+)://([^/?#]*)([^?#]*)(\\?[^#]+)?', 3), '/') || regexp_extract(u, '^([^:/?#]+)://([^/?#]*)([^?#]*)(\\?[^#]+)?', 4) AS url FROM u""")
def normal_urls(s, d):
    text = F.concat(F.lit("See "), "url", F.lit("/#top, or <"), F.replace("url", F.lit("http"), F.lit("HTTP")), F.lit("> and "), "url", F.lit("!"))
    return read(s, d, "pages").select("page_id", F.explode(F.transform(S.urls_in(text), S.normal_url)).alias("url")).distinct()


def _intent_sql(kind: str) -> str:
    pattern = S.INTENTS[kind].replace("\\w", WORDS).replace("'", "''")
    return f"SELECT doc_id, '{kind}' AS kind FROM documents WHERE regexp_matches(text, '(?i){pattern}')"


@register("intents", " UNION ALL ".join(map(_intent_sql, S.INTENTS)))
def intents(s, d):
    kinds = F.array(*(F.when(S.wants(F.col("text"), k), k) for k in S.INTENTS))
    return read(s, d, "documents").select("doc_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


# --- policy


#: Runs are conversations; a step's tool follows from its turn, its output is the turn's text with a token and an address.
RUNS = """s AS (SELECT conv_id AS run_id, turn AS step, CASE turn % 7 WHEN 0 THEN 'web_search' WHEN 1 THEN 'read_file' WHEN 2 THEN 'fetch_page' WHEN 3 THEN 'run_code' WHEN 4 THEN 'install_package' WHEN 5 THEN 'unknown' ELSE 'web_search' END AS tool,
'Run-' || (conv_id % 5) || 'xy 4417-' || turn || ' secret_name' || (turn % 4) AS query, 'HTTPS://Host' || (turn % 3) || '.example/p/' AS url, 'run-' || (conv_id % 5) || 'xy see https://host' || ((turn + 2) % 4) || '.example/p.' AS output FROM conversations),
r AS (SELECT conv_id AS run_id, 'asks 4417-6 and https://host9.example' AS question, conv_id % 4 <> 0 AS web, conv_id % 3 <> 0 AS code, conv_id % 11 <> 0 AS enabled FROM conversations GROUP BY conv_id)"""


def steps(s, d):
    t, c, text = F.col("turn"), F.col("conv_id"), lambda x: x.cast("string")
    tools = F.array(*map(F.lit, ("web_search", "read_file", "fetch_page", "run_code", "install_package", "unknown", "web_search")))
    run = F.concat(F.lit("un-"), text(c % 5), F.lit("xy"))
    return read(s, d, "conversations").select(
        c.alias("run_id"), t.alias("step"), F.element_at(tools, (t % 7 + 1).cast("int")).alias("tool"),
        F.concat(F.lit("R"), run, F.lit(" 4417-"), text(t), F.lit(" secret_name"), text(t % 4)).alias("query"),
        F.concat(F.lit("HTTPS://Host"), text(t % 3), F.lit(".example/p/")).alias("url"),
        F.concat(F.lit("r"), run, F.lit(" see https://host"), text((t + 2) % 4), F.lit(".example/p.")).alias("output"),
    )


def policy_runs(s, d):
    c = F.col("conv_id")
    return read(s, d, "conversations").select(c.alias("run_id"), F.lit("asks 4417-6 and https://host9.example").alias("question"), (c % 4 != 0).alias("web"), (c % 3 != 0).alias("code"), (c % 11 != 0).alias("enabled")).distinct()


LABELS = """o AS (SELECT *, CASE tool WHEN 'read_file' THEN 1 WHEN 'web_search' THEN 0 WHEN 'fetch_page' THEN 0 WHEN 'install_package' THEN 0 END AS own FROM s),
g AS (SELECT *, coalesce(min(own) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS low FROM o)"""


@register("run_labels", f"""WITH {RUNS}, {LABELS} SELECT run_id, step, ['untrusted', 'private', 'trusted'][coalesce(own, low) + 1] AS trust, low = 0 AS tainted FROM g""")
def run_labels(s, d):
    return P.labels(steps(s, d)).select("run_id", "step", "trust", "tainted")


@register("policy_verdicts", f"""WITH {RUNS}, {LABELS}, x AS (SELECT g.*, web, code, enabled, tool = 'web_search' AND contains(query, 'secret_name2') AS named,
  tool = 'web_search' AND EXISTS (SELECT 1 FROM g p WHERE p.run_id = g.run_id AND p.step < g.step AND coalesce(p.own, p.low) = 1) AS leaked,
  EXISTS (SELECT 1 FROM g p WHERE p.run_id = g.run_id AND p.step < g.step AND p.tool = 'web_search' AND 'https://host' || (p.step + 2) % 4 || '.example/p' = rtrim(lower(g.url), '/')) AS known FROM g JOIN r USING (run_id)),
y AS (SELECT *, CASE WHEN tool = 'unknown' THEN 'tools' WHEN tool IN ('web_search', 'fetch_page') AND NOT web OR tool IN ('run_code', 'install_package') AND NOT code THEN 'S21' WHEN NOT enabled THEN 'off' WHEN named OR leaked THEN 'rule 1'
  WHEN tool = 'fetch_page' THEN CASE WHEN known THEN '' ELSE 'rule 3' END WHEN tool = 'install_package' THEN 'FR14' WHEN tool = 'web_search' AND low = 0 THEN 'rule 2' ELSE '' END AS rule FROM x)
SELECT run_id, step, CASE WHEN rule IN ('', 'off') THEN 'allow' WHEN rule IN ('tools', 'S21', 'rule 3') THEN 'deny' ELSE 'confirm' END AS action, rule, CASE WHEN rule <> 'rule 1' THEN '' WHEN named THEN 'secret_name2' ELSE 'run-' || (run_id % 5) || 'xy' END AS held FROM y""")
def policy_verdicts(s, d):
    names = s.createDataFrame([("Secret_name2",), ("abc",)], "name string")
    out = P.verdicts(policy_runs(s, d), steps(s, d), names)
    return out.select("run_id", "step", "action", "rule", F.array_join("held", ",").alias("held"))


# --- two rounds of retrieval


FOUND = """SELECT query_id, doc_id AS node_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, count(*) AS n FROM t JOIN (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS w FROM documents) USING (w) GROUP BY 1, 2) QUALIFY rank <= 3"""
JUDGED = """SELECT query_id, max(round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z]{4,}')), regexp_extract_all(lower(d.text), '[a-z]{4,}'))) / greatest(len(list_distinct(regexp_extract_all(lower(q.text), '[a-z]{4,}'))), 1) - 0.35, 6)) AS best"""


@register("corrective_search", f"""WITH q AS (SELECT doc_id AS query_id, left(text, 60) AS text FROM documents WHERE doc_id % 20 = 3 AND text IS NOT NULL), t AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(left(text, 60), '[a-z]{{5,}}')) AS w FROM q), f AS ({FOUND}),
b AS ({JUDGED} FROM f JOIN q USING (query_id) JOIN documents d ON d.doc_id = f.node_id GROUP BY 1), b1 AS (SELECT query_id, coalesce(best, 0) AS best FROM q LEFT JOIN b USING (query_id)),
t2 AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS w FROM q WHERE query_id IN (SELECT query_id FROM b1 WHERE best < 0.02)), f2 AS ({FOUND.replace('FROM t JOIN', 'FROM t2 JOIN')}),
b2 AS ({JUDGED} FROM f2 f JOIN q USING (query_id) JOIN documents d ON d.doc_id = f.node_id GROUP BY 1),
z AS (SELECT b1.query_id, CASE WHEN coalesce(b2.best, 0) > b1.best THEN 2 ELSE 1 END AS round, greatest(b1.best, coalesce(b2.best, 0)) AS best FROM b1 LEFT JOIN b2 USING (query_id)), v AS (SELECT *, CASE WHEN best >= 0.5 THEN 'correct' WHEN best < 0.02 THEN 'incorrect' ELSE 'ambiguous' END AS verdict FROM z),
h AS (SELECT *, 1 AS round FROM f UNION ALL SELECT *, 2 FROM f2) SELECT v.query_id, h.node_id, h.rank, v.round, v.best, v.verdict FROM v LEFT JOIN h ON v.query_id = h.query_id AND v.round = h.round AND v.verdict <> 'incorrect'""")
def corrective_search(s, d):
    """A question's first words are sought as they are written, capitals losing theirs; rewritten, in lower case."""
    docs = read(s, d, "documents").filter("text is not null")
    terms = lambda c, p, i=0: F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(i)))
    texts = docs.select(F.col("doc_id").alias("node_id"), "text")

    def search(asked):
        t = asked.select("query_id", F.explode(terms(F.col("text"), "[a-z]{5,}")).alias("term"))
        return R.shared_terms_topk(t, texts, terms(F.lower("text"), "[a-z]{5,}"), 3)

    def relevance(pairs):
        both = pairs.join(texts, "node_id")
        mine, theirs = terms(F.lower("question"), "[a-z]{4,}"), terms(F.lower("text"), "[a-z]{4,}")
        return both.withColumn("relevance", F.round(F.size(F.array_intersect(mine, theirs)) / F.greatest(F.size(mine), F.lit(1)) - 0.35, 6))

    asked = docs.filter("doc_id % 20 = 3").select(F.col("doc_id").alias("query_id"), F.left("text", F.lit(60)).alias("text"))
    return longs(R.corrective_search(asked, search, relevance, F.lower), "rank")
