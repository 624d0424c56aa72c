"""What stands between retrieval and an answer: fused evidence, budgets, prompts, provenance, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import wants
from .ranking import keep_first, ordered_union, rank_by


def upload_hits(exact: DataFrame, dense: DataFrame, limit: int = 8) -> DataFrame:
    """Exact keys first, above every dense score, then the dense hits (RET-09)."""
    top = dense.groupBy("query_id").agg((F.max("score") + 1).alias("_top"))
    first = exact.join(top, "query_id", "left").select("query_id", "node_id", F.coalesce("_top", F.lit(1.0)).alias("score"), "rank")
    both = ordered_union([first, dense.select("query_id", "node_id", "score", "rank")], ["query_id", "node_id"], "rank")
    return rank_by(both.drop("rank"), ["query_id"], [F.desc("score"), F.asc("node_id")]).filter(F.col("rank") <= limit)


def lead_with(leading: DataFrame, hits: DataFrame) -> DataFrame:
    """One list put before another, repeats dropped, ranked anew (RET-12)."""
    frames = [f.select("query_id", "node_id", "score", F.col("rank").alias("_r"), F.lit(i).alias("_f")) for i, f in enumerate((leading, hits))]
    one = keep_first(frames[0].unionByName(frames[1]), ["query_id", "node_id"], [F.asc("_f"), F.asc("_r")])
    return rank_by(one, ["query_id"], [F.asc("_f"), F.asc("_r"), F.asc("node_id")]).select("query_id", "node_id", "score", "rank")


def evidence_pool(seen: DataFrame, lower: float = 0.02, most: int = 8) -> DataFrame:
    """Each fragment at its first score, best first; those under `lower` go unless nothing is left (RET-13).

    seen (query_id, node_id, score, step).
    """
    once = keep_first(seen, ["query_id", "node_id"], [F.asc("step")])
    ranked = rank_by(once, ["query_id"], [F.desc("score"), F.asc("step"), F.asc("node_id")])
    return ranked.filter(((F.col("score") >= lower) | (F.col("rank") == 1)) & (F.col("rank") <= most))


def upload_route(question: Column, n_chars: Column, budget: int, answerable: Column, mode: Column | None = None) -> Column:
    """overview, whole, parts, index or index+parts for a question about uploads (RET-14).

    Files within the budget go in whole; larger ones by an overview if the question asks for one, else
    by their index, and by parts after it only where the fragments could not answer. A `mode` of whole or
    index, instead of self_route, forbids the other way.
    """
    mode = F.lit("self_route") if mode is None else mode
    fits = n_chars <= budget
    return (
        F.when(~fits & (mode != "index") & wants(question, "overview"), "overview")
        .when(fits & (mode != "index"), "whole")
        .when(mode == "whole", "parts")
        .when((mode == "self_route") & ~F.coalesce(answerable, F.lit(False)), "index+parts")
        .otherwise("index")
    )


def page_fragments(visual_hits: DataFrame, nodes: DataFrame, most: int = 2) -> DataFrame:
    """A hit on a page becomes the page's first fragments (JOIN-15): hits (query_id, file_path, page, rank), nodes (file_path, page, ord, node_id)."""
    first = rank_by(nodes, ["file_path", "page"], [F.asc("ord")], "_n").filter(F.col("_n") <= most)
    hits = visual_hits.join(first, ["file_path", "page"])
    return rank_by(hits.withColumnRenamed("rank", "_r"), ["query_id"], [F.asc("_r"), F.asc("_n")]).select("query_id", "node_id", "rank")


def round_trip(questions: DataFrame, hits: DataFrame, most: int = 20) -> DataFrame:
    """Questions whose own fragment is found among the first `most` (JOIN-23)."""
    good = hits.filter(F.col("rank") <= most).select("query_id", F.col("node_id").alias("own_id"))
    return questions.join(good, ["query_id", "own_id"], "left_semi")


def provenance_nodes(rows: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """Cells named by a result: the cell's output if it has one, else its first fragment; the first pairs only (JOIN-14).

    rows (path, cell, pos); nodes (file_path, cell, node_id, node_type, ord).
    """
    pairs = keep_first(rows, ["path", "cell"], [F.asc("pos")])
    pairs = rank_by(pairs.withColumn("_one", F.lit(1)), ["_one"], [F.asc("pos")], "_n").filter(F.col("_n") <= most).drop("_one")
    hit = pairs.join(nodes, (F.col("path") == F.col("file_path")) & (pairs["cell"] == nodes["cell"])).select("path", pairs["cell"], "pos", "node_id", "node_type", "ord")
    return keep_first(hit, ["path", "cell"], [F.desc(F.col("node_type") == "output"), F.asc("ord")]).select("path", "cell", "node_id", "pos")


def context_blocks(hits: DataFrame, limit: int, text: str = "text", label: str = "label") -> DataFrame:
    """(query_id, context): numbered source blocks in rank order, each cut at `limit` with an ellipsis (PRJ-08)."""
    body = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(F.col(text))
    block = F.format_string('<source id="%d" ref="%s">\n%s\n</source>', F.col("rank"), F.col(label), body)
    parts = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("b"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["b"]), "\n").alias("context"))


def overview_nodes(nodes: DataFrame, budget: int, key: str = "file") -> DataFrame:
    """An overview within a budget: the first three fragments, the first of each section, then others in order (CHK-19).

    nodes (key, ord, section, size). A fragment that does not fit is passed over, not a stop; the
    first of all always stays. The choice is a fold over the fragments in order of priority.
    """
    first = F.row_number().over(Window.partitionBy(key, "section").orderBy("ord")) == 1
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    ranked = nodes.withColumn("_p", F.when(place <= 3, 0).when(first & (F.coalesce("section", F.lit("")) != ""), 1).otherwise(2))
    rows = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "ord", "size"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))

    def take(acc: Column, r: Column) -> Column:
        fits = (F.size(acc["out"]) == 0) | (acc["sum"] + r["size"] <= budget)
        return F.when(fits, F.struct((acc["sum"] + r["size"]).cast("long").alias("sum"), F.concat(acc["out"], F.array(r["ord"].cast("long"))).alias("out"))).otherwise(acc)

    chosen = rows.select(key, F.explode(F.aggregate("rows", start, take, lambda acc: acc["out"])).alias("ord"))
    return nodes.join(chosen, [key, "ord"], "left_semi")


def joined_cells(parts: DataFrame) -> DataFrame:
    """(file_path, cell, source): overlapping parts of a cell put together; of later parts only lines not seen yet (CHK-16).

    parts (file_path, cell, ord, text).
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: F.split(p["text"], "\n", -1))
    rows = parts.groupBy("file_path", "cell").agg(texts.alias("t"))
    rest = F.when(F.size("t") > 1, F.slice("t", 2, F.size("t") - 1)).otherwise(F.array().cast("array<array<string>>"))
    lines = F.aggregate(rest, F.element_at("t", 1), lambda acc, ls: F.concat(acc, F.filter(ls, lambda x: ~F.array_contains(acc, x))))
    return rows.select("file_path", "cell", F.array_join(lines, "\n").alias("source"))


def notebook_prompt(cells: DataFrame, limit: int) -> DataFrame:
    """(file_path, prompt): cells in order, each cut to its share of the limit, 400 characters at least (CHK-17)."""
    share = F.greatest(F.lit(400), F.floor(F.lit(limit) / F.count("*").over(Window.partitionBy("file_path"))).cast("int"))
    cut = cells.withColumn("_s", share)
    # The two headings are fixed values of the format.
    head = F.format_string("[ячейка %d · %s]\n%s", F.col("cell"), F.coalesce("cell_type", F.lit("output")), F.left("source", F.col("_s")))
    out = F.when(F.coalesce("output", F.lit("")) != "", F.format_string("\n\n[вывод ячейки %d]\n%s", F.col("cell"), F.left("output", F.col("_s")))).otherwise("")
    blocks = F.array_sort(F.collect_list(F.struct("cell", F.concat(head, out).alias("b"))))
    return cut.groupBy("file_path").agg(F.left(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n"), F.lit(limit)).alias("prompt"))


def compact_history(messages: DataFrame, keep: int = 12, lines: int = 2) -> DataFrame:
    """Tool outputs other than the last `keep` messages cut to their first lines (WIN-08): messages (run_id, pos, role, text)."""
    from_end = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("pos")))
    short = F.array_join(F.slice(F.split("text", "\n", -1), 1, lines), "\n")
    old = (F.col("_e") > keep) & (F.col("role") == "tool") & (F.size(F.split("text", "\n", -1)) > lines)
    return messages.withColumn("_e", from_end).withColumn("text", F.when(old, F.concat(short, F.lit("\n…"))).otherwise(F.col("text"))).drop("_e")


def numbered_view(files: DataFrame, start: int, window: int = 80) -> DataFrame:
    """(path, line_no, line): a window of numbered lines (WIN-12)."""
    rows = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("_p", "line")).withColumn("line_no", F.col("_p") + 1)
    return rows.filter(F.col("line_no").between(start, start + window - 1)).select("path", "line_no", "line")


def partition_by_budget(nodes: DataFrame, budget: int, key: str = "file") -> DataFrame:
    """`part`: fragments dealt in order into parts within the budget (CHK-18): nodes (key, ord, size)."""
    from .chunking import greedy_pack

    rows = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "size"))).alias("r"))
    parts = greedy_pack(F.transform("r", lambda x: x["size"]), budget)
    return rows.select(key, F.explode(F.arrays_zip(F.col("r").alias("r"), parts.alias("part"))).alias("x")).select(key, "x.r.ord", "x.r.size", "x.part")


def narrowed_tables(question: str, tables: DataFrame, joins: dict[str, list[str]], hinted: list[str] = (), most: int = 4) -> list[str]:
    """Tables for a question (SQL-04): the closest by shared words, then their join partners and those that hints name."""
    words = F.array(*map(F.lit, sorted(set(question.lower().split()))))
    own = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "name", "description")), r"[^\p{L}\p{N}]+"))
    best = [r["name"] for r in tables.withColumn("_s", F.size(F.array_intersect(own, words))).orderBy(F.desc("_s"), "name").limit(most).collect()]
    return list(dict.fromkeys([*best, *(j for b in best for j in joins.get(b, [])), *hinted]))


def describe_table(name: str, schema, comment: str = "") -> str:
    """CREATE TABLE text with column comments from a StructType's metadata (SQL-10)."""
    rows = [f"  {f.name} {f.dataType.simpleString().upper()}" + (f" -- {f.metadata['comment']}" if f.metadata.get("comment") else "") for f in schema.fields]
    return (f"-- {comment}\n" if comment else "") + f"CREATE TABLE {name} (\n" + ",\n".join(rows) + "\n)"


def closest_examples(question: str, examples: DataFrame, most: int = 3) -> DataFrame:
    """The most similar solved questions by shared words (SQL-06)."""
    words = F.array(*map(F.lit, sorted(set(question.lower().split()))))
    own = F.array_distinct(F.split(F.lower("question"), r"[^\p{L}\p{N}]+"))
    shared = F.size(F.array_intersect(own, words))
    return examples.withColumn("score", shared / F.sqrt(F.size(own) * F.size(words))).orderBy(F.desc("score"), "question").limit(most)
