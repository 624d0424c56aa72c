"""Plain text files cut by what they hold: logs, tables, markdown, code and prose in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import HEADING_LINE, classify, greedy_pack, heading_paths

#: Characters of a chunk of prose or markdown, of a table's chunk, lines of a window and those that two windows share (fixed values).
TEXT_CHARS, TABLE_CHARS, WINDOW_LINES, SHARED_LINES = 1500, 6000, 60, 10
DELIMITERS = ("\t", ";", "|", ",")


def _rendered(cells: Column, width: Column) -> Column:
    """A table's row between bars, filled up to `width` cells."""
    missing = F.greatest(width - F.size(cells), F.lit(0))
    return F.concat(F.lit("| "), F.array_join(F.concat(cells, F.array_repeat(F.lit(""), missing)), " | "), F.lit(" |"))


def text_segments(files: DataFrame, key: str = "path", text_chars: int = TEXT_CHARS, table_chars: int = TABLE_CHARS, window: int = WINDOW_LINES, shared: int = SHARED_LINES) -> DataFrame:
    """(key, content_type, node_type, title, section, line_start, line_end, text) of files (key, text) (SRC-09).

    Each line is read once. It belongs to units: a log's or code's windows of lines, a table's row, a
    paragraph of prose or of the part under a markdown heading, which begins one. Units are packed in
    order up to the size of their type, each whole; windows stay alone. What type a file is, is a column,
    so that no type has a scan or a branch of its own.

    A table's header is the first row with the most frequent number of fields, and stands above every
    chunk; rows before it are a preamble; fields are split at the delimiter as it stands. A table without
    rows gives its header. Null and blank texts give nothing.
    """
    typed = files.filter(F.col("text").isNotNull()).select(key, F.regexp_replace("text", "\r\n?", "\n").alias("text")).select(key, classify(F.col("text")).alias("kind"), F.split("text", "\n", -1).alias("_l"))
    rows = typed.select(key, "kind", F.size("_l").alias("n"), F.posexplode("_l").alias("at", "line"))
    order, table = Window.partitionBy(key).orderBy("at"), F.col("kind") == "table"
    windowed = F.col("kind").isin("log", "code")
    step = max(window - shared, 1)
    back = F.transform(F.sequence(F.lit(0), F.lit((window - 1) // step)), lambda b: F.floor(F.col("at") / step) - b)
    of = F.filter(back, lambda k: (k >= 0) & (F.col("at") < k * step + window) & ((k == 0) | (k * step + shared < F.col("n"))))
    rows = rows.withColumn("run", F.explode(F.when(windowed, of).otherwise(F.array(F.lit(0).cast("long"))))).filter(windowed | F.col("line").rlike(r"\S"))
    # Headings, paragraphs.
    level = F.when((F.col("kind") == "markdown") & F.col("line").rlike(HEADING_LINE), F.length(F.regexp_extract("line", HEADING_LINE, 1)))
    rows = rows.withColumn("level", level).withColumn("head", F.trim(F.regexp_extract("line", HEADING_LINE, 2)))
    by_run = Window.partitionBy(key, F.when(windowed, F.col("run")).otherwise(-1)).orderBy("at")
    opens = F.col("level").isNotNull() | (F.coalesce(F.lag("at").over(by_run), F.lit(-2)) != F.col("at") - 1)
    rows = heading_paths(rows, key, "at", "level", "head").withColumn("section", F.nullif("section", F.lit("")))
    rows = rows.withColumn("run", F.when(windowed, F.col("run")).otherwise(F.sum(F.col("level").isNotNull().cast("long")).over(order.rangeBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("_opens", opens.cast("int"))
    rows = rows.withColumn("unit", F.when(windowed, 0).when(table, F.col("at")).otherwise(F.sum("_opens").over(order.rangeBetween(Window.unboundedPreceding, 0))))
    # Tables: the delimiter that most lines have as often, the width of most rows, the header.
    whole = Window.partitionBy(key)
    for i, mark in enumerate(DELIMITERS):
        rows = rows.withColumn(f"_d{i}", F.when(table, F.length("line") - F.length(F.replace("line", F.lit(mark), F.lit("")))))
    modes = [F.mode(f"_d{i}", True).over(whole).alias(f"_m{i}") for i in range(len(DELIMITERS))]
    rows = rows.select("*", *modes)
    regular = [F.coalesce(F.sum(((F.col(f"_d{i}") == F.col(f"_m{i}")) & (F.col(f"_m{i}") > 0)).cast("int")).over(whole) >= 0.8 * F.count("*").over(whole), F.lit(False)) for i in range(len(DELIMITERS))]
    delimiter = F.lit(None).cast("string")
    for mark, good in zip(reversed(DELIMITERS), reversed(regular), strict=True):
        delimiter = F.when(good, F.lit(mark)).otherwise(delimiter)
    rows = rows.withColumn("_mark", F.when(table, F.coalesce(delimiter, F.lit(","))))
    rows = rows.withColumn("cells", F.when(table, F.split("line", F.concat(F.lit(r"\Q"), "_mark", F.lit(r"\E")), F.lit(-1)))).withColumn("width", F.size("cells"))
    rows = rows.withColumn("_wide", F.mode("width", True).over(whole)).withColumn("_top", F.min(F.when(table & (F.col("width") == F.col("_wide")), F.col("at"))).over(whole))
    rows = rows.withColumn("run", F.when(table, F.when(F.col("at") < F.col("_top"), -1).when(F.col("at") == F.col("_top"), -2).otherwise(0)).otherwise(F.col("run")))
    header = F.max(F.when(F.col("at") == F.col("_top"), _rendered(F.col("cells"), F.col("_wide")))).over(whole)
    shown = F.when(table & (F.col("run") != -1), _rendered(F.col("cells"), F.col("_wide"))).otherwise(F.col("line"))
    rows = rows.withColumn("_header", header).withColumn("line", shown)
    # Units, then chunks.
    joined = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]), sep)
    units = rows.groupBy(key, "kind", "run", "unit", F.col("_wide").alias("wide")).agg(F.min("at").alias("at"), F.max("at").alias("end"), joined("line", "\n").alias("body"), F.max_by("section", "at").alias("section"), F.max("_header").alias("header"))
    size = F.when(F.col("kind").isin("log", "code"), 0).when(F.col("run") == -1, 0).otherwise(F.length("body") + F.col("kind").isin("table").cast("int"))
    packed = units.filter(F.col("body").rlike(r"\S")).groupBy(key, "kind", "run").agg(F.array_sort(F.collect_list(F.struct("at", "end", "unit", size.alias("size")))).alias("u"), F.first("header").alias("header"), F.first("wide").alias("wide"))
    room = F.when(F.col("kind") == "table", F.lit(table_chars) - F.length("header") - 1 - (F.lit(1) + 4 * F.col("wide"))).otherwise(text_chars)
    packs = greedy_pack(F.transform("u", lambda x: x["size"]), room)
    placed = packed.select(key, "run", F.explode(F.arrays_zip(F.col("u").alias("u"), packs.alias("pack"))).alias("z")).select(key, "run", "z.u.unit", "z.pack")
    chunks = units.join(placed, [key, "run", "unit"])
    body = F.when(F.first("kind").isin("prose", "markdown"), joined("body", "\n\n")).otherwise(joined("body", "\n"))
    out = chunks.groupBy(key, "kind", "run", "pack").agg((F.min("at") + 1).alias("line_start"), (F.max("end") + 1).alias("line_end"), body.alias("text"), F.max_by("section", "at").alias("section"), F.first("header").alias("header"), F.first("wide").alias("wide"))
    alone = F.max(F.when(F.col("run") >= 0, 1).otherwise(0)).over(whole) == 0
    out = out.withColumn("_alone", alone).filter((F.col("kind") != "table") | (F.col("run") != -2) | F.col("_alone"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("wide").cast("int")))
    table_text = F.when(F.col("run") == -1, F.col("text")).when(F.col("run") == -2, F.concat_ws("\n", "header", rule)).otherwise(F.concat_ws("\n", "header", rule, "text"))
    node = F.create_map(*(F.lit(x) for kv in {"log": "log_chunk", "code": "code_chunk", "table": "table"}.items() for x in kv))
    lines = F.format_string("%s %d-%d", F.when(F.col("kind") == "table", "rows").otherwise("lines"), F.col("line_start"), F.col("line_end"))
    title = F.when(F.col("run") == -1, "preamble").when(F.col("run") == -2, "header").otherwise(F.coalesce(F.element_at(F.split("section", " > "), -1), lines))
    kind = F.when(F.col("run") == -1, "section").otherwise(F.coalesce(node[F.col("kind")], F.lit("section")))
    return out.select(key, F.col("kind").alias("content_type"), kind.alias("node_type"), title.alias("title"), "section", "line_start", "line_end", F.left(F.when(F.col("kind") == "table", table_text).otherwise(F.col("text")), F.lit(table_chars)).alias("text"))
