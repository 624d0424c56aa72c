"""Web results, page caches and uploads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import main_text, source_priority
from .ranking import keep_first, rank_by


def merged_results(results: DataFrame, prefer: list[str], demote: list[str], most: int = 8) -> DataFrame:
    """Results of several searches: each address at its best rank, preferred hosts first, then by rank (SRC-17, TOP-03).

    results (query_id, url, rank).
    """
    one = keep_first(results, ["query_id", "url"], [F.asc("rank")])
    ranked = one.withColumn("priority", source_priority(F.col("url"), prefer, demote)).withColumnRenamed("rank", "_r")
    return rank_by(ranked, ["query_id"], [F.desc("priority"), F.asc("_r"), F.asc("url")]).filter(F.col("rank") <= most).select("query_id", "url", "priority", "rank")


def fresh_pages(cache: DataFrame, now: Column, hours: int = 24, limit: int = 20_000) -> DataFrame:
    """(url, title_text): the latest copy of each page that is not too old, as cut main text (SRC-18)."""
    live = cache.filter(F.col("fetched_at") > now - F.make_dt_interval(hours=F.lit(hours)))
    latest = keep_first(live, ["url"], [F.desc("fetched_at")])
    return latest.select("url", F.substring(main_text(F.col("html")), 1, limit).alias("body"))


def live_uploads(uploads: DataFrame, now: Column) -> DataFrame:
    """Uploads that have not expired, newest first (SRC-25)."""
    return uploads.filter(F.col("expires_at") > now).orderBy(F.desc("created_at"), "upload_id")


def known_uploads(uploads: DataFrame, corpus: DataFrame) -> DataFrame:
    """`known_path`: the first corpus file with the same content, if any (JOIN-12)."""
    first = corpus.groupBy("content_hash").agg(F.min("path").alias("known_path"))
    return uploads.join(first, "content_hash", "left")


def upload_totals(fragments: DataFrame, budget_tokens: int, chars_per_token: int = 3, share: float = 0.33) -> DataFrame:
    """Characters, estimated tokens and whether an upload fits its share of the context (AGG-23)."""
    n = fragments.groupBy("upload_id").agg(F.sum(F.length("text")).alias("n_chars"))
    tokens = F.floor(F.col("n_chars") / chars_per_token)
    return n.withColumn("n_tokens", tokens).withColumn("fits", tokens <= int(budget_tokens * share))


def series_scenario(ranks: DataFrame, steps: int, onset: int, seed: int = 0) -> DataFrame:
    """(segment, step, value): one canary of each segment drawn per step, from the normal state before `onset` and the changed one after (MON-04).

    ranks (segment, state, canary_id, rank), states `normal` and `changed`. The draw is a hash,
    so that a run can be repeated anywhere.
    """
    from .monitoring import signals

    n = F.count("*").over(Window.partitionBy("segment", "state"))
    place = F.row_number().over(Window.partitionBy("segment", "state").orderBy("canary_id")) - 1
    rows = ranks.withColumn("_n", n).withColumn("_place", place)
    plan = rows.select("segment", "_n", "state").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    plan = plan.filter(F.when(F.col("step") < onset, F.lit("normal")).otherwise(F.lit("changed")) == F.col("state"))
    plan = plan.withColumn("_place", (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "segment", F.col("step").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("_n")).cast("int"))
    return plan.join(rows.drop("_n"), ["segment", "state", "_place"]).select("segment", "step", signals(F.col("rank"))[0].alias("value"))


def table_chunks(docs: DataFrame, delimiter: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, line_start, line_end, body): rows of delimited texts under their header, packed by rendered size (CHK-12).

    The header is the first line with the most frequent number of fields (the first such number
    on ties); lines above it are left out. A row that does not fit starts the next chunk.
    """
    from .chunking import greedy_pack

    rows = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_p", "line")).filter(F.trim("line") != "")
    rows = rows.select(key, (F.col("_p") + 1).alias("no"), F.split("line", _literal(delimiter), -1).alias("cells"))
    widths = rows.groupBy(key, F.size("cells").alias("w")).agg(F.count("*").alias("n"), F.min("no").alias("first"))
    width = rank_by(widths, [key], [F.desc("n"), F.asc("first")], "_k").filter("_k = 1").select(key, "w", F.col("first").alias("head"))
    body = rows.join(width, key).filter("no >= head")
    shown = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    sets = body.groupBy(key, "head").agg(F.array_sort(F.collect_list(F.struct("no", shown.alias("line")))).alias("r"))
    top, rest = F.element_at("r", 1), F.filter("r", lambda x: x["no"] > F.col("head"))
    packs = greedy_pack(F.transform(rest, lambda x: F.length(x["line"]) + 1), limit)
    out = sets.select(key, top["line"].alias("header"), F.explode(F.arrays_zip(rest.alias("r"), packs.alias("chunk"))).alias("x"))
    lines = F.array_sort(F.collect_list(F.struct("x.r.no", "x.r.line")))
    return out.groupBy(key, "header", F.col("x.chunk").alias("chunk")).agg(F.min("x.r.no").alias("line_start"), F.max("x.r.no").alias("line_end"), F.array_join(F.transform(lines, lambda v: v["line"]), "\n").alias("_b")).select(key, "chunk", "line_start", "line_end", F.concat_ws("\n", "header", "_b").alias("body"))


def _literal(delimiter: str) -> str:
    import re

    return re.escape(delimiter)
