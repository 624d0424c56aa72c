"""Canary probes, drift detectors and control of false discoveries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_folder
from ..sources.sinks import written

#: Canary questions (fixed values): definitions of classes, methods and functions, calls, notebooks, their sections, sections of documents, phrases.
TEMPLATES = {
    "class": "Где определён класс %s?",
    "method": "Где определён метод %s?",
    "function": "Где определена функция %s?",
    "call": "Где вызывается %s?",
    "nbcall": "В каких ноутбуках используется %s?",
    "nbsec": "О чём раздел «%s» ноутбука %s?",
    "section": "Что написано в разделе «%s»?",
    "text": "Где в моих файлах написано «%s»?",
}
PHRASE_WORD = r"(?U)[\w.,%=-]+"
#: A text's first fourteen words, all that a phrase needs; the rest is not read.
PHRASE_START = r"(?U)^(?:[^\w.,%=-]*[\w.,%=-]+){1,14}"


def signals(rank: Column) -> tuple[Column, Column]:
    """(value, error) of a canary: 1 - 1/rank, or 1 if not found; an error beyond rank 5 (PRJ-17)."""
    lost = F.coalesce(rank, F.lit(0)) == 0
    return F.when(lost, 1.0).otherwise(1 - 1 / rank), (lost | (rank > 5)).cast("int")


TARGET = "struct<file_path:string,line_start:int,line_end:int,cell:int,section:string,node_id:string>"


def _target(**known: Column) -> Column:
    parts = [f.split(":") for f in TARGET[7:-1].split(",")]
    return F.struct(F.col("file_path").alias("file_path"), *(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in parts[1:]))


def build_canaries(symbols: DataFrame, calls: DataFrame, nodes: DataFrame, least: int = 4) -> DataFrame:
    """(id, segment, question, targets): questions whose answers the catalog knows; segments of fewer than `least` go (MON-01, AGG-20/21, JOIN-07).

    symbols (name, qualname, kind, file_path, line_start, line_end), calls (name, file_path, line,
    cell), nodes (node_id, file_path, node_type, text, cell, section, embed). Six kinds: public
    definitions in modules; calls of public names, by folder; the notebooks that use them; headed
    notebook sections, with the two cells after; sections of .pdf and .docx files, once for each
    title; and the fifth to fourteenth word of a .txt, .log or .md fragment of twelve words or more.
    """
    module, notebook = F.endswith("file_path", F.lit(".py")), F.endswith("file_path", F.lit(".ipynb"))
    public = symbols.filter(~F.startswith("name", F.lit("_")))
    put = lambda df, id_, segment, question, targets: df.select(id_.alias("id"), segment.alias("segment"), question.alias("question"), targets.alias("targets"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    package, c = first_folder(F.col("file_path")), F.col
    asked = F.when(c("kind") == "class", F.format_string(TEMPLATES["class"], "name")).when(c("kind") == "method", F.format_string(TEMPLATES["method"], "qualname")).otherwise(F.format_string(TEMPLATES["function"], "name"))
    lines = _target(line_start=c("line_start"), line_end=F.coalesce("line_end", "line_start"))
    defs = put(public.filter(module & c("line_start").isNotNull()), text("def:", c("file_path"), ":", c("qualname")), text("py:def:", package), asked, F.array(lines))
    used = calls.join(public.select("name").distinct(), "name", "left_semi")
    in_modules = used.filter(module & c("line").isNotNull()).withColumn("pkg", package).groupBy("name", "pkg").agg(F.array_sort(F.collect_list(_target(line_start=c("line"), line_end=c("line")))).alias("targets"))
    called = put(in_modules, text("call:", c("pkg"), ":", c("name")), text("py:call:", c("pkg")), F.format_string(TEMPLATES["call"], "name"), c("targets"))
    in_notebooks = used.filter(notebook & c("cell").isNotNull()).groupBy("name").agg(F.array_sort(F.collect_list(_target(cell=c("cell")))).alias("targets"))
    noted = put(in_notebooks, text("nbcall:", c("name")), F.lit("ipynb:call"), F.format_string(TEMPLATES["nbcall"], "name"), c("targets"))
    shown = nodes.filter("embed")
    heading = F.trim(F.regexp_replace(F.regexp_extract("text", r"(?m)^(#.*)$", 1), "^#+", ""))
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "")
    after = F.array(*(_target(cell=c("cell") + k) for k in range(3)))
    headed = shown.filter((c("node_type") == "markdown_cell") & (c("cell") > 0) & (F.length(heading) >= 4))
    sections = put(headed, text("nbsec:", c("node_id").cast("string")), F.lit("ipynb:section"), F.format_string(TEMPLATES["nbsec"], heading, stem), after)
    rest = shown.filter(~((c("node_type") == "markdown_cell") & (F.coalesce("cell", F.lit(0)) > 0)))
    title = F.element_at(F.split("section", " > "), -1)
    titled = rest.filter(F.col("file_path").rlike(r"\.(pdf|docx)$") & (F.coalesce("section", F.lit("")) != "")).select("file_path", title.alias("title")).filter(F.length("title") >= 4).distinct()
    documents = put(titled, text("sec:", c("file_path"), ":", c("title")), F.lit("doc"), F.format_string(TEMPLATES["section"], "title"), F.array(_target(section=c("title"))))
    words = F.regexp_extract_all(F.regexp_extract("text", PHRASE_START, 0), F.lit(PHRASE_WORD), F.lit(0))
    phrased = rest.filter(F.col("file_path").rlike(r"\.(txt|log|md)$")).withColumn("_w", words).filter(F.size("_w") >= 12)
    phrases = put(phrased, text("text:", c("node_id").cast("string")), F.lit("text"), F.format_string(TEMPLATES["text"], F.array_join(F.slice("_w", 5, 10), " ")), F.array(_target(node_id=c("node_id").cast("string"))))
    every = written(defs.unionByName(called).unionByName(noted).unionByName(sections).unionByName(documents).unionByName(phrases), "canaries")
    sizes = every.groupBy("segment").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return every.join(sizes, "segment", "left_semi").select("id", "segment", "question", "targets")


def benjamini_hochberg(p_values: DataFrame, by: list[str], p: str = "p", q: float = 0.05, tie: str = "series") -> DataFrame:
    """`discovered`: whether p is at or below the largest p_(k) <= k q / m of its window (MON-06)."""
    w = Window.partitionBy(*by)
    ranked = p_values.withColumn("_k", F.row_number().over(w.orderBy(p, tie))).withColumn("_m", F.count("*").over(w))
    ranked = ranked.withColumn("_last", F.max(F.when(F.col(p) <= F.col("_k") * q / F.col("_m"), F.col("_k")).otherwise(0)).over(w))
    return ranked.withColumn("discovered", (F.col("_k") <= F.col("_last")).cast("int")).drop("_k", "_m", "_last")


#: Steps of a series' reference and of a window; resamples of the reference (fixed values but for the last).
REFERENCE, WINDOW, RESAMPLES = 300, 100, 199


def calibrated(series: DataFrame, key: str, step: str, value: str, reference: int = REFERENCE, window: int = WINDOW, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """(key, window, mean, p) of each whole window after the reference, whose steps are numbered from 0 in the order of `step` (MON-06).

    The null distribution of a window's mean is that of `window` values drawn with replacement from the
    reference; each draw is a digest of seed, series, resample and number, so that it is the same wherever
    it is made. A p-value is the share of null means at or above the window's, itself counted: one running
    count over the union of both finds it. Nulls are no steps. A series with a shorter reference has no windows.
    """
    order = Window.partitionBy(key).orderBy(step)
    rows = series.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"), (F.row_number().over(order) - 1).alias("at"))
    after = rows.filter(F.col("at") >= reference).withColumn("window", F.floor((F.col("at") - reference) / window))
    means = after.groupBy(key, "window").agg(F.round(F.avg("x"), 9).alias("mean"), F.count("*").alias("n")).filter(F.col("n") == window).drop("n")
    base = rows.filter(F.col("at") < reference)
    whole = base.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == reference).select(key)
    pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(resamples)), lambda b: F.transform(F.sequence(F.lit(1), F.lit(window)), lambda j: F.struct(b.alias("b"), j.alias("j"))))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("d.b").cast("string"), F.col("d.j").cast("string")))
    drawn = whole.select(key, pairs.alias("d")).select(key, "d.b", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % reference).cast("int").alias("at"))
    null = drawn.join(base, [key, "at"]).groupBy(key, "b").agg(F.round(F.avg("x"), 9).alias("mean"))
    both = means.join(whole, key).select(key, "window", "mean").unionByName(null.select(key, F.lit(None).cast("long").alias("window"), "mean"))
    above = Window.partitionBy(key).orderBy(F.desc("mean")).rangeBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_null", F.count_if(F.col("window").isNull()).over(above))
    return counted.filter(F.col("window").isNotNull()).select(key, "window", "mean", ((F.col("_null") + 1) / F.lit(float(resamples + 1))).alias("p"))


#: Makes the weights of LORD++ sum to one over 10,000 tests (derived from their formula).
_LORD_SUM = sum(math.log(max(j, 2)) / (j * math.exp(math.sqrt(math.log(j)))) for j in range(1, 10_001))


def lord(p_values: Column, q: float = 0.05, start: float = 0.5) -> Column:
    """LORD++ over an array of p-values in their order: whether each is a discovery (MON-06).

    A fold holds the tests so far and where the discoveries were; a level is the starting wealth's share
    and that of each discovery, by the tests since then.
    """

    def share(since: Column) -> Column:
        j = since.cast("double")
        return F.log(F.greatest(j, F.lit(2.0))) / (j * F.exp(F.sqrt(F.log(j)))) / _LORD_SUM

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + 1
        first = F.coalesce(F.lit(q * (1 - start)) * share(at - F.get(acc["found"], F.lit(0))), F.lit(0.0))
        rest = F.aggregate(F.slice(acc["found"], 2, F.greatest(F.size(acc["found"]) - 1, F.lit(0))), F.lit(0.0), lambda s, t: s + share(at - t))
        hit = F.coalesce(p <= F.lit(q * start) * share(at) + first + F.lit(q) * rest, F.lit(False))
        return F.struct(at.alias("at"), F.when(hit, F.concat(acc["found"], F.array(at))).otherwise(acc["found"]).alias("found"), F.concat(acc["out"], F.array(hit)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"), F.array().cast("array<boolean>").alias("out"))
    return F.aggregate(p_values, begin, step, lambda acc: acc["out"])


def online_discoveries(p_values: DataFrame, key: str, order: str = "window", q: float = 0.05) -> DataFrame:
    """(key, order, p, discovered): LORD++ along each series of windows; a series is one row's array of p-values, one for WINDOW steps."""
    held = p_values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "p"))).alias("x"))
    flags = lord(F.transform("x", lambda v: v["p"]), q)
    out = held.select(key, F.explode(F.arrays_zip(F.col("x"), flags.alias("d"))).alias("z"))
    return out.select(key, F.col(f"z.x.{order}").alias(order), F.col("z.x.p").alias("p"), F.col("z.d").cast("int").alias("discovered"))


def alarm_metrics(alarms: DataFrame, changes: DataFrame, horizon: int) -> DataFrame:
    """False discovery share, missed share, mean delay, precision, recall, F1 (MON-07): alarms (series, step), changes (series, step)."""
    c = changes.select("series", F.col("step").alias("_at"))
    hits = alarms.join(c, "series", "left").withColumn("_true", F.coalesce(F.col("step").between(F.col("_at"), F.col("_at") + horizon), F.lit(False)))
    judged = hits.groupBy("series", "step").agg(F.max(F.col("_true").cast("int")).alias("good"))
    a = judged.agg(F.count("*").alias("n_alarms"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"))
    first = c.join(alarms, "series", "left").filter(F.col("step").isNull() | F.col("step").between(F.col("_at"), F.col("_at") + horizon)).groupBy("series", "_at").agg(F.min(F.col("step") - F.col("_at")).alias("delay"))
    d = c.join(first, ["series", "_at"], "left").agg(F.count("*").alias("n_changes"), F.count("delay").alias("n_found"), F.avg("delay").alias("delay"))
    out = a.crossJoin(d)
    precision, recall = F.col("n_good") / F.nullif("n_alarms", F.lit(0)), F.col("n_found") / F.nullif("n_changes", F.lit(0))
    return out.select("n_alarms", "n_changes", (1 - precision).alias("fdp"), (1 - recall).alias("mdr"), "delay", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).alias("f1"))


def miss_rates(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Share of canaries beyond rank 5 (AGG-26)."""
    return ranks.groupBy(*by).agg(F.avg(signals(F.col("rank"))[1].cast("double")).alias("miss_rate"), F.count("*").alias("n"))
