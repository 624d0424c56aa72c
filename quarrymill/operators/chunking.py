"""Chunking and segmentation of texts into ordered fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let


def line_windows(n: Column, size: int, overlap: int) -> Column:
    """Array of half-open windows (start, end) over n lines; it stops at the first that reaches the end (CHK-01)."""
    step = max(size - overlap, 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    kept = F.filter(starts, lambda s: (s == 0) | (s + overlap < n) if step == size - overlap else (s == 0) | (s - step + size < n))
    return F.transform(kept, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line_no from 1, line)."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("line_no"), "line")


def paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, para, line_start, line_end, size): runs of lines that are not blank (CHK-08).

    A paragraph is found inside its row's array, so that no text is shuffled: the lines are
    folded into runs once.
    """
    runs = paragraph_spans(F.split(F.col(text), "\n", -1))
    return docs.select(key, F.posexplode(runs).alias("_p", "r")).select(key, (F.col("_p") + 1).alias("para"), "r.line_start", "r.line_end", "r.size")


_RUNS = "array<struct<line_start:int,line_end:int,size:int>>"


def paragraph_spans(parts: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("open"), F.lit(0).alias("from"), F.lit(0).alias("size"), F.array().cast(_RUNS).alias("runs"))
    done = lambda acc: F.concat(acc["runs"], F.array(F.struct(acc["from"].alias("line_start"), acc["at"].alias("line_end"), acc["size"].alias("size"))))

    def step(acc: Column, line: Column) -> Column:
        blank = F.trim(line) == ""
        at = acc["at"] + 1
        return F.struct(
            at.alias("at"),
            (~blank).alias("open"),
            F.when(blank | acc["open"], acc["from"]).otherwise(at).alias("from"),
            F.when(blank, 0).otherwise(F.when(acc["open"], acc["size"]).otherwise(0) + F.length(line)).alias("size"),
            F.when(blank & acc["open"], done(acc)).otherwise(acc["runs"]).alias("runs"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"], done(acc)).otherwise(acc["runs"]))


def greedy_pack(sizes: Column, limit: int | Column) -> Column:
    """Group number of each size: items are taken in order while their sum fits; a larger one stands alone (CHK-02, CHK-09)."""
    start = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        s = F.coalesce(s.cast("long"), F.lit(0).cast("long"))
        fresh = (F.size(acc["out"]) > 0) & (acc["sum"] + s > limit)
        group = F.when(fresh, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(group.alias("group"), F.when(fresh, s).otherwise(acc["sum"] + s).alias("sum"), F.concat(acc["out"], F.array(group)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def heading_paths(items: DataFrame, key: str, ord_: str, level: str, title: str, max_level: int = 6) -> DataFrame:
    """`section`: titles of the headings open at each item, joined by " > " (CHK-06, WIN-04).

    A heading of level L closes those of level L and deeper. For each level the last heading is
    carried forward, with its place, and counts only if no shallower one came after it.
    """
    w = Window.partitionBy(key).orderBy(ord_).rowsBetween(Window.unboundedPreceding, 0)
    out = items
    for n in range(1, max_level + 1):
        here = F.when(F.col(level) == n, F.struct(F.col(ord_).alias("at"), F.col(title).alias("title")))
        out = out.withColumn(f"_h{n}", F.last(here, ignorenulls=True).over(w))
    parts = []
    for n in range(1, max_level + 1):
        above = [F.coalesce(F.col(f"_h{m}.at"), F.lit(-1)) for m in range(1, n)]
        newest = F.greatest(*above) if len(above) > 1 else (above[0] if above else F.lit(-1))
        parts.append(F.when(F.col(f"_h{n}.at") > newest, F.col(f"_h{n}.title")))
    return out.withColumn("section", F.concat_ws(" > ", *parts)).drop(*(f"_h{n}" for n in range(1, max_level + 1)))


#: Lines of logs, markdown and code, metric pairs, and the kinds of metric whose best value is the smallest (fixed values).
STEP = r"(?i)\b(epoch|step|iter(?:ation)?)\b\s*[=:#]?\s*(\d+)"
METRIC = r"\b([A-Za-z][\w/.\-]*)\s*[=:]\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
TIME_LINE = r"^\s*\[?(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}|\d{2}:\d{2}:\d{2})"
MARK_LINE = r"^\s{0,3}(#{1,6}\s|[-*+]\s|\d+\.\s|```|\|.*\|)"
HEADING_LINE = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
CODE_LINE = r"^\s*(def |class |import |from \S+ import |return\b|if __name__|@\w+|for .+ in .+:)"
LOWER_IS_BETTER = ("loss", "error", "err", "rmse", "mae", "mse", "perplexity", "ppl")


def _modal_share(some: Column, mark: str) -> Column:
    """Share of the lines that have the most frequent positive count of a delimiter."""
    counts = F.filter(F.transform(some, lambda s: F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))), lambda c: c > 0)
    most = let(counts, lambda cs: F.array_max(F.transform(F.array_distinct(cs), lambda c: F.size(cs) - F.size(F.array_remove(cs, c)))))
    return F.coalesce(most / F.size(some), F.lit(0.0))


def classify(text: Column) -> Column:
    """log, table, markdown, code or prose, from the first 500 lines that are not blank (CHK-11)."""
    return let(F.slice(F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"\S")), 1, 500), _kind)


def _kind(some: Column) -> Column:
    n = F.size(some)
    share = lambda test: F.size(F.filter(some, test)) / n
    tables = [_modal_share(F.slice(some, 1, 200), mark) for mark in ("\t", ";", "|", ",")]
    return (
        F.when(n == 0, "prose")
        .when(share(lambda s: s.rlike(TIME_LINE) | (s.rlike(STEP) & s.rlike(METRIC))) >= 0.3, "log")
        .when((n >= 3) & (F.greatest(*tables) >= 0.8), "table")
        .when(F.exists(some, lambda s: s.rlike(HEADING_LINE)) | (share(lambda s: s.rlike(MARK_LINE)) >= 0.2), "markdown")
        .when(share(lambda s: s.rlike(CODE_LINE)) >= 0.25, "code")
        .otherwise("prose")
    )


def character_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows (start, end) of characters that end at white space where there is some in the second half (CHK-13)."""
    n = F.length(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, F.lit(size))
        last_space = F.length(F.regexp_extract(piece, r"(?s)^(.*\s)\S*$", 1))
        end = F.when(acc["at"] + size >= n, n).otherwise(acc["at"] + F.when(last_space > size // 2, last_space).otherwise(size))
        after = F.when(end >= n, n).otherwise(F.greatest(end - overlap, acc["at"] + 1))
        more = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))
        return F.when(acc["at"] < n, F.struct(after.alias("at"), more.alias("out"))).otherwise(acc)

    rounds = F.ceil(n / F.lit(max(1, size // 2 - overlap))).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), start, step, lambda acc: acc["out"])


def text_tiles(text: str, block: int = 6) -> list[tuple[int, int]]:
    """Topic segments as sentence ranges: cuts at local minima of block similarity below mean - std / 2, at least `block` apart (CHK-10)."""
    import re
    from collections import Counter

    import numpy as np

    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
    bags = [Counter(re.findall(r"\w+", s.lower())) for s in sentences]
    gaps = range(1, len(bags))
    scores = []
    for g in gaps:
        a, b = sum(bags[max(0, g - block) : g], Counter()), sum(bags[g : g + block], Counter())
        d = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        scores.append(sum(v * b[k] for k, v in a.items()) / d if d else 0.0)
    cuts: list[int] = []
    if scores:
        low = float(np.mean(scores) - np.std(scores) / 2)
        for i, g in enumerate(gaps):
            left, right = scores[i - 1] if i else 2.0, scores[i + 1] if i + 1 < len(scores) else 2.0
            if scores[i] < low and scores[i] <= left and scores[i] <= right and g - (cuts[-1] if cuts else 0) >= block:
                cuts.append(g)
    edges = [0, *cuts, len(sentences)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def log_metrics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, metric, step, value, seq): name=value pairs of lines, with the step of their line if it has one; series of two points or more (AGG-05).

    The pair that gives the step is not a metric of its line.
    """
    row = lines(docs, text, key)
    unit, step = F.lower(F.regexp_extract("line", STEP, 1)), F.regexp_extract("line", STEP, 2).try_cast("double")
    of = lambda i: F.regexp_extract_all("line", F.lit("(?U)" + METRIC), F.lit(i))
    pairs = row.filter(F.col("line").rlike("(?U)" + METRIC)).select(key, "line_no", unit.alias("unit"), step.alias("step"), F.posexplode(F.arrays_zip(of(1).alias("n"), of(2).alias("v"))).alias("at", "p"))
    points = pairs.filter(F.lower("p.n") != F.col("unit")).select(key, F.col("p.n").alias("metric"), "line_no", "at", "step", F.col("p.v").cast("double").alias("value"))
    each = Window.partitionBy(key, "metric")
    points = points.withColumn("seq", F.row_number().over(each.orderBy("line_no", "at"))).withColumn("_n", F.count("*").over(each))
    return points.filter("_n >= 2").select(key, "metric", "step", "value", "seq")


def metric_summary(series: DataFrame, by: list[str], name: str = "metric") -> DataFrame:
    """Best value (smallest for losses and errors, else largest; the first of equals), its step, the last value and step (AGG-06, WIN-10)."""
    lower = F.lower(name).rlike("|".join(LOWER_IS_BETTER))
    out = series.groupBy(*by).agg(
        F.min(F.struct("value", "seq", "step")).alias("_low"),
        F.max(F.struct(F.col("value"), (-F.col("seq")).alias("_neg"), F.col("step"))).alias("_high"),
        F.max(F.struct("seq", "value", "step")).alias("_last"),
        F.count("*").alias("n"),
    )
    best = lambda c: F.when(lower, F.col(f"_low.{c}")).otherwise(F.col(f"_high.{c}"))
    return out.select(*by, F.when(lower, "min").otherwise("max").alias("direction"), best("value").alias("best"), best("step").alias("best_step"), F.col("_last.value").alias("last"), F.col("_last.step").alias("last_step"), "n")
