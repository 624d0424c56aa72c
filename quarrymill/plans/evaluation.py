"""Queries over labels: rates, confusion, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .registry import read, register


@register("label_precision_recall", """WITH t AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
round(2 * nullif((tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)), 0) / (tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0)), 6) AS f1 FROM t""")
def label_precision_recall(s, d):
    df = read(s, d, "labels").join(read(s, d, "documents").select("doc_id", "lang"), "doc_id")
    out = E.precision_recall(df, F.col("quality") == 1, F.col("toxic") == 0, ["lang"])
    return out.select("lang", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@register("confusion", "SELECT lang, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3")
def confusion(s, d):
    return read(s, d, "labels").join(read(s, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@register("metrics_by_class", """SELECT coalesce(lang, 'all') AS cls, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95
FROM labels JOIN documents USING (doc_id) GROUP BY CUBE (lang)""")
def metrics_by_class(s, d):
    df = read(s, d, "labels").join(read(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = df.cube("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.expr("percentile(cast(n_chars as double), 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(cast(n_chars as double), 0.95)"), 6).alias("p95"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("cls"), "n", "quality", "toxic", "p50", "p95")


@register("overthinking_share", """WITH p AS (SELECT doc_id, quality - toxic AS gain, n_chars AS extra FROM labels JOIN documents USING (doc_id)) SELECT CAST(sum(CASE WHEN gain <= 0 THEN extra ELSE 0 END) AS BIGINT) AS wasted, CAST(sum(extra) AS BIGINT) AS extra, round(sum(CASE WHEN gain <= 0 THEN extra ELSE 0 END)::DOUBLE / nullif(sum(extra), 0), 6) AS share FROM p""")
def overthinking_share(s, d):
    p = read(s, d, "labels").join(read(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") - F.col("toxic")).alias("gain"), F.col("n_chars").alias("extra"))
    wasted = F.sum(F.when(F.col("gain") <= 0, F.col("extra")).otherwise(0))
    return p.agg(wasted.alias("wasted"), F.sum("extra").alias("extra"), F.round(wasted / F.nullif(F.sum("extra"), F.lit(0)), 6).alias("share"))
