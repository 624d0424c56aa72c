"""Queries over the event table: percentiles, series, as-of joins, windows, detectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import catalog as C
from ..operators import code as A
from ..operators import evaluation as E
from ..operators import monitoring as M
from ..streaming import incremental as I
from .registry import read, register


@register("latency_percentiles", "SELECT event_type, count(value) AS n, round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(s, d):
    p = E.percentiles(read(s, d, "events"), "value", ["event_type"])
    return p.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@register("json_extract", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_extract(s, d):
    return read(s, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@register("metric_best_last", """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
SELECT user_id, max(value) AS best, arg_min(seq, {'a': -value, 'b': seq}) AS best_step, arg_max(value, seq) AS last, count(*) AS n FROM e GROUP BY 1""")
def metric_best_last(s, d):
    from ..operators.chunking import metric_summary

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = read(s, d, "events").select("user_id", "value", seq.cast("long").alias("seq")).withColumn("step", F.col("seq")).withColumn("metric", F.lit("accuracy"))
    return metric_summary(e, ["user_id", "metric"]).select("user_id", "best", "best_step", "last", "n")


@register("asof_last_event", """SELECT event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'click' AND p.ts < e.ts) AS last_click FROM events e WHERE event_type = 'purchase'""")
def asof_last_event(s, d):
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(ms).rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "click", F.col("ts"))).over(w)
    return read(s, d, "events").withColumn("last_click", last).filter("event_type = 'purchase'").select("event_id", "last_click")


@register("out_of_order", """SELECT user_id, max(CAST(coalesce(p > event_id, false) AS INT)) AS out_of_order FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1""")
def out_of_order(s, d):
    e = read(s, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id")
    return A.out_of_order(e, "user_id", "at", "event_id")


@register("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(s, d):
    return I.windowed_counts(read(s, d, "events"))


@register("sliding_counts", """SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2""")
def sliding_counts(s, d):
    return I.windowed_counts(read(s, d, "events"), size="1 hour", slide="30 minutes")


@register("sessionize", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def sessionize(s, d):
    return I.sessions(read(s, d, "events"))


@register("bh_window", """WITH p AS (SELECT CAST(ts AS DATE) AS day, user_id AS series, round(exp(-sum(value) / 50.0), 9) AS p FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY p, series) AS k, count(*) OVER (PARTITION BY day) AS m FROM p)
SELECT day, series, p, CAST(k <= max(CASE WHEN p <= k * 0.05::DOUBLE / m THEN k ELSE 0 END) OVER (PARTITION BY day) AS INT) AS discovered FROM r""")
def bh_window(s, d):
    p = read(s, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("user_id").alias("series")).agg(F.round(F.exp(-F.sum("value") / 50.0), 9).alias("p"))
    return M.benjamini_hochberg(p, ["day"])


#: Each test's few numbers, row after row.
SERIES = """e AS (SELECT event_type, event_id, %s AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)"""
PAGE_HINKLEY = """r AS (SELECT DISTINCT event_type, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0::BIGINT AS n, 0::DOUBLE AS mean, 0::DOUBLE AS cum, 0::DOUBLE AS low, false AS alarm FROM events
UNION ALL SELECT event_type, k, event_id, CASE WHEN a THEN 0 ELSE n END, CASE WHEN a THEN 0 ELSE m END, CASE WHEN a THEN 0 ELSE c END, CASE WHEN a THEN 0 ELSE l END, a FROM (SELECT *, n >= 30 AND c - l > 5.0 AS a FROM (SELECT *, least(low, c) AS l FROM (SELECT *, cum + (x - m - 0.005::DOUBLE) AS c
FROM (SELECT e.event_type, e.k, e.event_id, e.x, r.n + 1 AS n, r.cum, r.low, r.mean + (e.x - r.mean) / (r.n + 1) AS m FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1)))))"""
DRIFT = """r AS (SELECT DISTINCT event_type, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0::BIGINT AS n, 0::DOUBLE AS p, 'inf'::DOUBLE AS bp, 'inf'::DOUBLE AS bs, false AS alarm FROM events
UNION ALL SELECT event_type, k, event_id, CASE WHEN a THEN 0 ELSE n END, CASE WHEN a THEN 0 ELSE q END, CASE WHEN a THEN 'inf'::DOUBLE ELSE p1 END, CASE WHEN a THEN 'inf'::DOUBLE ELSE s1 END, a FROM (SELECT *, n >= 30 AND q + s > p1 + 3.0 * s1 AS a FROM (SELECT *, CASE WHEN n >= 30 AND q + s < bp + bs THEN q ELSE bp END AS p1, CASE WHEN n >= 30 AND q + s < bp + bs THEN s ELSE bs END AS s1
FROM (SELECT *, sqrt(q * (1 - q) / n) AS s FROM (SELECT e.event_type, e.k, e.event_id, r.n + 1 AS n, r.bp, r.bs, r.p + (e.x - r.p) / (r.n + 1) AS q FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1)))))"""
ALARMS = "SELECT event_type, event_id FROM r WHERE alarm"


@register("ph_detector", f"WITH RECURSIVE {SERIES % 'value / 100'}, {PAGE_HINKLEY} {ALARMS}")
def ph_detector(s, d):
    e = read(s, d, "events").select("event_type", "event_id", (F.col("value") / 100).alias("value"))
    return T.detect(e, "event_type", "event_id", "value")


@register("ddm_detector", f"WITH RECURSIVE {SERIES % '(value > 50)::INT::DOUBLE'}, {DRIFT} {ALARMS}")
def ddm_detector(s, d):
    e = read(s, d, "events").select("event_type", "event_id", (F.col("value") > 50).cast("int").alias("value"))
    return T.detect(e, "event_type", "event_id", "value", "drift_detection")


@register("table_functions", f"WITH RECURSIVE {SERIES % 'value / 100'}, {PAGE_HINKLEY} SELECT 'alarm' AS kind, event_type AS key, event_id AS at FROM r WHERE alarm UNION ALL SELECT 'window', source || doc_id, w * 3 FROM (SELECT source, doc_id, len(string_split(text, chr(10))) AS n, unnest(range(0, len(string_split(text, chr(10))))) AS w FROM documents WHERE text IS NOT NULL) WHERE w = 0 OR w * 3 + 1 < n")
def table_functions(s, d):
    """Table functions in a statement that passes the read-only tool's checks."""
    T.register(s)
    for t in ("events", "documents"):
        read(s, d, t).createOrReplaceTempView(t)
    sql = """SELECT 'alarm' AS kind, key, step AS at FROM page_hinkley(0.005D, 5D, 30, TABLE(SELECT event_type AS key, event_id AS step, value / 100 AS value FROM events) PARTITION BY key ORDER BY step)
    UNION ALL SELECT 'window', key, CAST(line_start AS BIGINT) FROM line_windows(4, 1, TABLE(SELECT concat(source, doc_id) AS key, text FROM documents))"""
    return s.sql(C.validate_sql(s, sql, {"events", "documents"}, 10_000_000))


@register("calibrated_windows", """WITH RECURSIVE e AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events WHERE value IS NOT NULL), b AS (SELECT * FROM e WHERE pos < 300),
h AS (SELECT event_type FROM b GROUP BY 1 HAVING count(*) = 300), m AS (SELECT event_type, ((pos - 300) // 100)::BIGINT AS win, round(avg(x), 9) AS mean FROM e WHERE pos >= 300 GROUP BY 1, 2 HAVING count(*) = 100),
n AS (SELECT event_type, i, round(avg(x), 9) AS mean FROM (SELECT event_type, i, ('0x' || left(md5('0:' || event_type || ':' || i || ':' || j), 8))::BIGINT % 300 AS pos FROM h, (SELECT unnest(range(1, 200)) AS i), (SELECT unnest(range(1, 101)) AS j)) JOIN b USING (event_type, pos) GROUP BY 1, 2),
p AS (SELECT event_type, win, m.mean, ((SELECT count(*) FROM n WHERE n.event_type = m.event_type AND n.mean >= m.mean) + 1) / 200.0::DOUBLE AS p, row_number() OVER (PARTITION BY event_type ORDER BY win) AS k FROM m JOIN h USING (event_type)),
g AS (SELECT j, ln(greatest(j, 2)) / (j * exp(sqrt(ln(j)))) AS w FROM (SELECT unnest(range(1, 10001)) AS j)), z AS (SELECT j, w / (SELECT sum(w) FROM g) AS w FROM g WHERE j < 500),
r AS (SELECT event_type, 0::BIGINT AS k, []::BIGINT[] AS found, false AS hit FROM h
UNION ALL SELECT p.event_type, p.k, CASE WHEN p.p <= l THEN list_append(found, p.k) ELSE found END, p.p <= l FROM (SELECT r.*, p.p, p.k AS pk, 0.025::DOUBLE * (SELECT w FROM z WHERE j = p.k) + coalesce(0.025::DOUBLE * (SELECT w FROM z WHERE j = p.k - found[1]), 0) + 0.05::DOUBLE * coalesce((SELECT sum(w) FROM z WHERE list_contains(list_transform(found[2:], lambda t: p.k - t), j)), 0) AS l
  FROM r JOIN p ON p.event_type = r.event_type AND p.k = r.k + 1) q JOIN p ON p.event_type = q.event_type AND p.k = q.pk)
SELECT p.event_type, win AS "window", mean, p, hit::INT AS discovered FROM p JOIN r USING (event_type, k)""")
def calibrated_windows(s, d):
    e = read(s, d, "events").select("event_type", "event_id", "value")
    p = M.calibrated(e, "event_type", "event_id", "value")
    return p.join(M.online_discoveries(p, "event_type").select("event_type", "window", "discovered"), ["event_type", "window"])


@register("canary_signals", """WITH r AS (SELECT event_id, event_id % 8 AS rank FROM events) SELECT event_id, CASE WHEN rank = 0 THEN 1.0::DOUBLE ELSE round(1 - 1.0::DOUBLE / rank, 6) END AS value, CASE WHEN rank = 0 OR rank > 5 THEN 1 ELSE 0 END AS error FROM r""")
def canary_signals(s, d):
    value, error = M.signals(F.col("rank"))
    return read(s, d, "events").select("event_id", (F.col("event_id") % 8).alias("rank")).select("event_id", F.round(value, 6).alias("value"), error.alias("error"))


@register("miss_rates", """SELECT event_type, round(avg(CASE WHEN event_id % 8 = 0 OR event_id % 8 > 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS miss_rate, count(*) AS n FROM events GROUP BY 1""")
def miss_rates(s, d):
    r = read(s, d, "events").select("event_type", (F.col("event_id") % 8).alias("rank"))
    return M.miss_rates(r, ["event_type"]).withColumn("miss_rate", F.round("miss_rate", 6))
