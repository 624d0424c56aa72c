import datetime as dt

from pyspark.sql import functions as F

from quarrymill.operators import web as W


def test_results_and_pages(spark):
    r = spark.createDataFrame([("q", "https://a.org/x", 2), ("q", "https://a.org/x", 1), ("q", "https://spam.net/", 1), ("q", "https://b.com/", 3)], "query_id string, url string, rank int")
    assert [(x.url, x.priority) for x in W.merged_results(r, ["b.com"], ["spam"]).orderBy("rank").collect()] == [("https://b.com/", 1), ("https://a.org/x", 0), ("https://spam.net/", -1)]
    now = dt.datetime(2025, 1, 2, 12)
    cache = spark.createDataFrame([("u", now - dt.timedelta(hours=30), "<p>old</p>"), ("u", now - dt.timedelta(hours=2), "<p>new text</p><script>x</script>"), ("v", now - dt.timedelta(hours=40), "<p>gone</p>")], "url string, fetched_at timestamp, html string")
    assert [tuple(x) for x in W.fresh_pages(cache, F.lit(now)).collect()] == [("u", "new text")]
    up = spark.createDataFrame([("1", "h1", now, now + dt.timedelta(hours=1)), ("2", "h2", now, now - dt.timedelta(hours=1))], "upload_id string, content_hash string, created_at timestamp, expires_at timestamp")
    assert [x.upload_id for x in W.live_uploads(up, F.lit(now)).collect()] == ["1"]
    assert {x.upload_id: x.known_path for x in W.known_uploads(up, spark.createDataFrame([("b", "h1"), ("a", "h1")], "path string, content_hash string")).collect()} == {"1": "a", "2": None}
    t = W.upload_totals(spark.createDataFrame([("1", "x" * 90), ("1", "y" * 9)], "upload_id string, text string"), 100).first()
    assert (t.n_chars, t.n_tokens, t.fits) == (99, 33, True)


def test_scenario(spark):
    ranks = spark.createDataFrame([("s", "normal", "a", 1), ("s", "normal", "b", 1), ("s", "changed", "a", 0), ("s", "changed", "b", 0)], "segment string, state string, canary_id string, rank int")
    rows = W.series_scenario(ranks, 20, 12).orderBy("step").collect()
    assert [r.step for r in rows] == list(range(20)) and [r.value for r in rows] == [0.0] * 12 + [1.0] * 8


def test_table_chunks(spark):
    text = "My table\n\nname;n\na;1\nb;2\n\nc;3"
    rows = W.table_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), ";", 20).orderBy("chunk").collect()
    assert [(r.line_start, r.line_end) for r in rows] == [(4, 5), (7, 7)] and rows[0].body == "| name | n |\n| a | 1 |\n| b | 2 |"
