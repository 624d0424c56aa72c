"""Golden values and small fixtures for the engine's own operators."""

import functools
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrymill.functions import scalars as S
from quarrymill.functions import tables as T
from quarrymill.operators import catalog as C
from quarrymill.operators import chunking as K
from quarrymill.operators import code as A
from quarrymill.operators import evaluation as E
from quarrymill.operators import grounding as G
from quarrymill.operators import monitoring as M
from quarrymill.operators import ranking as R


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n,size,overlap,want", [(0, 5, 1, []), (3, 5, 1, [(0, 3)]), (10, 4, 1, [(0, 4), (3, 7), (6, 10)])])
def test_line_windows(spark, n, size, overlap, want):
    assert [tuple(w) for w in value(spark, K.line_windows(F.lit(n), size, overlap))] == want


def test_greedy_pack(spark):
    got = value(spark, K.greedy_pack(F.array(*map(F.lit, [3, 3, 3, 9, 1])), 6))
    assert got == [0, 0, 1, 2, 3]


def test_keep_tail(spark):
    got = value(spark, S.keep_tail(F.lit("x" * 1000 + "FINAL roc_auc=0.99"), 200))
    assert len(got) <= 200 and got.endswith("FINAL roc_auc=0.99") and "[...]" in got


def test_classify(spark):
    texts = {"log": "2025-01-01 00:00:01 start\n2025-01-01 00:00:02 end", "table": "a;b\n1;2\n3;4", "markdown": "# Plan\ntext", "code": "import os\ndef f(x):\n    return x", "prose": "A quiet sentence. Another one."}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "want string, t string")
    assert all(r.want == r.got for r in df.select("want", K.classify(F.col("t")).alias("got")).collect())


def test_heading_paths(spark):
    df = spark.createDataFrame([("n", 1, 1, "Title"), ("n", 2, 2, "Data"), ("n", 3, 3, "Cleaning"), ("n", 4, 0, None), ("n", 5, 2, "Model"), ("n", 6, 0, None)], "k string, ord int, level int, title string")
    got = {r.ord: r.section for r in K.heading_paths(df, "k", "ord", "level", "title").collect()}
    assert got[4] == "Title > Data > Cleaning" and got[6] == "Title > Model"


def test_character_windows_cover(spark):
    text = "word " * 50
    got = [tuple(w) for w in value(spark, K.character_windows(F.lit(text), 60, 10))]
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] >= b[0] for a, b in zip(got, got[1:]))


def test_text_tiles():
    cats, stocks = "The cat sat with the cat. " * 6, "The stock price fell with stocks. " * 6
    assert K.text_tiles(cats + stocks, 2)[0] == (0, 6)


def test_metric_summary(spark):
    log = "\n".join(f"2025-01-01 00:00:0{e} epoch={e} train_loss={1 / (e + 1):.3f} val_acc={a}" for e, a in zip(range(1, 6), (0.5, 0.6, 0.8, 0.7, 0.8)))
    s = K.metric_summary(K.log_metrics(spark.createDataFrame([(1, log)], "doc_id long, text string")), ["doc_id", "metric"])
    got = {r.metric: r for r in s.collect()}
    assert (got["val_acc"].best, got["val_acc"].best_step) == (0.8, 3) and (got["train_loss"].best, got["train_loss"].best_step) == (0.167, 5)


def test_rrf(spark):
    lists = [[("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], [("q", "c", 1), ("q", "d", 2)]]
    got = R.rrf([spark.createDataFrame(x, "query_id string, node_id string, rank int") for x in lists]).orderBy("rank").collect()
    assert got[0].node_id == "c" and {r.node_id for r in got} == set("abcd")


def test_dense_topk_blocks(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)], "node_id long, vector array<double>")
    q = v.select(F.col("node_id").alias("query_id"), "vector")
    one = R.dense_topk(q, v, 3).collect()
    old, R.BLOCK = R.BLOCK, 7
    try:
        assert sorted(map(tuple, R.dense_topk(q, v, 3).collect())) == sorted(map(tuple, one))
    finally:
        R.BLOCK = old


def test_name_candidates(spark):
    symbols = spark.createDataFrame([("compute_f1", "pkg/metrics.py", 3, 9)], "name_lc string, file_path string, line_start int, line_end int")
    calls = spark.createDataFrame([("compute_f1", "pkg/use.py", 3)], "name_lc string, file_path string, line int")
    nodes = spark.createDataFrame([("n1", "pkg/metrics.py", 1, 60, 0), ("n2", "pkg/use.py", 1, 10, 0), ("n3", "pkg/use.py", 11, 20, 1)], "node_id string, file_path string, line_start int, line_end int, ord int")
    q = spark.createDataFrame([("q", "where is COMPUTE_F1 defined?")], "query_id string, text string")
    assert [r.node_id for r in R.name_candidates(q, symbols, calls, nodes).orderBy("rank").collect()] == ["n1", "n2"]


def test_within_budget(spark):
    df = spark.createDataFrame([("q", 1, 10), ("q", 2, 10), ("q", 3, 10)], "query_id string, rank int, size int")
    n = lambda budget: R.within_budget(df, "size", budget, ["query_id"]).count()
    assert (n(21), n(1)) == (2, 1)


def test_retrieval_metrics(spark):
    refs = spark.createDataFrame([("q", "r1", 2), ("q", "r2", 4)], "query_id string, ref_id string, first_rank int")
    m = E.retrieval_metrics(refs).first()
    assert (m.recall_1, m.recall_3, m.recall_5, m.mrr) == (0.0, 0.5, 1.0, 0.5) and 0 < m.ndcg_10 < 1
    perfect = spark.createDataFrame([("q", "r1", 1), ("q", "r2", 2)], "query_id string, ref_id string, first_rank int")
    assert E.retrieval_metrics(perfect).first().ndcg_10 == 1


def test_precision_recall(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, e boolean")
    r = E.precision_recall(df, F.col("p"), F.col("e")).first()
    assert (r.precision, r.recall) == (0.5, 0.5)


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", i, float(i % 2)) for i in range(200)] + [("b", 999, 1.0), ("c", 7, None)], "g string, id int, v double")
    got = {r.g: r for r in E.bootstrap(df, "v", ["g"], "id").collect()}
    assert (got["a"].n, got["a"].mean) == (200, 0.5) and got["b"].low is None and got["c"].n == 0
    error = 1.96 * 0.5 / 200**0.5  # the normal interval of the mean
    assert abs(got["a"].low - 0.5 + error) < 0.02 and abs(got["a"].high - 0.5 - error) < 0.02
    most = E.resampled(df.filter("g = 'a'"), "v", ["g"], "id", 20, 0, lambda v, w: F.max(F.when(w > 0, v))).collect()
    assert len(most) == 20 and {r.m for r in most} == {1.0}
    better = df.filter("g = 'a'").withColumn("v", F.col("v") + 0.1)
    r = E.paired_bootstrap(df.filter("g = 'a'"), better, "id", "v").first()
    assert r.n == 200 and abs(r["diff"] - 0.1) < 1e-9 and abs(r.low - 0.1) < 1e-6 and r.p == 0.0
    assert E.paired_bootstrap(df.limit(0), better, "id", "v").count() == 0


@pytest.mark.parametrize("most", [R.BROADCAST_BYTES, 0])
def test_dense_topk_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(R, "BROADCAST_BYTES", most)
    rng = random.Random(3)
    rows = [(f"n{i % 70:02d}", [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(3)]) for i in range(90)] + [("z", [0.0] * 3), ("two", [1.0, 0.0]), ("null", None), ("hole", [None, 1.0, 0.0]), (None, [1.0] * 3)]
    df = spark.createDataFrame(rows, "node_id string, vector array<double>")
    asked = [(i, v) for i, v in rows if i is not None and v is not None and None not in v][::4]

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) + 0.0 if n else 0.0

    want = set()
    for q in {i for i, _ in asked}:
        found = sorted((-cos(v, w), j) for i, v in asked if i == q for j, w in rows if j is not None and w is not None and None not in w and len(w) == len(v) and j != q)
        want |= {(q, j, -s + 0.0, r) for r, (s, j) in enumerate(found[:5], 1)}
    got = R.dense_topk(spark.createDataFrame(asked, "query_id string, vector array<double>"), df, 5).collect()
    assert {(r.query_id, r.node_id, r.score + 0.0, r["rank"]) for r in got} == want


def test_token_weights_and_zero_vectors(spark):
    tokens = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.9), (1, "</s>", 3.0), (2, "a", 0.1)], "node_id int, term string, weight double")
    assert {tuple(r) for r in R.token_weights(tokens, ["</s>"]).collect()} == {(1, "a", 0.9), (2, "a", 0.1)}
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0])], "node_id int, vector array<double>")
    top = R.dense_topk(rows.withColumnRenamed("node_id", "query_id"), rows, 1).collect()
    assert {(r.query_id, r.node_id, r.score) for r in top} == {(1, 2, 0.0), (2, 3, 1.0), (3, 2, 1.0), (4, 1, 0.0)}


def test_execution_matches(spark):
    def told(gold, predicted, **k):
        cell = lambda v: F.lit(None).cast("string") if v is None else E.text_cell(F.lit(v)) if isinstance(v, str) else E.number_cell(F.lit(v))
        one = spark.range(1)
        side = lambda rows: [one.select(F.lit(1).alias("query_id"), F.lit(i).alias("row"), F.array(*map(cell, r)).alias("cells")) for i, r in enumerate(rows)]
        empty = one.select(F.lit(1).alias("query_id"), F.lit(0).alias("row"), F.array().cast("array<string>").alias("cells")).limit(0)
        frames = [functools.reduce(lambda a, b: a.unionByName(b), side(rows), empty) for rows in (gold, predicted)]
        return [r.matches for r in E.execution_matches(*frames, **k).collect()]

    assert told([("A ", 0.5)], [(0.50001, "a", 3)]) == [True] and told([("a",), ("a",)], [("a",), ("b",)]) == [False]
    assert told([("a",)], [("a",), ("b",)]) == told([("a",)], []) == [False] and told([], []) == []
    assert told([(1, 1)], [(1, 2)]) == [False] and told([(1, 1), (1,)], [(1, "x"), (1, 1, "y")]) == [True]
    assert told([("title", 0.5)], [("path", 0.5)]) == [False] and told([("title", 0.5)], [("path", 0.5)], values_only=True) == [True]
    assert told([("x",)], [("y",)], values_only=True) == [False]


def test_def_use():
    a = A.analyze("import pandas as pd\ndf = df.dropna()\nrows = [x for x in df]\nprint(rows)")
    assert a["uses"] == ["df"] and "pd" in a["defines"]
    b = A.analyze("class T:\n    def fit(self, x: int = 1) -> int:\n        '''Doc.'''\n        return f(x).g()\n")
    assert [(s[1], s[2]) for s in b["symbols"]] == [("T", "class"), ("T.fit", "method")] and {c[0] for c in b["calls"]} == {"f", "g"}
    assert A.analyze("def (")["error"]


def test_uses_var_edges(spark):
    cells = spark.createDataFrame([("f", 2, ["pd", "df"], []), ("f", 4, ["df"], ["pd"]), ("f", 6, [], ["df", "score"]), ("f", 1, ["score"], [])], "file_path string, cell int, defines array<string>, uses array<string>")
    assert {(r.src, r.dst, r.label) for r in A.uses_var_edges(cells).collect()} == {(2, 4, "pd"), (4, 6, "df"), (1, 6, "score")}


@pytest.mark.parametrize("text,v,want", [("auc 0.97777", 0.9778, True), ("97.78 %", 0.9778, True), ("lr=3e-3", 0.003, True), ("0.9925", 0.99, False), ("0.05", 0.5, False), ("x", float("nan"), False), ("97.78", 0.9778, True), ("0.9778", 0.97777123, False), ("0,9778", 0.9778, True)])
def test_value_in(spark, text, v, want):
    assert value(spark, G.value_in(F.lit(text), F.lit(v))) is want


def test_normalize_metric(spark):
    df = spark.createDataFrame([("ROC-AUC", "validation"), ("val_acc", ""), ("F1 macro", "Test")], "n string, s string")
    name, split = G.normalize_metric(F.col("n"), F.col("s"))
    assert [tuple(r) for r in df.select(name, split).collect()] == [("roc_auc", "val"), ("accuracy", "val"), ("f1", "test")]


def test_ground(spark):
    items = spark.createDataFrame([(1, "f", 4, 0.9925), (2, "f", 9, 0.05), (3, "f", 2, 7.5)], "item_id int, file_path string, cell int, value double")
    cells = spark.createDataFrame([("f", 2, "lr = 0.05"), ("f", 4, "roc_auc 0.9925")], "file_path string, cell int, text string")
    assert {(r.item_id, r.cell) for r in G.ground(items, cells).collect()} == {(1, 4), (2, 2)}


def test_exact_keys(spark):
    asked = {"что было 14 марта 2025": ["2025-03-14", "14.03.2025"], "run-414 и ResNet-18": ["run-414", "ResNet-18"], "2 июня": ["-06-02"], "в 2025 году": [], "5 мая 2024, 2024-05-05, exp_07": ["2024-05-05", "05.05.2024", "exp_07"]}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", G.exact_keys(F.col("q")).alias("k")).collect()
    assert {r.q: r.k for r in rows} == asked


def test_definitions_and_uses():
    use = lambda s: A.analyze(s)["uses"]
    assert use("def f():\n    return df.mean()\nclass C(Base):\n    x = other\ng = lambda: later") == ["Base"]
    assert use("rows = [x + k for x in df]\nrows += extra\nfrom . import m") == ["df", "extra", "k"] and use("n = 1\nn += 1") == []


def test_dialect():
    assert C.translate_dialect("SELECT 'I like it', max(a, b), MAX(a) FROM t WHERE x not like '%max(1, 2)%' -- like") == "SELECT 'I like it', greatest(a, b), MAX(a) FROM t WHERE x not ILIKE '%max(1, 2)%' -- like"
    assert C.translate_dialect("min(f(a, b)) , min ((a), b)") == "min(f(a, b)) , least ((a), b)"


def test_hash_embedding_keeps_texts_without_words(spark):
    rows = R.hash_embedding(spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "node_id int, text string"), 8).collect()
    assert {r.node_id: sum(r.vector) > 0 for r in rows} == {1: True, 2: False, 3: False}


def _lord(ps, q=0.05, w0=0.025):
    """LORD++ from its definition, test after test."""
    raw = [math.log(max(j, 2)) / (j * math.exp(math.sqrt(math.log(j)))) for j in range(1, 10_001)]
    gamma, found, out = [g / sum(raw) for g in raw], [], []
    for t, p in enumerate(ps, 1):
        level = gamma[t - 1] * w0 + sum((q - w0 if k == 0 else q) * gamma[t - f - 1] for k, f in enumerate(found))
        out.append(p <= level)
        found += [t] * out[-1]
    return out


def test_detectors(spark):
    rows = [("quiet", i, 0.1) for i in range(200)] + [("loud", i, 0.1 if i < 200 else 0.9) for i in range(400)] + [("null", 1, None)]
    series = spark.createDataFrame(rows, "s string, t int, v double")
    alarms = T.detect(series, "s", "t", "v").collect()
    assert {r.s for r in alarms} == {"loud"} and min(r.t for r in alarms) > 200
    errors = spark.createDataFrame([("e", i, x) for i, x in enumerate(([0] * 9 + [1]) * 30 + [1] * 60)] + [("f", i, int(i % 5 == 4)) for i in range(200)], "s string, t int, v int")
    assert {r.s for r in T.detect(errors, "s", "t", "v", "drift_detection").collect()} == {"e"}
    T.register(spark)
    series.createOrReplaceTempView("drift_series")
    sql = "SELECT key, step FROM page_hinkley(0.005D, 5D, 30, TABLE(SELECT s AS key, t AS step, v AS value FROM drift_series) PARTITION BY key ORDER BY step)"
    assert {tuple(r) for r in spark.sql(C.validate_sql(spark, sql, {"drift_series"}, 1000)).collect()} == {(r.s, r.t) for r in alarms}
    for bad in (sql.replace("drift_series", "other"), "SELECT * FROM range(5)"):
        with pytest.raises(C.SQLRejected):
            C.validate_sql(spark, bad, {"drift_series"})


def test_online_discoveries(spark):
    rng = random.Random(8)
    ps = [1e-6] + [rng.random() ** 4 for _ in range(60)]
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(ps)], "s string, window int, p double")
    got = [bool(r.discovered) for r in M.online_discoveries(df, "s").orderBy("window").collect()]
    assert got == _lord(ps) and 1 < sum(got) < len(ps)
    assert [bool(r.discovered) for r in M.online_discoveries(df.filter("window = 3"), "s").collect()] == _lord(ps[3:4])


def test_calibrated_windows(spark):
    rows = [(s, i, (0.2 if s == "flat" or i < 40 else 0.8) + 0.01 * (i % 7)) for s in ("flat", "up") for i in range(65)] + [("short", i, 0.1) for i in range(20)]
    series = spark.createDataFrame(rows, "s string, t int, v double")
    got = {(r.s, r.window): r.p for r in M.calibrated(series, "s", "t", "v", 30, 10, 49).collect()}
    assert set(got) == {(s, w) for s in ("flat", "up") for w in range(3)} and got["up", 1] == got["up", 2] == 1 / 50 and got["flat", 1] > 0.1


def test_corrective_search(spark):
    questions = spark.createDataFrame([(1, "good"), (2, "BAD"), (3, "worse"), (4, "none")], "query_id int, text string")
    index = {"good": [("a", 1), ("b", 2)], "BAD": [("c", 1)], "bad": [("a", 1)], "worse": [("d", 1)]}
    table = spark.createDataFrame([(t, n, k) for t, xs in index.items() for n, k in xs], "text string, node_id string, rank int")
    scores = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.6), (2, "c", 0.01), (2, "a", 0.3), (3, "d", 0.005)], "query_id int, node_id string, relevance double")
    search = lambda q: q.join(table, "text").select("query_id", "node_id", "rank")
    out = R.corrective_search(questions, search, lambda pairs: pairs.join(scores, ["query_id", "node_id"]), F.lower).collect()
    assert {(r.query_id, r.node_id, r.round, r.best, r.verdict) for r in out} == {(1, "a", 1, 0.6, "correct"), (1, "b", 1, 0.6, "correct"), (2, "a", 2, 0.3, "ambiguous"), (3, None, 1, 0.005, "incorrect"), (4, None, 1, 0.0, "incorrect")}


def test_benjamini_hochberg(spark):
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.6]
    df = spark.createDataFrame([("w", i, p) for i, p in enumerate(ps)], "w string, series int, p double")
    assert M.benjamini_hochberg(df, ["w"]).filter("discovered = 1").count() == 2


def test_sql_tool(spark):
    spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id int, name string").createOrReplaceTempView("notes")
    allowed = {"notes"}
    for bad in ("DELETE FROM notes", "DROP TABLE notes", "SELECT 1; SELECT 2", "INSERT INTO notes VALUES (1, 'x')", "SELECT * FROM secret", "SET x=1", "SELECT * FROM notes WHERE id IN (SELECT id FROM other)", "WITH a AS (SELECT * FROM hidden) SELECT * FROM a", "SELECT * FROM parquet.`/etc`", ""):
        with pytest.raises(C.SQLRejected):
            C.validate_sql(spark, bad, allowed)
    r = C.run_sql(spark, "WITH a AS (SELECT id FROM notes) SELECT n.id, n.name FROM notes n JOIN a ON a.id = n.id ORDER BY 1", allowed, max_rows=2, timeout_s=60)
    assert r.error is None and len(r.rows) == 2 and r.truncated
    assert C.run_sql(spark, C.translate_dialect("SELECT count(*) FROM notes WHERE name LIKE 'N%'"), allowed, timeout_s=60).rows == [(5,)]
    assert C.run_sql(spark, "DROP TABLE notes", allowed).error
    assert "a\\|b" in C.SQLResult("", ["x"], [("a|b",)]).markdown()


def test_state_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {r.path: r.change for r in C.state_diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    merged = C.replace_files(old.withColumnRenamed("path", "file_path"), spark.createDataFrame([("a", "9")], "file_path string, content_hash string"))
    assert sorted(map(tuple, merged.collect())) == [("a", "9"), ("b", "1"), ("c", "1")]


def test_analytics_views(spark):
    nodes = spark.createDataFrame(
        [("e.ipynb", "cell", 0, 1, "markdown", "# Experiment A", None), ("e.ipynb", "cell", 1, 2, "code", "print(1)", 2), ("e.ipynb", "output", 2, 2, None, "roc_auc 0.9925", None), ("e.ipynb", "cell", 3, 3, "code", "1/0", 1), ("e.ipynb", "output", 4, 3, None, "ZeroDivisionError: division by zero", None)],
        "file_path string, node_type string, ord int, cell int, cell_type string, text string, execution_count int",
    )
    files = spark.createDataFrame([("e.ipynb", "notebook", 10, "ok")], "path string, file_type string, size long, status string")
    v = C.analytics_views(nodes, files)
    assert tuple(v["notebooks"].first()) == ("e.ipynb", "Experiment A", 3, 2, 1)
    errors = v["cells"].filter("has_error = 1").select("cell", "error_name").collect()
    assert errors == [Row(cell=3, error_name="ZeroDivisionError")] and v["files"].first().n_fragments == 5


def test_short_items_in_documents(spark, tmp_path):
    from quarrymill.plans.text import benchmark_in_documents

    spark.createDataFrame([(1, "one two three four five"), (2, "twofold"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "two"), (2, "two three"), (3, "e two three f"), (4, "three two"), (5, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.item_id, r.doc_id) for r in benchmark_in_documents(spark, str(tmp_path)).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (3, 1)]


@pytest.mark.parametrize("most", [R.BROADCAST_ROWS, 0])
def test_whole_items_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(R, "BROADCAST_ROWS", most)
    long = " ".join(f"w{i}" for i in range(14))
    items = [(1, long), (2, "w1  w2 w3 w4"), (3, "2 w3 w4 w5 w"), (4, "w4"), (5, None), (6, " w3 w4 w5 "), (7, "w5 w4 w3 w2"), (8, ""), (1, long)]
    texts = [(1, f"x {long} y"), (2, f"x{long}y\n{long}"), (None, long), (3, ""), (4, None), (5, "w1  w2 w3 w4"), (5, "w1  w2 w3 w4"), (6, long.replace("w7", "v7"))]
    texts.append((7, "a " * 30_000 + long))
    want = sorted(str((i, d)) for i, t in items for d, x in texts if t is not None and x is not None and t in x)
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit(1))
    got = R.whole_items(spark.createDataFrame(items, "item_id long, text string"), docs).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert R.whole_items(spark.createDataFrame([], "item_id long, text string"), docs).count() == 0
