import pytest
from pyspark.sql import functions as F

from quarrymill.functions import scalars as S
from quarrymill.operators import assembly as B
from quarrymill.operators import catalog as C
from quarrymill.operators import code as A
from quarrymill.operators import evaluation as E
from quarrymill.operators import graph as G


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, node_id string, score double, rank int")


def test_chain_and_order(spark):
    df = spark.createDataFrame([(1, "[IMG] a cat -> [VID] move it"), (2, "plain -> text"), (3, "draw first -> [img]: now")], "message_id int, text string")
    got = {(r.message_id, r.step): (r.kind, r.body, r.input) for r in G.chain_steps(df, ["img", "vid"]).collect()}
    assert got == {(1, 1): ("img", "a cat", None), (1, 2): ("vid", "move it", 1), (3, 1): ("text", "draw first", None), (3, 2): ("img", "now", 1)}
    nodes = spark.createDataFrame([("c", 0, "text"), ("a", 1, "img"), ("b", 2, "vid"), ("d", 3, "text")], "node_id string, ord int, kind string")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert [(r.node_id, r.level) for r in G.execution_order(spark, nodes, links).orderBy("position").collect()] == [("a", 0), ("d", 0), ("b", 1), ("c", 2)]
    assert {r.node_id: r.found for r in G.nearest_above(nodes, links, "img").collect()} == {"b": "a", "c": "a"}
    for bad in ([("a", "b"), ("b", "a")], [("a", "z")], [("c", "a"), ("a", "b"), ("b", "c"), ("d", "c")]):
        with pytest.raises(G.GraphError):
            G.execution_order(spark, nodes, spark.createDataFrame(bad, "src string, dst string"))


def test_hit_lists(spark):
    dense = hits(spark, [("q", "a", 0.9, 1), ("q", "b", 0.5, 2), ("q", "c", 0.01, 3)])
    exact = hits(spark, [("q", "c", 0.0, 1)])
    assert [(r.node_id, r.score) for r in B.upload_hits(exact, dense).orderBy("rank").collect()] == [("c", 1.9), ("a", 0.9), ("b", 0.5)]
    assert [r.node_id for r in B.lead_with(exact, dense).orderBy("rank").collect()] == ["c", "a", "b"]
    seen = spark.createDataFrame([("q", "a", 0.1, 1), ("q", "a", 0.9, 2), ("q", "b", 0.5, 2), ("q", "c", 0.001, 3)], "query_id string, node_id string, score double, step int")
    assert [r.node_id for r in B.evidence_pool(seen).orderBy("rank").collect()] == ["b", "a"]
    own = spark.createDataFrame([("q", "b"), ("q", "z")], "query_id string, own_id string")
    assert B.round_trip(own, dense).count() == 1


def test_budgets_and_views(spark):
    nodes = spark.createDataFrame([("f", i, s, n) for i, (s, n) in enumerate([("A", 10), ("A", 10), ("A", 10), ("A", 10), ("B", 50), ("C", 10)])], "file string, ord long, section string, size long")
    assert sorted(r.ord for r in B.overview_nodes(nodes, 50).collect()) == [0, 1, 2, 3, 5]
    assert [r.part for r in B.partition_by_budget(nodes, 30).orderBy("ord").collect()] == [0, 0, 0, 1, 2, 3]
    parts = spark.createDataFrame([("n", 1, 0, "a\nb\nb"), ("n", 1, 1, "b\nc"), ("n", 2, 2, "x")], "file_path string, cell int, ord int, text string")
    assert {r.cell: r.source for r in B.joined_cells(parts).collect()} == {1: "a\nb\nb\nc", 2: "x"}
    cells = spark.createDataFrame([("n", 1, "code", "x = 1", "out"), ("n", 2, "markdown", "# T", None)], "file_path string, cell int, cell_type string, source string, output string")
    assert B.notebook_prompt(cells, 1000).first().prompt == "[ячейка 1 · code]\nx = 1\n\n[вывод ячейки 1]\nout\n\n[ячейка 2 · markdown]\n# T"
    h = spark.createDataFrame([("r", i, "tool", "1\n2\n3") for i in range(14)], "run_id string, pos int, role string, text string")
    assert B.compact_history(h).filter(F.col("text").endswith("…")).count() == 2
    assert B.numbered_view(spark.createDataFrame([("p", "a\nb\nc")], "path string, text string"), 2, 1).first().line == "b"
    rows = hits(spark, [("q", "a", 1.0, 1)]).withColumn("text", F.lit("abcdef")).withColumn("label", F.lit("p.py"))
    assert B.context_blocks(rows, 3).first().context == '<source id="1" ref="p.py">\nabc…\n</source>'


def test_places(spark):
    nodes = spark.createDataFrame([("n1", "m.py", None, 1, 60, "chunk", 0), ("n2", "e.ipynb", 2, None, None, "cell", 1), ("n3", "e.ipynb", 2, None, None, "output", 2)], "node_id string, file_path string, cell int, line_start int, line_end int, node_type string, ord int")
    places = spark.createDataFrame([(1, "m.py", None, 13, 27), (2, "e.ipynb", 2, None, None), (3, "m.py", None, 61, 70)], "place_id int, file_path string, cell int, line_start int, line_end int")
    assert {(r.place_id, r.node_id) for r in C.nodes_at(nodes, places).collect()} == {(1, "n1"), (2, "n2")}
    prov = B.provenance_nodes(spark.createDataFrame([("e.ipynb", 2, 0), ("e.ipynb", 2, 1)], "path string, cell int, pos int"), nodes)
    assert [r.node_id for r in prov.collect()] == ["n3"]
    pages = spark.createDataFrame([("d.pdf", 1, i, f"p{i}") for i in range(3)], "file_path string, page int, ord int, node_id string")
    assert [r.node_id for r in B.page_fragments(spark.createDataFrame([("q", "d.pdf", 1, 1)], "query_id string, file_path string, page int, rank int"), pages).orderBy("rank").collect()] == ["p0", "p1"]


def test_references_and_targets(spark):
    shape = "query_id string, node_id string, rank int, file_path string, cell int, line_start int, line_end int, page int, page_end int, section string, text string"
    h = spark.createDataFrame([("q", "n1", 1, "m.py", None, 1, 12, None, None, "", "x"), ("q", "n2", 2, "m.py", None, 20, 40, None, None, "A > Results", "auc 0.9")], shape)
    r = spark.createDataFrame([("q", "r1", "m.py", None, 13, 27, None, None, None), ("q", "r2", "m.py", None, None, None, None, "result", "AUC"), ("q", "r3", "o.py", None, None, None, None, None, None)], "query_id string, ref_id string, file string, cell int, line_start int, line_end int, page int, section string, quote string")
    first = {x.ref_id: x.first_rank for x in E.first_matches(h, r, E.source_matches()).collect()}
    assert first == {"r1": 2, "r2": 2, "r3": None}
    assert E.citation_precision(h, r, E.source_matches()).first().precision == 0.5
    targets = spark.createDataFrame([("q", "m.py", 1, 5, None, None, None), ("z", "m.py", None, None, 7, None, None)], "canary_id string, file_path string, line_start int, line_end int, cell int, section string, node_id string")
    assert {x.canary_id: x.rank for x in E.canary_ranks(h.select("query_id", "node_id", "rank"), targets, h.drop("query_id", "rank")).collect()} == {"q": 1, "z": 0}


def test_summaries(spark):
    rows = [("Q1", True, True, "corpus", "corpus", True, False, 1.0, 10), ("Q1", False, True, "sql", "corpus", True, True, 3.0, 30), ("G", True, True, "general", "general", False, True, 2.0, 20)]
    df = spark.createDataFrame(rows, "cls string, correct boolean, faithful boolean, expected_route string, route string, answerable boolean, refused boolean, latency_s double, tokens int")
    s = {r.cls: r for r in E.summarize(df).collect()}
    assert (s["all"].n, s["all"].refusal_precision, s["all"].refusal_recall, s["all"].false_refusals, s["Q1"].p50) == (3, 0.5, 1.0, 1, 2.0)
    a = spark.createDataFrame([(True, "zeb-1", "look ZEB-1", "", "", True, 0), (False, "zeb-2", "", "", "no", True, 1)], "policies boolean, canary string, queries_text string, urls_text string, answer string, useful boolean, blocked int")
    assert {r.policies: r.attack_success for r in E.red_team_summary(a).collect()} == {True: 1.0, False: 0.0}
    runs = spark.createDataFrame([("m", True, 3, 1, 4, 2.0), ("m", False, 5, 1, 0, 4.0)], "model string, solved boolean, steps int, broken_writes int, writes int, latency_s double")
    r = E.summarize_code(runs).first()
    assert (r.solved, r.steps, r.broken_share) == (0.5, 4.0, 0.5)
    items = spark.createDataFrame([("a", "Q1", "x", [("f.py", 5, 2)]), ("a", "Q1", "x", [])], "id string, cls string, answer string, sources array<struct<file:string,line_start:int,line_end:int>>")
    assert {r.problem for r in E.evalset_problems(items, spark.createDataFrame([("g.py",)], "path string")).collect()} == {"repeated id", "no sources", "unknown file", "inverted lines"}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(S.defang_markdown(F.lit("![a](http://x/y) [b](http://z) `[c](http://w)` http://v"))) == "[изображение: a] `http://x/y` b (`http://z`) `c (``http://w``)` `http://v`"
    import hashlib

    paths = [f"p/{i}.py" for i in range(50)]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.held_out(F.col("p"), 0.3).alias("h"))
    assert all(r.h == (int(hashlib.sha1(r.p.encode()).hexdigest(), 16) % 1000 < 300) for r in df.collect())
    assert one(S.location_label(F.lit("a.py"), F.lit(None).cast("int"), F.lit(""), F.lit(2), F.lit(1), F.lit(5))) == "a.py, cell 2, lines 1-5"
    assert one(E.must_include(F.lit("Accuracy 0.9"), F.array(F.lit("ACCURACY"), F.lit(r"0\.9")))) is True
    assert one(S.wants(F.lit("Give me an overview"), "overview")) and not one(S.wants(F.lit("x"), "web"))


def test_catalog_updates(spark):
    nodes = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "id string, text string, title string")
    got = C.update_nodes(nodes, spark.createDataFrame([("2", "new")], "id string, text string"))
    assert sorted(map(tuple, got.collect())) == [("1", "a", "x"), ("2", "new", "y")]
    tables = spark.createDataFrame([("cells", "cells of notebooks"), ("metrics", "metric values"), ("files", "files")], "name string, description string")
    assert B.narrowed_tables("best metric values", tables, {"metrics": ["experiments"]}, most=1) == ["metrics", "experiments"]
    e = spark.createDataFrame([(1, "t")], "id int, title string")
    s = C.experiment_summary(e, spark.createDataFrame([(1, "auc", "val", 0.9)], "experiment_id int, name string, split string, value double"), spark.createDataFrame([(1, "lr", "0.1")], "experiment_id int, name string, value string")).first()
    assert s.metrics[0].name == "auc" and s.hyperparameters[0].value == "0.1"


def test_source_chunks(spark):
    src = "import os\n\n# note\ndef small(a):\n    return a\n\n\ndef other():\n    return 1\n\n\nclass Big:\n    '''Doc.'''\n    x = 1\n\n    def one(self):\n        return '" + "y" * 60 + "'\n\n    def two(self):\n        return '" + "z" * 60 + "'\n"
    chunks = A.source_chunks(src, limit=90)
    titles = [c["title"] for c in chunks]
    assert titles == ["module code, small, other", "class Big", "Big.one", "Big.two"] and chunks[2]["context"] == "class Big: Doc."
    assert chunks[0]["start"] == 1 and all(a["end"] < b["start"] for a, b in zip(chunks, chunks[1:]))
    assert A.source_chunks("def (", limit=10)[0]["title"] == "lines (part 1/1)"
    df = A.chunked_sources(spark.createDataFrame([("a.py", src)], "path string, source string"), limit=90)
    assert df.count() == 4
    assert A.syntax_error("a.json", "{") and A.syntax_error("a.py", "x = 1") is None and A.syntax_error("a.ipynb", "{}") == "no cells"


def test_reports_of_a_run(spark):
    base = dict(id=1, cls="Q1", expected_route="corpus", route="corpus", upload=None, upload_route=None, failed=False, recall_5=0.5, mrr=0.5, ndcg_10=0.5, must_include_ok=True, score=1.0, faithful=True, relevant=True, cited=2, supported=1, grounded=True, answerable=True, refused=False, latency_s=1.0, tokens=10, sql_used=False, sql_ex=None, agent_used=False, agent_steps=0, agent_stop=None, crag_refused=False, web_supported=0, web_unsupported=0, level=None, truncated=False, escalated=False)
    rows = [
        base, base | dict(id=2, cls="Q6", refused=True, score=0.0, latency_s=3.0, answerable=False, crag_refused=True, level="low", truncated=True), base | dict(id=3, cls="Q1", refused=True, score=0.0, cited=0, supported=0, agent_used=True, agent_steps=4, agent_stop="done"),
        base | dict(id=4, cls="Q10", route="web", score=None, web_supported=3, web_unsupported=1), base | dict(id=5, upload="f", upload_route="index", route="upload"), base | dict(id=6, failed=True),
    ]
    schema = "id int, cls string, expected_route string, route string, upload string, upload_route string, failed boolean, recall_5 double, mrr double, ndcg_10 double, must_include_ok boolean, score double, faithful boolean, relevant boolean, cited int, supported int, grounded boolean, answerable boolean, refused boolean, latency_s double, tokens int, sql_used boolean, sql_ex boolean, agent_used boolean, agent_steps int, agent_stop string, crag_refused boolean, web_supported int, web_unsupported int, level string, truncated boolean, escalated boolean"
    got = {(r.report, r.part): r for r in E.reports(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()}
    whole = got["all", "all"]
    assert (whole.n, whole.routed_right, whole.correctness, whole.refusal_precision, whole.refusal_recall, whole.false_refusals) == (5, 0.75, 0.5, 0.5, 1.0, 1)
    assert (whole.citation_precision, whole.wrong_rate, whole.unsupported_share, whole.truncated_share, whole.crag_refusals) == (0.5, 1 / 3, 0.25, 1.0, 1)
    assert {k[1]: v.n for k, v in got.items() if k[0] == "route"} == {"corpus->corpus": 3, "corpus->web": 1} and got["upload_route", "f: index"].n == 1
    assert got["agent", "used"].agent_steps == 4.0 and got["agent_stop", "done"].n == 1 and got["reasoning", "low"].n == 1 and got["class", "Q1"].n == 3
    spans = spark.createDataFrame([("py", 1), ("py", 4), ("py", None)], "file_type string, rank int")
    r = E.recall_by_file_type(spans).first()
    assert (r.spans, r.recall_1, r.recall_5) == (3, 1 / 3, 2 / 3)
