"""Registered queries against their DuckDB twins, on small tables that once told them apart."""

import os
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarrymill.operators import ranking as R
from quarrymill.plans import judging, registry


def same(spark, folder, name, **tables):
    """Rows of the query and of its SQL over `tables`; a list of tables is a folder of files."""
    con = duckdb.connect()
    for t, parts in tables.items():
        path = f"{folder}/{t}.parquet"
        if isinstance(parts, list):
            os.makedirs(path)
            for i, part in enumerate(parts):
                pq.write_table(pa.table(part), f"{path}/part-{i:04d}.parquet")
        else:
            pq.write_table(pa.table(parts), path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if isinstance(parts, list) else ''}')")
    out = registry.queries()[name](spark, str(folder))
    asked = ", ".join(f'"{c}"' for c in out.columns)
    want = con.execute(f"SELECT {asked} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, out.collect())) == Counter(want)
    return len(want)


def test_interfaces_hold_all_signatures(spark, tmp_path):
    n = 12_000  # 300 for each line, more than the operator's own limit of 200 in all
    texts = {"doc_id": list(range(n)), "text": [f"name{i:05d} other" for i in range(n)], "lang": ["en"] * n, "source": ["a"] * n, "n_chars": [10] * n}
    assert same(spark, tmp_path, "interfaces", documents=texts) == 1


def test_fresh_pages_take_the_largest_id_of_an_address(spark, tmp_path):
    ids = [2015, 6718, 24, 99, 123, 0]
    assert same(spark, tmp_path, "fresh_pages", pages={"page_id": ids, "url": ["u", "u", "u", "v", "w", "w"], "html": [""] * 6}) == 2


def test_positions_run_through_all_files_of_a_table(spark, tmp_path):
    parts = [{"doc_id": list(range(a, a + 10))} for a in (0, 10, 20)]
    assert same(spark, tmp_path, "positional_split", documents=parts) == 5


def test_quoted_phrase_asks_where_it_stands(spark, tmp_path):
    assert same(spark, tmp_path, "quoted_phrase_canaries", benchmark={"item_id": [1, 2], "text": ["a b c d e f", "too few"]}) == 2


def test_extracted_metrics_keep_their_own_cells(spark, tmp_path):
    keys = [1, 6, 10_000_001, 10_000_006, 5]
    assert same(spark, tmp_path, "extracted_metrics", orders={"o_orderkey": keys, "o_custkey": [7] * 5, "o_totalprice": [123.45, 123.45, 123.45, 99.5, 77.25]}) == 4


def test_lateral_has_every_customer_of_an_order(spark, tmp_path):
    orders = {"o_orderkey": [2, 1, 7, 3, 4, 6], "o_custkey": [1, 1, 1, 9, None, 1], "o_totalprice": [5.0, 5.0, 5.0, 1.0, 2.0, None]}
    assert same(spark, tmp_path, "sql_lateral", orders=orders, customer={"c_custkey": [1, 2]}) == 3  # the first of equal prices is the smallest key


def test_full_outer_pairs_no_rows(spark, tmp_path):
    n = 20_000  # on either side in one nation: 400 million pairs
    supplier = {"s_suppkey": [*range(n), 1, 2], "s_nationkey": [*([3] * n), None, 4]}
    customer = {"c_custkey": [*range(n), 1, 1], "c_nationkey": [*([3] * n), None, 5]}
    plan = registry.queries()["sql_full_outer"]
    assert same(spark, tmp_path, "sql_full_outer", supplier={k: v[-30:] for k, v in supplier.items()}, customer={k: v[-30:] for k, v in customer.items()}) == 4
    text = plan(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join FullOuter") < text.index("Aggregate [s_nationkey")  # counted below the join


def test_name_candidates_meet_by_spans(spark, tmp_path):
    n = 4_000  # all name the same: places times fragments were 400,000 rows
    texts = {"doc_id": list(range(n)), "text": ["alpha beta gamma"] * n, "lang": ["en"] * n, "source": [f"s{i % 2}" for i in range(n)], "n_chars": [10] * n}
    assert same(spark, tmp_path, "name_candidates", documents=texts, benchmark={"item_id": [1, 2], "text": ["where is Beta or alpha", "nothing here"]}) == 40


def plan_of(spark, folder, name):
    return registry.queries()[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()


def test_late_interaction_writes_no_pairs(spark, tmp_path):
    ids = [*range(0, 900, 25), 1000, 1001, 1100]
    vectors = {"vec_id": ids, "embedding": pa.array([[float(i % 7 + 1), float(i % 3), 1.0 - i % 5] for i in ids], pa.list_(pa.float32())), "label": [i % 4 for i in ids]}
    assert same(spark, tmp_path, "maxsim", embeddings=vectors) == 8
    assert "Join" not in plan_of(spark, tmp_path, "maxsim")


def test_late_interaction_of_odd_vectors(spark):
    tokens = spark.createDataFrame([("q", 1, [3.0, 4.0]), ("q", 2, [0.0, 0.0]), ("q", 3, None), ("q", 4, [1.0]), ("n", 5, None)], "query_id string, token int, vector array<double>")
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 2.0]), (None, [-3.0, -4.0]), ("b", None), ("c", [2.0]), ("c", [1.0, None])], "node_id string, vector array<double>")
    want = {("q", "c"): 1.0, ("q", "a"): 0.8, ("q", None): -1.0, ("q", "b"): None, **{("n", x): None for x in ("a", "b", "c", None)}}
    assert {(r.query_id, r.node_id): r.score for r in R.max_similarity(tokens, items).collect()} == want


#: One id on three rows, one null text.
REPEATED = {"doc_id": [*range(1, 40), 7, 7, 41], "text": [f"alpha alpha {'beta ' * (i % 5)}gamma{i % 3} their" for i in range(40)] + ["beta beta alpha gamma1", None]}


def test_terms_are_counted_within_rows(spark, tmp_path):
    benchmark = {"item_id": [1, 2, 3, 4], "text": ["Alpha beta beta", "gamma1 x gamma1", "nothing", None]}
    assert same(spark, tmp_path, "sparse_topk", documents=REPEATED, benchmark=benchmark) == 20
    (tmp_path / "unique").mkdir()
    assert same(spark, tmp_path / "unique", "sparse_topk", documents={k: v[-12:-3] for k, v in REPEATED.items()}, benchmark=benchmark) == 12
    assert "Generate" not in plan_of(spark, tmp_path / "unique", "sparse_topk").split("MapInArrow")[1]


def test_weights_of_tokens_are_found_within_rows(spark, tmp_path):
    assert same(spark, tmp_path, "term_weights", documents=REPEATED) == 78
    (tmp_path / "unique").mkdir()
    assert same(spark, tmp_path / "unique", "term_weights", documents={k: v[:39] for k, v in REPEATED.items()}) == 78
    assert "Exchange" not in plan_of(spark, tmp_path / "unique", "term_weights")


def test_shared_terms_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "DOCS", 7)  # so that sets are passed over in later documents
    draw = random.Random(3)
    letters = "abcdefghijkl"
    docs = [(i % 190, [draw.choice(letters) for _ in range(draw.randrange(9))]) for i in range(200)] + [(900, None), (None, ["a", "b"])]
    asked = [(q, w) for q in range(40) for w in draw.choices(letters + "z", k=q % 6)]
    got = R.shared_terms_topk(spark.createDataFrame(asked, "query_id int, term string"), spark.createDataFrame(docs, "node_id int, words array<string>"), F.col("words"), 3)
    want = set()
    for q in {q for q, _ in asked}:
        mine, n = {w for x, w in asked if x == q}, Counter()
        for node, words in docs:
            n[node] += len(mine & set(words or []))
        first = sorted((-c, node is not None, node or 0, node) for node, c in n.items() if c)[:3]
        want |= {(q, x[-1], r + 1) for r, x in enumerate(first)}
    assert {(r.query_id, r.node_id, r.rank) for r in got.collect()} == want


def test_corrective_search_joins_no_words(spark, tmp_path):
    n = 3_000  # every question shares its words with every document: 450,000 pairs of them
    texts = {"doc_id": [*range(n), 5], "text": [f"Alpha bravo charlie {'delta ' * (i % 2)}{i}" for i in range(n)] + ["alpha bravo charlie delta"]}
    assert same(spark, tmp_path, "corrective_search", documents=texts) == 450


def test_canaries_read_the_first_words_only(spark, tmp_path):
    words = [" ".join(f"w{j}x{i}," for j in range(i)) for i in range(8, 24)] * 3 + ["ab 1", "_one", "a bc def9 -- x_y", "  .. ; name;other;name"] * 4
    n = len(words)
    documents = {"doc_id": list(range(n)), "text": words, "lang": ["en"] * n, "source": [f"s{i % 3}" for i in range(n)], "n_chars": [100] * n}
    assert same(spark, tmp_path, "canaries", documents=documents) > 50
    for part in (judging.symbols, judging.calls):
        assert "regexp_extract_all" not in part(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
