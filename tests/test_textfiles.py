"""Plain text files: one fixture of each type, packing and edges."""

from quarrymill.operators import textfiles as X

LOG = "\n".join(f"2025-01-01 00:00:{i:02d} epoch={i} loss=0.{i}" for i in range(25))
CODE = "import os\nclass A:\n    x = 1\n\ndef f(x):\n    return x\n\nfor a in b:\n    pass\n"
TABLE = "Results of May\n\nname;n;m\na;1;2\nb;2;3\nc;3\nd;4;5\ne;5;6\nf;6;7\ng;7;8\nh;8;9\ni;9;9\n"
NOTE = "intro one\nintro two\n\n# Plan\nfirst line\n\nsecond line\n## April\n- one\n- two\n\n# End\n"
PROSE = "One paragraph here.\nIt has two lines.\n\nSecond one is alone.\n\n\nThird one ends it."


def _segments(spark, **limits):
    files = [("l", LOG), ("c", CODE), ("t", TABLE), ("m", NOTE), ("p", PROSE), ("none", None), ("blank", " \n\t\n"), ("h", "a;b\n1;2\n3;4".replace("1;2\n3;4", "").strip())]
    df = spark.createDataFrame(files, "path string, text string")
    out = {}
    for r in X.text_segments(df, **limits).orderBy("path", "line_start", "line_end").collect():
        out.setdefault(r.path, []).append((r.content_type, r.node_type, r.title, r.section, r.line_start, r.line_end, r.text))
    return out


def test_each_type_is_cut_its_own_way(spark):
    got = _segments(spark, text_chars=40, window=10, shared=2)
    lines = LOG.split("\n")
    assert got["l"] == [("log", "log_chunk", f"lines {a + 1}-{b}", None, a + 1, b, "\n".join(lines[a:b])) for a, b in ((0, 10), (8, 18), (16, 25))]
    code = CODE.split("\n")
    assert got["c"] == [("code", "code_chunk", f"lines {a + 1}-{b}", None, a + 1, b, "\n".join(code[a:b])) for a, b in ((0, 10),)]
    assert got["p"] == [("prose", "section", "lines 1-2", None, 1, 2, "One paragraph here.\nIt has two lines."), ("prose", "section", "lines 4-7", None, 4, 7, "Second one is alone.\n\nThird one ends it.")]
    assert got["m"] == [
        ("markdown", "section", "lines 1-2", None, 1, 2, "intro one\nintro two"), ("markdown", "section", "Plan", "Plan", 4, 7, "# Plan\nfirst line\n\nsecond line"),
        ("markdown", "section", "April", "Plan > April", 8, 10, "## April\n- one\n- two"), ("markdown", "section", "End", "End", 12, 12, "# End"),
    ]
    top = "| name | n | m |\n|---|---|---|\n"
    got["t"] = _segments(spark, table_chars=80)["t"]
    assert got["t"][0] == ("table", "section", "preamble", None, 1, 1, "Results of May")
    assert [x[1:3] for x in got["t"][1:]] == [("table", "rows 4-6"), ("table", "rows 7-9"), ("table", "rows 10-12")]
    assert got["t"][1][-1] == top + "| a | 1 | 2 |\n| b | 2 | 3 |\n| c | 3 |  |"
    assert set(got) == {"l", "c", "t", "m", "p", "h"} and got["h"][0][0] == "prose"


def test_whole_files_under_the_limits(spark):
    got = _segments(spark)
    assert {k: len(v) for k, v in got.items()} == {"l": 1, "c": 1, "t": 2, "m": 4, "p": 1, "h": 1}
    assert got["p"][0][-1] == "One paragraph here.\nIt has two lines.\n\nSecond one is alone.\n\nThird one ends it."
