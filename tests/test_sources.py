import io
import json
import zipfile

from pyspark.sql import functions as F

from quarrymill.sources import files as X
from quarrymill.sources import sinks
from quarrymill.sources.merge_table import MergeTable
from quarrymill.streaming import incremental as I


def test_listing_and_decoding(spark, tmp_path):
    for name, data in {"a/x.py": b"a = 1\r\n", "a/__pycache__/y.py": b"", ".hid/z.py": b"", "data/raw/w.py": b"", "data/clean/v.py": "текст".encode("cp1251"), "big.py": b"x" * 3000, "n.bin": b""}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    df = X.list_files(spark, str(tmp_path), [".PY"], ["__pycache__", "data/raw/*"], max_mb=0.002)
    rows = {r.path: r for r in df.withColumn("text", X.decode_text(F.col("content"))).collect()}
    assert set(rows) == {"a/x.py", "data/clean/v.py", "big.py"}
    assert rows["a/x.py"].text == "a = 1\n" and rows["data/clean/v.py"].text == "текст" and rows["big.py"].skipped


def test_notebook(spark):
    cells = [{"cell_type": "markdown", "source": ["# Experiment A\n", "x"]}, {"cell_type": "code", "execution_count": 2, "source": "print(1)", "outputs": [{"output_type": "stream", "text": ["roc_auc ", "0.9925"]}]}, {"cell_type": "code", "execution_count": 1, "source": "1/0", "outputs": [{"output_type": "error", "ename": "ZeroDivisionError", "evalue": "division by zero"}]}]
    df = X.notebook_cells(spark.createDataFrame([("e.ipynb", json.dumps({"cells": cells}))], "path string, text string"))
    rows = df.orderBy("cell").collect()
    assert rows[0].source == "# Experiment A\nx" and rows[1].output == "roc_auc 0.9925" and rows[2].output == "ZeroDivisionError: division by zero"


def test_docx(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Plan</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
    df = spark.createDataFrame([("d.docx", bytearray(buffer.getvalue())), ("bad", bytearray(b"PK\x03\x04x"))], "path string, content binary")
    assert [(r.level, r.text) for r in X.docx_documents(df).orderBy("ord").collect()] == [(1, "Plan"), (0, "text")]
    assert {r.path: r.t for r in df.select("path", X.detect_type(F.col("content")).alias("t")).collect()} == {"d.docx": ".docx", "bad": None}


def test_generations(spark, tmp_path):
    t = sinks.GenerationTable(spark, str(tmp_path / "t"))
    t.replace(spark.range(3))
    t.replace(spark.range(5))
    assert t.read().count() == 5


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 2, "view", 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = I.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 120
    series = df.select("user_id", "event_id", F.when(F.col("event_id") < 60, 0.1).otherwise(9.0).alias("value"))
    series.write.parquet(str(tmp_path / "s"))
    alarms = I.page_hinkley_stream(spark.readStream.schema(series.schema).parquet(str(tmp_path / "s")), "user_id", "event_id", "value", least=10)
    q = alarms.writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.user_id for r in spark.table("alarms").collect()} == {0, 1}


def test_upsert_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = MergeTable(spark, str(tmp_path / "t"))
    read = lambda: sorted(map(tuple, table.read().collect()))
    stream = spark.readStream.schema("path string, v int, version int").parquet(str(tmp_path / "in"))

    def feed(*rows):
        spark.createDataFrame(list(rows), "path string, v int, version int").write.mode("append").parquet(str(tmp_path / "in"))
        I.upsert_files(stream, table, checkpoint=str(tmp_path / "cp"), version="version", gone="v < 0").awaitTermination(90)

    feed(("a", 1, 1), ("a", 2, 2), ("b", 1, 1))
    assert read() == [("a", 2, 2), ("b", 1, 1)]
    feed(("b", -1, 2), ("c", 5, 1))
    assert read() == [("a", 2, 2), ("c", 5, 1)]


def test_footers_and_positions(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quarrymill.sources import footers as P

    folder = tmp_path / "f"
    folder.mkdir()
    pq.write_table(pa.table({"x": list(range(25))}), folder / "a.parquet", row_group_size=10)
    pq.write_table(pa.table({"x": [100]}), folder / "b.parquet")
    (folder / "_note.txt").write_text("no table")
    want = [("a.parquet", 0, 0, 10), ("a.parquet", 1, 10, 10), ("a.parquet", 2, 20, 5), ("b.parquet", 0, 0, 1)]
    for path in (str(folder), f"file://{folder}"):
        got = [(r.path.rpartition("/")[2], r.row_group, r.first_row, r.rows) for r in P.row_groups(spark, path).orderBy("path", "row_group").collect()]
        assert got == want
    assert [r.rows for r in P.row_groups(spark, str(folder / "b.parquet")).collect()] == [1]
    rows = P.with_positions(spark, str(folder), "x")
    assert {(r.file, r.position, r.x) for r in rows.collect()} == {("a.parquet", i, i) for i in range(25)} | {("b.parquet", 0, 100)}
    wanted = spark.createDataFrame([("a.parquet", 3), ("a.parquet", 3), ("b.parquet", 9)], "file string, position long")
    assert [r.x for r in P.take_positions(rows, wanted).collect()] == [3]
    folds = lambda n: {(r.file, r.position): r.fold for r in P.positional_split(rows.repartition(n), 3).collect()}
    assert folds(1) == folds(4) and set(folds(1).values()) == {0, 1, 2}
