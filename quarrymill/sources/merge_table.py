"""Incremental tables: small segments over a base, merged when read; and values that several writers update.

A batch that replaces some files writes these files' rows and their keys, and nothing else. A reader
takes a file's rows from the newest segment that names it, or from the base. Compaction is a job of
its own: it writes what a reader sees as a new base, then one commit names it.

Every commit is the creation of one numbered file that must not exist yet, so that of two writers of
one number the second fails, looks again and retries. A lost job leaves folders that no commit names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _fs


class VersionLog:
    """Numbered versions of a small text; a version is written once, whole, by one writer (SNK-11).

    On a local file system a version appears by a hard link, elsewhere by a rename that does not
    overwrite; both fail if the number is taken.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        fs, folder = _fs(self.spark, self.root)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def text(self, number: int) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{number:012d}").collect())

    def commit(self, number: int, text: str) -> bool:
        """Whether this writer made version `number`; false if another one did."""
        fs, target = _fs(self.spark, f"{self.root}/{number:012d}")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        temporary = hadoop.Path(f"{self.root}/_{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                os.link(temporary.toUri().getPath(), target.toUri().getPath())
                return True
            context = hadoop.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
            none[0] = getattr(hadoop, "Options$Rename").NONE
            context.rename(fs.makeQualified(temporary), fs.makeQualified(target), none)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e) or fs.exists(target):
                return False
            raise
        finally:
            if fs.exists(temporary):
                fs.delete(temporary, False)

    def update(self, change: Callable[[dict], dict], tries: int = 50) -> dict:
        """Apply `change` to the newest value, a JSON object, and commit it; again on the newer one if another writer came first."""
        for _ in range(tries):
            known = self.numbers()
            value = change(json.loads(self.text(known[-1])) if known else {})
            if self.commit(known[-1] + 1 if known else 0, json.dumps(value, ensure_ascii=False)):
                return value
        raise RuntimeError(f"{tries} times another writer of {self.root} came first")


class MergeTable:
    """Rows by file, replaced a file at a time (SNK-01): a base, and segments over it.

    The log's entries are segments ({"segment": folder, "batch": id}) and bases ({"base": folder,
    "through": number of the last segment in it}). A batch id that was committed once is not applied
    again, so that a stream may repeat its last batch.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "path"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.log = VersionLog(spark, f"{self.root}/log")

    def _all(self) -> list[tuple[int, dict]]:
        """All entries in the order of their commits, by one read of the log's small files."""
        if not self.log.numbers():
            return []
        name = F.element_at(F.split(F.input_file_name(), "/"), -1).cast("long")
        rows = self.spark.read.text(f"{self.log.root}/[0-9]*").select(name.alias("n"), "value").collect()
        return sorted(((r["n"], json.loads(r["value"])) for r in rows), key=lambda x: x[0])

    def _entries(self) -> list[tuple[int, dict]]:
        """The newest base, and all segments after what it holds."""
        rows = self._all()
        base = max(((x["through"], n) for n, x in rows if "base" in x), default=None)
        return [(n, x) for n, x in rows if base is None or n == base[1] or ("segment" in x and n > base[0])]

    def replace(self, rows: DataFrame, gone: DataFrame | None = None, batch: str | None = None) -> bool:
        """`rows` in place of all rows of their files; files of `gone` (key) without any rows. False if the batch was committed before.

        It writes the rows and one row for each file, whatever the table holds.
        """
        if batch is not None and any(x.get("batch") == batch for _, x in self._all()):
            return False
        folder = f"segment-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}/rows")
        named = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}/rows").select(self.key)
        if gone is not None:
            named = named.unionByName(gone.select(self.key))
        named.distinct().write.parquet(f"{self.root}/{folder}/files")
        self._append({"segment": folder, "batch": batch})
        return True

    def _append(self, entry: dict) -> int:
        while True:
            known = self.log.numbers()
            number = known[-1] + 1 if known else 0
            if self.log.commit(number, json.dumps(entry)):
                return number

    def exists(self) -> bool:
        return bool(self.log.numbers())

    def read(self) -> DataFrame:
        """Each file's rows from the newest segment that names it, else from the base.

        The files' names are grouped after combining on the map side; the base is filtered by the
        files of the segments, which Spark broadcasts while they are few.
        """
        return self._merged(self._entries())

    def _merged(self, entries: list[tuple[int, dict]]) -> DataFrame:
        if not entries:
            raise ValueError(f"{self.root} has no commit")
        base = next((x["base"] for _, x in entries if "base" in x), None)
        held = self.spark.read.parquet(f"{self.root}/{base}") if base else None
        segments = [(n, x["segment"]) for n, x in entries if "segment" in x]
        if not segments:
            return held
        number = F.create_map(*(F.lit(v) for n, folder in segments for v in (folder, n)))[F.element_at(F.split(F.input_file_name(), "/"), -3)]
        of = lambda kind: self.spark.read.parquet(*(f"{self.root}/{folder}/{kind}" for _, folder in segments)).withColumn("_segment", number)
        newest = of("files").groupBy(F.col(self.key).alias("_file")).agg(F.max("_segment").alias("_newest"))
        same = F.col(self.key).eqNullSafe(F.col("_file"))  # rows without a file are a file of their own
        rows = of("rows").join(newest, same & (F.col("_segment") == F.col("_newest")), "left_semi").drop("_segment")
        return rows if held is None else held.join(newest, same, "left_anti").unionByName(rows)

    def compact(self) -> bool:
        """Write what a reader sees as the new base; segments that are committed meanwhile stay above it.

        False if there is nothing to merge, or if another compaction reached as far.
        """
        entries = self._entries()
        segments = [n for n, x in entries if "segment" in x]
        if not segments:
            return False
        folder = f"base-{uuid.uuid4().hex}"
        self._merged(entries).write.parquet(f"{self.root}/{folder}")
        if any(x.get("through", -1) >= segments[-1] for _, x in self._entries() if "base" in x):
            return False
        self._append({"base": folder, "through": segments[-1]})
        return True

    def vacuum(self) -> list[str]:
        """Delete folders that the newest base replaces; run it when no reader of an older state is left. Unfinished writes stay."""
        live = {x.get("segment") or x.get("base") for _, x in self._entries()}
        gone = [f for f in ((x.get("segment") or x.get("base")) for _, x in self._all()) if f not in live]
        fs, _ = _fs(self.spark, self.root)
        out = []
        for folder in gone:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
            if fs.exists(path) and fs.delete(path, True):
                out.append(folder)
        return out
