"""Sinks: replaceable tables by generation, traces by day, run folders."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written into the scratch folder and read again, for what is used several times; an executor that is lost takes nothing along."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class GenerationTable:
    """A table that is rebuilt whole: a new folder is written, then a pointer file is replaced by one rename (SNK-07).

    Readers see the old generation until the pointer names the new one; a lost job leaves the old.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> str:
        return f"{self.root}/CURRENT"

    def replace(self, df: DataFrame, partition_by: list[str] | None = None) -> None:
        folder = f"generation-{uuid.uuid4().hex}"
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/{folder}")
        fs, target = _fs(self.spark, self._pointer())
        jvm = self.spark.sparkContext._jvm
        temporary = jvm.org.apache.hadoop.fs.Path(f"{self._pointer()}.{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(folder.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(fs.makeQualified(temporary), fs.makeQualified(target), overwrite)

    def exists(self) -> bool:
        """Whether any generation was ever written."""
        fs, target = _fs(self.spark, self._pointer())
        return fs.exists(target)

    def read(self) -> DataFrame:
        folder = self.spark.read.text(self._pointer()).first()[0]
        return self.spark.read.parquet(f"{self.root}/{folder}")


def append_traces(events: DataFrame, path: str, ts: str = "ts") -> None:
    """JSON lines by UTC day (SNK-08)."""
    events.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def save_run(results: DataFrame, summary: dict, config: dict, path: str) -> None:
    """results as JSON lines, summary and config beside them (SNK-09)."""
    results.write.mode("overwrite").json(f"{path}/results")
    for name, value in (("summary", summary), ("config", config)):
        results.sparkSession.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
