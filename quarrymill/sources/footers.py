"""Parquet files by their footers and row positions: no column is read to know what a file holds (SRC-23)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FooterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _open(self, path: str):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else FileSystem.from_uri("file://" + path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, place = self._open(self.path)
        if fs.get_file_info(place).type == FileType.File:
            return [_File(self.path)]
        found = fs.get_file_info(FileSelector(place, recursive=True))
        head = self.path[: len(self.path) - len(place)] if self.path.endswith(place) else ""
        return [_File(head + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == FileType.File and f.path.endswith(".parquet")]

    def read(self, partition: _File) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        fs, place = self._open(partition.path)
        with fs.open_input_file(place) as file:
            footer, first = pq.ParquetFile(file).metadata, 0
            for g in range(footer.num_row_groups):
                group = footer.row_group(g)
                yield partition.path, g, first, group.num_rows, group.total_byte_size
                first += group.num_rows


class ParquetFooters(DataSource):
    """`spark.read.format("parquet_footers").load(path)`: a row for each row group of a file, or of a folder's files; a task reads a file's footer.

    Paths are those that Arrow can open: local, HDFS, S3 and the like.
    """

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return "path string, row_group int, first_row long, rows long, bytes long"

    def reader(self, schema) -> DataSourceReader:
        return _FooterReader(self.options["path"])


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_group, first_row, rows, bytes) of the Parquet files under a path."""
    spark.dataSource.register(ParquetFooters)
    return spark.read.format("parquet_footers").load(path)


def with_positions(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of Parquet files with `file` and `position`, the row's place in its file: what readers know without a shuffle."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("position"))


def table_positions(spark: SparkSession, path: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table's Parquet files with `file`, which is `name`, and `position`, the row's place in the table: its files one after the other by path.

    Files are counted first, without a column; their rows stay where they are.
    """
    rows = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    files = rows.groupBy("_path").agg(F.count("*").alias("_n")).select("_path", before.alias("_before"))
    return rows.join(F.broadcast(files), "_path").select(*columns, F.lit(name).alias("file"), (F.col("_before") + F.col("_row")).alias("position"))


def positional_split(rows: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """`fold` of each row (file, position): a digest of seed, file and position, so that a split is the same whenever files are."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "file", F.col("position").cast("string")))
    return rows.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int"))


def take_positions(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows at given places (file, position), in no particular order; places that no file has give none."""
    return rows.join(wanted.select("file", "position").distinct(), ["file", "position"], "left_semi")
