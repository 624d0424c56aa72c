"""Table functions, as DataFrames and in SQL: windows of lines, and drift detectors that walk a series row by row.

A detector takes its table by `PARTITION BY key ORDER BY step`: Spark deals the series, sorts each and
streams it past a few numbers of state, so that no series is held, however long it is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="key string, line_start int, line_end int")
class LineWindows:
    """Windows of `size` lines that overlap, of rows (key, text): as line_windows; null texts have none."""

    def eval(self, size: int, overlap: int, row: Row):
        n = 0 if row["text"] is None else row["text"].count("\n") + 1
        at = 0
        while at < n:
            end = min(at + size, n)
            yield row["key"], at, end
            if end == n:
                return
            at += max(size - overlap, 1)


@F.udtf(returnType="key string, step long")
class PageHinkley:
    """Alarms of the Page-Hinkley test for a rising mean along rows (key, step, value); it starts anew after each (MON-05)."""

    def __init__(self):
        self.n, self.mean, self.cum, self.low = 0, 0.0, 0.0, 0.0

    def eval(self, delta: float, threshold: float, least: int, row: Row):
        if row["value"] is None:
            return
        self.n += 1
        self.mean += (row["value"] - self.mean) / self.n
        self.cum += row["value"] - self.mean - delta
        self.low = min(self.low, self.cum)
        if self.n >= least and self.cum - self.low > threshold:
            self.__init__()
            yield row["key"], row["step"]


@F.udtf(returnType="key string, step long")
class DriftDetection:
    """Alarms of the drift detection method along rows (key, step, value) of errors, 0 or 1; it starts anew after each (MON-05)."""

    def __init__(self):
        self.n, self.p, self.best_p, self.best_s = 0, 0.0, math.inf, math.inf

    def eval(self, level: float, least: int, row: Row):
        if row["value"] is None:
            return
        self.n += 1
        self.p += (row["value"] - self.p) / self.n
        s = math.sqrt(self.p * (1 - self.p) / self.n)
        if self.n < least:
            return
        if self.p + s < self.best_p + self.best_s:
            self.best_p, self.best_s = self.p, s
        if self.p + s > self.best_p + level * self.best_s:
            self.__init__()
            yield row["key"], row["step"]


#: Names of the functions in SQL.
TABLE_FUNCTIONS = {"line_windows": LineWindows, "page_hinkley": PageHinkley, "drift_detection": DriftDetection}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL (UDF-07): `SELECT * FROM page_hinkley(0.005D, 5D, 30, TABLE(series) PARTITION BY key ORDER BY step)`."""
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)


def detect(series: DataFrame, key: str, step: str, value: str, detector: str = "page_hinkley", **parameters: float) -> DataFrame:
    """(key, step): alarms of a detector along each series."""
    kinds = dict(series.dtypes)
    known = {"page_hinkley": {"delta": 0.005, "threshold": 5.0, "least": 30}, "drift_detection": {"level": 3.0, "least": 30}}[detector] | parameters
    rows = series.select(F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    found = TABLE_FUNCTIONS[detector](*map(F.lit, known.values()), rows.asTable().partitionBy("key").orderBy("step"))
    return found.select(F.col("key").cast(kinds[key]).alias(key), F.col("step").cast(kinds[step]).alias(step))
