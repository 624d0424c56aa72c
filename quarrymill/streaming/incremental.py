"""Structured Streaming forms of the incremental behaviours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.merge_table import MergeTable


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", slide: str | None = None, by: tuple[str, ...] = ("event_type",), late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window; late rows within the watermark still count. Works on batches and streams."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_ts", late)
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    return timed.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after `gap` without an event."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_ts", late)
    out = timed.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def first_seen(events: DataFrame, key: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream without repeats inside the watermark."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(key)


def page_hinkley_stream(events: DataFrame, key: str, step: str, value: str, delta: float = 0.005, threshold: float = 5.0, least: int = 30) -> DataFrame:
    """Alarms of the Page-Hinkley test along each series of a stream; the running sums are the state (MON-05)."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, cum, low = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        alarms = []
        rows = pd.concat(batches).sort_values(step)
        for t, x in zip(rows[step], rows[value], strict=True):
            n += 1
            mean += (x - mean) / n
            cum += x - mean - delta
            low = min(low, cum)
            if n >= least and cum - low > threshold:
                alarms.append(t)
                n, mean, cum, low = 0, 0.0, 0.0, 0.0
        state.update((n, mean, cum, low))
        yield pd.DataFrame({key: [keys[0]] * len(alarms), step: alarms})

    kinds = dict(events.dtypes)
    return events.select(key, step, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {step} {kinds[step]}", "n long, mean double, cum double, low double", "append", GroupStateTimeout.NoTimeout)


def upsert_files(stream: DataFrame, table: MergeTable, checkpoint: str | None = None, version: str | None = None, gone: str | None = None):
    """Each micro-batch replaces the rows of its files in a MergeTable (SNK-01 as a stream); it writes its own rows and no others.

    With `version`, only the rows of a file's latest version in the batch count. Rows for which the
    condition `gone` holds take their file away. A batch that fails is tried again under its number, and
    is applied once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if version:
            newest = batch.groupBy(table.key).agg(F.max(version).alias("_newest"))
            batch = batch.join(newest, table.key).filter(F.col(version) == F.col("_newest")).drop("_newest")
        left = F.coalesce(F.expr(gone), F.lit(False)) if gone else F.lit(False)
        table.replace(batch.filter(~left), batch.filter(left) if gone else None, batch=f"{checkpoint}:{number}" if checkpoint else None)

    w = stream.writeStream.foreachBatch(apply)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).trigger(availableNow=True).start()
