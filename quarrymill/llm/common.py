"""What the operators of this subpackage share: scratch tables, label splits, bounded samples."""

from __future__ import annotations

import atexit
import ctypes
import pickle
import re
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get this code with each task, so that a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt to all cores if its files make fewer partitions than there are cores.

    That happens to small tables in one file only; a large table is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset: a temporary one if driver and executors are one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet into the shared folder and read it again.

    The files outlive lost executors; they go by `release`, by `drop_scratch`, or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quarrymill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*written: DataFrame) -> None:
    """Delete what `materialize` wrote for these; whatever read it must be written itself by now."""
    for df in written:
        _delete(df.sparkSession, df.scratch_path)
        _SCRATCH.remove((df.sparkSession, df.scratch_path))


#: Ids of one broadcast set, about 30 MB as a hashed relation.
BROADCAST_IDS = 500_000


def counted(ids: DataFrame, name: str) -> DataFrame:
    """One column of distinct ids, written and counted; broadcast up to BROADCAST_IDS, joined by a shuffle beyond.

    A set that may be broadcast spares the shuffle of the texts it selects.
    """
    ids = materialize(ids, name)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as the side of a join that is never broadcast.

    Files of ids are small on disk and large as hashed relations, which the driver builds: a side that grows
    with the input is sorted and merged by the tasks, so that the driver's memory does not grow with it.
    """
    return df.hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch() -> None:
    """Delete what `materialize` wrote so far; results that still read it must be done."""
    while _SCRATCH:
        try:
            _delete(*_SCRATCH.pop())
        except Exception:  # the session may be gone at exit; its folder goes with the cluster
            return


atexit.register(drop_scratch)


def in_split(doc_id: Column, buckets: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves `remainder`; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(buckets) == F.lit(remainder), F.lit(False))


def bounded_labels(labels: DataFrame, label: str, max_rows: int, held_out: Column, balanced: bool = False) -> DataFrame:
    """At most `max_rows` (doc_id, label) outside `held_out`, chosen by a hash of the id.

    Null labels go, as do ids whose rows disagree. The number of rows is known before the
    sort, so that only about twice the bound is ever sorted. `balanced` takes up to half of
    the rows from each of the labels 0 and 1 and adds the `weight` that restores their shares.
    """
    rows = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .filter(F.col("label") == F.col("_most"))
        .select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("_h"))
    )
    if not balanced:
        return _first_by_hash(rows, rows.count(), max_rows)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().filter(F.col("label").isin(0, 1)).collect()}
    parts = [_first_by_hash(rows.filter(F.col("label") == y), sizes.get(y, 0), max_rows // 2) for y in (0, 1)]
    weight = F.create_map(*(F.lit(x) for y in (0, 1) for x in (y, max(1.0, sizes.get(y, 0) / (max_rows // 2)))))
    return parts[0].unionByName(parts[1]).withColumn("weight", weight[F.col("label")])


def _first_by_hash(rows: DataFrame, n: int, most: int) -> DataFrame:
    if n > 2 * most:
        slots = 1_000_000
        rows = rows.filter(F.pmod(F.col("_h"), F.lit(slots)) < int(slots * 2 * most / n) + 1)
    return rows.orderBy("_h", "_id").limit(most).select("_id", "label")


def labelled_texts(docs: DataFrame, sample: DataFrame, max_chars: int) -> DataFrame:
    """(_id, text, label, ...) of the sampled ids, written; the sample is bounded, so it may be broadcast.

    An id on several rows counts once, with the text whose hash is smallest. Texts are taken in
    the order of a hash of their ids, each that still fits into `max_chars` beside those taken before,
    so that the bytes are bounded too; one that does not fit is passed over and keeps no other out.
    """
    text = F.coalesce("text", F.lit(""))
    one = docs.select(F.col("doc_id").alias("_id"), text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(sample.select("_id")), "_id")
    one = one.groupBy("_id").agg(F.min_by("text", "h").alias("text")).join(F.broadcast(sample), "_id")
    one = spread(materialize(one.select("_id", "text", *(c for c in sample.columns if c != "_id")), "labelled"))
    if (one.agg(F.sum(F.length("text"))).first()[0] or 0) <= max_chars:
        return one
    kept, left = [], max_chars
    for r in one.select("_id", F.length("text").alias("n")).orderBy(F.xxhash64("_id"), "_id").collect():  # a row for each of the bounded sample
        if r["n"] <= left:
            kept.append((r["_id"],))
            left -= r["n"]
    return one.join(F.broadcast(docs.sparkSession.createDataFrame(kept, one.select("_id").schema)), "_id")


def share(spark: SparkSession, model):
    """Broadcast a fitted model, of bounded size, with its class; the result gives it to a worker."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)


#: Bytes of text that a worker turns into Python strings at once.
SLICE_BYTES = 4 << 20


def slices(batches, column: str, most: int = SLICE_BYTES):
    """Record batches of at most about `most` bytes of `column` each (one row at least); memory goes back when all are done.

    Only such a slice is ever turned into Python objects, however many rows a batch has.
    """
    for batch in batches:
        at, n = 0, batch.num_rows
        if n and batch.schema.field(column).type not in (pa.string(), pa.binary(), pa.large_string()):
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if n else []
        while at < n:
            begin = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, begin + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


_SPACE = re.compile(r"\s")


def cut(text: str, most: int = 1 << 20):
    """The text in parts of about `most` characters, cut at white space: their words are the text's words."""
    at = 0
    while len(text) - at > most and (m := _SPACE.search(text, at + most)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def give_back() -> None:
    """Return a worker's free memory to the system; it serves other stages later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to ask
        pass


def kept_by_worker(key: str, make):
    """What `make` gives, kept by a Python worker from task to task: workers are reused, code is sent anew.

    A worker keeps one thing at a time, so that a pipeline's stages don't add up in its memory.
    """
    home = sys.modules.setdefault("_quarrymill_worker", types.ModuleType("_quarrymill_worker"))
    held = home.__dict__.setdefault("held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def forget_kept() -> None:
    """Let go of what this worker keeps for another stage; for stages that keep nothing."""
    home = sys.modules.get("_quarrymill_worker")
    if home is not None and home.__dict__.get("held"):
        home.held.clear()
        give_back()


def span_digest(spans, kinds):
    """kind:start:end by start, then kind as listed (others after them, by name), joined by commas."""
    place = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.coalesce(place[s["kind"]], F.lit(len(kinds))).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(span_digest(base, kinds), 256).alias("base_sha256"), span_digest(F.col("spans"), kinds).alias("spans"))
