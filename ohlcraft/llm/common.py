"""Shared helpers: table reads, stage tables in the cluster's shared folder, text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words of the substring, mixing and near-duplicate operators.
BLANK = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session without the setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="spark-llm-")
    return shared_folder.own


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors, and is computed once for several readers."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str, total: str) -> DataFrame:
    """0-based rank of each row inside ``keys`` and the number of rows of its key, without a key or a tie in one task.

    Rows are range-partitioned by keys and order and written with their partition; a rank is the rank in the partition plus
    the rows of the key in earlier ones. Only one row per key and partition meets in a window.
    """
    parted = staged(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, "_part", before.alias("_before"), F.sum("_rows").over(whole).alias(total))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return parted.join(offsets, [*keys, "_part"]).withColumn(rank, (F.col("_before") + inside - 1).cast("long")).drop("_part", "_before")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system at the end of a task: Python workers live on beside later stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a per-task set-up: ``make()`` runs once in each task and returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]
                out = None
        batch = None
        release()

    return df.mapInArrow(run, schema)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their keys, from batches in key order. Holds one unfinished key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [tuple(batch[k][i].as_py() for k in keys) for i in (0, batch.num_rows - 1)]
        if ends[1] == (ends[0] if last is None else last) == ends[0]:
            held.append(batch)
        else:
            same = np.ones(batch.num_rows, bool)
            for k, v in zip(keys, ends[1], strict=True):
                same &= batch[k].to_numpy(zero_copy_only=False) == v
            at = int(np.argmax(same))
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
            held = [batch.slice(at)]
        last = ends[1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs_of(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """Start and end of each key's rows."""
    key = np.stack([table[k].to_numpy() for k in keys], axis=1)
    cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True]).tolist() if len(key) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def smallest_linked(link: np.ndarray) -> np.ndarray:
    """The first row that each row reaches over a symmetric link matrix."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Arrays that one task adds up.
FAN_IN = 64


def packed_counts(counts: np.ndarray, segment: int) -> pa.RecordBatch:
    """A task's counters as rows of a segment each, to be added up by :func:`summed_counts`; empty segments are left out."""
    parts = counts.astype(np.int64).reshape(-1, segment)
    some = np.flatnonzero(parts.any(axis=1))
    node = pa.array([TaskContext.get().partitionId()] * len(some), pa.int64())
    return pa.RecordBatch.from_arrays([node, pa.array(some, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())], names=["node", "segment", "counts"])


COUNTS = "node long, segment int, counts binary"


def summed_counts(parts: DataFrame, size: int, segment: int, tasks: int) -> np.ndarray:
    """Sum of the counters of all tasks, by a tree in which no task adds up more than ``FAN_IN`` arrays of a segment."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(segment, np.int64)
        for x in table["counts"]:
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return pa.table({"node": table["node"][:1], "segment": table["segment"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("node", F.expr(f"node div {FAN_IN}")).groupBy("segment", "node").applyInArrow(add, COUNTS)
    out = np.zeros((-(-size // segment), segment), np.int64)
    for r in parts.collect():  # one row per segment, or a few if the plan ran in more tasks than it was asked about
        out[r.segment] += np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out.ravel()[:size]
