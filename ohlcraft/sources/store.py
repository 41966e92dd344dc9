"""Derived tables written once per application and read back with column pruning.

Bars are thousands of times smaller than the ticks they come from and every
indicator reads them several times, so they are written to the shared folder the
cluster names in ``spark.checkpoint.dir`` instead of being recomputed from ticks.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for derived tables: the session's checkpoint folder.

    Only a session on one machine without the setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-ohlcraft-"))
    return _OWN[0]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


_SCHEMAS: dict[str, object] = {}


def stored(
    spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], partitions: list[str] | None = None
) -> DataFrame:
    """Read ``name`` derived from ``source``; build and write it if it is not there yet."""
    tag = hashlib.md5(source.encode()).hexdigest()[:10]
    app = re.sub(r"[^A-Za-z0-9-]", "_", spark.sparkContext.applicationId)
    path = f"{shared_dir(spark)}/ohlcraft/{app}/{name}-{tag}"
    if not _exists(spark, path):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
        _SCHEMAS.pop(path, None)
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used between the stages of long recursions: each stage reads its input twice, so
    without a cut the work would double with every stage. The files outlive executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ohlcraft/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
