"""Structured Streaming over event files: windows, and keyed state as deltas that are merged when read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.operators.core import latest_by

Merge = Callable[[DataFrame], DataFrame]


def event_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, at: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Counts and sums per window; rows later than ``late`` behind the newest are dropped with their state."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def latest(keys: list[str], order: list[str]) -> Merge:
    """The greatest-order row of each key: a late event loses by comparison, whatever batch it comes in."""
    return lambda rows: latest_by(rows, keys, order)


def sums(keys: list[str], value: str = "delta") -> Merge:
    """The sum of each key."""
    return lambda rows: rows.groupBy(*keys).agg(F.sum(value).alias(value))


def into_deltas(events: DataFrame, merge: Merge, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch, merged by itself, is a folder of its own: its cost follows the batch, not the state. A repeated batch rewrites its folder."""

    def fold(batch: DataFrame, number: int) -> None:
        merge(batch).write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished folders NAME=number below a path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [x.getPath() for x in fs.listStatus(at)]
    return sorted(int(p.getName().partition("=")[2]) for p in found if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def state(spark: SparkSession, path: str, merge: Merge) -> DataFrame | None:
    """The merged state: the last compaction and the deltas after it. None before the first batch."""
    bases, deltas = _folders(spark, f"{path}/bases"), _folders(spark, f"{path}/deltas")
    upto = bases[-1] if bases else -1
    parts = [f"{path}/bases/upto={upto}"] * bool(bases) + [f"{path}/deltas/batch={k}" for k in deltas if k > upto]
    return merge(spark.read.parquet(*parts)) if parts else None


def compact(spark: SparkSession, path: str, merge: Merge, keep: str | None = None) -> None:
    """Writes the state as the base of later reads; ``keep`` is a condition on what is worth keeping, as balance above 0. Readers see the old base until the new one is finished."""
    deltas = _folders(spark, f"{path}/deltas")
    now = state(spark, path, merge)
    if now is not None and deltas and deltas[-1] not in _folders(spark, f"{path}/bases"):
        (now.where(keep) if keep else now).write.mode("overwrite").parquet(f"{path}/bases/upto={deltas[-1]}")
