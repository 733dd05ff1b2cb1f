"""Dated snapshots of a table, a folder each: written once a day, kept for a while, compared with the newest one that is old enough but not stale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400
TAKEN = "taken"


@dataclass
class History:
    """Snapshots below a folder that all machines share. Times are seconds; a snapshot's folder names its time, so readers prune by it."""

    spark: SparkSession
    root: str

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def times(self) -> list[int]:
        """The times of the complete snapshots, oldest first: one number each, from the folder's names. A snapshot that broke off has no mark of success and doesn't count."""
        path, fs = self._path(self.root)
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()]
        own = [int(n.removeprefix(f"{TAKEN}=")) for n in names if n.startswith(f"{TAKEN}=")]
        return sorted(k for k in own if fs.exists(self._path(f"{self._folder(k)}/_SUCCESS")[0]))

    def _folder(self, at: int) -> str:
        return f"{self.root}/{TAKEN}={at}"

    def add(self, rows: DataFrame, at: int, apart: int = 23 * HOUR) -> bool:
        """Writes a snapshot, unless one was taken in the time before it: running it again changes nothing. One that broke off is written anew."""
        if any(at - apart < k <= at for k in self.times()):
            return False
        rows.write.mode("overwrite").parquet(self._folder(at))
        return True

    def expire(self, at: int, days: int = 90) -> list[int]:
        """Deletes snapshots older than so many days, the oldest first, and returns their times."""
        gone = [k for k in self.times() if k < at - days * DAY]
        for k in gone:
            path, fs = self._path(self._folder(k))
            fs.delete(path, True)
        return gone

    def before(self, at: int, window: int, stale: int = 48 * HOUR) -> int | None:
        """The time of the newest snapshot older than the window; none if there is none, or if the newest of all is older than `stale` or not from before."""
        times = self.times()
        if not times or not 0 < at - times[-1] <= stale:
            return None
        return max((k for k in times if k < at - window), default=None)

    def read(self, at: int) -> DataFrame:
        return self.spark.read.parquet(self._folder(at)).withColumn(TAKEN, F.lit(at))


def changes(history: History, current: DataFrame, key: str, value: str, at: int, window: int, drop: int = 20, spike: int = 30) -> DataFrame:
    """One row: how many keys are in both, how many fell by more than `drop` and rose by more than `spike`, and how many fell or rose at all. All are 0 without a snapshot to compare with."""
    then = history.before(at, window)
    old = history.read(then) if then is not None else current.limit(0)
    both = current.select(key, F.col(value).alias("_now")).join(old.select(key, F.col(value).alias("_was")), key)
    rose = F.col("_now") - F.col("_was")
    return both.agg(F.count("*").alias("compared"), F.count_if(-rose > drop).alias("drops"), F.count_if(rose > spike).alias("spikes"), F.count_if(rose < 0).alias("fell"), F.count_if(rose > 0).alias("rose"))
