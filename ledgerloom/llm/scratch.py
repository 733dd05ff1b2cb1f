"""Tables written to the shared checkpoint folder, to cut lineage where an executor's loss must not cost a recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, DoubleType, LongType, StringType, StructField, StructType


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine (tests) a temporary one, set from then on."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        at = sc.getCheckpointDir()
    return f"{at.rstrip('/')}/ledgerloom-{sc.applicationId}"


def with_columns(df: DataFrame, **kinds: str) -> StructType:
    """df's schema and more columns."""
    return StructType([*df.schema.fields, *(StructField(k, _parse(v)) for k, v in kinds.items())])


def _parse(kind: str) -> DataType:
    return {"double": DoubleType(), "string": StringType(), "long": LongType()}[kind]


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__ ... that no column of df has, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the checkpoint folder once, and reads it back from there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """As written, in n buckets by a column: a join on it moves only the other side. The table's name is in the session's catalog."""
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(n, column).sortBy(column).option("path", f"{folder(spark)}/{own}").saveAsTable(own)
    return spark.table(own)


def cleared(spark: SparkSession) -> None:
    """Deletes every table that this application wrote; results that still read them are lost."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
