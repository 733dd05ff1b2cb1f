"""Event tables with declared schemas, pinned to a block where asked, and sinks that may run twice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DecimalType, LongType, StringType, StructField, StructType

# The header that every event table starts with.
HEADER = (("block_number", "Int"), ("timestamp", "Int"), ("transaction_index", "Int"), ("log_index", "Int"), ("transaction_hash", "String"))
KEY = ("block_number", "transaction_index", "log_index")
TYPES: dict[str, DataType] = {"Boolean": BooleanType(), "Address": StringType(), "Int": LongType(), "BigInt": DecimalType(38, 0), "String": StringType(), "Bytes": BinaryType(), "Json": StringType()}
# Solidity types and the column type each is stored as.
SOLIDITY = {"address": "Address", "bool": "Boolean", "string": "String", "bytes": "Bytes", "bytes32": "Bytes", "uint8": "Int", "uint16": "Int", "uint32": "Int", "uint64": "Int", "uint72": "BigInt", "uint128": "BigInt", "uint256": "BigInt", "int256": "BigInt"}


RANGE = "block_range"
BLOCKS = ("System", "Block")


@dataclass(frozen=True)
class Table:
    namespace: str
    name: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...] = KEY

    @property
    def schema(self) -> StructType:
        return StructType([StructField(n, TYPES[t], True, {"kind": t, "key": n in self.key}) for n, t in self.columns])


def from_signature(namespace: str, signature: str, batch: bool = False) -> Table:
    """A table from an event signature, as ``event Trust(address indexed truster, address indexed trustee, uint256 expiry)``."""
    head, _, body = signature.strip().removeprefix("event").strip().partition("(")
    own = []
    for part in filter(None, (x.strip() for x in body.rstrip(";) ").split(","))):
        kind, *rest = part.split()
        own.append((rest[-1] if rest else f"arg{len(own)}", SOLIDITY[kind]))
    return Table(namespace, head.strip(), (*HEADER, *own, *([("batch_index", "Int")] * batch)), KEY + ("batch_index",) * batch)


@dataclass
class Catalog:
    """Tables by (namespace, name), in folders of ``span`` blocks. ``at`` pins every event table to blocks up to a number, and time to that block's."""

    spark: SparkSession
    root: str
    tables: dict[tuple[str, str], Table] = field(default_factory=dict)
    block: int | None = None
    span: int = 100_000  # blocks that share a folder

    def add(self, table: Table) -> Catalog:
        self.tables[table.namespace, table.name] = table
        return self

    def at(self, block: int) -> Catalog:
        return Catalog(self.spark, self.root, self.tables, block, self.span)

    def path(self, namespace: str, name: str) -> str:
        return f"{self.root}/{namespace}_{name}"

    def known(self, namespace: str, name: str) -> Table:
        if (namespace, name) not in self.tables:
            raise ValueError(f"unknown table {namespace}.{name}")
        return self.tables[namespace, name]

    def _stored(self, namespace: str, name: str) -> DataFrame:
        """The rows with their block range, which is the folder they are in; empty before the first batch."""
        schema = StructType([*self.known(namespace, name).schema, StructField(RANGE, LongType())])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(namespace, name))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(namespace, name))

    def read(self, namespace: str, name: str) -> DataFrame:
        df = self._stored(namespace, name)
        if self.block is not None:
            df = df.where((F.col("block_number") <= self.block) & (F.col(RANGE) <= self.block // self.span))
        return df.drop(RANGE)

    def describe(self) -> DataFrame:
        rows = [(ns, n, c, t) for (ns, n), table in sorted(self.tables.items()) if ns != "System" for c, t in table.columns]
        return self.spark.createDataFrame(rows, "namespace string, table_name string, column_name string, type string")

    def _ranged(self, table: Table, rows: DataFrame) -> DataFrame:
        own = rows.select(*[F.col(c).cast(TYPES[t]).alias(c) for c, t in table.columns])
        return own.withColumn(RANGE, F.floor(F.col("block_number") / self.span))

    def append(self, namespace: str, name: str, rows: DataFrame) -> None:
        """Adds rows whose key is not there yet: running it again changes nothing. Only the block ranges of the batch are read."""
        table = self.known(namespace, name)
        fresh = self._ranged(table, rows).dropDuplicates(list(table.key))
        low, high = fresh.agg(F.min(RANGE), F.max(RANGE)).first()
        if low is None:
            return
        old = self._stored(namespace, name).where(F.col(RANGE).between(low, high)).select(RANGE, *table.key)
        fresh.join(old, [RANGE, *table.key], "left_anti").select(*[c for c, _ in table.columns], RANGE).write.mode("append").partitionBy(RANGE).parquet(self.path(namespace, name))

    def flush(self, batches: dict[tuple[str, str], DataFrame], blocks: DataFrame) -> None:
        """One batch over several tables. The blocks are written last and stand for its completion: at(complete()) never shows a part of a batch, and a batch that broke off is run again."""
        for (ns, name), rows in batches.items():
            self.append(ns, name, rows)
        self.append(*BLOCKS, blocks)

    def complete(self) -> int | None:
        """The last block that is complete in all tables."""
        return self.read(*BLOCKS).agg(F.max("block_number")).first()[0]

    def rewind(self, block: int) -> None:
        """Deletes events from ``block`` on in all tables, blocks first. Whole block ranges go; the one that the block is in is written anew and swapped in by the commit. A rewind that broke off is run again: nothing before the block is ever gone."""
        names = sorted(self.tables, key=lambda k: k != BLOCKS)
        for ns, name in names:
            self._replace(ns, name, block, None, None)

    def backfill(self, namespace: str, name: str, rows: DataFrame, low: int, high: int) -> None:
        """Replaces the blocks from low to high of one table by rows of the same blocks."""
        self._replace(namespace, name, low, high, rows)

    def _replace(self, ns: str, name: str, low: int, high: int | None, rows: DataFrame | None) -> None:
        table = self.known(ns, name)
        first, last = low // self.span, None if high is None else high // self.span
        inside = (F.col("block_number") >= low) & (F.lit(True) if high is None else F.col("block_number") <= high)
        edges = [first] if last is None else [first, last]
        kept = self._stored(ns, name).where(F.col(RANGE).isin(*edges) & ~inside)
        if rows is not None:
            fresh = self._ranged(table, rows).where(inside).dropDuplicates(list(table.key))
            kept = kept.select(*fresh.columns).unionByName(fresh)
        have = {r[0] for r in self._stored(ns, name).where(F.col(RANGE) >= first).select(RANGE).distinct().collect()}
        full = {r[0] for r in kept.select(RANGE).distinct().collect()}
        gone = sorted((k for k in have - full if last is None or k <= last), reverse=True)
        jvm = self.spark._jvm
        for k in gone:  # newest first: what is left is always a prefix
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path(ns, name)}/{RANGE}={k}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if full:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(self.path(ns, name))


def decoded_batch(df: DataFrame, ids: str, values: str) -> DataFrame:
    """One row for each element of parallel arrays, with batch_index."""
    out = df.select("*", F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(values).alias("value"))).alias("batch_index", "_e"))
    return out.drop(ids, values).select("*", "_e.id", "_e.value").drop("_e")
