"""Raw contract logs to typed event tables: dispatch by topic in one scan, decoding by expressions.

A log has the header of the event tables, ``emitter``, ``topics`` (array<binary>)
and ``data`` (binary). What a topic means is a small table, made of declared
signatures, that is broadcast; every row is then read by one expression that
goes through its event's fields, however many events there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import abi, keccak
from ledgerloom.sources.tables import HEADER, KEY, SOLIDITY, TYPES, Table

HEAD = [n for n, _ in HEADER]
LAYOUT = "topic binary, of_emitter string, event string, fields array<struct<name: string, kind: string, topic: boolean, place: int>>, batch boolean"


@dataclass(frozen=True)
class Event:
    """An event by its signature, as ``Trust(address indexed truster, address indexed trustee, uint256 expiry)``. ``emitter`` tells events of one signature apart; a batch has parallel arrays, each element a row."""

    namespace: str
    signature: str
    emitter: str | None = None
    batch: bool = False

    @property
    def name(self) -> str:
        return self.signature.partition("(")[0].removeprefix("event").strip()

    @property
    def columns(self) -> list[tuple[str, str, bool]]:
        """(column, type, whether it is a topic). A dynamic value is in the data even where it is called indexed."""
        out = []
        for part in filter(None, (x.strip() for x in self.signature.partition("(")[2].rstrip("); ").split(","))):
            kind, *rest = part.split()
            out.append((rest[-1] if rest else f"arg{len(out)}", kind, "indexed" in rest[:-1] and not abi.dynamic(kind)))
        return out

    @property
    def key(self) -> str:
        return f"{self.namespace}_{self.name}"

    @property
    def topic(self) -> bytes:
        return keccak.topic(f"{self.name}({','.join(kind for _, kind, _ in self.columns)})")

    @property
    def layout(self) -> tuple:
        fields, topics, words = [], 0, 0
        for name, kind, indexed in self.columns:
            topics, words = topics + indexed, words + (not indexed)
            fields.append((name, abi.kind(kind), indexed, topics if indexed else words - 1))
        return bytearray(self.topic), self.emitter, self.key, fields, self.batch

    @property
    def table(self) -> Table:
        """The table of its rows; arrays that aren't a batch are JSON."""
        own = [(n, SOLIDITY.get(k.removesuffix("[]") if self.batch else k, "Json")) for n, k, _ in self.columns]
        return Table(self.namespace, self.name, (*HEADER, ("emitter", "Address"), *own, *([("batch_index", "Int")] * self.batch)), KEY + ("batch_index",) * self.batch)


def decoded(logs: DataFrame, events: list[Event]) -> DataFrame:
    """Header, emitter, event, names, values, broken: one row for each log of a known topic.

    values holds an array of texts for each field. A log whose topics or data
    end before a field does has no values, and the first such field's name in
    ``broken``; in a batch, arrays of different lengths are broken as well. Logs
    without topics, of unknown topics or of other emitters are left out.
    """
    layouts = F.broadcast(logs.sparkSession.createDataFrame([e.layout for e in events], LAYOUT))
    rows = logs.where(F.size("topics") > 0).withColumn("topic", F.col("topics")[0]).join(layouts, "topic").where("of_emitter is null or of_emitter = emitter")
    word = lambda f: F.when(f["topic"], F.get("topics", f["place"])).otherwise(abi.piece(F.col("data"), abi.WORD * f["place"], abi.WORD))
    rows = rows.select(*HEAD, "emitter", "event", "batch", F.transform("fields", lambda f: f["name"]).alias("names"), F.transform("fields", lambda f: abi.value(f["kind"], word(f), F.col("data"))).alias("values"), F.transform("fields", lambda f: f["kind"].endswith("[]")).alias("arrays"))
    lengths = F.array_distinct(F.filter(F.zip_with("arrays", "values", lambda a, v: F.when(a, F.size(v))), lambda n: n.isNotNull()))
    missing = F.exists("values", lambda v: v.isNull())
    broken = F.when(missing, F.try_element_at(F.filter(F.zip_with("names", "values", lambda n, v: F.when(v.isNull(), n)), lambda n: n.isNotNull()), F.lit(1))).when(F.col("batch") & (F.size(lengths) > 1), F.lit("lengths"))
    return rows.withColumn("broken", broken).select(*HEAD, "emitter", "event", "names", F.when(F.col("broken").isNull(), F.col("values")).alias("values"), "broken")


def typed(rows: DataFrame, event: Event) -> DataFrame:
    """The rows of one event with its table's columns, and ``wide``: the texts of numbers of more than 38 digits by column, whose decimals are null; null where there are none. A batch gives a row for each element, in order."""
    own = rows.where((F.col("event") == event.key) & F.col("broken").isNull())
    if event.batch:
        arrays = [k.endswith("[]") for _, k, _ in event.columns]
        n = F.size(F.col("values")[arrays.index(True)])
        at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
        own = own.withColumn("batch_index", at)
        text = {c: F.col("values")[k][F.col("batch_index") if arrays[k] else 0] for k, (c, _, _) in enumerate(event.columns)}
    else:
        text = {c: F.to_json(F.col("values")[k]) if t.endswith("[]") else F.col("values")[k][0] for k, (c, t, _) in enumerate(event.columns)}
    kinds = dict(event.table.columns)
    out, wide = [], []
    for c, x in text.items():
        if kinds[c] == "BigInt":
            value = x.try_cast("decimal(38,0)")
            wide.append(F.when(value.isNull(), F.struct(F.lit(c).alias("key"), x.alias("value"))))
        elif kinds[c] == "Bytes":
            value = F.unhex(F.substr(x, F.lit(3)))
        else:
            value = x.try_cast(TYPES[kinds[c]]) if kinds[c] in ("Int", "Boolean") else x
        out.append(value.alias(c))
    beyond = F.filter(F.array(*wide), lambda w: w.isNotNull()) if wide else F.array().cast("array<struct<key: string, value: string>>")
    return own.select(*HEAD, "emitter", *out, *(["batch_index"] if event.batch else []), F.when(F.size(beyond) > 0, F.map_from_entries(beyond)).alias("wide"))


def split(logs: DataFrame, events: list[Event], path: str) -> None:
    """Writes the decoded logs once, in a folder for each event, and the broken ones in one of their own; ``stored`` reads one event's without the others."""
    rows = decoded(logs, events).withColumn("part", F.when(F.col("broken").isNull(), F.col("event")).otherwise("broken"))
    rows.write.mode("overwrite").partitionBy("part").parquet(path)


def stored(spark: SparkSession, path: str, event: Event) -> DataFrame:
    return typed(spark.read.parquet(path).where(F.col("part") == event.key), event)


def encoded(rows: DataFrame, event: Event, emitter: str | None = None) -> DataFrame:
    """Logs made of rows that have the header and the event's columns; a batch's columns are arrays."""
    topics = [abi.written_value(k, F.col(c)) for c, k, indexed in event.columns if indexed]
    data = abi.written_head_and_tail([(k, F.col(c)) for c, k, indexed in event.columns if not indexed])
    return rows.select(*HEAD, F.lit(emitter or event.emitter or "0x" + "0" * 40).alias("emitter"), F.array(F.lit(event.topic), *topics).alias("topics"), data.alias("data"))
