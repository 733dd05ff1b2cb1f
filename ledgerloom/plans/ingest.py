"""Raw logs and call data on the given tables: event rows are written as a chain emits them, then decoded, each beside the same rows in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerloom.functions import abi, ledger
from ledgerloom.plans.chain import KEY, ZERO, view
from ledgerloom.sources import calls, logs
from ledgerloom.sources.logs import Event

EVENTS = {
    "trust": Event("Ledger", "event Trust(address indexed truster, address indexed trustee, uint256 expiry_time)"),
    "single": Event("Ledger", "event TransferSingle(address indexed operator, address indexed from_, address indexed to_, uint256 id, uint256 value)"),
    "batch": Event("Ledger", "event TransferBatch(address indexed operator, address indexed from_, address indexed to_, uint256[] id, uint256[] value)", batch=True),
    "group": Event("Ledger", "event RegisterGroup(address indexed grp, address indexed mint, address indexed treasury, string indexed name, string indexed symbol)"),
}
HUB = "0x" + "c1" * 20


def raw_logs(t):
    """The logs that the event tables stand for, in one table; the transfers of one log index are a batch."""
    head = lambda df: df.withColumn("transaction_hash", F.concat_ws("-", "block_number", "transaction_index"))
    operator = F.lit(ZERO)
    pairs = F.array_sort(F.collect_list(F.struct("id", "value")))
    batch = t["transfer_batch"].groupBy(*KEY, "timestamp", "from_", "to_").agg(pairs.alias("p")).withColumns({"id": F.col("p.id"), "value": F.col("p.value"), "operator": operator})
    rows = {"trust": t["trust"], "single": t["transfer_single"].withColumn("operator", operator), "batch": batch, "group": t["register_group"]}
    return reduce(lambda a, b: a.union(b), [logs.encoded(head(df), EVENTS[k], HUB) for k, df in rows.items()])


@view(
    "SELECT 'Trust' AS event, block_number, transaction_index, log_index, 0 AS batch_index, truster AS a, trustee AS b, NULL AS token, CAST(expiry_time AS VARCHAR) AS amount FROM trust UNION ALL SELECT 'TransferSingle', block_number, transaction_index, log_index, 0, from_, to_, id, CAST(value AS VARCHAR) FROM transfer_single UNION ALL SELECT 'TransferBatch', block_number, transaction_index, log_index, row_number() OVER (PARTITION BY block_number, transaction_index, log_index, from_, to_ ORDER BY id, value) - 1, from_, to_, id, CAST(value AS VARCHAR) FROM transfer_batch UNION ALL SELECT 'RegisterGroup', block_number, transaction_index, log_index, 0, mint, treasury, grp, name || '/' || symbol FROM register_group"
)
def c_decoded_logs(t):
    """Logs decoded in one scan: parties, the token by its address (ids have up to 49 digits) and the amount as text."""
    rows = logs.decoded(raw_logs(t), list(EVENTS.values()))
    value = lambda k: F.col("values")[k]
    batch, group = F.col("event") == EVENTS["batch"].key, F.col("event") == EVENTS["group"].key
    move = F.col("event").isin(EVENTS["single"].key, EVENTS["batch"].key)
    each = F.when(batch, F.arrays_zip(value(3).alias("id"), value(4).alias("amount"))).otherwise(F.array(F.struct(F.when(move, value(3)[0]).alias("id"), F.when(move, value(4)[0]).when(group, F.concat(value(3)[0], F.lit("/"), value(4)[0])).otherwise(value(2)[0]).alias("amount"))))
    side = F.when(move | group, F.array(value(1)[0], value(2)[0])).otherwise(F.array(value(0)[0], value(1)[0]))
    out = rows.select(F.substring_index("event", "_", -1).alias("event"), *KEY, F.posexplode(each).alias("batch_index", "e"), side[0].alias("a"), side[1].alias("b"), F.when(group, value(0)[0]).alias("_g"))
    return out.select("event", *KEY, "batch_index", "a", "b", F.coalesce("_g", ledger.token_address(F.col("e.id"))).alias("token"), F.col("e.amount").alias("amount"))


def raw_transactions(t):
    """A transaction for each order: its single transfers with data, one call or many packed ones, in no, one, two or three wrappers."""
    note = F.concat_ws(":", "transaction_index", "log_index").cast("binary")
    own = t["transfer_single"].select("block_number", F.concat(F.lit(bytes.fromhex(calls.TRANSFER)), abi.written_head_and_tail([("address", F.col("from_")), ("address", F.col("to_")), ("uint256", F.col("id")), ("uint256", F.col("value")), ("bytes", note)])).alias("call"))
    packed = F.concat(F.lit(b"\0"), F.unhex(F.lit(HUB[2:])), abi.written_number(0), abi.written_number(F.length("call")), F.col("call"))
    rows = own.groupBy("block_number").agg(F.array_sort(F.collect_list(packed)).alias("packed"))
    many = F.concat(F.lit(bytes.fromhex(calls.MULTI_SEND)), abi.written_head_and_tail([("bytes", F.aggregate("packed", F.lit(b""), lambda a, x: F.concat(a, x)))]))
    wrap = lambda name, n, inner: F.concat(F.lit(bytes.fromhex(name)), abi.written_head_and_tail([("address", F.lit(HUB)), ("uint256", 0), ("bytes", inner), *[("uint256", 0)] * (n - 3)]))
    operation = lambda inner: abi.written_head_and_tail([("address", F.lit(HUB)), ("uint256", 0), ("bytes", F.lit(b"")), ("bytes", inner), *[("uint256", 0)] * 3, ("bytes", F.lit(b"")), ("bytes", F.lit(b""))])
    ops = lambda inner: F.concat(F.lit(bytes.fromhex(calls.HANDLE_OPS)), *[abi.written_number(k) for k in (64, 0, 1, 32)], operation(inner))
    kind = F.col("block_number") % 4

    def wrapped(m):
        """In the wrappers of the transaction's kind; the others aren't written."""
        return F.when(kind == 0, m).when(kind == 2, wrap(calls.USER_OP, 4, m)).otherwise(abi.named(wrap(calls.EXEC, 10, m), lambda x: F.when(kind == 1, x).otherwise(ops(x))))

    return rows.select("block_number", abi.named(many, wrapped).alias("input"))


@view("SELECT block_number, from_, to_, concat(CAST(transaction_index AS VARCHAR), ':', CAST(log_index AS VARCHAR)) AS data FROM transfer_single")
def c_transfer_data(t):
    """The data that transfers carry, which no event shows, out of the transactions' call data."""
    return calls.transfer_data(raw_transactions(t)).select("block_number", "from_", "to_", F.col("data").cast("string").alias("data"))
