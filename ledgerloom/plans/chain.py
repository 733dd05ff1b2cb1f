"""Chain-shaped event tables on the given tables, and the registration of views over them.

The given tables hold no chain data, so each event table is a projection of one
of them. A projection is written once, in expressions that Spark SQL and DuckDB
read alike, and serves the Spark query and its SQL. Views are functions of a
mapping from table names to DataFrames, so they run on real event tables as well.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.ledger import DAY, EPOCH
from ledgerloom.plans.catalogue import ORACLE_SQL, QUERIES, table

ZERO = "0x" + "0" * 40
KEY = ["block_number", "transaction_index", "log_index"]
NEWEST = "block_number DESC, transaction_index DESC, log_index DESC"


def made(kind: str, key: str) -> str:
    """An address of one kind: a avatar, b group, c vault, d version-1 token, e static and f demurraged wrapper."""
    return f"concat('0x{kind}', lpad(CAST({key} AS STRING), 39, '0'))"


def _head(block: str, tx: str = "0", log: str = "0") -> dict[str, str]:
    return {"block_number": f"CAST({block} AS BIGINT)", "transaction_index": f"CAST({tx} AS BIGINT)", "log_index": f"CAST({log} AS BIGINT)", "timestamp": f"CAST({EPOCH} + ({block}) * 600 AS BIGINT)"}


_ORDER, _EVENT, _CUSTOMER, _SUPPLIER = _head("o_orderkey"), _head("event_id"), _head("c_custkey"), _head("s_suppkey")
_LINE = _head("l_orderkey", "l_linenumber", "l_partkey")
_OWNER = f"CASE WHEN l_partkey % 4 = 0 THEN {made('b', '1 + l_partkey % 10')} ELSE {made('a', '1 + l_partkey % 200')} END"
_FROM = f"CASE WHEN l_suppkey % 6 = 0 THEN '{ZERO}' ELSE {made('a', '1 + l_suppkey % 97')} END"
_TO = f"CASE WHEN l_suppkey % 6 = 1 THEN '{ZERO}' WHEN l_suppkey % 6 = 2 THEN {made('c', '1 + l_suppkey % 10')} ELSE {made('a', 'o_custkey')} END"
_VALUE = "CAST(l_quantity AS BIGINT) * 1000000"
_MEMBER = made("a", "greatest(1, o_custkey + o_orderkey % 7 - 3)")
_MOVE = {"from_": _FROM, "to_": _TO, "id": _OWNER, "token_address": _OWNER, "value": _VALUE}
_LOCK = {"grp": made("b", "1 + l_partkey % 10"), "id": made("a", "1 + l_partkey % 200"), "value": _VALUE}
_EMITTED = {**_EVENT, "emitter": made("b", "1 + user_id % 10")}
_WRAPPER = f"CASE WHEN l_partkey % 4 = 3 THEN {made('f', 'l_partkey % 200')} ELSE {made('e', 'l_partkey % 200')} END"
_LIMITED = {"emitter": made("a", "(1 + l_partkey % 10) % 7"), "grp": made("b", "1 + l_partkey % 10"), "token": made("a", "o_custkey"), "day": f"CAST(floor(l_orderkey * 600 / {DAY}) AS BIGINT)"}

#: name: (given table, condition, columns)
TABLES: dict[str, tuple[str, str, dict[str, str]]] = {
    "system_block": ("orders", "true", {"block_number": _ORDER["block_number"], "timestamp": _ORDER["timestamp"]}),
    "register_human": ("customer", "c_custkey % 10 < 8", {**_CUSTOMER, "avatar": made("a", "c_custkey"), "inviter": f"CASE WHEN c_custkey % 3 = 0 THEN '{ZERO}' ELSE {made('a', 'c_custkey % 97 + 1')} END"}),
    "register_organization": ("customer", "c_custkey % 10 = 8", {**_CUSTOMER, "organization": made("a", "c_custkey"), "name": "c_name"}),
    "register_group": ("supplier", "true", {**_SUPPLIER, "grp": made("b", "s_suppkey"), "mint": made("a", "s_suppkey % 7"), "treasury": made("c", "s_suppkey"), "name": "s_name", "symbol": "concat('S', CAST(s_suppkey % 17 AS STRING))"}),
    "create_vault": ("supplier", "true", {**_SUPPLIER, "grp": made("b", "s_suppkey"), "vault": made("c", "s_suppkey")}),
    "base_group_created": ("supplier", "s_suppkey % 3 = 0", {**_SUPPLIER, "grp": made("b", "s_suppkey"), "mint_handler": made("a", "s_suppkey + 5")}),
    "cm_group_created": ("supplier", "s_suppkey % 5 = 0", {**_SUPPLIER, "proxy": made("b", "s_suppkey"), "owner": made("a", "s_suppkey + 9"), "mint_handler": made("a", "s_suppkey + 6")}),
    "group_owner_updated": ("events", "event_type = 'click'", {**_EMITTED, "owner": made("a", "event_id % 40")}),
    "group_service_updated": ("events", "event_type = 'purchase'", {**_EMITTED, "service": made("a", "event_id % 41")}),
    "group_fee_updated": ("events", "event_type = 'error'", {**_EMITTED, "fee_collection": made("a", "event_id % 42")}),
    "v1_signup": ("customer", "c_custkey % 3 = 0", {**_CUSTOMER, "user_": made("a", "c_custkey"), "token": made("d", "c_custkey")}),
    "v1_organization_signup": ("customer", "c_custkey % 7 = 0", {**_CUSTOMER, "organization": made("a", "c_custkey")}),
    "update_metadata_digest": ("events", "event_type IN ('view', 'signup')", {**_EVENT, "avatar": f"CASE WHEN event_type = 'view' THEN {made('a', 'user_id')} ELSE {made('b', '1 + user_id % 10')} END", "digest": "concat('digest-', CAST(event_id AS STRING))"}),
    "v1_trust": ("orders", "o_orderkey % 5 = 0", {**_ORDER, "user_": made("a", "o_custkey"), "can_send_to": _MEMBER, "limit_": "CAST(o_orderkey % 4 * 25 AS BIGINT)"}),
    "trust": ("orders", "o_orderkey % 5 <> 0", {**_ORDER, "truster": f"CASE WHEN o_orderkey % 3 = 0 THEN {made('b', '1 + o_orderkey % 10')} ELSE {made('a', 'o_custkey')} END", "trustee": f"CASE WHEN o_orderkey % 3 = 0 THEN {made('a', 'o_custkey')} WHEN o_orderkey % 7 = 0 THEN {made('b', '1 + o_orderkey % 10')} ELSE {_MEMBER} END", "expiry_time": f"CASE o_orderkey % 8 WHEN 0 THEN CAST({EPOCH} + o_orderkey * 600 - 1 AS BIGINT) WHEN 1 THEN CAST({EPOCH} + o_orderkey * 600 + 864000 AS BIGINT) ELSE 9223372036854775807 END"}),
    "transfer_single": ("lines", "l_linenumber % 2 = 0", {**_LINE, **_MOVE}),
    "transfer_batch": ("lines", "l_linenumber % 2 = 1", {**_LINE, "batch_index": "CAST(l_linenumber % 3 AS BIGINT)", **_MOVE}),
    "wrapper_deployed": ("customer", "c_custkey % 4 = 0 OR c_custkey % 4 = 3", {**_CUSTOMER, "avatar": f"CASE WHEN c_custkey % 12 < 9 THEN {made('a', 'c_custkey')} ELSE {made('b', '1 + c_custkey % 10')} END", "wrapper": f"CASE WHEN c_custkey % 4 = 3 THEN {made('f', 'c_custkey')} ELSE {made('e', 'c_custkey')} END", "wrapper_kind": "CAST(CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE 1 END AS BIGINT)"}),
    "wrapper_transfer": ("lines", "l_linenumber = 3", {**_LINE, "token_address": _WRAPPER, "from_": _FROM, "to_": _TO, "amount": _VALUE}),
    "v1_transfer": ("lines", "l_linenumber = 1", {**_LINE, "token_address": made("d", "1 + l_partkey % 300"), "from_": _FROM, "to_": _TO, "amount": _VALUE}),
    "v1_hub_transfer": ("lines", "l_linenumber = 2", {**_head("l_orderkey", "1", "l_partkey"), "from_": _FROM, "to_": _TO, "amount": _VALUE}),
    "collateral_locked_single": ("lines", "l_suppkey % 9 = 0", {**_LINE, **_LOCK}),
    "collateral_locked_batch": ("lines", "l_suppkey % 9 = 3", {**_LINE, **_LOCK}),
    "redeem_return": ("lines", "l_suppkey % 9 = 1 AND l_linenumber < 4", {**_LINE, **_LOCK}),
    "redeem_burn": ("lines", "l_suppkey % 27 = 2", {**_LINE, **_LOCK}),
    "flow_scope_started": ("orders", "o_orderkey % 4 = 0", {**_head("o_orderkey", "1 + o_orderkey % 3", "500")}),
    "stream_completed": ("orders", "o_orderkey % 4 = 0", {**_head("o_orderkey", "1 + o_orderkey % 3", "1200"), "from_": made("a", "o_custkey"), "to_": made("a", "o_custkey + 1"), "id": made("a", "1 + o_orderkey % 200"), "amount": "CAST(o_orderkey % 100 AS BIGINT)"}),
    "affiliate_changed": ("events", "true", {**_EVENT, "human": made("a", "user_id"), "old_group": f"CASE WHEN event_id % 3 = 0 THEN '{ZERO}' ELSE {made('b', '1 + event_id % 9')} END", "new_group": made("b", "1 + (event_id + user_id) % 10")}),
    "affiliate_event": ("events", "event_type <> 'view'", {**_EVENT, "grp": made("b", "1 + event_id % 6"), "avatar": made("a", "user_id"), "is_add": "event_type <> 'error'", "is_seed": "event_type = 'signup'"}),
    "advanced_flag": ("events", "event_type = 'click'", {**_EVENT, "avatar": made("a", "user_id"), "flag": "CAST(event_id % 2 AS BIGINT)"}),
    "approval": ("events", "event_type IN ('click', 'view')", {**_EVENT, "account": f"CASE WHEN event_id % 4 = 0 THEN {made('b', '1 + user_id % 10')} ELSE {made('a', 'user_id')} END", "operator": made("a", "1 + event_id % 5"), "approved": "event_id % 3 <> 0"}),
    "stopped": ("customer", "c_custkey % 50 = 1", {**_CUSTOMER, "avatar": made("a", "c_custkey")}),
    "safe_setup": ("customer", "c_custkey % 6 = 0", {**_CUSTOMER, "safe": made("a", "c_custkey % 90"), "owner": made("a", "c_custkey % 13")}),
    "safe_added": ("events", "event_type = 'purchase'", {**_head("100000 + event_id"), "safe": made("a", "user_id % 90"), "owner": made("a", "event_id % 13")}),
    "safe_removed": ("events", "event_type = 'error'", {**_head("100000 + event_id"), "safe": made("a", "user_id % 90"), "owner": made("a", "event_id % 13")}),
    "at_scale_register": ("customer", "c_custkey % 11 = 0", {**_CUSTOMER, "human": made("a", "c_custkey"), "origin_inviter": f"CASE WHEN c_custkey % 22 = 0 THEN '{ZERO}' ELSE {made('a', 'c_custkey % 50')} END", "proxy_inviter": made("a", "c_custkey % 51")}),
    "escrow_redeemed": ("customer", "c_custkey % 13 = 0", {**_CUSTOMER, "inviter": made("a", "c_custkey % 52"), "invitee": made("a", "c_custkey"), "amount": "CAST(c_custkey * 10 AS BIGINT)"}),
    "escrowed": ("customer", "c_custkey % 9 = 0", {**_CUSTOMER, "inviter": made("a", "c_custkey % 52"), "invitee": made("a", "c_custkey + 7"), "amount": "CAST(c_custkey * 10 AS BIGINT)"}),
    "score_group_initialized": ("supplier", "s_suppkey % 2 = 0", {**_SUPPLIER, "grp": made("b", "s_suppkey"), "emitter": made("a", "s_suppkey % 7"), "path_mint_router": made("b", "1 + s_suppkey % 9")}),
    "historical_supply": ("lines", "l_suppkey % 4 = 1", {**_LINE, **_LIMITED, "supply": _VALUE}),
    "personal_minted": ("lines", "l_suppkey % 4 = 2", {**_LINE, **_LIMITED, "minted": _VALUE}),
    "profile": ("events", "event_type IN ('view', 'signup')", {"digest": "concat('digest-', CAST(event_id AS STRING))", "name": "concat(event_type, ' person ', CAST(user_id AS STRING))", "description": "concat('member since block ', CAST(event_id AS STRING))"}),
    "content_queue": ("events", "event_id % 5 = 0", {"digest": "concat('digest-', CAST(event_id AS STRING))"}),
    "content_file": ("events", "event_id % 7 = 0", {"digest": "concat('digest-', CAST(event_id AS STRING))"}),
    "offer_claimed": ("events", "event_type = 'purchase'", {**_EVENT, "offer": made("e", "event_id % 12"), "account": made("a", "user_id"), "spent": "CAST(floor(value * 100) AS BIGINT)", "received": "CAST(floor(value * 30) AS BIGINT)"}),
    "gateway_created": ("supplier", "s_suppkey % 4 = 0", {**_SUPPLIER, "owner": made("a", "s_suppkey % 30"), "gateway": made("f", "s_suppkey")}),
    "payment_received": ("events", "event_type = 'view'", {**_EVENT, "payer": made("a", "user_id"), "gateway": made("f", "event_id % 24 * 4"), "amount": "CAST(floor(value * 100) AS BIGINT)"}),
    "reputation_history": ("events", "event_type <> 'view'", {**_EVENT, "grp": made("b", "1 + user_id % 4"), "avatar": made("a", "user_id"), "score": "CAST(floor(value) AS BIGINT)"}),
    "blacklist": ("customer", "c_custkey % 23 = 0", {"address": made("a", "c_custkey")}),
}

#: The columns of each table that hold addresses: those that an address is made for
ADDRESSES = {name: [c for c, x in columns.items() if "'0x" in x] for name, (_, _, columns) in TABLES.items()}


class Chain(Mapping):
    """The event tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def __getitem__(self, name: str) -> DataFrame:
        return self.rows(name)

    def rows(self, name: str, hashed: bool = False) -> DataFrame:
        source, condition, columns = TABLES[name]
        if source == "lines":
            orders = table(self.spark, self.sf, "orders").select("o_orderkey", "o_custkey")
            df = table(self.spark, self.sf, "lineitem").join(orders.hint("shuffle_hash") if hashed else orders, F.expr("l_orderkey = o_orderkey"))
        else:
            df = table(self.spark, self.sf, source)
        own = [F.expr(x).alias(c, metadata={"kind": "Address"}) if c in ADDRESSES[name] else F.expr(x).alias(c) for c, x in columns.items()]
        return df.where(condition).select(*own)

    def columns(self, name: str) -> list[str]:
        return list(TABLES[name][2])

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def unsorted(t: Mapping[str, DataFrame], name: str) -> DataFrame:
    """A table for queries that take all of it: lines meet hashed orders, so no task sorts the lines it reads. Other mappings' tables as they are."""
    return t.rows(name, hashed=True) if isinstance(t, Chain) else t[name]


class Pinned(Mapping):
    """Tables as they were at a block: only rows up to it, where a table has blocks. The number is known before the plan, so it reaches the scans."""

    def __init__(self, tables: Mapping[str, DataFrame], block: int):
        self.tables, self.block = tables, block

    def __getitem__(self, name: str) -> DataFrame:
        df = self.tables[name]
        return df.where(F.col("block_number") <= self.block) if "block_number" in df.columns else df

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


def back(t: Mapping[str, DataFrame], blocks: int) -> Pinned:
    """The tables so many blocks before the last; nothing at all without blocks."""
    last = t["system_block"].agg(F.max("block_number")).first()[0]
    return Pinned(t, -1 if last is None else last - blocks)


VIEW_SQL: dict[str, str] = {}


def newest(name: str, keys: str) -> str:
    """The SQL of the latest row of each key."""
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {NEWEST}) AS rn_ FROM {name}) WHERE rn_ = 1)"


def _columns(columns: Mapping[str, str]) -> str:
    return ", ".join(f"{x} AS {c}" for c, x in columns.items())


def with_tables(sql: str) -> str:
    """The SQL after the definitions of all event tables and views that it names, in order. A name with __Nago is that table or view N blocks before the last."""
    seen: dict[str, str] = {}

    def add(text: str) -> None:
        for name in sorted(set(re.findall(r"\b[a-z][a-z0-9_]*\b", text))):
            base, _, blocks = name.removesuffix("ago").partition("__") if re.search(r"__\d+ago$", name) else (name, "", "")
            if name in seen:
                continue
            if base in VIEW_SQL:
                own = VIEW_SQL[base]
                if blocks:
                    own = re.sub(r"\b([a-z][a-z0-9_]*)\b", lambda m: f"{m[1]}__{blocks}ago" if m[1] in VIEW_SQL else m[1], own)
                    own = re.sub(r"\b(FROM|JOIN) ([a-z][a-z0-9_]*)\b", lambda m: f"{m[1]} {m[2]}__{blocks}ago" if m[2] in TABLES else m[0], own)
                add(own)
                seen[name] = own
            elif base in TABLES and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                source, condition, columns = TABLES[base]
                origin = "lineitem JOIN orders ON l_orderkey = o_orderkey" if source == "lines" else source
                if blocks and "block_number" in columns:
                    condition = f"({condition}) AND {columns['block_number']} <= (SELECT max(o_orderkey) - {blocks} FROM orders)"
                seen[name] = f"SELECT {_columns(columns)} FROM {origin} WHERE {condition}"

    add(sql)
    return f"WITH {', '.join(f'{k} AS ({v})' for k, v in seen.items())} SELECT * FROM ({sql})" if seen else sql


def view(sql: str | None = None, register: bool = True):
    """Registers a view over a Chain under its own name, and its SQL, which later SQL may name."""

    def add(f: Callable[..., DataFrame]):
        if sql:
            VIEW_SQL[f.__name__] = sql
        if register:
            QUERIES[f.__name__] = lambda spark, sf: f(Chain(spark, sf))
            if sql:
                ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return add


def now(t: Mapping[str, DataFrame]) -> DataFrame:
    """One row: the time of the last block, 0 without blocks."""
    return F.broadcast(t["system_block"].agg(F.coalesce(F.max("timestamp"), F.lit(0).cast("long")).alias("now")))


NOW = "(SELECT coalesce(max(timestamp), 0) FROM system_block)"


def age(day: str, at: str = "now") -> str:
    """Whole days from one time to another, counted by the ledger's day index."""
    return f"(floor(({at} - {EPOCH}) / {DAY}) - floor(({day} - {EPOCH}) / {DAY}))"


DECAY = "power(0.93, 1 / 365.25)"
