"""Event search over all tables of a ledger: which columns hold addresses is read from the tables' metadata."""

from __future__ import annotations

import base64
import json
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.compat import after
from ledgerloom.operators import core
from ledgerloom.plans import dsl
from ledgerloom.plans.chain import ADDRESSES, KEY, TABLES, view
from ledgerloom.plans.named import ME
from ledgerloom.plans.views import union

HEAD = ["block_number", "timestamp", "transaction_index", "log_index", "transaction_hash"]  # Fixed value: what a payload starts with, in this order
ORDER = [*KEY, "event", "payload"]
DEFAULT_SIZE, MOST = 100, 1000  # Fixed values: rows of a page, by default and at most
#: The given tables' ledger: tables of the hub, whose transactions those without addresses belong to
HUB = ("register_human", "register_organization", "register_group", "update_metadata_digest", "trust", "transfer_single", "transfer_batch", "wrapper_deployed", "stream_completed", "advanced_flag", "approval", "stopped")


def addresses(df: DataFrame) -> list[str]:
    """The columns that are declared as addresses."""
    return [f.name for f in df.schema if f.metadata.get("kind") == "Address"]


def payload_order(columns: Collection[str]) -> list[str]:
    """The head, then all others by name; a column named limit_ comes last."""
    rest = sorted(set(columns) - set(HEAD), key=lambda c: (c == "limit_", c))
    return [c for c in HEAD if c in columns] + rest


def payload(df: DataFrame) -> F.Column:
    """The row as JSON: whole numbers as hexadecimal text, those beyond 64 bits and fractions as decimal text, nulls kept."""
    parts = []
    for c in payload_order(df.columns):
        kind, long = df.schema[c].dataType, F.expr(f"try_cast(`{c}` AS BIGINT)")
        text = F.concat(F.lit("0x"), F.lower(F.hex(long)))
        if kind.typeName() == "decimal":
            text = F.when(long == F.col(c), text).otherwise(F.col(c).cast("string"))
        elif kind.typeName() in ("double", "float"):
            text = F.col(c).cast("string")
        elif kind.typeName() not in ("long", "integer", "short", "byte"):
            text = F.col(c)
        parts.append(text.alias(c))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def named_by(df: DataFrame, address: str) -> F.Column:
    return F.lit(address).isin(*[F.col(c) for c in addresses(df)])


def events(
    tables: Mapping[str, DataFrame], address: str | None = None, low: int | None = None, high: int | None = None, names: Collection[str] | None = None, filters: Sequence[Mapping] = (), hub: Collection[str] = HUB, size: int = DEFAULT_SIZE, cursor: str | None = None, ascending: bool = False
) -> DataFrame:
    """(block_number, transaction_index, log_index, event, payload): the newest events of all tables, or the oldest, one more than a page has.

    A table is searched if it has the columns of KEY and is named, or none is. With
    an address, those of its rows come that hold it in a column declared as an
    address; of a table without such columns, those whose transaction an event of a
    hub's table with the address belongs to. A filter must name columns of every
    table searched. Each table gives its own first rows before the common ones are
    taken. Rows of equal key are ordered by table and payload, and the cursor holds
    all five, so equal keys at the end of a page lose nothing; a row
    that is equal in all of them comes once.

    A first job takes the page's keys alone and finds the last; only rows up to it
    get a payload, and scans and joins see none beyond it.
    """
    within = [F.col("block_number") >= low] if low is not None else []
    within += [F.col("block_number") <= high] if high is not None else []
    address = address.lower() if address else None

    def pick(df: DataFrame, *conditions: F.Column) -> DataFrame:
        for c in (*within, *conditions):
            df = df.where(c)
        return df

    searched, transactions = {}, None
    size = min(max(size, 1), MOST)
    for name in names if names else tables:
        df = tables[name]
        if not set(KEY) <= set(df.columns):
            continue
        if address is None:
            own = pick(df)
        elif addresses(df):
            own = pick(df, named_by(df, address))
        else:
            if transactions is None:
                hubs = [d for d in (tables[h] for h in hub if h in tables) if addresses(d)]
                if not hubs:
                    continue
                transactions = union(*[pick(d, named_by(d, address)).select(*KEY[:2]) for d in hubs]).distinct()
            own = pick(df).join(transactions, KEY[:2], "left_semi")
        for node in filters:
            if (p := dsl.predicate(own, node)) is not None:
                own = own.where(p)
        if cursor:  # rows of an equal key may be left: the rest of the order is compared below
            own = own.where(after(KEY, _read(cursor)[: len(KEY)], not ascending) | _equal(_read(cursor)))
        searched[name] = own
    if not searched:
        raise ValueError("no table to search")
    last = _last_key(searched.values(), size, _read(cursor) if cursor else None, not ascending)
    parts = []
    for name, own in searched.items():
        own = own if last is None else own.where(_up_to(last, not ascending))
        rows = own.select(*KEY, F.lit(name).alias("event"), payload(own).alias("payload"))
        parts.append(core.keyset_page(rows, ORDER, size, _read(cursor) if cursor else None, not ascending))
    return core.keyset_page(union(*parts), ORDER, size, None, not ascending)


def _equal(at: Sequence) -> F.Column:
    return (F.col(KEY[0]) == at[0]) & (F.col(KEY[1]) == at[1]) & (F.col(KEY[2]) == at[2])


def _last_key(tables: Collection[DataFrame], size: int, cursor: Sequence | None, descending: bool) -> list | None:
    """The key of the page's last row; none if no more rows are there, or if it has nulls. Rows of the cursor's own key don't count, as some were on the page before."""
    parts = [core.keyset_page(df.select(*KEY), KEY, size, cursor and cursor[: len(KEY)], descending) for df in tables]
    rows = core.keyset_page(union(*parts), KEY, size, None, descending).collect()
    last = list(rows[-1]) if len(rows) > size else [None]
    return None if None in last else last


def _up_to(at: Sequence, descending: bool) -> F.Column:
    """Rows with the key or before it in the order. Those whose keys have nulls stay; the block is compared apart too, as scans know it."""
    first = F.col(KEY[0]) >= at[0] if descending else F.col(KEY[0]) <= at[0]
    absent = F.col(KEY[0]).isNull() | F.col(KEY[1]).isNull() | F.col(KEY[2]).isNull()
    return (first | F.col(KEY[0]).isNull()) & (after(KEY, list(at), not descending) | _equal(at) | absent)


def cursor_of(row) -> str:
    return base64.b64encode(json.dumps([row[c] for c in ORDER]).encode()).decode()


def _read(cursor: str) -> list:
    return json.loads(base64.b64decode(cursor))


def page(df: DataFrame, size: int = DEFAULT_SIZE) -> dict:
    """A page of `events` as the API returns it: rows, hasMore, nextCursor."""
    rows = df.collect()
    more, rows = len(rows) > size, rows[:size]
    return {"events": [{"event": r.event, "values": json.loads(r.payload)} for r in rows], "hasMore": more, "nextCursor": cursor_of(rows[-1]) if more else None}


# SQL of the registered queries


def _payload_sql(name: str) -> str:
    own = TABLES[name][2]
    number = lambda c: own[c].endswith(("BIGINT)", "* 1000000")) or c == "expiry_time"
    fields = (f"{c!r}: " + (f"concat('0x', lower(to_hex({c})))" if number(c) else c) for c in payload_order(own))
    return f"CAST(to_json({{{', '.join(fields)}}}) AS VARCHAR)"


def _events_sql(address: str | None, low: int, size: int, names: Collection[str] = ()) -> str:
    searched = [n for n in names or TABLES if set(KEY) <= set(TABLES[n][2])]
    mine = lambda n: f"'{address}' IN ({', '.join(ADDRESSES[n])})"
    transactions = " UNION ALL ".join(f"SELECT block_number, transaction_index FROM {n} WHERE block_number >= {low} AND {mine(n)}" for n in HUB)
    parts = []
    for n in searched:
        condition = "true" if address is None else mine(n) if ADDRESSES[n] else f"(block_number, transaction_index) IN ({transactions})"
        parts.append(f"SELECT {', '.join(KEY)}, '{n}' AS event, {_payload_sql(n)} AS payload FROM {n} WHERE block_number >= {low} AND {condition}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) ORDER BY {', '.join(f'{c} DESC' for c in ORDER)} LIMIT {size + 1}"


@view(_events_sql(ME, 50, 1000))
def c_q_event_search(t, address: str = ME, low: int = 50, size: int = 1000):
    """All events that name an account, and those without addresses of its transactions, the newest first."""
    return events(t, address, low, size=size)


@view(_events_sql(None, 0, 100))
def c_q_newest_events(t):
    """The newest events of all tables."""
    return events(t)
