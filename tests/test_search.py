"""Event search: pages against all rows, tables without addresses, what payloads hold."""

import json
from decimal import Decimal

import pytest

from ledgerloom.plans import search

ME, YOU = "0xaa", "0xbb"
HEAD = "block_number long, transaction_index long, log_index long"


def table(spark, schema, address, *rows):
    df = spark.createDataFrame(rows, f"{HEAD}, {schema}" if schema else HEAD)
    for c in address:
        df = df.withMetadata(c, {"kind": "Address"})
    return df


@pytest.fixture(scope="module")
def ledger(spark):
    return {
        "moved": table(spark, "sender string, receiver string, amount decimal(38,0)", ["sender", "receiver"], *[(b, 0, 3, ME if b % 2 else YOU, "0xcc", Decimal(10**k)) for b, k in enumerate((3, 18, 25))], (1, 0, 3, ME, "0xcc", Decimal(10**18)), (4, 2, 1, YOU, ME, None)),
        "named": table(spark, "avatar string, note string, limit_ long", ["avatar"], (1, 0, 4, ME, ME, 5), (6, 0, 0, YOU, ME, None)),
        "scope": table(spark, "", [], (1, 0, 9), (1, 1, 9), (4, 2, 0), (6, 0, 1)),
        "elsewhere": table(spark, "avatar string", ["avatar"], (1, 1, 0, ME)),
        "profile": spark.createDataFrame([("d", ME)], "digest string, name string"),
    }


def keys(rows):
    return [(r.block_number, r.transaction_index, r.log_index, r.event) for r in rows]


def test_address_reaches_declared_columns_and_transactions_of_the_hub(ledger):
    got = keys(search.events(ledger, ME.upper().replace("X", "x"), hub=("moved", "named")).collect())
    want = [(4, 2, 1, "moved"), (4, 2, 0, "scope"), (1, 1, 0, "elsewhere"), (1, 0, 9, "scope"), (1, 0, 4, "named"), (1, 0, 3, "moved"), (1, 0, 3, "moved")]
    assert got == want, "a text column that holds an address, and a transaction of a table outside the hub, find nothing"
    assert keys(search.events(ledger, ME, low=2, high=4, hub=("moved", "named")).collect()) == want[:2]
    assert keys(search.events(ledger, ME, hub=()).collect()) == [k for k in want if k[3] != "scope"]
    assert search.events(ledger, "0xdd").count() == 0


@pytest.mark.parametrize("ascending", [False, True])
def test_pages_lose_and_repeat_nothing(ledger, ascending):
    whole = search.events(ledger, ascending=ascending).collect()
    assert len(whole) == 12 and keys(whole) == sorted(keys(whole), reverse=not ascending)
    got, cursor = [], None
    while True:
        page = search.page(search.events(ledger, ascending=ascending, size=1, cursor=cursor), 1)
        got += page["events"]
        cursor = page["nextCursor"]
        assert page["hasMore"] == (cursor is not None)
        if not cursor:
            break
    distinct = [x for i, x in enumerate(got) if x not in got[:i]]
    assert got == distinct and len(got) == 11, "only a row that is equal in all columns is shown once"
    assert got == [{"event": r.event, "values": json.loads(r.payload)} for i, r in enumerate(whole) if r not in whole[:i]]


def test_payload(ledger):
    rows = {(r.block_number, r.event): r.payload for r in search.events(ledger, names=["moved", "named"]).collect()}
    assert rows[1, "named"] == '{"block_number":"0x1","transaction_index":"0x0","log_index":"0x4","avatar":"0xaa","note":"0xaa","limit_":"0x5"}'
    assert json.loads(rows[2, "moved"])["amount"] == str(10**25) and json.loads(rows[1, "moved"])["amount"] == hex(10**18)
    assert json.loads(rows[4, "moved"])["amount"] is None


def test_filters_and_names(ledger):
    node = {"type": "FilterPredicate", "column": "amount", "filterType": "GreaterThan", "value": "1000"}
    assert keys(search.events(ledger, names=["moved"], filters=[node], ascending=True).collect()) == [(1, 0, 3, "moved")] * 2 + [(2, 0, 3, "moved")]
    with pytest.raises(ValueError, match="unknown column"):
        search.events(ledger, filters=[node])
    with pytest.raises(ValueError, match="no table"):
        search.events(ledger, names=["profile"])


@pytest.mark.parametrize("ascending", (False, True))
def test_payloads_are_made_of_rows_up_to_the_last_key_alone(spark, ledger, ascending):
    """the page's last key cuts every table before payloads are made; equal keys, nulls and cursors lose nothing."""
    more = {**ledger, "odd": table(spark, "avatar string", ["avatar"], (None, 0, 0, ME), (6, None, 0, YOU), (6, 0, 0, ME), (1, 0, 3, YOU), (0, 0, None, ME))}
    whole = [tuple(r) for r in search.events(more, size=100, ascending=ascending).collect()]
    assert len(whole) == 17
    for size in (1, 4, 17):
        df = search.events(more, size=size, ascending=ascending)
        assert [tuple(r) for r in df.collect()] == whole[: size + 1]
    own = {k: ledger[k] for k in ("moved", "named", "scope", "elsewhere")}
    whole = search.events(own, size=100, ascending=ascending).collect()
    plan = search.events(own, size=2, ascending=ascending)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"{'<=' if ascending else '>='} {whole[2].block_number})") >= 4
    for k in (2, 5):
        rest = search.events(own, size=2, cursor=search.cursor_of(whole[k]), ascending=ascending).collect()
        assert keys(rest) == keys(x for x in whole[k + 1 :] if tuple(x) != tuple(whole[k]))[:3]
