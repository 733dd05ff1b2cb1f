"""Sinks that may run twice or break off, and streams with late and repeated batches, on folders of their own."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import core
from ledgerloom.plans import dsl
from ledgerloom.sources import tables
from ledgerloom.streaming import state

TRUST = tables.from_signature("Ledger", "event Trust(address indexed truster, address indexed trustee, uint256 expiry)")
BATCH = tables.from_signature("Ledger", "event TransferBatch(address from, uint256[] ids)".replace("uint256[] ids", "uint256 id"), batch=True)
BLOCK = tables.Table("System", "Block", (("block_number", "Int"), ("timestamp", "Int")), ("block_number",))


@pytest.fixture
def catalog(spark, tmp_path):
    return tables.Catalog(spark, str(tmp_path), span=10).add(TRUST).add(BLOCK)


def trusts(spark, blocks, log=0):
    rows = [(b, b * 5, 0, log, f"h{b}", f"a{b}", "b", 7) for b in blocks]
    return spark.createDataFrame(rows, "block_number long, timestamp long, transaction_index long, log_index long, transaction_hash string, truster string, trustee string, expiry long")


def blocks_of(spark, numbers):
    return spark.createDataFrame([(b, b * 5) for b in numbers], "block_number long, timestamp long")


def have(catalog):
    return sorted(r.block_number for r in catalog.read("Ledger", "Trust").collect())


def test_signatures():
    assert TRUST.key == ("block_number", "transaction_index", "log_index") and BATCH.key[-1] == "batch_index"
    assert [t for _, t in TRUST.columns[-3:]] == ["Address", "Address", "BigInt"]
    with pytest.raises(KeyError):
        tables.from_signature("Ledger", "event X(tuple a)")


def test_append_twice_changes_nothing(spark, catalog):
    assert have(catalog) == []
    for _ in range(2):
        catalog.append("Ledger", "Trust", trusts(spark, [1, 2, 2, 15]))
    catalog.append("Ledger", "Trust", trusts(spark, [15, 16]))
    catalog.append("Ledger", "Trust", trusts(spark, [16], log=1))
    catalog.append("Ledger", "Trust", trusts(spark, []))
    assert have(catalog) == [1, 2, 15, 16, 16]
    assert sorted(r.block_number for r in catalog.at(15).read("Ledger", "Trust").collect()) == [1, 2, 15]
    assert catalog.read("Ledger", "Trust").columns == [c for c, _ in TRUST.columns]
    with pytest.raises(ValueError):
        catalog.read("Ledger", "Nothing")
    assert {r.table_name for r in catalog.describe().collect()} == {"Trust"}


def test_rewind(spark, catalog):
    for _ in range(2):  # a rewind runs again without harm
        catalog.flush({("Ledger", "Trust"): trusts(spark, range(1, 45))}, blocks_of(spark, range(1, 45)))
        assert catalog.complete() == 44
        for _ in range(2):
            catalog.rewind(23)
        assert have(catalog) == list(range(1, 23)) and catalog.complete() == 22
    catalog.rewind(20)
    assert have(catalog) == list(range(1, 20))
    catalog.rewind(0)
    assert have(catalog) == [] and catalog.complete() is None


def test_rewind_that_breaks_off(spark, catalog, monkeypatch):
    catalog.flush({("Ledger", "Trust"): trusts(spark, range(1, 45))}, blocks_of(spark, range(1, 45)))
    whole = tables.Catalog._replace

    def breaks(self, ns, name, *rest):
        if name == "Trust":
            raise RuntimeError("lost")
        whole(self, ns, name, *rest)

    monkeypatch.setattr(tables.Catalog, "_replace", breaks)
    with pytest.raises(RuntimeError):
        catalog.rewind(30)
    # the blocks went first: what counts as complete is before the rewind everywhere
    assert catalog.complete() == 29 and catalog.at(29).read("Ledger", "Trust").count() == 29
    monkeypatch.undo()
    catalog.rewind(30)
    assert have(catalog) == list(range(1, 30))


def test_flush_that_breaks_off_is_run_again(spark, catalog):
    catalog.flush({("Ledger", "Trust"): trusts(spark, [1])}, blocks_of(spark, [1]))
    catalog.append("Ledger", "Trust", trusts(spark, [2]))  # and no blocks: the batch broke off
    assert catalog.complete() == 1 and catalog.at(1).read("Ledger", "Trust").count() == 1
    catalog.flush({("Ledger", "Trust"): trusts(spark, [2, 3])}, blocks_of(spark, [2, 3]))
    assert have(catalog) == [1, 2, 3] and catalog.complete() == 3


def test_backfill(spark, catalog):
    catalog.append("Ledger", "Trust", trusts(spark, range(1, 40)))
    catalog.backfill("Ledger", "Trust", trusts(spark, [14, 15, 33]), 14, 31)
    assert have(catalog) == [*range(1, 14), 14, 15, *range(32, 40)]


def test_batch_events(spark):
    df = spark.createDataFrame([(1, ["5", "6"], [50, 60]), (2, [], [])], "block_number long, ids array<string>, amounts array<long>")
    assert [tuple(r) for r in tables.decoded_batch(df, "ids", "amounts").orderBy("batch_index").collect()] == [(1, 0, "5", 50), (1, 1, "6", 60)]


def streamed(spark, folder, parts, merge, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    source = state.event_stream(spark, f"{folder}/in/*", spark.read.parquet(f"{folder}/in/0").schema)
    state.into_deltas(source, merge, f"{folder}/state", f"{folder}/checkpoint").awaitTermination()


def test_latest_state_with_late_events(spark, tmp_path):
    merge = state.latest(["k"], ["at"])
    parts = [[("x", 1, "a"), ("y", 5, "b")], [("x", 9, "c")], [("x", 4, "late"), ("y", 6, "d")]]
    streamed(spark, str(tmp_path), parts, merge, "k string, at long, v string")
    want = [("x", 9, "c"), ("y", 6, "d")]
    assert sorted(map(tuple, state.state(spark, f"{tmp_path}/state", merge).collect())) == want
    state.compact(spark, f"{tmp_path}/state", merge)
    state.compact(spark, f"{tmp_path}/state", merge)
    assert sorted(map(tuple, state.state(spark, f"{tmp_path}/state", merge).collect())) == want
    streamed_again = spark.createDataFrame([("x", 10, "e"), ("z", 1, "f")], "k string, at long, v string")
    for _ in range(2):  # a batch that runs again rewrites its folder
        merge(streamed_again).write.mode("overwrite").parquet(f"{tmp_path}/state/deltas/batch=100")
    assert sorted(map(tuple, state.state(spark, f"{tmp_path}/state", merge).collect())) == [("x", 10, "e"), ("y", 6, "d"), ("z", 1, "f")]


def test_balances_drop_what_is_spent(spark, tmp_path):
    merge = state.sums(["account", "token"])
    parts = [[("a", "t", 10), ("b", "t", 5)], [("a", "t", -10), ("c", "t", 10)], [("c", "t", -4), ("b", "u", 1)]]
    streamed(spark, str(tmp_path), parts, merge, "account string, token string, delta long")
    want = [("b", "t", 5), ("b", "u", 1), ("c", "t", 6)]
    live = lambda: sorted(map(tuple, state.state(spark, f"{tmp_path}/state", merge).where("delta > 0").collect()))
    assert live() == want
    state.compact(spark, f"{tmp_path}/state", merge, "delta > 0")
    assert live() == want and state.state(spark, f"{tmp_path}/state", merge).count() == 3
    full = spark.createDataFrame([r for p in parts for r in p], "account string, token string, delta long")
    assert core.drift(state.state(spark, f"{tmp_path}/state", merge), merge(full).where("delta > 0")).count() == 0
    assert core.drift(merge(full), merge(full).where("delta > 0")).collect()[0].side == "incremental"


def test_tumbling_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:50:00", "a", 2), ("2024-01-01 01:10:00", "b", 4)]
    spark.createDataFrame(rows, "ts string, k string, value long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = state.event_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    query = state.tumbling(source, "ts", "1 hour", "2 hours", ["k"]).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.k, r.n, r.value) for r in spark.table("tumbled").collect()) == [("a", 2, 3), ("b", 1, 4)]


def test_query_language_errors_and_pages(spark):
    df = spark.createDataFrame([(k, k % 3, f"n{k}") for k in range(10)], "id long, kind long, name string")
    own = {("N", "T"): df}
    ask = lambda **q: dsl.page(own, {"namespace": "N", "table": "T", **q}, ["id"], q.pop("cursor", None))
    for bad in ({"columns": ["nope"]}, {"columns": ["id; drop"]}, {"order": [{"column": "nope"}]}, {"filter": [{"type": "FilterPredicate", "filterType": "Equals", "column": "nope", "value": 1}]}, {"filter": [{"type": "FilterPredicate", "filterType": "Near", "column": "id", "value": 1}]}, {"filter": [{"type": "Other"}]}):
        with pytest.raises(ValueError):
            ask(**bad)
    with pytest.raises(ValueError):
        dsl.page(own, {"namespace": "N", "table": "X"}, ["id"])

    def where(kind, value, column="kind"):
        return [r[0] for r in ask(columns=["id"], filter=[{"type": "FilterPredicate", "filterType": kind, "column": column, "value": value}])["rows"]]

    assert where("In", []) == [] and where("NotIn", []) == list(range(10)) and where("NotIn", [0, 1]) == [2, 5, 8]
    assert where("Equals", [1, 2]) == [1, 2, 4, 5, 7, 8] and where("NotEquals", [1, 2]) == [0, 3, 6, 9]
    assert where("ILike", "N3", "name") == [3] and where("Like", "N3", "name") == [] and where("IsNull", None, "name") == []
    first = ask(columns=["id"], limit=4)
    assert first["hasMore"] and [r[0] for r in first["rows"]] == [0, 1, 2, 3]
    second = dsl.page(own, {"namespace": "N", "table": "T", "columns": ["id"], "limit": 6}, ["id"], first["nextCursor"])
    assert [r[0] for r in second["rows"]] == [4, 5, 6, 7, 8, 9] and not second["hasMore"] and second["nextCursor"] is None
    assert dsl.read_cursor("not base64!", 1) is None and dsl.read_cursor(first["nextCursor"], 2) is None
