"""Transfer summaries on small fixtures by hand, and the path search against all simple paths."""

import random
from decimal import Decimal

from ledgerloom.plans import flows

KEY = "block_number long, transaction_index long, log_index long, timestamp long"


def simple_paths(edges, source, sink):
    def go(node, seen, path):
        if node == sink:
            yield path
            return
        for k, (a, b) in enumerate(edges):
            if a == node and b not in seen:
                yield from go(b, seen | {b}, [*path, k])

    return go(source, {source}, [])


def test_edges_on_simple_paths():
    rng = random.Random(4)
    for _ in range(200):
        edges = [(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(10))]
        hubs = [(rng.randrange(6), rng.randrange(6)) for _ in range(2)]
        found, cut = flows.used_edges(hubs, edges)
        assert not cut and found == [{k for p in simple_paths(edges, a, b) for k in p} for a, b in hubs]


def test_search_gives_up():
    n = 12
    complete = [(a, b) for a in range(n) for b in range(n) if a != b]
    assert flows.used_edges([(0, n)], complete)[1] and not flows.used_edges([(0, 1)], [(0, 1)])[1]


def test_version_1_summary(spark):
    hub = spark.createDataFrame([(1, 0, 9, 5, "a", "c", 10), (2, 0, 9, 5, "a", "b", 1)], f"{KEY}, from_ string, to_ string, amount long")
    plain = spark.createDataFrame([(1, 0, 1, 5, "t", "a", "b", 10), (1, 0, 2, 5, "t", "b", "c", 10), (1, 0, 3, 5, "t", "x", "y", 3), (3, 0, 1, 5, "t", "p", "q", 4)], f"{KEY}, token_address string, from_ string, to_ string, amount long")
    got = flows.c_v1_transfer_summary({"v1_hub_transfer": hub, "v1_transfer": plain}).collect()
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got) == [(1, "hub", "a", "c", 10, 2, False), (1, "standalone", "x", "y", 3, 1, False), (2, "hub", "a", "b", 1, 0, False), (3, "standalone", "p", "q", 4, 1, False)]


def test_version_2_summary(spark):
    """Inside a stream only its completion and wrapper transfers count; outside everything is summed by sender and receiver."""
    move = f"{KEY}, operator string, from_ string, to_ string, id string, token_address string, value long"
    single = spark.createDataFrame([(1, 0, k, 0, "o", a, b, t, t, v) for k, a, b, t, v in ((1, "a", "b", "t", 5), (2, "a", "b", "u", 7), (4, "a", "c", "t", 100), (8, "a", "b", "t", 1))], move)
    tables = {
        "transfer_single": single,
        "transfer_batch": single.limit(0),
        "wrapper_transfer": spark.createDataFrame([(1, 0, 5, 0, "w", "a", "d", 9)], f"{KEY}, token_address string, from_ string, to_ string, amount long"),
        "wrapper_deployed": spark.createDataFrame([("w", 0)], "wrapper string, wrapper_kind long"),
        "flow_scope_started": spark.createDataFrame([(1, 0, 3, 0)], KEY),
        "stream_completed": spark.createDataFrame([(1, 0, 7, 0, "a", "c", "t", 42)], f"{KEY}, from_ string, to_ string, id string, amount long"),
    }
    got = flows.c_transfer_summary(tables).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, False, "a", "b", 13.0, 2, "t,u", 3), (1, 0, False, "a", "d", 9.0, 1, "w", 1), (1, 0, True, "a", "c", 42.0, 1, "t", 1)]
    assert {(r.avatar, r.received) for r in flows.c_receive_count(tables).collect()} == {("b", 1), ("c", 1), ("d", 1)}


def test_transactions_of_one_block_stay_apart(spark):
    """The open stream of one transaction says nothing about the next one's transfers, a hub transfer takes no edge of another transaction, and amounts have 38 digits."""
    move = f"{KEY}, operator string, from_ string, to_ string, id string, token_address string, value long"
    single = spark.createDataFrame([(1, 0, 1, 0, "o", "a", "b", "t", "t", 5), (1, 1, 2, 0, "o", "a", "b", "t", "t", 7), (1, 0, 6, 0, "o", "a", "c", "t", "t", 1), (1, 1, 7, 0, "o", "a", "c", "t", "t", 9)], move)
    tables = {
        "transfer_single": single, "transfer_batch": single.limit(0), "wrapper_transfer": spark.createDataFrame([], f"{KEY}, token_address string, from_ string, to_ string, amount long"), "wrapper_deployed": spark.createDataFrame([], "wrapper string, wrapper_kind long"),
        "flow_scope_started": spark.createDataFrame([(1, 0, 3, 0)], KEY), "stream_completed": spark.createDataFrame([], f"{KEY}, from_ string, to_ string, id string, amount long"),
        "v1_hub_transfer": spark.createDataFrame([(1, 0, 9, 5, "a", "c", 10)], f"{KEY}, from_ string, to_ string, amount long"),
        "v1_transfer": spark.createDataFrame([(1, 1, 1, 5, "t", "a", "c", Decimal(10**19)), (1, 0, 2, 5, "t", "a", "c", Decimal(10**37))], f"{KEY}, token_address string, from_ string, to_ string, amount decimal(38,0)"),
    }
    got = sorted(tuple(r) for r in flows.c_transfer_summary(tables).collect())
    assert got == [(1, 0, False, "a", "b", 5.0, 1, "t", 1), (1, 1, False, "a", "b", 7.0, 1, "t", 1), (1, 1, False, "a", "c", 9.0, 1, "t", 1)]
    got = sorted(tuple(r) for r in flows.c_v1_transfer_summary(tables).collect())
    assert got == [(1, 0, "hub", "a", "c", 10, 1, False), (1, 1, "standalone", "a", "c", 10**19, 1, False)]
    assert flows.c_transfer_summaries(tables).count() == 5
