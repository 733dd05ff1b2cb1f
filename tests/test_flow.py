import random
from collections import Counter, deque

import pytest

from ledgerloom.operators import graph
from ledgerloom.plans import catalogue, flows
from ledgerloom.plans.catalogue import QUERIES, holdings, kept, trust


def max_flow(edges: list[tuple], source, sink, target: int | None = None) -> tuple[int, dict[tuple, int]]:
    """Shortest augmenting paths on a bounded edge list (src, dst, key, capacity): the value, and the flow of each edge."""
    at: dict = {}
    to, room, label = [], [], []
    for s, d, k, c in edges:
        for a, b, cap, name in ((s, d, int(c), (s, d, k)), (d, s, 0, None)):
            at.setdefault(a, []).append(len(to))
            to.append(b)
            room.append(cap)
            label.append(name)
    value = 0
    while target is None or value < target:
        came, queue = {source: -1}, deque([source])
        while queue and sink not in came:
            for e in at.get(queue[0], ()):
                if room[e] and to[e] not in came:
                    came[to[e]] = e
                    queue.append(to[e])
            queue.popleft()
        if sink not in came or source == sink:
            break
        path, node = [], sink
        while node != source:
            path.append(came[node])
            node = to[came[node] ^ 1]
        push = min([room[e] for e in path] + ([target - value] if target is not None else []))
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
        value += push
    return value, {label[e]: room[e ^ 1] for e in range(0, len(to), 2) if room[e ^ 1]}


def check(spark, held, trusts, source, sink):
    """Trust, balances and conservation hold, and the value is that of a plain solver."""
    balances = spark.createDataFrame(held, "account long, token long, balance long")
    trust = spark.createDataFrame(trusts, "src long, dst long")
    rows = [tuple(r) for r in graph.largest_flow(balances, trust, source, sink, kept).collect()]
    plain(held, trusts, source, sink, rows)
    return rows


def plain(held, trusts, source, sink, rows):
    have, sent, net = Counter(), Counter(), Counter()
    for a, t, v in held:
        have[a, t] += v
    for s, d, t, v in rows:
        assert v > 0 and s != d and (d, t) in set(trusts)
        sent[s, t] += v
        net[s] -= v
        net[d] += v
    assert all(v <= have[k] for k, v in sent.items())
    assert all(v == 0 for a, v in net.items() if a not in (source, sink)) and net[source] == -net[sink]
    edges = [(a, ("t", t), 0, v) for (a, t), v in have.items()] + [(("t", t), a, 1, 10**9) for a, t in trusts]
    assert net[sink] == max_flow(edges, source, sink)[0]


def test_chain_of_many_hops(spark):
    held = [(k, k, 10 - k) for k in range(7)]
    trusts = [(k + 1, k) for k in range(7)]
    assert sum(v for _, d, _, v in check(spark, held, trusts, 0, 7) if d == 7) == 4


def test_flow_must_go_back(spark):
    """The shortest path is taken first and has to be undone; two takers share one balance."""
    check(spark, [(0, 10, 5), (0, 11, 5), (1, 12, 5), (2, 13, 5), (3, 14, 9)], [(1, 10), (2, 10), (1, 11), (9, 12), (3, 13), (9, 14)], 0, 9)
    assert check(spark, [(0, 1, 5)], [(2, 1)], 0, 9) == [] and check(spark, [(0, 1, 5)], [(0, 1)], 0, 0) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    rng = random.Random(seed)
    held = [(rng.randrange(12), rng.randrange(8), rng.randint(1, 9)) for _ in range(25)]
    trusts = sorted({(rng.randrange(12), rng.randrange(8)) for _ in range(20)})
    check(spark, held, trusts, 0, 1)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    held = [tuple(r) for r in holdings(spark, sf).collect()]
    trusts = [tuple(r) for r in trust(spark, sf).collect()]
    plain(held, trusts, 1, 2, [tuple(r) for r in QUERIES["g_max_flow"](spark, sf).collect()])


EDGES = "src string, dst string, kind string, capacity long"


def nodes(src, dst, kind):
    return (("pool", src) if kind in ("truster", "collateral") else src), (("pool", dst) if kind == "holder" else dst)


def check_path(spark, edges, source, sink, target=None):
    """Balances, trust, mint limits and conservation hold, and the value is a plain solver's."""
    rows = [tuple(r) for r in flows.find_path(spark.createDataFrame(edges, EDGES), source, sink, target, kept).collect()]
    cap = {(s, d, k): 10**9 if c is None else c for s, d, k, c in edges}
    groups = {d for _, d, k in cap if k == "collateral"}
    sent, into, net = Counter(), Counter(), Counter()
    for s, d, t, v in rows:
        assert v > 0 and s != d
        if s in groups and s == t:
            assert (s, d, "mint") in cap
        else:
            sent[s, t] += v
            into[t, d] += v
        net[s] -= v
        net[d] += v
    assert all(v <= cap[a, t, "holder"] for (a, t), v in sent.items())
    assert all(v <= cap[t, a, "collateral" if a in groups else "truster"] for (t, a), v in into.items())
    assert all(v == 0 for a, v in net.items() if a not in (source, sink)) and net[source] == -net[sink]
    plain_edges = [(*nodes(s, d, k), k, c) for (s, d, k), c in cap.items()]
    assert net[sink] == max_flow(plain_edges, source, sink, target)[0]
    return rows


def test_path_through_a_group(spark):
    """A group passes collateral on as its own token, up to the limit; an account and its token's pool are apart; a target is kept."""
    edges = [("a", "a", "holder", 50), ("a", "m", "holder", 40), ("a", "g", "collateral", 7), ("m", "g", "collateral", None), ("g", "z", "mint", None), ("m", "z", "truster", None), ("a", "b", "truster", None), ("b", "b", "holder", 3), ("b", "z", "truster", None)]
    assert sum(v for _, d, _, v in check_path(spark, edges, "a", "z") if d == "z") == 50
    assert sum(v for _, d, _, v in check_path(spark, edges, "a", "z", 9) if d == "z") == 9
    for source, sink, target in (("a", "a", None), ("z", "a", None), ("none", "z", None), ("a", "z", 0)):
        assert check_path(spark, edges, source, sink, target) == []


def test_random_paths(spark):
    rng = random.Random(7)
    people, groups = [f"p{k}" for k in range(10)], ["g0", "g1", "g2"]
    edges = {(a, t, "holder"): rng.randint(1, 20) for a, t in ((rng.choice(people), rng.choice(people + groups)) for _ in range(24))}
    edges |= {(rng.choice(people), rng.choice(people), "truster"): None for _ in range(9)}
    edges |= {(rng.choice(people), g, "collateral"): rng.choice([None, 2, 5]) for g in groups for _ in range(3)}
    edges |= {(g, rng.choice(people), "mint"): None for g in groups for _ in range(2)}
    check_path(spark, [(*k, c) for k, c in edges.items()], "p0", "p1")


def test_arcs(spark):
    """Parallel arcs add up, arcs go both ways, loops, nulls and empty arcs carry nothing; no bound at all needs a target."""
    rows = [("s", "a", 4), ("s", "a", 3), ("a", "s", 9), ("a", "t", None), ("a", "a", 5), (None, "t", 5), ("s", "t", 0), ("s", "t", -2)]
    arcs = spark.createDataFrame(rows, "src string, dst string, capacity long")
    assert sorted(map(tuple, graph.arc_flow(arcs, "s", "t", kept).collect())) == [("a", "t", 7), ("s", "a", 7)]
    assert graph.arc_flow(arcs.limit(0), "s", "t", kept).collect() == []
    free = spark.createDataFrame([("s", "t", None), ("s", "t", 2**62)], "src string, dst string, capacity long")
    with pytest.raises(ValueError):
        graph.arc_flow(free, "s", "t", kept)
    assert [tuple(r) for r in graph.arc_flow(free, "s", "t", kept, 2**62).collect()] == [("s", "t", 2**62)]


def test_dealing(spark):
    """A hot token's givers and takers make at most as many transfers as they are; both sides' sums come out."""
    rng = random.Random(3)
    sent = {("h", f"a{k}"): rng.randint(1, 50) for k in range(300)} | {("c", "a1"): 4}
    got, left = {("c", "b1"): 1, ("c", "b2"): 3}, sum(v for (t, _), v in sent.items() if t == "h")
    while left:
        got["h", f"b{len(got)}"] = x = min(left, rng.randint(1, 90))
        left -= x
    sides = (spark.createDataFrame([(*k, x) for k, x in side.items()], "t string, a string, x long") for side in (sent, got))
    rows = [tuple(r) for r in graph.dealt(*sides, kept).collect()]
    out, into = Counter(), Counter()
    for s, d, t, v in rows:
        assert v > 0
        out[t, s] += v
        into[t, d] += v
    assert out == sent and into == got and len(rows) <= len(sent) + len(got)


def test_rounds_read_what_is_near(spark):
    """only the first table holds what is far from both ends; the rest has the pairs that the search met."""
    written = []

    def spied(df, name):
        out = kept(df, name)
        written.append((name, out.count()))
        return out

    held = [(0, 10, 3), (1, 11, 4), (2, 12, 5)] + [(1000 + k, 1000 + k, 1) for k in range(50)]
    trusts = [(1, 10), (2, 11), (9, 12)] + [(1001 + k, 1000 + k) for k in range(49)]
    balances, trust_ = spark.createDataFrame(held, "account long, token long, balance long"), spark.createDataFrame(trusts, "src long, dst long")
    rows = [tuple(r) for r in graph.largest_flow(balances, trust_, 0, 9, spied).collect()]
    plain(held, trusts, 0, 9, rows)
    assert sum(v for _, d, _, v in rows if d == 9) == 3
    assert max(n for name, n in written if name == "pairs") < 20


def test_null_ends_end_the_search(spark):
    balances = spark.createDataFrame([(0, 1, 5), (None, 1, 5), (0, None, 5), (2, 3, 5)], "account long, token long, balance long")
    trust_ = spark.createDataFrame([(2, 1), (None, 1), (None, 3), (9, None)], "src long, dst long")
    assert graph.largest_flow(balances, trust_, 0, 9, kept).collect() == []


def test_query_meets_lines_once(spark, monkeypatch):
    """holdings and trusts come from one pass over the lines."""
    calls, real = [], catalogue.transfers
    monkeypatch.setattr(catalogue, "transfers", lambda *a: calls.append(1) or real(*a))
    QUERIES["g_max_flow"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
