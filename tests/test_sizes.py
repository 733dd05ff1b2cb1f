"""Steps whose work must not outgrow their input: what they may make, and that their results stay the same."""

from oracle import actual
from pyspark.sql import functions as F

from ledgerloom.functions import abi
from ledgerloom.operators import core, paths
from ledgerloom.plans import catalogue, flows, kpis, named, views
from ledgerloom.plans.chain import Chain
from ledgerloom.sources import calls

SF = "/root/testdata/sf0.001"


class With(dict):
    """Tables of a mapping with some of them replaced."""

    def __init__(self, t, **own):
        super().__init__(own)
        self.t = t

    def __missing__(self, name):
        return self.t[name]


def test_dealt_join_is_a_join(spark):
    left = spark.range(40).selectExpr("id as a", "if(id < 30, 0, id % 4) as k")
    right = spark.range(25).selectExpr("id as b", "if(id < 15, 0, id % 5) as k")
    want = actual(left.join(right, "k").select("k", "a", "b"))
    for most in (1, 7, 16_000_000):
        assert actual(core.dealt_join(left, right, "k", most).select("k", "a", "b")) == want


def test_small_places_are_not_put_together(spark):
    """what meets is small beside what comes of it, so its tasks aren't chosen by its bytes."""
    rows = spark.range(30).selectExpr("id as a", "id % 2 as k")
    df = core.dealt_join(rows, rows.withColumnRenamed("a", "b"), "k", 100)
    assert df.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism and df.count() == 450


def test_frequent_keys_are_repeated_by_array(spark):
    """a key's right rows aren't repeated one by one for each part of its left rows; values may be null or more than one."""
    left = spark.range(2000).selectExpr("id as a", "id % 2 as k")
    right = spark.range(2000).selectExpr("if(id < 2, null, id) as b", "id % 2 as k", "id % 3 as c")
    store, no = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    stages = lambda: store.stageList(no, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), no)
    written = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    for columns in (["k", "b", "c"], ["k", "b"]):
        sums = ["count(*)", "count(b)", "sum(a * b)", *[f"sum(hash({c}))" for c in columns]]
        want, before = left.join(right.select(columns), "k").selectExpr(*sums).first(), written()
        assert core.dealt_join(left, right.select(columns), "k", 20_000).selectExpr(*sums).first() == want
        assert written() - before < 50_000


def test_trust_graph_rows_are_not_shuffled_to_be_distinct(spark):
    """rows are made once, also where a wrapper has two avatars or an avatar's name."""
    t = Chain(spark, SF)
    trusts, _ = flows._trusts(t)
    (one, a), (_, b) = trusts.where("truster <> trustee").groupBy("truster").agg({"trustee": "min"}).limit(2).collect()
    other = trusts.where(f"truster = '{one}' and trustee <> '{a}'").first()
    own = [(a, "0xw1"), (b, "0xw1"), (a, "0xw2"), (a, "0xw2"), (a, b)] + ([(other[1], "0xw1"), (a, other[1])] if other else [])
    t = With(t, wrapper_deployed=spark.createDataFrame(own, "avatar string, wrapper string"))
    got = flows.c_trust_graph(t)
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    pairs = {tuple(r) for r in trusts.collect()}
    want = pairs | {(x, w) for x, y in pairs for v, w in own if v == y}
    rows = [tuple(r) for r in got.collect()]
    assert sorted(want - set(rows)) == [] and sorted(set(rows) - want) == []
    assert len(rows) == len(want)


def test_capacity_edges_make_no_rows_of_tokens_without_a_pool(spark, monkeypatch):
    """A wrapper that nobody holds meets no trust."""

    def whole(_):
        raise AssertionError("the whole trust graph isn't needed")

    monkeypatch.setattr(flows, "c_trust_graph", whole)
    t = Chain(spark, SF)
    pool = flows.c_balance_graph(t).where("units > 0").select("token").distinct()
    got = flows.trust_in(t, pool).select("truster", "token")
    monkeypatch.undo()
    want = flows.c_trust_graph(t).join(pool, "token", "left_semi").select("truster", "token")
    assert actual(got) == actual(want) and got.count()
    monkeypatch.setattr(flows, "c_trust_graph", whole)
    flows.capacity_edges(t)


def test_users_balances_are_given_as_moved_and_as_decayed(spark):
    """both measures of a balance, as a user may ask for either."""
    t = Chain(spark, SF)
    first, second = named.c_q_total_balance(t).orderBy("version").collect()
    assert first.decayed is None and 0 < second.decayed < second.units
    assert named.c_q_profile_view(t).first().decayed == second.decayed
    rows = named.c_q_valid_inviters(t).collect()
    assert rows and all(0 < r.decayed <= r.units for r in rows)


def test_steps_are_joined_once_for_each_address_before_they_are_kept(spark):
    """all that is known of an address comes with one join; pairs are looked up where a rule asks for them."""
    plans = {}

    def keep(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return df

    own = {"registered": "avatar", "groups": "grp", "routers": "router", "score_routers": "router", "flags": "avatar", "wrappers": "wrapper avatar", "trusts": "truster trustee", "approvals": "account operator"}
    state = {n: spark.createDataFrame([], ", ".join(f"{c} string" for c in columns.split())) for n, columns in own.items()}
    state |= {"limits": spark.createDataFrame([], "grp string, token string, value long"), "balances": spark.createDataFrame([], "account string, token string, value long")}
    steps = spark.range(3).selectExpr("id as path", "id as step", "'0xa' as source", "'0xb' as sink", "'0xa' as from_", "'0xb' as to_", "'0xa' as token", "id as value")
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation,org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation")
    try:
        paths.violations(steps, state, keep)
    finally:
        spark.conf.unset("spark.sql.optimizer.excludedRules")
    assert plans["steps"].count("Join ") <= 5  # three of the steps, two that make the tokens' table


def test_steps_of_few_addresses_are_not_moved(spark):
    """what is known of few addresses goes to the steps; rules that read no state take what was kept first; all ways find the same."""
    rows = [(p, k, "0xA", "0xd", *x) for p in range(6) for k, x in enumerate([("0xa", f"0xb{p % 4}", "0xt", 5), ("0xA", f"0xb{p % 4}", "0xt", 6), (f"0xb{p % 4}", "0xd", "0xu", p), ("0xc", "0xd", "0xa", None), ("0xd", "0xd", "0xa", 1)])]
    rows += [(1, 9, "0xe", "0xa", "0xa", "0xb1", "0xt", 7)]  # a second pair of ends in a path
    steps = spark.createDataFrame(rows, "path long, step int, source string, sink string, from_ string, to_ string, token string, value long")
    own = {"registered": "avatar", "groups": "grp", "routers": "router", "score_routers": "router", "flags": "avatar", "wrappers": "wrapper avatar", "trusts": "truster trustee", "approvals": "account operator"}
    told = {"registered": [("0xa",), ("0xB1",), ("0xd",)], "groups": [("0xb2",)], "routers": [("0xb3",)], "flags": [("0xa",), ("0xb1",)], "wrappers": [("0xT", "0xa")], "trusts": [("0xb1", "0xa"), ("0xa", "0xb1")]}
    state = {n: spark.createDataFrame(told.get(n, []), ", ".join(f"{c} string" for c in columns.split())) for n, columns in own.items()}
    state |= {"limits": spark.createDataFrame([], "grp string, token string, value long"), "balances": spark.createDataFrame([("0xa", "0xt", 11)], "account string, token string, value long")}
    plans, found = {}, {}
    for few in (0, 3, 1_000):

        def keep(df, name, few=few):
            plans[few, name] = plan_of(df)
            return df

        found[few] = sorted(map(tuple, paths.violations(steps, state, keep, few).collect()), key=str)
    assert found[0] == found[3] == found[1_000]
    held = [r for r in found[0] if r[1] == "HolderBalanceAvailable" and r[3] is None and r[4] == "0xa"]
    assert [r[0] for r in held] == [1]  # 5 + 6 + 7 of 11, the others 5 + 6
    assert {few: plans[few, "steps"].count("strategy=broadcast") for few in (0, 3, 1_000)} == {0: 0, 3: 1, 1_000: 3}
    assert all(c not in plans[0, "steps"].split("\n")[0] for c in ("malformed", "spent", "sink"))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_summaries_group_where_the_window_left_the_rows(spark):
    """wrappers are looked up for wrapper transfers alone, before the window."""
    plan = plan_of(flows.c_transfer_summary(Chain(spark, SF)))
    above = plan[: plan.index("Window")]
    assert "Join" not in above and "distinct" not in above


def test_transfers_are_not_sorted_by_token(spark):
    """Few tokens are moved often; the tokens' side is hashed."""
    t = Chain(spark, SF)
    for df, how in ((views.c_v1_transfers(t), "LeftOuter"), (views.c_v2_transfers(t), "Inner")):
        assert f"Join {how}" in plan_of(df) and "rightHint=(strategy=shuffle_hash)" in plan_of(df)


def test_dense_series_are_made_after_their_totals(spark):
    """a total stands for all buckets up to the next change, so the series is never shuffled."""
    t = With(None, system_block=spark.createDataFrame([(1, 47)], "block_number long, timestamp long"))
    rows = [("a", 10, 2), ("a", 10, 1), ("a", 30, -1), ("a", 50, 9), ("b", 40, 5), ("c", 50, 1), (None, 30, 7), ("d", 40, None)]
    got = views.dense(spark.createDataFrame(rows, "k string, bucket long, delta long"), ["k"], 10, t)
    assert plan_of(got).index("explode(") < plan_of(got).index("Window")
    want = [("a", 10, 3), ("a", 20, 3), ("a", 30, 2), ("a", 40, 2), ("b", 40, 5), ("d", 40, 0), (None, 30, 0), (None, 40, 0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_supply_is_summed_before_its_tokens_are_looked_up(spark):
    """the semi-join takes sums, not transfers."""
    plan = plan_of(views._supply(Chain(spark, SF), 3600))
    assert plan.index("LeftSemi") < plan.index("sum(CASE WHEN")


def test_calls_are_read_once_for_their_transfers(spark):
    """no filter below the explode repeats the reading of all calls; numbers and lengths are written the same by either way."""
    df = calls.transfer_data(spark.createDataFrame([(b"",), (None,)], "input binary"))
    plan = plan_of(df)
    assert "Filter" not in plan[plan.index("Generate") :] and df.count() == 0
    rows = spark.createDataFrame([(0, "1.5"), (77, "99999999999999999999"), (2**62, "0xfF")], "n long, t string")
    assert [tuple(map(bytes.hex, map(bytes, r))) for r in rows.select(abi.written_number(F.col("n")), abi.written_number(F.col("t")), abi.written_length(F.col("n"))).collect()] == [(f"{n:064x}", f"{t:064x}", f"{n:064x}") for n, t in ((0, 2), (77, 99999999999999999999), (2**62, 255))]


def test_lines_are_not_sorted_by_order(spark):
    """Lines meet hashed orders, so no task sorts the lines it reads."""
    for df in (catalogue.transfers(spark, SF), views.moves(Chain(spark, SF))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan


def test_score_changes_read_trusts_once(spark, monkeypatch):
    """scores of all times come from one pass over the trusts."""
    seen, real = [], Chain.rows
    monkeypatch.setattr(Chain, "rows", lambda self, name, *a, **b: seen.append(name) or real(self, name, *a, **b))
    kpis.c_score_changes(Chain(spark, SF))
    assert seen.count("trust") == 1


def test_standings_of_awkward_trusts(spark):
    """a later row of either way decides from its block on; self-trust is mutual once; null ends are no one's; who came later isn't there before."""
    trusts = [(1, "a", "b", 99), (2, "b", "a", 99), (3, "a", "a", 99), (4, None, "a", 99), (4, "a", None, 99), (4, None, None, 99), (5, "c", "a", 4), (5, "z", "y", 99), (5, "b", "c", 7), (6, "b", "a", 0), (8, "c", "b", 99), (9, "a", "b", 0), (9, "b", "a", 50)]
    blocks = range(1, 11)
    people = [(1, "a"), (2, "b"), (2, "b"), (7, "c"), (8, None)]
    t = {
        "system_block": spark.createDataFrame([(b, b) for b in blocks], "block_number long, timestamp long"),
        "trust": spark.createDataFrame([(b, 0, k, *x) for k, (b, *x) in enumerate(trusts)], "block_number long, transaction_index long, log_index long, truster string, trustee string, expiry_time long"),
        "register_human": spark.createDataFrame([(b, b, a) for b, a in people], "block_number long, timestamp long, avatar string"),
        "register_organization": spark.createDataFrame([], "block_number long, timestamp long, organization string, name string"),
        "register_group": spark.createDataFrame([], "block_number long, timestamp long, grp string, name string"),
        "update_metadata_digest": spark.createDataFrame([], "block_number long, transaction_index long, log_index long, avatar string, digest string"),
    }
    ends = [-1, 5, 8, None]
    got = {r["avatar"]: [None if s is None else tuple(s) for s in r[1:]] for r in views.standings(t, ends).collect()}
    want: dict = {a: [] for a in ("a", "b", "c", None)}
    for end in ends:
        to = 10 if end is None else end
        live = {(x, y) for (x, y), e in {(x, y): e for b, x, y, e in trusts if b <= to}.items() if e > to}
        for a, out in want.items():
            mutual = sum(x == a and y is not None and (y, x) in live for x, y in live) if a else 0
            out.append((sum(y == a for _, y in live) if a else 0, sum(x == a for x, _ in live) if a else 0, mutual, 0) if any(b <= to and n == a for b, n in people) else None)
    assert got == want
