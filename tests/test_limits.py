"""Mint limits and pinned tables against rows worked out by hand."""

import pytest

from ledgerloom.functions.ledger import DAY, EPOCH
from ledgerloom.plans import flows
from ledgerloom.plans.chain import TABLES, Pinned, back

DAY_LEFT = 0.93 ** (1 / 365.25)
GROUP, BASE, TOKEN, LONE, STRANGER = "0xg1", "0xg2", "0xt1", "0xt2", "0xt3"
POLICY, OTHER = flows.SCORE_POLICIES[:2]


def rows(spark, name, *given):
    """A table of the given columns; blocks are days, the rest of the head is 0."""
    columns = {c: "long" if x.startswith("CAST(") and x.endswith("BIGINT)") else "string" for c, x in TABLES[name][2].items()}
    numbers = {"value", "amount", "supply", "minted", "day", "expiry_time", "wrapper_kind", "batch_index"}
    schema = ", ".join(f"{c} {'long' if kind == 'long' or c in numbers else 'string'}" for c, kind in columns.items())
    made = []
    for own in given:
        day = own.get("block_number", 0)
        head = {"block_number": day, "transaction_index": 0, "log_index": 0, "timestamp": EPOCH + day * DAY}
        made.append(tuple({**head, **own}.get(c) for c in columns))
    return spark.createDataFrame(made, schema)


@pytest.fixture(scope="module")
def ledger(spark):
    forever = 1 << 60
    given = {
        "system_block": [{"block_number": d} for d in (0, 10, 20)],
        "register_human": [{"avatar": TOKEN}, {"avatar": LONE}],
        "register_organization": [],
        "register_group": [{"grp": GROUP, "mint": POLICY, "treasury": "0xv"}, {"grp": BASE, "mint": "0xelse", "treasury": "0xv"}],
        "update_metadata_digest": [],
        "score_group_initialized": [{"grp": GROUP, "emitter": POLICY}, {"grp": GROUP, "emitter": OTHER, "block_number": 12}, {"grp": GROUP, "emitter": "0xelse", "block_number": 15}, {"grp": BASE, "emitter": POLICY}],
        "trust": [{"truster": g, "trustee": t, "expiry_time": forever} for g in (GROUP, BASE) for t in (TOKEN, LONE, STRANGER)],
        "transfer_single": [
            {"from_": flows.ZERO, "to_": "0xv", "token_address": TOKEN, "value": 100_000, "block_number": 5},
            {"from_": flows.ZERO, "to_": "0xp", "token_address": TOKEN, "value": 7_000, "block_number": 20},
            {"from_": flows.ZERO, "to_": "0xp", "token_address": LONE, "value": 9_000, "block_number": 18},
        ],
        "transfer_batch": [],
        "historical_supply": [{"emitter": OTHER, "grp": GROUP, "token": TOKEN, "supply": s, "day": d, "block_number": d} for s, d in ((900_000, 8), (500_000, 13))] + [{"emitter": POLICY, "grp": GROUP, "token": TOKEN, "supply": 640_000, "day": 9, "block_number": 9}],
        "personal_minted": [{"emitter": OTHER, "grp": GROUP, "token": TOKEN, "minted": 2_000, "day": 25, "block_number": 19}],
    }
    return {n: rows(spark, n, *own) for n, own in given.items()}


def left(amount, days):
    return int(amount * DAY_LEFT**days)


def test_newest_reports_decay_and_count_for_the_newest_policy(ledger):
    got = {r.token: r for r in flows.mint_limits(ledger, treasuries={}).collect()}
    assert set(got) == {TOKEN, LONE}, "a token that isn't registered and a group of another mint have no limit"
    one = got[TOKEN]
    assert (one.policy, one.supply, one.minted, one.held) == (OTHER, left(500_000, 7), 2_000, left(100_000, 15))
    assert one.available == int((one.supply + one.minted - one.held) * flows.MARGIN)
    assert got[LONE].supply == left(9_000, 2), "without a report, what all accounts hold now"


def test_treasuries_that_pass_on(ledger):
    got = {r.token: r for r in flows.mint_limits(ledger, treasuries={"0xv": ("0xp", "0xq", "0xp")}).collect()}
    assert (got[TOKEN].held, got[LONE].held, got[LONE].available) == (7_000, left(9_000, 2), 0)


def test_limits_of_a_past_block(ledger):
    then = Pinned(ledger, 10)
    got = {r.token: r for r in flows.mint_limits(ledger, then, 1.0, {}).collect()}
    one = got[TOKEN]
    assert (one.policy, one.supply, one.minted, one.held) == (POLICY, left(640_000, 1), 0, left(100_000, 5))
    assert one.available == one.supply - one.held and (got[LONE].supply, got[LONE].available) == (0, 0)


def test_pinned_tables(ledger):
    assert sorted(r[0] for r in back(ledger, 5)["transfer_single"].select("block_number").collect()) == [5]
    nothing = {**ledger, "system_block": ledger["system_block"].limit(0)}
    assert back(nothing, 5)["transfer_single"].count() == 0
