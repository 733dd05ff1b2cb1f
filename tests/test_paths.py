"""Every rule of a path: one broken fixture each, beside a path that keeps them all."""

import pytest

from ledgerloom.operators import paths


def a(k):
    return f"0x{k:040x}"


ALICE, BOB, CAROL, GROUP, ROUTER, SCORE, SCORED, WRAP, LONER = map(a, range(1, 10))
STATE = {
    "registered": ([(ALICE,), (BOB,), (CAROL,), (GROUP,), (SCORED,)], "avatar string"),
    "groups": ([(GROUP,), (SCORED,)], "grp string"),
    "routers": ([(ROUTER,)], "router string"),
    "score_routers": ([(SCORE,)], "router string"),
    "wrappers": ([(WRAP, ALICE)], "wrapper string, avatar string"),
    "flags": ([(CAROL,)], "avatar string"),
    "trusts": ([(BOB, ALICE), (ROUTER, ALICE), (SCORE, ALICE), (BOB, GROUP), (BOB, SCORED), (CAROL, BOB), (ALICE, BOB)], "truster string, trustee string"),
    "approvals": ([(SCORE, ALICE)], "account string, operator string"),
    "limits": ([(SCORED, ALICE, 50)], "grp string, token string, value long"),
    "balances": ([(ALICE, ALICE, 1000), (ALICE, WRAP, 1000), (BOB, ALICE, 1000), (BOB, BOB, 1000), (CAROL, ALICE, 9), (CAROL, BOB, 9)], "account string, token string, value long"),
}
MINT = [(ALICE, ROUTER, ALICE, "10"), (ROUTER, GROUP, ALICE, "10"), (GROUP, BOB, GROUP, "10")]
MINTED = [(ALICE, SCORE, ALICE, "40"), (SCORE, SCORED, ALICE, "40"), (SCORED, BOB, SCORED, "40")]

CASES = {
    "whole": (ALICE, BOB, [(ALICE, BOB, ALICE, "10"), *MINT, (BOB, BOB, ALICE, "10")], []),
    "wrapped": (ALICE, BOB, [(ALICE, BOB, WRAP, "10")], []),
    "scored": (ALICE, BOB, MINTED, []),
    "upper case": (ALICE, BOB, [(ALICE, BOB.upper().replace("X", "x"), ALICE, "10")], []),
    "zero": (ALICE, BOB, [(ALICE, BOB, ALICE, "0")], ["NoZeroFlow"]),
    "empty": (ALICE, BOB, [(ALICE, BOB, ALICE, None)], ["HolderBalanceAvailable", "NoZeroFlow"]),
    "format": (ALICE, BOB, [(ALICE, BOB, "0x12", "10")], ["AddressFormat", "HolderBalanceAvailable", "IsPermittedFlow"]),
    "prefix": (ALICE, BOB, [(ALICE, BOB.replace("0x", "0X"), ALICE, "10")], ["AddressFormat"]),
    "unregistered": (ALICE, LONER, [(ALICE, LONER, ALICE, "10")], ["AvatarRegistration", "IsPermittedFlow"]),
    "no group": (ALICE, BOB, [(ALICE, ROUTER, ALICE, "10"), (ROUTER, CAROL, ALICE, "10"), (CAROL, BOB, CAROL, "10")], ["GroupRegistration", "HolderBalanceAvailable", "IsPermittedFlow", "IsPermittedFlow"]),
    "token": (ALICE, BOB, [(ALICE, BOB, LONER, "10")], ["HolderBalanceAvailable", "IsPermittedFlow", "TokenIdValidity"]),
    "no trust": (BOB, ALICE, [(BOB, ALICE, ALICE, "10")], ["IsPermittedFlow"]),
    "no consent": (CAROL, BOB, [(CAROL, BOB, ALICE, "5")], ["IsPermittedFlow"]),
    "approval": (BOB, BOB, [(BOB, SCORE, ALICE, "10"), (SCORE, SCORED, ALICE, "10"), (SCORED, BOB, SCORED, "10")], ["ApproveCRCRequired"]),
    "conservation": (ALICE, BOB, [(ALICE, ROUTER, ALICE, "11"), *MINT[1:]], ["FlowConservation"]),
    "mint first": (ALICE, BOB, [MINT[0], MINT[2], MINT[1]], ["CollateralBeforeMint", "CollateralBeforeMint"]),
    "twice": (ALICE, BOB, [(ALICE, BOB, ALICE, "10")] * 3, ["NoDuplicateEdges", "NoDuplicateEdges"]),
    "self": (ALICE, BOB, [(ALICE, BOB, ALICE, "10"), (BOB, BOB, ALICE, "1")], []),
    "self elsewhere": (ALICE, CAROL, [(BOB, BOB, ALICE, "1")], ["NoSelfTransfers"]),
    "limit": (ALICE, BOB, [(f, t, k, "30") for f, t, k, _ in MINTED for _ in range(2)], ["NoDuplicateEdges"] * 3 + ["ScoreGroupMintLimitsHonored"]),
    "balance": (ALICE, BOB, [(ALICE, BOB, ALICE, "600"), (ALICE, BOB, WRAP, "1000"), (ALICE, BOB, ALICE, "401")], ["HolderBalanceAvailable", "NoDuplicateEdges"]),
}


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(name, i, source, sink, *step) for name, (source, sink, steps, _) in CASES.items() for i, step in enumerate(steps)]
    steps = spark.createDataFrame(rows, "path string, step int, source string, sink string, from_ string, to_ string, token string, value string")
    state = {k: spark.createDataFrame(*v) for k, v in STATE.items()}
    found = spark.createDataFrame(paths.violations(steps, state).collect(), "path string, rule string, severity string, step int, about string")
    return steps, state, found


@pytest.mark.parametrize("name", CASES)
def test_rules(checked, name):
    assert sorted(r.rule for r in checked[2].where(f"path = '{name}'").collect()) == CASES[name][3]


def test_steps_and_report(spark, checked):
    steps, state, found = checked
    at = {(r.path, r.rule): r.step for r in found.collect()}
    assert at["limit", "ScoreGroupMintLimitsHonored"] == 3 and at["zero", "NoZeroFlow"] == 0 and at["conservation", "FlowConservation"] is None
    report = {r.rule: (r.broken, r.paths) for r in paths.report(steps, found).collect()}
    assert set(report) == set(paths.RULES) and report["CollateralBeforeMint"] == (2, 1) and report["VertexOrdering"] == (0, 0)
    assert set(report) - {"VertexOrdering"} == {r for _, _, _, rules in CASES.values() for r in rules}
    good = {r.path for r in paths.valid(steps, found).where("valid").collect()}
    assert good == {n for n, (_, _, _, rules) in CASES.items() if all(paths.RULES[r] == "warning" for r in rules)} - {"empty"}
    assert paths.violations(steps.limit(0), state).count() == 0
