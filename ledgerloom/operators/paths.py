"""Rules that a list of transfers must keep before it is sent, for any number of paths at once.

A path is an ordered list of steps; every rule is an assertion over rows, so all
paths are checked by a few groupings and one window over (path, group).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDRESS = "^0x[0-9a-fA-F]{40}$"
#: The rules by name, and whether a break makes the path invalid
RULES = {
    "NoZeroFlow": "error",
    "AddressFormat": "error",
    "VertexOrdering": "error",
    "AvatarRegistration": "error",
    "GroupRegistration": "error",
    "TokenIdValidity": "error",
    "IsPermittedFlow": "error",
    "ApproveCRCRequired": "error",
    "FlowConservation": "error",
    "CollateralBeforeMint": "error",
    "NoDuplicateEdges": "warning",
    "NoSelfTransfers": "warning",
    "ScoreGroupMintLimitsHonored": "error",
    "HolderBalanceAvailable": "warning",
}
NUMBER = "decimal(38,0)"
#: So many different addresses of a column are few: what is known of them goes to the steps, not the steps to it
FEW = 1_000


def _facts(state: Mapping[str, DataFrame]) -> DataFrame:
    """(address, known, group, router, score, flag): what the state tells of an address, a row for each."""
    kinds = {"known": ["registered"], "group": ["groups"], "router": ["routers", "score_routers"], "score": ["score_routers"], "flag": ["flags"]}
    rows = reduce(DataFrame.union, [state[n].select(F.lower(F.col(state[n].columns[0])).alias("address"), F.lit(k).alias("kind")) for k, names in kinds.items() for n in names])
    return rows.where("address is not null").groupBy("address").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in kinds])


def _few(steps: DataFrame, columns: Sequence[str], few: int) -> dict[str, list[str]]:
    """The addresses of the columns that have few of them; a pass for sketches comes first, so that long lists are never made."""
    about = steps.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    found = {c: [r[0] for r in steps.select(c).distinct().limit(few + 1).collect()] for c in columns if about[c] <= few}
    return {c: own for c, own in found.items() if len(own) <= few}


def _hinted(facts: DataFrame, column: str, few: Mapping[str, list[str]]) -> DataFrame:
    """Facts of a column's addresses for a join in which the steps aren't sorted, and not moved either where there are few of them."""
    return F.broadcast(facts.where(F.col(column).isin(few[column]))) if column in few else facts.hint("shuffle_hash")


def _told(df: DataFrame, column: str, facts: DataFrame, names: Mapping[str, str], few: Mapping[str, list[str]] = {}) -> DataFrame:  # noqa: B006
    """df with facts of a column's address under other names, false where there are none."""
    own = facts.select(F.col("address").alias(column), *[F.col(k).alias(n) for k, n in names.items()])
    return df.join(_hinted(own, column, few), column, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in names.values()})


def _paired(df: DataFrame, a: str, b: str, pairs: DataFrame, name: str) -> DataFrame:
    """df with a flag: (a, b) is among the pairs (first two columns)."""
    x, y = pairs.columns[:2]
    own = pairs.select(F.lower(x).alias(a), F.lower(y).alias(b), F.lit(True).alias(name)).distinct()
    return df.join(own, [a, b], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def violations(steps: DataFrame, state: Mapping[str, DataFrame], keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, few: int = FEW) -> DataFrame:
    """(path, rule, severity, step, about): each break of a rule.

    steps: path, step (its place), source, sink, from_, to_, token, value (text or a
    number of up to 38 digits). state: registered (avatar), groups (grp), routers
    (router), score_routers (router), wrappers (wrapper, avatar), flags (avatar: those
    that consent), trusts (truster, trustee), approvals (account, operator), limits
    (grp, token, value), balances (account, token, value). Addresses compare in lower
    case. A step from sink to sink is only shown, never sent, and isn't checked. A
    value that is no number is 0 or empty for NoZeroFlow only if it is "0", empty or
    null; other rules leave it out, but mint limits refuse it. A step of a rule on
    whole paths is null. VertexOrdering (two addresses of one number) can't break, as
    lower-case addresses of equal numbers are equal. No steps, no rows; a repeated step is a duplicate edge.
    keep(rows, name) may write the steps, first with what their paths tell of them, then
    with what the state tells too, which all rules read, so that the joins run once. A
    column of up to ``few`` different addresses takes the state's facts by a broadcast.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c)
    text, given = F.col("value").cast("string"), F.array("from_", "to_", "token")
    malformed = F.filter(given, lambda x: x.isNull() | ~x.rlike(ADDRESS))
    s = steps.select("path", "step", low("source"), low("sink"), low("from_"), low("to_"), low("token"), F.expr(f"try_cast(cast(value as string) AS {NUMBER})").alias("value"), (text.isNull() | text.isin("", "0")).alias("blank"), malformed.alias("malformed"))
    s = s.where(~((F.col("from_") == F.col("sink")) & (F.col("to_") == F.col("sink"))))
    # what needs no state comes first, while a path's steps are together: two sorts serve it, as all windows of one share their keys
    each, ends = Window.partitionBy("path", "from_", "token").orderBy("to_", "step"), Window.partitionBy("path").orderBy("source", "sink", "step")
    whole = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = F.when(F.row_number().over(each) == 1, F.sum(F.when(F.col("value") > 0, F.col("value"))).over(whole))
    same = [F.lag(c).over(ends).eqNullSafe(F.col(c)) for c in ("source", "sink")]
    s = s.withColumn("first", ~(same[0] & same[1])).withColumn("way", F.count_if("first").over(ends.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    s = s.withColumns({"again": F.lag("to_").over(each).eqNullSafe(F.col("to_")), "spent": spent})
    s = s.withColumns({f"{c}end": F.col(c).isin(F.col("source"), F.col("sink")) for c in ("from_", "to_")})
    moves = keep(s.withColumn("sink", F.when(F.col("first"), F.col("sink"))), "moves")
    known = _few(moves, ["token", "from_", "to_"], few)

    facts = _facts(state)
    wrappers = state["wrappers"].select(F.lower("wrapper").alias("token"), F.lower("avatar").alias("owner")).where("owner is not null").dropDuplicates(["token"])
    wrappers = wrappers.join(facts.select(F.col("address").alias("owner"), F.col("known").alias("owner_known")), "owner", "left")
    tokens = facts.select(F.col("address").alias("token"), F.col("router").alias("token_router"), F.col("known").alias("token_known")).join(wrappers, "token", "full")
    tokens = tokens.select("token", "owner", "token_router", F.when(F.col("owner").isNull(), F.col("token_known")).otherwise(F.col("owner_known")).alias("known"))
    s = moves.select("path", "step", "source", "from_", "to_", "token", "value")  # no more than what rules on the state read
    for column in ("to_", "from_"):
        s = _told(s, column, facts, {k: f"{column.rstrip('_')}_{k}" for k in ("known", "group", "router", "score", "flag")}, known)
    s = s.join(_hinted(tokens, "token", known), "token", "left").withColumns({"owner": F.coalesce("owner", "token"), **{n: F.coalesce(n, F.lit(False)) for n in ("token_router", "known")}})
    s = keep(s, "steps")

    def broken(rule: str, df: DataFrame, condition: Column | str, about: str = "token", step: bool = True) -> DataFrame:
        at = F.col("step") if step else F.lit(None).cast("int")
        return df.where(condition).select("path", F.lit(rule).alias("rule"), F.lit(RULES[rule]).alias("severity"), at.cast("int").alias("step"), F.col(about).cast("string").alias("about"))

    flowing = s.where("value > 0")
    out = [
        broken("NoZeroFlow", moves, "blank"),
        broken("AddressFormat", moves.where("size(malformed) > 0").select("path", "step", F.explode("malformed").alias("address")), F.lit(True), "address"),
        broken("TokenIdValidity", s.where(F.col("token").rlike(ADDRESS)).where("not token_router and not known").groupBy("path", "token").agg(F.min("step").alias("step")), F.lit(True)),
        broken("NoDuplicateEdges", moves, "again"),
        broken("NoSelfTransfers", moves, "from_ = to_", "from_"),
    ]

    # of a step's accounts its joins tell already; the ends are looked up once a path
    ends = moves.where("first").select("path", F.explode(F.array("source", "sink")).alias("vertex"))
    ends = _told(ends, "vertex", facts, {"router": "router", "known": "known"})
    own = s.select("path", F.explode(F.array(*[F.struct(F.col(c).alias("vertex"), F.col(f"{n}_router").alias("router"), F.col(f"{n}_known").alias("known")) for c, n in (("from_", "from"), ("to_", "to"))])).alias("v")).select("path", "v.*")
    strange = ends.select("path", "vertex", "router", "known").union(own).where("not router and not known").where(F.col("vertex").rlike("^0x.{40}$")).select("path", "vertex").distinct()
    out.append(broken("AvatarRegistration", strange, F.lit(True), "vertex", False))

    fed = s.where("from_router and token <> to_").select("path", F.col("to_").alias("vertex")).distinct()
    minting = s.where("token = from_ and not from_router").select("path", F.col("from_").alias("vertex"), "from_group").distinct()
    out.append(broken("GroupRegistration", minting.join(fed, ["path", "vertex"], "left_semi"), "not from_group", "vertex", False))

    # who may send to whom: routers feed groups freely, all others by trust, or by consent on both sides
    # each step is looked up only among the pairs that its case asks for
    asked = s.where("not (from_router and to_group)")
    to_router = asked.where("to_router")
    by_trust = _paired(asked.where("to_router or not from_flag").select("path", "step", "token", "to_", "owner"), "to_", "owner", state["trusts"], "trusted")
    approving = _paired(to_router.where("to_score").select("path", "step", "to_", "source"), "to_", "source", state["approvals"], "approved")
    consent = asked.where("not to_router and from_flag")
    follows = _paired(consent.select("path", "step", "from_", "to_"), "from_", "to_", state["trusts"], "follows")
    out += [
        broken("IsPermittedFlow", by_trust, "not trusted"),
        broken("IsPermittedFlow", to_router, "from_flag", "from_"),
        broken("ApproveCRCRequired", approving, "not approved", "to_"),
        broken("IsPermittedFlow", follows, "not follows", "to_"),
        broken("IsPermittedFlow", consent, "not to_flag", "to_"),
    ]

    legs = moves.where("value > 0").select("path", "way", F.explode(F.array(F.struct(F.col("from_").alias("vertex"), F.col("from_end").alias("end"), (-F.col("value")).alias("d")), F.struct(F.col("to_").alias("vertex"), F.col("to_end").alias("end"), F.col("value").alias("d")))).alias("leg"))
    net = legs.select("path", "way", "leg.*").where("not end").groupBy("path", "way", "vertex").agg(F.sum("d").alias("net"))
    out.append(broken("FlowConservation", net, "net <> 0", "vertex", False))

    # a group's collateral and mints in order: what came in before a mint covers all mints up to it, and nothing comes in after
    collateral, mint = F.expr("from_router and to_group"), F.expr("from_group and not from_router and not to_router and not to_group")
    minted = flowing.where(collateral | mint).select("path", "step", F.when(collateral, F.col("to_")).otherwise(F.col("from_")).alias("grp"), collateral.alias("inward"), "value")
    upto = Window.partitionBy("path", "grp").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    minted = minted.withColumn("came", F.sum(F.when(F.col("inward"), F.col("value")).otherwise(0)).over(upto)).withColumn("left", F.sum(F.when(~F.col("inward"), F.col("value")).otherwise(0)).over(upto))
    out.append(broken("CollateralBeforeMint", minted, "(inward and left > 0) or (not inward and came < left)", "grp"))

    # mints through a score router, added up in order by group and collateral: the first step over the limit
    scored = s.where("from_score and to_group")
    out.append(broken("ScoreGroupMintLimitsHonored", scored, "value is null or value < 0"))
    limits = state["limits"].select(F.lower("grp").alias("to_"), F.lower("token").alias("token"), F.col("value").cast(NUMBER).alias("room"))
    so_far = Window.partitionBy("path", "to_", "token").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    over = scored.where("value > 0").withColumn("sum", F.sum("value").over(so_far)).join(limits, ["to_", "token"], "left").where("room is null or sum > room")
    out.append(broken("ScoreGroupMintLimitsHonored", over.groupBy("path", "to_", "token").agg(F.min("step").alias("step")), F.lit(True)))

    holders = s.where("not from_group and not from_router")
    out.append(broken("HolderBalanceAvailable", holders, "value is null"))
    held = state["balances"].select(F.lower("account").alias("from_"), F.lower("token").alias("token"), F.col("value").cast(NUMBER).alias("held"))
    spent = _told(moves.where("spent is not null").select("path", "from_", "token", "spent"), "from_", facts, {"group": "from_group", "router": "from_router"}, known)
    spent = spent.where("not from_group and not from_router").join(held, ["from_", "token"], "left")
    out.append(broken("HolderBalanceAvailable", spent, "held is null or spent > held", "from_", False))
    return reduce(DataFrame.unionByName, out)


def report(steps: DataFrame, found: DataFrame) -> DataFrame:
    """(rule, severity, broken, paths): a row for each rule, those that nothing breaks too."""
    spark = steps.sparkSession
    rules = spark.createDataFrame(list(RULES.items()), "rule string, severity string")
    counts = found.groupBy("rule").agg(F.count("*").alias("broken"), F.count_distinct("path").alias("paths"))
    return F.broadcast(rules).join(counts, "rule", "left").fillna(0, ["broken", "paths"])


def valid(steps: DataFrame, found: DataFrame) -> DataFrame:
    """(path, valid): a path is valid if it breaks no rule that is an error."""
    bad = found.where("severity = 'error'").select("path", F.lit(False).alias("valid")).distinct()
    return steps.select("path").distinct().join(bad, "path", "left").fillna(True, ["valid"])
