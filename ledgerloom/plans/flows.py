"""Transfer summaries, the routing graph's tables, mint limits and domain checks, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ledger
from ledgerloom.functions.ledger import DAY, EPOCH
from ledgerloom.operators import core, graph, paths
from ledgerloom.plans.catalogue import kept
from ledgerloom.plans.chain import DECAY, KEY, NOW, ZERO, age, back, newest, now, view
from ledgerloom.plans.views import c_v2_avatars, c_v2_balances, c_v2_trust_relations, decayed, latest, union

TRANSACTION = ["block_number", "transaction_index"]
MARGIN = 0.999999  # Fixed value: what the routing graph takes of a balance


# transfer summaries

_MOVES_2 = "SELECT block_number, transaction_index, log_index, 'move' AS what, from_, to_, token_address AS token, value AS amount, timestamp FROM transfer_single UNION ALL SELECT block_number, transaction_index, log_index, 'move', from_, to_, token_address, value, timestamp FROM transfer_batch UNION ALL SELECT block_number, transaction_index, log_index, 'wrapper', from_, to_, token_address, amount, timestamp FROM wrapper_transfer UNION ALL SELECT block_number, transaction_index, log_index, 'start', NULL, NULL, NULL, NULL, timestamp FROM flow_scope_started UNION ALL SELECT block_number, transaction_index, log_index, 'done', from_, to_, id, amount, timestamp FROM stream_completed"


@view(
    f"WITH e AS ({_MOVES_2}), s AS (SELECT *, max(CASE WHEN what = 'start' THEN log_index END) OVER w AS started, max(CASE WHEN what = 'done' THEN log_index END) OVER w AS done FROM e WINDOW w AS (PARTITION BY block_number, transaction_index ORDER BY log_index RANGE UNBOUNDED PRECEDING)), k AS (SELECT s.*, what = 'done' AS stream FROM s WHERE what IN ('done', 'wrapper') OR what = 'move' AND (started IS NULL OR coalesce(done, -1) >= started)) SELECT k.block_number, k.transaction_index, stream, from_, to_, round(CAST(sum(CASE WHEN d.wrapper_kind = 1 AND what = 'wrapper' THEN amount * power({DECAY}, greatest(0, floor((k.timestamp - 1602720000) / 86400))) ELSE amount END) AS DOUBLE), 0) AS amount, count(DISTINCT token) AS tokens, string_agg(DISTINCT token, ',' ORDER BY token) AS token_set, count(*) AS transfers FROM k LEFT JOIN wrapper_deployed d ON d.wrapper = k.token GROUP BY 1, 2, 3, 4, 5"
)
def c_transfer_summary(t):
    """Per transaction, inside or outside a stream, and sender and receiver: amount, tokens (their number and names) and transfers.

    A stream starts with a scope marker and ends with its completion, whose own
    rows stand for the transfers inside. Wrapper transfers inside a stream are
    counted outside, as completions don't show them. Static wrapper amounts are
    decayed to the block's day. Events of one log index are peers.
    """
    own = [*TRANSACTION, "log_index", "from_", "to_"]
    static = t["wrapper_deployed"].where("wrapper_kind = 1").select(F.col("wrapper").alias("token_address"), F.lit(True).alias("static"))
    wrapped = t["wrapper_transfer"].join(static.hint("shuffle_hash"), "token_address", "left")
    wrapped = wrapped.withColumn("amount", F.when(F.col("static"), ledger.decayed(F.col("amount"), ledger.day_index(F.col("timestamp")))).otherwise(F.col("amount").cast("double")))
    parts = [df.select(*own, F.lit(what).alias("what"), F.col(token).alias("token"), F.col(amount).cast("double").alias("amount")) for df, what, token, amount in ((t["transfer_single"], "move", "token_address", "value"), (t["transfer_batch"], "move", "token_address", "value"), (wrapped, "wrapper", "token_address", "amount"), (t["stream_completed"], "done", "id", "amount"))]
    e = union(*parts, t["flow_scope_started"].select(*TRANSACTION, "log_index", F.lit("start").alias("what")))
    w = Window.partitionBy(*TRANSACTION).orderBy("log_index").rangeBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({n: F.max(F.when(F.col("what") == n, F.col("log_index"))).over(w) for n in ("start", "done")})
    outside = F.col("start").isNull() | (F.coalesce("done", F.lit(-1)) >= F.col("start"))
    e = e.where(F.col("what").isin("done", "wrapper") | ((F.col("what") == "move") & outside)).withColumn("stream", F.col("what") == "done")
    # rows of a transaction are together since the window: they are grouped where they are
    tokens = F.collect_set("token")
    return e.groupBy(*TRANSACTION, "stream", "from_", "to_").agg(F.round(F.sum("amount"), 0).alias("amount"), F.size(tokens).cast("long").alias("tokens"), F.array_join(F.array_sort(tokens), ",").alias("token_set"), F.count("*").alias("transfers"))


@view("SELECT to_ AS avatar, count(*) AS received FROM c_transfer_summary GROUP BY to_")
def c_receive_count(t):
    return c_transfer_summary(t).groupBy(F.col("to_").alias("avatar")).agg(F.count("*").alias("received"))


MOST_STEPS = 100_000  # Fixed values: the search of one transaction gives up after so many steps,
MOST_DEPTH = 50  # and follows no path beyond this


def used_edges(hubs: list[tuple[str, str]], edges: list[tuple[str, str]]) -> tuple[list[set[int]], bool]:
    """For each hub transfer the edges that lie on a simple path from its sender to its receiver, and whether the search gave up."""
    by_sender: dict[str, list[int]] = {}
    for k, (a, _) in enumerate(edges):
        by_sender.setdefault(a, []).append(k)
    steps, found = 0, []
    for source, sink in hubs:
        used: set[int] = set()
        path: list[int] = []
        on_path = {source}
        stack: list[Iterator[int]] = []
        steps += 1
        if source != sink:
            stack.append(iter(by_sender.get(source, ())))
        while stack and steps < MOST_STEPS:
            k = next(stack[-1], None)
            if k is None:
                stack.pop()
                if path:
                    on_path.discard(edges[path.pop()][1])
                continue
            to = edges[k][1]
            if to in on_path:
                continue
            steps += 1
            if to == sink:
                used.update(path)
                used.add(k)
            elif len(stack) < MOST_DEPTH:
                path.append(k)
                on_path.add(to)
                stack.append(iter(by_sender.get(to, ())))
        found.append(used)
    return found, steps >= MOST_STEPS


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*TRANSACTION, "kind", "from_", "to_", "amount", "transfers", "cut"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.decimal128(38, 0), pa.int64(), pa.bool_())
    for b in batches:
        out: list[tuple] = []
        for block, transaction, events in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            hubs, own = ([e for e in events if e["hub"] == flag] for flag in (True, False))
            found, cut = used_edges([(e["from_"], e["to_"]) for e in hubs], [(e["from_"], e["to_"]) for e in own])
            out += [(block, transaction, "hub", h["from_"], h["to_"], h["amount"], len(used), cut) for h, used in zip(hubs, found, strict=True)]
            used = set().union(*found)
            out += [(block, transaction, "standalone", m["from_"], m["to_"], m["amount"], 1, cut) for k, m in enumerate(own) if k not in used]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


@view()
def c_v1_transfer_summary(t):
    """Each hub transfer with the number of the transaction's transfers on its paths, and transfers on none; transactions are searched one by one, ``cut`` tells that its search gave up."""
    own = ["from_", "to_", F.col("amount").cast("decimal(38,0)").alias("amount")]
    rows = t["v1_hub_transfer"].select(*TRANSACTION, *own, F.lit(True).alias("hub")).union(t["v1_transfer"].select(*TRANSACTION, *own, F.lit(False).alias("hub")))
    grouped = rows.groupBy(*TRANSACTION).agg(F.array_sort(F.collect_list(F.struct("from_", "to_", "amount", "hub"))).alias("events"))
    return grouped.mapInArrow(_summed, "block_number long, transaction_index long, kind string, from_ string, to_ string, amount decimal(38,0), transfers long, cut boolean")


@view()
def c_transfer_summaries(t):
    """The summaries of both versions."""
    second = c_transfer_summary(t).select(F.lit(2).alias("version"), *TRANSACTION, F.when(F.col("stream"), "stream").otherwise("transfer").alias("kind"), "from_", "to_", "amount")
    first = c_v1_transfer_summary(t).select(F.lit(1).alias("version"), *TRANSACTION, "kind", "from_", "to_", F.col("amount").cast("double").alias("amount"))
    return second.unionByName(first)


# the routing graph


@view("SELECT t.truster, t.trustee AS token FROM c_v2_trust_relations t WHERE t.truster NOT IN (SELECT grp FROM register_group) AND t.truster IN (SELECT avatar FROM c_v2_avatars) AND t.trustee IN (SELECT avatar FROM c_v2_avatars) UNION SELECT t.truster, d.wrapper FROM c_v2_trust_relations t JOIN wrapper_deployed d ON d.avatar = t.trustee WHERE t.truster NOT IN (SELECT grp FROM register_group) AND t.truster IN (SELECT avatar FROM c_v2_avatars) AND t.trustee IN (SELECT avatar FROM c_v2_avatars)")
def c_trust_graph(t):
    """(truster, token): registered avatars but groups trust tokens of registered avatars, wrapped ones too.

    A group with many trusters and many wrappers gives as many rows as their
    product, so these rows are neither shuffled nor made distinct: a wrapper of one
    avatar that is no avatar itself can't give a row twice.
    """
    trusts, avatars = _trusts(t)
    wrappers = t["wrapper_deployed"].select("wrapper", F.col("avatar").alias("trustee")).distinct()
    shared = wrappers.groupBy("wrapper").agg(F.count("*").alias("n")).where("n > 1").select("wrapper").union(avatars.select(F.col("avatar").alias("wrapper")))
    lone, others = (wrappers.join(shared, "wrapper", how) for how in ("left_anti", "left_semi"))
    few = trusts.select("truster", F.col("trustee").alias("token")).union(trusts.join(others, "trustee").select("truster", "wrapper")).distinct()
    return few.union(core.dealt_join(trusts, lone, "trustee").select("truster", F.col("wrapper").alias("token")))


def _trusts(t) -> tuple[DataFrame, DataFrame]:
    """(truster, trustee) of registered avatars, each pair once, without groups as trusters; and the registered avatars."""
    avatars = c_v2_avatars(t).select("avatar").distinct()
    own = c_v2_trust_relations(t).select("truster", "trustee").join(t["register_group"].select(F.col("grp").alias("truster")), "truster", "left_anti")
    own = own.join(avatars.withColumnRenamed("avatar", "truster"), "truster", "left_semi").join(avatars.withColumnRenamed("avatar", "trustee"), "trustee", "left_semi")
    return own.select("truster", "trustee"), avatars


def trust_in(t, tokens: DataFrame) -> DataFrame:
    """The trust graph's rows of distinct tokens (token). Wrappers are picked before trusts meet them, so no others are made."""
    trusts = _trusts(t)[0]
    wrappers = t["wrapper_deployed"].select(F.col("avatar").alias("trustee"), F.col("wrapper").alias("token")).join(tokens, "token", "left_semi")
    own = trusts.select("truster", F.col("trustee").alias("token")).join(tokens, "token", "left_semi")
    return own.unionByName(trusts.join(wrappers, "trustee").select("truster", "token")).distinct()


_WRAPPED = f"(SELECT account, token, kind, CAST(sum(d) AS BIGINT) AS balance, max(timestamp) AS last_activity FROM (SELECT x.from_ AS account, x.token_address AS token, d.wrapper_kind AS kind, -x.amount AS d, x.timestamp FROM wrapper_transfer x JOIN wrapper_deployed d ON d.wrapper = x.token_address UNION ALL SELECT x.to_, x.token_address, d.wrapper_kind, x.amount, x.timestamp FROM wrapper_transfer x JOIN wrapper_deployed d ON d.wrapper = x.token_address) WHERE account <> '{ZERO}' GROUP BY 1, 2, 3)"


@view(
    f"SELECT account, token, false AS wrapped, CAST(floor(round(balance * power({DECAY}, {age('last_activity', NOW)}) * {MARGIN} / 1000, 6)) AS BIGINT) AS units FROM c_v2_balances WHERE account IN (SELECT avatar FROM c_v2_avatars) AND token IN (SELECT avatar FROM c_v2_avatars) UNION ALL SELECT account, token, true, CAST(floor(round(balance * power({DECAY}, CASE kind WHEN 1 THEN greatest(0, floor(({NOW} - 1602720000) / 86400)) ELSE {age('last_activity', NOW)} END) * {MARGIN} / 1000, 6)) AS BIGINT) FROM {_WRAPPED} WHERE balance > 0 AND account IN (SELECT avatar FROM c_v2_avatars) AND token IN (SELECT wrapper FROM wrapper_deployed WHERE avatar IN (SELECT avatar FROM c_v2_avatars))"
)
def c_balance_graph(t):
    """(account, token, wrapped, units): native and wrapped balances above 0 of registered accounts in registered avatars' tokens, decayed to now, less the safety margin, cut to thousandths. Static wrappers decay from the ledger's first day."""
    avatars = c_v2_avatars(t).select("avatar").distinct()
    accounts, tokens = (avatars.withColumnRenamed("avatar", c) for c in ("account", "token"))
    native = c_v2_balances(t).join(accounts, "account", "left_semi").join(tokens, "token", "left_semi")
    native = native.crossJoin(now(t)).select("account", "token", F.lit(False).alias("wrapped"), decayed("balance", "last_activity").alias("v"))
    known = t["wrapper_deployed"].join(avatars, "avatar", "left_semi")
    held = wrapped_balances(t, t["wrapper_transfer"], known).join(accounts, "account", "left_semi").crossJoin(now(t))
    wrapped = F.when(F.col("kind") == 1, ledger.decayed(F.col("balance"), ledger.day_index(F.col("now")))).otherwise(decayed("balance", "last_activity"))
    out = native.union(held.select("account", "token", F.lit(True).alias("wrapped"), wrapped.alias("v")))
    return out.select("account", "token", "wrapped", F.floor(F.round(F.col("v") * MARGIN / 1_000, 6)).alias("units"))


def wrapped_balances(t, moved: DataFrame, deployed: DataFrame) -> DataFrame:
    """(account, token, kind, balance, last_activity) above 0 of the given wrappers' transfers."""
    kinds = deployed.select(F.col("wrapper").alias("token"), F.col("wrapper_kind").alias("kind"))
    legs = core.double_entry(moved.withColumnRenamed("token_address", "token").join(kinds, "token"), "from_", "to_", "amount", ["token", "kind", "timestamp"])
    return core.balances(legs, ["token", "kind"], "timestamp").where(f"balance > 0 and account <> '{ZERO}'")


def _made(kind: str, *numbers: int) -> tuple[str, ...]:
    return tuple(f"0x{kind}{n:039d}" for n in numbers)


# Parameters of the given tables' ledger: the mint policy of base groups and their router, and the policies of score groups
BASE_POLICY, SCORE_POLICIES, ROUTER = _made("a", 1)[0], _made("a", 2, 4, 6), _made("b", 10)[0]


@view(
    f"SELECT g.grp, g.treasury, g.mint AS policy, coalesce(s.path_mint_router, '{ROUTER}') AS router, coalesce(s.path_mint_router <> '{ROUTER}', false) AS score FROM register_group g LEFT JOIN (SELECT * FROM {newest(f'(SELECT * FROM score_group_initialized WHERE emitter IN {SCORE_POLICIES})', 'grp')}) s ON s.grp = g.grp WHERE g.mint = '{BASE_POLICY}' OR (g.mint IN {SCORE_POLICIES} AND s.path_mint_router IS NOT NULL)"
)
def c_supported_groups(t):
    """(grp, treasury, policy, router, score): groups of the base policy, and those of a score policy that was initialised for them with a router. A group without a router of its own takes the standard one; score groups have one of their own."""
    score = t["score_group_initialized"].where(F.col("emitter").isin(*SCORE_POLICIES))
    score = latest(score.select("grp", F.col("path_mint_router").alias("own"), *KEY), "grp").select("grp", "own")
    groups = t["register_group"].join(score, "grp", "left").where((F.col("mint") == BASE_POLICY) | (F.col("mint").isin(*SCORE_POLICIES) & F.col("own").isNotNull()))
    return groups.select("grp", "treasury", F.col("mint").alias("policy"), F.coalesce("own", F.lit(ROUTER)).alias("router"), F.coalesce(F.col("own") != ROUTER, F.lit(False)).alias("score"))


@view("SELECT DISTINCT g.grp, g.treasury, g.policy, g.router, g.score, r.trustee AS member FROM c_supported_groups g JOIN c_v2_trust_relations r ON r.truster = g.grp WHERE r.trustee IN (SELECT avatar FROM c_v2_avatars)")
def c_group_trusts(t):
    """The registered avatars whose tokens a supported group trusts."""
    members = c_v2_trust_relations(t).select(F.col("truster").alias("grp"), F.col("trustee").alias("member"))
    members = members.join(c_v2_avatars(t).select(F.col("avatar").alias("member")).distinct(), "member", "left_semi")
    return c_supported_groups(t).join(members, "grp").select("grp", "treasury", "policy", "router", "score", "member").distinct()


#: Parameters of the given tables' ledger: treasuries that pass on what they get, and to whom
SUB_TREASURIES = {_made("c", 4)[0]: _made("c", 4, 1, 8), _made("c", 6)[0]: _made("c", 3)}

_OVERRIDES = " ".join(f"WHEN '{k}' THEN [{', '.join(map(repr, v))}]" for k, v in SUB_TREASURIES.items())


def _left(amount: str, day: str, now_sql: str) -> str:
    """SQL: what the days from a stored day to now leave of an amount, cut to whole units; a later day leaves all."""
    return f"CAST(floor({amount} * power({DECAY}, greatest(0, floor(({now_sql} - {EPOCH}) / {DAY}) - {day}))) AS BIGINT)"


def _limits_sql(ago: str = "", margin: float = MARGIN) -> str:
    time = f"(SELECT coalesce(max(timestamp), 0) FROM system_block{ago})"
    one = lambda n, c: f"(SELECT emitter, grp, token, {_left(c, 'day', time)} AS amount FROM {newest(f'{n}{ago}', 'emitter, grp, token')})"
    groups = f"SELECT g.grp, s.emitter AS policy, CASE g.treasury {_OVERRIDES} ELSE [g.treasury] END AS treasuries FROM register_group{ago} g JOIN {newest(f'(SELECT * FROM score_group_initialized{ago} WHERE emitter IN {SCORE_POLICIES})', 'grp')} s ON s.grp = g.grp WHERE g.mint IN {SCORE_POLICIES}"
    return (
        f"WITH k AS (SELECT DISTINCT g.grp, g.policy, g.treasuries, r.trustee AS token FROM ({groups}) g JOIN c_v2_trust_relations r ON r.truster = g.grp WHERE r.trustee IN (SELECT avatar FROM c_v2_avatars)), u AS (SELECT DISTINCT grp, token, unnest(treasuries) AS account FROM k), "
        f"b AS (SELECT account, token, decayed FROM c_v2_balances{ago}), held AS (SELECT u.grp, u.token, sum(b.decayed) AS held FROM u JOIN b USING (account, token) GROUP BY 1, 2), now_ AS (SELECT token, sum(decayed) AS amount FROM b GROUP BY token), "
        f"x AS (SELECT k.grp, k.token, k.policy, CAST(coalesce(h.amount, n.amount, 0) AS BIGINT) AS supply, coalesce(p.amount, 0) AS minted, CAST(coalesce(held.held, 0) AS BIGINT) AS held FROM k LEFT JOIN {one('historical_supply', 'supply')} h ON h.emitter = k.policy AND h.grp = k.grp AND h.token = k.token LEFT JOIN {one('personal_minted', 'minted')} p ON p.emitter = k.policy AND p.grp = k.grp AND p.token = k.token LEFT JOIN now_ n ON n.token = k.token LEFT JOIN held ON held.grp = k.grp AND held.token = k.token) "
        f"SELECT grp, token, policy, supply, minted, held, CAST(trunc(CAST(greatest(0, supply + minted - held) AS DOUBLE) * {margin}) AS BIGINT) AS available FROM x"
    )


def mint_limits(t, then=None, margin: float = MARGIN, treasuries=SUB_TREASURIES) -> DataFrame:
    """(grp, token, policy, supply, minted, held, available): what a score group may still mint for each registered token that it trusts.

    Groups are those with a mint of a score policy that such a policy initialised;
    their policy is the latest one's. Supply is the policy's latest report for group
    and token, less the decay since its day; without a report what all accounts hold
    of the token now. Minted is the latest report of own mints, decayed alike, else 0.
    Held is what the treasuries hold now: a treasury in `treasuries` counts as those
    it passes on to. Available is supply + minted - held, never below 0, with the
    margin, in whole units. `then` are tables pinned at a block, for the past:
    groups, reports and balances are read from them, trusts and avatars as of now.
    """
    then = then if then is not None else t
    scored = F.col("emitter").isin(*SCORE_POLICIES)
    policy = latest(then["score_group_initialized"].where(scored).select("grp", "emitter", *KEY), "grp").select("grp", F.col("emitter").alias("policy"))
    groups = then["register_group"].where(F.col("mint").isin(*SCORE_POLICIES)).join(policy, "grp").select("grp", "policy", "treasury")
    trusts = c_v2_trust_relations(t).select(F.col("truster").alias("grp"), F.col("trustee").alias("token")).join(groups.select("grp"), "grp", "left_semi")
    known = c_v2_avatars(t).select(F.col("avatar").alias("token"))
    out = groups.join(trusts.distinct().join(known, "token", "left_semi"), "grp")

    balances = c_v2_balances(then).select("account", "token", "decayed").join(out.select("token").distinct(), "token", "left_semi")
    own = F.array("treasury")
    for one, subs in treasuries.items():
        own = F.when(F.col("treasury") == one, F.array(*map(F.lit, subs))).otherwise(own)
    of = out.select("grp", "token", F.explode(F.array_distinct(own)).alias("account"))
    held = of.join(balances, ["account", "token"]).groupBy("grp", "token").agg(F.sum("decayed").alias("held"))
    current = balances.groupBy("token").agg(F.sum("decayed").alias("current"))
    for name, column in (("historical_supply", "supply"), ("personal_minted", "minted")):
        reports = latest(then[name].where(scored).select(F.col("emitter").alias("policy"), "grp", "token", "day", column, *KEY), "policy", "grp", "token").crossJoin(now(then))
        days = F.greatest(F.lit(0), ledger.day_index(F.col("now")) - F.col("day"))
        out = out.join(reports.select("policy", "grp", "token", F.floor(ledger.decayed(F.col(column), days)).alias(column)), ["policy", "grp", "token"], "left")
    out = out.join(current, "token", "left").join(held, ["grp", "token"], "left")
    out = out.withColumn("supply", F.coalesce("supply", "current", F.lit(0))).fillna(0, ["minted", "held"])
    available = (F.greatest(F.lit(0), F.expr("supply + minted - held")).cast("double") * margin).cast("long")
    return out.select("grp", "token", "policy", "supply", "minted", "held", available.alias("available"))


@view(_limits_sql())
def c_mint_limits(t):
    return mint_limits(t)


@view(_limits_sql("__1440ago", 1.0))
def c_mint_limits_then(t, blocks: int = 1440):
    """The limits of ten days ago, without a margin."""
    return mint_limits(t, back(t, blocks), 1.0)


@view(
    f"SELECT avatar, max(flag) AS flag, max(stopped) AS stopped, max(organization) AS organization, max(operators) AS operators FROM (SELECT avatar, flag, 0 AS stopped, 0 AS organization, 0 AS operators FROM {newest('advanced_flag', 'avatar')} UNION ALL SELECT avatar, 0, 1, 0, 0 FROM stopped UNION ALL SELECT organization, 0, 0, 1, 0 FROM register_organization UNION ALL SELECT account, 0, 0, 0, count(*) FROM {newest('approval', 'account, operator')} WHERE approved GROUP BY account) GROUP BY avatar"
)
def c_flags(t):
    """What is known of an avatar: its latest consent flag, whether it stopped or is an organisation, and how many operators it approves now."""
    flag = latest(t["advanced_flag"].select("avatar", "flag", *KEY), "avatar").select("avatar", "flag")
    operators = latest(t["approval"].select("account", "operator", "approved", *KEY), "account", "operator").where("approved").groupBy(F.col("account").alias("avatar")).agg(F.count("*").alias("operators"))
    rows = union(flag, t["stopped"].select("avatar", F.lit(1).alias("stopped")), t["register_organization"].select(F.col("organization").alias("avatar"), F.lit(1).alias("organization")), operators)
    return rows.groupBy("avatar").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("flag", "stopped", "organization", "operators")])


_POOLS = "(SELECT DISTINCT token FROM c_balance_graph WHERE units > 0 AND token NOT IN (SELECT grp FROM c_supported_groups WHERE score))"
_LINKS = "(SELECT DISTINCT truster, trustee FROM c_v2_trust_relations)"
_EDGES = f"SELECT account AS src, token AS dst, 'holder' AS kind, units AS capacity FROM c_balance_graph WHERE units > 0 AND token IN {_POOLS} UNION ALL SELECT token, truster, 'truster', NULL FROM c_trust_graph WHERE token IN {_POOLS}"


def _edges_sql(source: str = "", sink: str = "") -> str:
    approved = f"(SELECT account FROM {newest('approval', 'account, operator')} WHERE approved AND operator = '{source}')"
    return f"{_EDGES} UNION ALL SELECT g.member, g.grp, 'collateral', CASE WHEN g.score THEN CAST(floor(l.available / 1000) AS BIGINT) END FROM c_group_trusts g JOIN {_LINKS} r ON r.truster = g.router AND r.trustee = g.member LEFT JOIN c_mint_limits l ON l.grp = g.grp AND l.token = g.member WHERE g.member IN {_POOLS} AND (NOT g.score OR (g.router IN {approved} AND l.available >= 1000)) UNION ALL SELECT g.grp, a.truster, 'mint', NULL FROM c_supported_groups g JOIN c_trust_graph a ON a.token = g.grp WHERE NOT g.score OR a.truster = '{sink}'"


def capacity_edges(t, source: str | None = None, sink: str | None = None) -> DataFrame:
    """(src, dst, kind, capacity) for a request, or without one the edges that all requests share.

    Holders send to a token's pool up to the balance; pools send to who trusts the
    token, and as collateral to groups that take it if the group's router trusts it
    too; groups send their own token to who trusts it. H holders and T trusters of a
    token are H + T edges; no capacity is no bound. Score groups' tokens have no
    pool; their collateral passes up to the mint limit, and only if the source is an
    operator that their router approves; they mint for the sink alone.
    """
    groups = c_supported_groups(t)
    held = c_balance_graph(t).where("units > 0").join(groups.where("score").select(F.col("grp").alias("token")), "token", "left_anti")
    holders = held.select(F.col("account").alias("src"), F.col("token").alias("dst"), F.lit("holder").alias("kind"), F.col("units").alias("capacity"))
    pools = held.select("token").distinct()
    trusters = trust_in(t, pools).select(F.col("token").alias("src"), F.col("truster").alias("dst"), F.lit("truster").alias("kind"))
    routed = c_v2_trust_relations(t).select(F.col("truster").alias("router"), F.col("trustee").alias("member"))
    taken = c_group_trusts(t).join(routed, ["router", "member"], "left_semi").join(pools.withColumnRenamed("token", "member"), "member", "left_semi")
    minted = groups.join(trust_in(t, groups.select(F.col("grp").alias("token")).distinct()).withColumnRenamed("token", "grp"), "grp")
    base = taken.where("not score").select(F.col("member").alias("src"), F.col("grp").alias("dst"), F.lit("collateral").alias("kind"))
    mints = minted.where(~F.col("score") | (F.col("truster") == sink) if sink else ~F.col("score"))
    parts = [holders, trusters, base, mints.select(F.col("grp").alias("src"), F.col("truster").alias("dst"), F.lit("mint").alias("kind"))]
    if source:
        approved = latest(t["approval"].select("account", "operator", "approved", *KEY), "account", "operator").where((F.col("operator") == source) & F.col("approved"))
        limits = c_mint_limits(t).where("available >= 1000").select("grp", F.col("token").alias("member"), F.floor(F.col("available") / 1000).alias("capacity"))
        scored = taken.where("score").join(approved.select(F.col("account").alias("router")), "router", "left_semi").join(limits, ["grp", "member"])
        parts.append(scored.select(F.col("member").alias("src"), F.col("grp").alias("dst"), F.lit("collateral").alias("kind"), "capacity"))
    return union(*parts)


@view(f"SELECT src, dst, kind, capacity FROM ({_edges_sql()})")
def c_capacity_edges(t):
    return capacity_edges(t)


_PAYER, _PAYEE = _made("a", 1, 4)


@view(f"SELECT src, dst, kind, capacity FROM ({_edges_sql(_PAYER, _PAYEE)})")
def c_capacity_request(t):
    """The edges of one request, score groups among them."""
    return capacity_edges(t, _PAYER, _PAYEE)


def filtered_edges(edges: DataFrame, wrapped: DataFrame, source: str, sink: str, from_tokens=None, to_tokens=None, excluded=(), with_wrap: bool = False) -> DataFrame:
    """The capacity edges of one request.

    The source sends only from_tokens, the sink takes only to_tokens, where
    given; excluded tokens have no pool; wrapped tokens are sent by the source
    alone, and only with_wrap.
    """
    holder, received = F.col("kind") == "holder", F.col("kind").isin("truster", "mint")
    pool = F.when(holder, F.col("dst")).when(F.col("kind") != "mint", F.col("src"))
    out = edges.where(pool.isNull() | ~pool.isin(*excluded)) if excluded else edges
    if from_tokens is not None:
        out = out.where(~holder | (F.col("src") != source) | F.col("dst").isin(*from_tokens))
    if to_tokens is not None:
        out = out.where(~received | (F.col("dst") != sink) | F.col("src").isin(*to_tokens))
    flagged = out.join(wrapped.select(F.col("wrapper").alias("dst"), F.lit(True).alias("_w")).distinct(), "dst", "left")
    keep = ~holder | F.col("_w").isNull()
    return flagged.where(keep | (F.col("src") == source) if with_wrap else keep).select(*edges.columns)


def with_virtual_sink(edges: DataFrame, source: str, to_tokens, groups: DataFrame, name: str = "virtual") -> DataFrame:
    """For a request from an account to itself: the wanted tokens' pools lead to a sink of their own, those that have an inbound edge; a wanted group's token without a pool is minted for it."""
    pools = edges.where((F.col("kind") == "holder") & F.col("dst").isin(*to_tokens)).select(F.col("dst").alias("src")).distinct()
    minting = groups.where(F.col("grp").isin(*to_tokens)).select(F.col("grp").alias("src")).distinct().join(pools, "src", "left_anti")
    kept = edges.where(~F.col("kind").isin("truster", "mint") | (F.col("dst") != source))
    return union(kept, *[d.select("src", F.lit(name).alias("dst"), F.lit(kind).alias("kind")) for d, kind in ((pools, "truster"), (minting, "mint"))])


_SOURCE, _SINK = ("0xa" + str(k).zfill(39) for k in (7, 11))
_PAID, _TAKEN, _OUT = ([("0xa" if k % 4 else "0xb") + str(k).zfill(39) for k in own] for own in (range(1, 60), range(1, 150), (5, 9)))


@view(
    f"SELECT src, dst, kind, capacity FROM c_capacity_edges WHERE NOT (CASE kind WHEN 'holder' THEN dst IN {tuple(_OUT)} WHEN 'mint' THEN false ELSE src IN {tuple(_OUT)} END) AND NOT (kind = 'holder' AND src = '{_SOURCE}' AND dst NOT IN {tuple(_PAID)}) AND NOT (kind IN ('truster', 'mint') AND dst = '{_SINK}' AND src NOT IN {tuple(_TAKEN)}) AND NOT (kind = 'holder' AND src <> '{_SOURCE}' AND dst IN (SELECT wrapper FROM wrapper_deployed))"
)
def c_capacity_filtered(t):
    return filtered_edges(c_capacity_edges(t), t["wrapper_deployed"], _SOURCE, _SINK, _PAID, _TAKEN, _OUT, True)


_WANTED = (*_PAID, *_made("b", *range(1, 11)))


@view(
    f"SELECT src, dst, kind, capacity FROM c_capacity_edges WHERE kind NOT IN ('truster', 'mint') OR dst <> '{_SOURCE}' UNION ALL SELECT DISTINCT dst, 'virtual', 'truster', NULL FROM c_capacity_edges WHERE kind = 'holder' AND dst IN {_WANTED} UNION ALL SELECT DISTINCT grp, 'virtual', 'mint', NULL FROM c_supported_groups WHERE grp IN {_WANTED} AND grp NOT IN (SELECT dst FROM c_capacity_edges WHERE kind = 'holder')"
)
def c_virtual_sink(t):
    return with_virtual_sink(c_capacity_edges(t), _SOURCE, _WANTED, c_supported_groups(t))


POOL = "pool "  # before a token's name: its pool's node, apart from the account of that name


def find_path(edges: DataFrame, source: str, sink: str, target: int | None, keep) -> DataFrame:
    """Transfers (src, dst, token, amount) of a largest flow, or of one of target units if as much can pass, over capacity edges; holders' tokens are dealt to their takers, groups send what they mint."""
    kind = F.col("kind")
    src = F.when(kind.isin("truster", "collateral"), F.concat(F.lit(POOL), "src")).otherwise(F.col("src"))
    dst = F.when(kind == "holder", F.concat(F.lit(POOL), "dst")).otherwise(F.col("dst"))
    flow = graph.arc_flow(keep(edges.select(src.alias("src"), dst.alias("dst"), "capacity"), "arcs"), source, sink, keep, target)
    into, out = F.col("dst").startswith(POOL), F.col("src").startswith(POOL)
    token = F.substring(F.when(into, F.col("dst")).otherwise(F.col("src")), len(POOL) + 1, 1 << 20)
    sent, got = (flow.where(side).select(token.alias("t"), F.col(end).alias("a"), F.col("flow").alias("x")) for side, end in ((into, "src"), (out, "dst")))
    minted = flow.where(~into & ~out).select("src", "dst", F.col("src").alias("token"), F.col("flow").alias("amount"))
    return graph.dealt(sent, got, keep).unionByName(minted)


@view()
def c_find_path(t):
    """A largest flow between two accounts over the given tables' capacity edges, unwrapped tokens alone."""
    edges = filtered_edges(capacity_edges(t, _PAYER, _PAYEE), t["wrapper_deployed"], _PAYER, _PAYEE)
    return find_path(edges, _PAYER, _PAYEE, None, kept)


_HUB_MOVES = "(SELECT * FROM transfer_single UNION ALL SELECT block_number, transaction_index, log_index, timestamp, from_, to_, id, token_address, value FROM transfer_batch)"
_IS = {
    "router": "(SELECT router FROM c_supported_groups)",
    "score": "(SELECT router FROM c_supported_groups WHERE score)",
    "group": "(SELECT grp FROM register_group)",
    "flag": f"(SELECT avatar FROM {newest('advanced_flag', 'avatar')} WHERE flag = 1)",
}
_LINKED = "(SELECT truster, trustee FROM c_v2_trust_relations)"
_STEPS = (
    f"WITH m AS (SELECT block_number AS path, row_number() OVER (PARTITION BY block_number ORDER BY transaction_index, log_index) AS step, from_, to_, token_address AS token, value FROM {_HUB_MOVES}), e AS (SELECT path, arg_min(from_, step) AS source, arg_max(to_, step) AS sink FROM m GROUP BY path), "
    f"s AS (SELECT m.*, source, sink, coalesce(w.avatar, token) AS owner, {', '.join(f'{c}_ IN {of} AS {c}_{k}' for c in ('from', 'to') for k, of in _IS.items())}, token IN {_IS['router']} AS token_router FROM m JOIN e USING (path) LEFT JOIN (SELECT wrapper, min(avatar) AS avatar FROM wrapper_deployed GROUP BY wrapper) w ON w.wrapper = token WHERE NOT (from_ = sink AND to_ = sink)), "
    f"f AS (SELECT s.*, owner IN (SELECT avatar FROM c_v2_avatars) AS known, (to_, owner) IN {_LINKED} AS trusted, (from_, to_) IN {_LINKED} AS follows, (to_, source) IN (SELECT account, operator FROM {newest('approval', 'account, operator')} WHERE approved) AS approved FROM s), "
    f"g AS (SELECT path, step, CASE WHEN from_router AND to_group THEN to_ ELSE from_ END AS grp, from_router AND to_group AS inward, value FROM f WHERE value > 0 AND ((from_router AND to_group) OR (from_group AND NOT from_router AND NOT to_router AND NOT to_group))), "
    "o AS (SELECT *, sum(CASE WHEN inward THEN value ELSE 0 END) OVER w AS came, sum(CASE WHEN inward THEN 0 ELSE value END) OVER w AS gone FROM g WINDOW w AS (PARTITION BY path, grp ORDER BY step ROWS UNBOUNDED PRECEDING)), "
    "l AS (SELECT f.path, f.to_, f.token, sum(f.value) AS spent, any_value(k.available) AS room FROM f LEFT JOIN c_mint_limits k ON k.grp = f.to_ AND k.token = f.token WHERE from_score AND to_group AND f.value > 0 GROUP BY 1, 2, 3), "
    "h AS (SELECT f.path, f.from_, f.token, sum(f.value) AS spent, any_value(b.balance) AS held FROM f LEFT JOIN c_v2_balances b ON b.account = f.from_ AND b.token = f.token WHERE NOT from_group AND NOT from_router AND f.value > 0 GROUP BY 1, 2, 3), "
    "v AS (SELECT DISTINCT path, unnest([source, sink, from_, to_]) AS a FROM f), n AS (SELECT path, source, sink, a, sum(d) AS net FROM (SELECT path, source, sink, from_ AS a, -value AS d FROM f WHERE value > 0 UNION ALL SELECT path, source, sink, to_, value FROM f WHERE value > 0) GROUP BY 1, 2, 3, 4)"
)
_BROKEN = {
    "NoZeroFlow": "SELECT path FROM f WHERE value = 0",
    "AddressFormat": "SELECT path FROM (SELECT path, unnest([from_, to_, token]) AS a FROM f) WHERE NOT regexp_matches(a, '^0x[0-9a-fA-F]{40}$')",
    "VertexOrdering": "SELECT path FROM f WHERE false",
    "AvatarRegistration": f"SELECT path FROM v WHERE a NOT IN {_IS['router']} AND a NOT IN (SELECT avatar FROM c_v2_avatars)",
    "GroupRegistration": "SELECT DISTINCT path, from_ FROM f WHERE token = from_ AND NOT from_router AND NOT from_group AND (path, from_) IN (SELECT path, to_ FROM f WHERE from_router AND token <> to_)",
    "TokenIdValidity": "SELECT DISTINCT path, token FROM f WHERE NOT token_router AND NOT known",
    "IsPermittedFlow": "SELECT path FROM f, range(2) r(k) WHERE NOT (from_router AND to_group) AND CASE WHEN to_router THEN (k = 0 AND NOT trusted) OR (k = 1 AND from_flag) WHEN NOT from_flag THEN k = 0 AND NOT trusted ELSE (k = 0 AND NOT follows) OR (k = 1 AND NOT to_flag) END",
    "ApproveCRCRequired": "SELECT path FROM f WHERE NOT (from_router AND to_group) AND to_score AND NOT approved",
    "FlowConservation": "SELECT path FROM n WHERE net <> 0 AND a <> source AND a <> sink",
    "CollateralBeforeMint": "SELECT path FROM o WHERE (inward AND gone > 0) OR (NOT inward AND came < gone)",
    "NoDuplicateEdges": "SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY path, from_, to_, token ORDER BY step) AS k FROM f) WHERE k > 1",
    "NoSelfTransfers": "SELECT path FROM f WHERE from_ = to_",
    "ScoreGroupMintLimitsHonored": "SELECT path FROM l WHERE room IS NULL OR spent > room",
    "HolderBalanceAvailable": "SELECT path FROM h WHERE held IS NULL OR spent > held",
}


@view(_STEPS + " " + " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{paths.RULES[rule]}' AS severity, count(*) AS broken, count(DISTINCT path) AS paths FROM ({sql})" for rule, sql in _BROKEN.items()))
def c_path_rules(t):
    """The native transfers of each block as one path, from its first sender to its last receiver, against all rules: how often each is broken, and by how many paths."""
    own = ["transaction_index", "log_index", F.col("block_number").alias("path"), "from_", "to_", F.col("token_address").alias("token"), "value"]
    moved = t["transfer_single"].select(*own).union(t["transfer_batch"].select(*own))
    each = Window.partitionBy("path").orderBy("transaction_index", "log_index")
    steps = moved.withColumn("step", F.row_number().over(each))
    steps = steps.withColumn("source", F.first("from_").over(each)).withColumn("sink", F.last("to_").over(each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return paths.report(steps, paths.violations(steps, ledger_state(t), kept))


def ledger_state(t) -> dict[str, DataFrame]:
    """What paths are checked against, of a ledger as it is now."""
    routers = c_supported_groups(t)
    return {
        "registered": c_v2_avatars(t).select("avatar"),
        "groups": t["register_group"].select("grp"),
        "routers": routers.select("router"),
        "score_routers": routers.where("score").select("router"),
        "wrappers": t["wrapper_deployed"].groupBy("wrapper").agg(F.min("avatar").alias("avatar")),
        "flags": latest(t["advanced_flag"].select("avatar", "flag", *KEY), "avatar").where("flag = 1").select("avatar"),
        "trusts": c_v2_trust_relations(t).select("truster", "trustee"),
        "approvals": latest(t["approval"].select("account", "operator", "approved", *KEY), "account", "operator").where("approved").select("account", "operator"),
        "limits": c_mint_limits(t).select("grp", "token", F.col("available").alias("value")),
        "balances": c_v2_balances(t).select("account", "token", F.col("balance").alias("value")),
    }


#: Domain checks by name: a condition on a row, the same for batch and stream.
CHECKS = {
    "trust": "truster <> trustee AND expiry_time > timestamp",
    "transfer_single": f"value > 0 AND from_ <> to_ AND NOT (from_ = '{ZERO}' AND to_ = '{ZERO}')",
    "wrapper_deployed": "wrapper_kind IN (0, 1) AND avatar IS NOT NULL",
    "update_metadata_digest": "digest IS NOT NULL AND length(digest) > 8",
    "approval": "account <> operator",
}


@view(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS checked, count(*) FILTER (WHERE NOT ({c})) AS broken FROM {n}" for n, c in CHECKS.items()))
def c_invariants(t):
    return union(*[t[n].agg(F.count("*").alias("checked"), F.count_if(~F.expr(c)).alias("broken")).select(F.lit(n).alias("name"), "checked", "broken") for n, c in CHECKS.items()])


@view("SELECT 'trust' AS part, truster AS a, token AS b, NULL AS units FROM c_trust_graph UNION ALL SELECT 'balance', account, token, units FROM c_balance_graph WHERE units > 0")
def c_network_snapshot(t):
    """Trust and balances as one table, as a snapshot carries them."""
    trust = c_trust_graph(t).select(F.lit("trust").alias("part"), F.col("truster").alias("a"), F.col("token").alias("b"))
    return union(trust, c_balance_graph(t).where("units > 0").select(F.lit("balance").alias("part"), F.col("account").alias("a"), F.col("token").alias("b"), "units"))
