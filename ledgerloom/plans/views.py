"""State views and time series over the event tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ledger
from ledgerloom.functions.compat import running
from ledgerloom.functions.ledger import DAY
from ledgerloom.operators import core
from ledgerloom.plans.chain import DECAY, KEY, NOW, ZERO, age, newest, now, unsorted, view


def latest(df: DataFrame, *keys: str) -> DataFrame:
    return core.latest_by(df, keys, KEY)


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def digests(t) -> DataFrame:
    return latest(t["update_metadata_digest"].select("avatar", "digest", *KEY), "avatar").select("avatar", "digest")


DIGESTS = f"(SELECT avatar AS of_, digest FROM {newest('update_metadata_digest', 'avatar')})"


# avatars and tokens


@view(f"SELECT avatar, kind, token, digest FROM (SELECT user_ AS avatar, 'signup' AS kind, token FROM v1_signup UNION ALL SELECT organization, 'organization', NULL FROM v1_organization_signup) LEFT JOIN {DIGESTS} ON avatar = of_")
def c_v1_avatars(t):
    people = t["v1_signup"].select(F.col("user_").alias("avatar"), F.lit("signup").alias("kind"), "token")
    return union(people, t["v1_organization_signup"].select(F.col("organization").alias("avatar"), F.lit("organization").alias("kind"))).join(digests(t), "avatar", "left")


@view(
    f"SELECT avatar, kind, token, name, digest, block_number, timestamp FROM (SELECT organization AS avatar, 'organization' AS kind, NULL AS token, name, block_number, timestamp FROM register_organization UNION ALL SELECT grp, 'group', grp, name, block_number, timestamp FROM register_group UNION ALL SELECT avatar, 'human', avatar, NULL, block_number, timestamp FROM register_human) LEFT JOIN {DIGESTS} ON avatar = of_"
)
def c_v2_avatars(t):
    organizations = t["register_organization"].select(F.col("organization").alias("avatar"), F.lit("organization").alias("kind"), F.lit(None).cast("string").alias("token"), "name", "block_number", "timestamp")
    groups = t["register_group"].select(F.col("grp").alias("avatar"), F.lit("group").alias("kind"), F.col("grp").alias("token"), "name", "block_number", "timestamp")
    humans = t["register_human"].select("avatar", F.lit("human").alias("kind"), F.col("avatar").alias("token"), "block_number", "timestamp")
    return union(organizations, groups, humans).join(digests(t), "avatar", "left")


@view("SELECT 2 AS version, avatar, kind, token, name, digest FROM c_v2_avatars UNION ALL SELECT 1, avatar, kind, token, NULL, digest FROM c_v1_avatars")
def c_avatars(t):
    return union(c_v2_avatars(t).select(F.lit(2).alias("version"), "avatar", "kind", "token", "name", "digest"), c_v1_avatars(t).withColumn("version", F.lit(1)))


@view("SELECT version, token, avatar AS owner, kind FROM c_avatars WHERE token IS NOT NULL UNION ALL SELECT 2, wrapper, avatar, CASE WHEN wrapper_kind = 1 THEN 'static wrapper' ELSE 'demurraged wrapper' END FROM wrapper_deployed")
def c_tokens(t):
    own = c_avatars(t).where("token is not null").select("version", "token", F.col("avatar").alias("owner"), "kind")
    wrapped = t["wrapper_deployed"].select(F.lit(2).alias("version"), F.col("wrapper").alias("token"), F.col("avatar").alias("owner"), F.when(F.col("wrapper_kind") == 1, "static wrapper").otherwise("demurraged wrapper").alias("kind"))
    return own.union(wrapped)


# transfers


@view("SELECT x.block_number, x.transaction_index, x.log_index, x.timestamp, x.kind, x.from_, x.to_, x.token, x.amount, s.user_ AS owner FROM (SELECT block_number, transaction_index, log_index, timestamp, 'hub' AS kind, from_, to_, NULL AS token, amount FROM v1_hub_transfer UNION ALL SELECT block_number, transaction_index, log_index, timestamp, 'transfer', from_, to_, token_address, amount FROM v1_transfer) x LEFT JOIN v1_signup s ON s.token = x.token")
def c_v1_transfers(t):
    hub = t["v1_hub_transfer"].select(*KEY, "timestamp", F.lit("hub").alias("kind"), "from_", "to_", F.lit(None).cast("string").alias("token"), "amount")
    plain = t["v1_transfer"].select(*KEY, "timestamp", F.lit("transfer").alias("kind"), "from_", "to_", F.col("token_address").alias("token"), "amount")
    return hub.union(plain).join(t["v1_signup"].select("token", F.col("user_").alias("owner")).hint("shuffle_hash"), "token", "left")


@view(
    "SELECT x.block_number, x.transaction_index, x.log_index, x.batch_index, x.timestamp, x.kind, x.from_, x.to_, x.token, x.amount, k.owner FROM (SELECT block_number, transaction_index, log_index, 0 AS batch_index, timestamp, 'single' AS kind, from_, to_, token_address AS token, value AS amount FROM transfer_single UNION ALL SELECT block_number, transaction_index, log_index, batch_index, timestamp, 'batch', from_, to_, token_address, value FROM transfer_batch UNION ALL SELECT block_number, transaction_index, log_index, 0, timestamp, 'wrapper', from_, to_, token_address, amount FROM wrapper_transfer) x JOIN c_tokens k ON k.version = 2 AND k.token = x.token"
)
def c_v2_transfers(t):
    """Transfers of tokens that aren't known drop out. Many move the same few tokens, so the tokens are hashed and the transfers not sorted."""
    single = t["transfer_single"].select(*KEY, F.lit(0).cast("long").alias("batch_index"), "timestamp", F.lit("single").alias("kind"), "from_", "to_", F.col("token_address").alias("token"), F.col("value").alias("amount"))
    batch = t["transfer_batch"].select(*KEY, "batch_index", "timestamp", F.lit("batch").alias("kind"), "from_", "to_", F.col("token_address").alias("token"), F.col("value").alias("amount"))
    wrapped = t["wrapper_transfer"].select(*KEY, F.lit(0).cast("long").alias("batch_index"), "timestamp", F.lit("wrapper").alias("kind"), "from_", "to_", F.col("token_address").alias("token"), "amount")
    return union(single, batch, wrapped).join(c_tokens(t).where("version = 2").select("token", "owner").hint("shuffle_hash"), "token")


@view("SELECT 1 AS version, block_number, transaction_index, log_index, 0 AS batch_index, timestamp, kind, from_, to_, token, amount FROM c_v1_transfers UNION ALL SELECT 2, block_number, transaction_index, log_index, batch_index, timestamp, kind, from_, to_, token, amount FROM c_v2_transfers")
def c_transfers(t):
    first = c_v1_transfers(t).drop("owner").withColumns({"version": F.lit(1), "batch_index": F.lit(0).cast("long")})
    return first.unionByName(c_v2_transfers(t).drop("owner").withColumn("version", F.lit(2)))


# trust


@view(f"SELECT user_, can_send_to, limit_, block_number FROM {newest('v1_trust', 'user_, can_send_to')} WHERE limit_ > 0")
def c_v1_trust_relations(t):
    """The condition applies after the latest row is chosen: a limit of 0 revokes."""
    return latest(t["v1_trust"].select("user_", "can_send_to", "limit_", *KEY), "user_", "can_send_to").where("limit_ > 0").select("user_", "can_send_to", "limit_", "block_number")


@view(f"SELECT truster, trustee, expiry_time, block_number FROM {newest('trust', 'truster, trustee')} WHERE expiry_time > {NOW}")
def c_v2_trust_relations(t, trusts: DataFrame | None = None):
    trusts = t["trust"] if trusts is None else trusts
    last = latest(trusts.select("truster", "trustee", "expiry_time", *KEY), "truster", "trustee")
    return last.crossJoin(now(t)).where("expiry_time > now").select("truster", "trustee", "expiry_time", "block_number")


@view("SELECT 2 AS version, truster, trustee, expiry_time, NULL AS limit_ FROM c_v2_trust_relations UNION ALL SELECT 1, can_send_to, user_, NULL, limit_ FROM c_v1_trust_relations")
def c_trust_relations(t):
    second = c_v2_trust_relations(t).select(F.lit(2).alias("version"), "truster", "trustee", "expiry_time")
    return union(second, c_v1_trust_relations(t).select(F.lit(1).alias("version"), F.col("can_send_to").alias("truster"), F.col("user_").alias("trustee"), "limit_"))


# balances and supply


@view(
    f"SELECT account, token, CAST(balance AS BIGINT) AS balance, last_activity FROM (SELECT account, token, sum(d) AS balance, max(timestamp) AS last_activity FROM (SELECT from_ AS account, token_address AS token, -amount AS d, timestamp FROM v1_transfer UNION ALL SELECT to_, token_address, amount, timestamp FROM v1_transfer) GROUP BY 1, 2) JOIN v1_signup s USING (token) WHERE balance > 0 AND account <> '{ZERO}'"
)
def c_v1_balances(t):
    legs = core.double_entry(t["v1_transfer"].select("timestamp", "from_", "to_", "amount", F.col("token_address").alias("token")), "from_", "to_", "amount", ["token", "timestamp"])
    return core.balances(legs, ["token"], "timestamp").where(f"balance > 0 and account <> '{ZERO}'").join(t["v1_signup"].select("token"), "token").select("account", "token", "balance", "last_activity")


def moves(t) -> DataFrame:
    """All native transfers: single and batch."""
    own = ["from_", "to_", F.col("token_address").alias("token"), "value", "timestamp"]
    return unsorted(t, "transfer_single").select(*own).union(unsorted(t, "transfer_batch").select(*own))


MOVES = "(SELECT from_, to_, token_address AS token, value, timestamp FROM transfer_single UNION ALL SELECT from_, to_, token_address, value, timestamp FROM transfer_batch)"


def decayed(amount: str, since: str) -> F.Column:
    """What days from one column's time to now leave of an amount, in double arithmetic."""
    return ledger.decayed(F.col(amount), F.expr(age(since)))


@view(
    f"SELECT account, token, balance, last_activity, CAST(floor(balance * power({DECAY}, {age('last_activity', NOW)})) AS BIGINT) AS decayed FROM (SELECT account, token, CAST(sum(d) AS BIGINT) AS balance, max(timestamp) AS last_activity FROM (SELECT from_ AS account, token, -value AS d, timestamp FROM {MOVES} UNION ALL SELECT to_, token, value, timestamp FROM {MOVES}) GROUP BY 1, 2) WHERE balance > 0 AND account <> '{ZERO}'"
)
def c_v2_balances(t):
    """Balances above 0 and what decay since the last activity leaves of them now."""
    legs = core.double_entry(moves(t), "from_", "to_", "value", ["token", "timestamp"])
    held = core.balances(legs, ["token"], "timestamp").where(f"balance > 0 and account <> '{ZERO}'")
    return held.crossJoin(now(t)).withColumn("decayed", F.floor(decayed("balance", "last_activity"))).drop("now")


@view(f"SELECT 1 AS version, token_address AS token, CAST(sum(CASE WHEN from_ = '{ZERO}' THEN amount ELSE 0 END) - sum(CASE WHEN to_ = '{ZERO}' THEN amount ELSE 0 END) AS BIGINT) AS supply FROM v1_transfer GROUP BY token_address UNION ALL SELECT 2, token, CAST(sum(CASE WHEN from_ = '{ZERO}' THEN value ELSE 0 END) - sum(CASE WHEN to_ = '{ZERO}' THEN value ELSE 0 END) AS BIGINT) FROM {MOVES} GROUP BY token")
def c_total_supply(t):
    minted, burned = F.col("from_") == ZERO, F.col("to_") == ZERO
    first = core.signed_flow(t["v1_transfer"].withColumnRenamed("token_address", "token"), ["token"], "amount", minted, burned)
    return first.withColumn("version", F.lit(1)).unionByName(core.signed_flow(moves(t), ["token"], "value", minted, burned).withColumn("version", F.lit(2)))


# groups


@view(
    f"SELECT m.truster AS grp, m.trustee AS member, m.expiry_time, CASE WHEN h.avatar IS NOT NULL THEN 'human' WHEN o.organization IS NOT NULL THEN 'organization' ELSE 'group' END AS member_kind FROM (SELECT * FROM {newest('(SELECT t.* FROM trust t JOIN register_group g ON g.grp = t.truster)', 'truster, trustee')} WHERE expiry_time > {NOW}) m LEFT JOIN register_human h ON h.avatar = m.trustee LEFT JOIN register_organization o ON o.organization = m.trustee"
)
def c_group_memberships(t):
    """Trusts by groups are picked before the latest is chosen, so the shuffle carries only them. A member that is neither human nor organisation counts as a group."""
    groups = t["register_group"].select(F.col("grp").alias("truster"))
    own = c_v2_trust_relations(t, t["trust"].join(groups, "truster", "left_semi"))
    humans = t["register_human"].select(F.col("avatar").alias("trustee"), F.lit(True).alias("human"))
    organizations = t["register_organization"].select(F.col("organization").alias("trustee"), F.lit(True).alias("organization"))
    own = own.join(humans, "trustee", "left").join(organizations, "trustee", "left")
    return own.select(F.col("truster").alias("grp"), F.col("trustee").alias("member"), "expiry_time", F.when(F.col("human"), "human").when(F.col("organization"), "organization").otherwise("group").alias("member_kind"))


_LATEST = {"owner": "group_owner_updated", "service": "group_service_updated", "fee_collection": "group_fee_updated"}


@view(
    f"SELECT g.grp, CASE WHEN cm.proxy IS NOT NULL THEN 'cm group' WHEN b.grp IS NOT NULL THEN 'base group' ELSE 'group' END AS kind, coalesce(cm.owner, o.owner) AS owner, g.mint, coalesce(cm.mint_handler, b.mint_handler) AS mint_handler, g.treasury, s.service, f.fee_collection, coalesce(m.members, 0) AS members, g.name, g.symbol, d.digest, w0.wrapper AS demurraged, w1.wrapper AS static FROM register_group g LEFT JOIN {newest('group_owner_updated', 'emitter')} o ON o.emitter = g.grp LEFT JOIN {newest('group_service_updated', 'emitter')} s ON s.emitter = g.grp LEFT JOIN {newest('group_fee_updated', 'emitter')} f ON f.emitter = g.grp LEFT JOIN (SELECT grp, count(*) AS members FROM c_group_memberships GROUP BY grp) m ON m.grp = g.grp LEFT JOIN {DIGESTS} d ON d.of_ = g.grp LEFT JOIN (SELECT avatar, max(wrapper) AS wrapper FROM wrapper_deployed WHERE wrapper_kind = 0 GROUP BY avatar) w0 ON w0.avatar = g.grp LEFT JOIN (SELECT avatar, max(wrapper) AS wrapper FROM wrapper_deployed WHERE wrapper_kind = 1 GROUP BY avatar) w1 ON w1.avatar = g.grp LEFT JOIN cm_group_created cm ON cm.proxy = g.grp LEFT JOIN base_group_created b ON b.grp = g.grp"
)
def c_groups(t):
    """Every group with the latest of its settings, its members and wrappers. Of several wrappers of a kind the last by address stands."""
    out = t["register_group"].select("grp", "mint", "treasury", "name", "symbol")
    for column, name in _LATEST.items():
        out = out.join(latest(t[name].select(F.col("emitter").alias("grp"), column, *KEY), "grp").select("grp", column), "grp", "left")
    out = out.join(c_group_memberships(t).groupBy("grp").agg(F.count("*").alias("members")), "grp", "left").join(digests(t).withColumnRenamed("avatar", "grp"), "grp", "left")
    wrappers = t["wrapper_deployed"].groupBy(F.col("avatar").alias("grp")).agg(*[F.max(F.when(F.col("wrapper_kind") == k, F.col("wrapper"))).alias(n) for k, n in enumerate(("demurraged", "static"))])
    cm = t["cm_group_created"].select(F.col("proxy").alias("grp"), F.col("owner").alias("_owner"), F.col("mint_handler").alias("_handler"), F.lit(True).alias("_cm"))
    base = t["base_group_created"].select("grp", "mint_handler", F.lit(True).alias("_base"))
    out = out.join(wrappers, "grp", "left").join(cm, "grp", "left").join(base, "grp", "left")
    kind = F.when(F.col("_cm"), "cm group").when(F.col("_base"), "base group").otherwise("group")
    return out.select("grp", kind.alias("kind"), F.coalesce("_owner", "owner").alias("owner"), "mint", F.coalesce("_handler", "mint_handler").alias("mint_handler"), "treasury", "service", "fee_collection", F.coalesce("members", F.lit(0)).alias("members"), "name", "symbol", "digest", "demurraged", "static")


def _group_balances(t) -> DataFrame:
    """(grp, account, balance) in the tokens of registered groups."""
    return c_v2_balances(t).select(F.col("token").alias("grp"), "account", "balance").join(t["register_group"].select("grp"), "grp", "left_semi")


@view("SELECT b.token AS grp, b.account, b.balance, round(CAST(b.balance AS DOUBLE) / nullif(sum(b.balance) OVER (PARTITION BY b.token), 0), 9) AS fraction FROM c_v2_balances b JOIN register_group g ON g.grp = b.token")
def c_group_token_holders(t):
    return core.share_of_partition(_group_balances(t), ["grp"], "balance").withColumn("fraction", F.round("fraction", 9))


@view("SELECT grp, CAST(sum(balance) AS BIGINT) AS supply FROM c_group_token_holders GROUP BY grp")
def c_group_token_supply(t):
    return _group_balances(t).groupBy("grp").agg(F.sum("balance").alias("supply"))


@view("SELECT timestamp, grp, id, CAST(sum(v) AS BIGINT) AS locked FROM (SELECT timestamp, grp, id, value AS v FROM collateral_locked_single UNION ALL SELECT timestamp, grp, id, value FROM collateral_locked_batch UNION ALL SELECT timestamp, grp, id, -value FROM redeem_return) GROUP BY 1, 2, 3")
def c_group_collateral_diff(t):
    parts = [t[n].select("timestamp", "grp", "id", (sign * F.col("value")).alias("v")) for n, sign in (("collateral_locked_single", 1), ("collateral_locked_batch", 1), ("redeem_return", -1))]
    return union(*parts).groupBy("timestamp", "grp", "id").agg(F.sum("v").alias("locked"))


@view(
    f"SELECT grp, id, locked, decayed, round(coalesce(CAST(locked AS DOUBLE) / nullif(sum(locked) OVER (PARTITION BY grp), 0), 0), 9) AS fraction FROM (SELECT grp, id, CAST(sum(locked) AS BIGINT) AS locked, CAST(floor(sum(locked * power({DECAY}, {age('timestamp', NOW)}))) AS BIGINT) AS decayed FROM c_group_collateral_diff GROUP BY grp, id) WHERE locked > 0"
)
def c_group_collateral(t):
    """What each group has locked, every lock decayed from its own time."""
    each = c_group_collateral_diff(t).crossJoin(now(t)).withColumn("d", decayed("locked", "timestamp"))
    held = each.groupBy("grp", "id").agg(F.sum("locked").alias("locked"), F.floor(F.sum("d")).alias("decayed")).where("locked > 0")
    return core.share_of_partition(held, ["grp"], "locked").withColumn("fraction", F.round(F.coalesce("fraction", F.lit(0.0)), 9))


def vault_flows(t) -> DataFrame:
    parts = [t[n].select("grp", "id", "timestamp", (sign * F.col("value")).alias("amount")) for n, sign in (("collateral_locked_single", 1), ("collateral_locked_batch", 1), ("redeem_return", -1), ("redeem_burn", -1))]
    return union(*parts).join(t["create_vault"].select("grp", "vault"), "grp")


VAULT_FLOWS = "(SELECT v.vault, x.grp, x.id, x.timestamp, x.amount FROM (SELECT grp, id, timestamp, value AS amount FROM collateral_locked_single UNION ALL SELECT grp, id, timestamp, value FROM collateral_locked_batch UNION ALL SELECT grp, id, timestamp, -value FROM redeem_return UNION ALL SELECT grp, id, timestamp, -value FROM redeem_burn) x JOIN create_vault v ON v.grp = x.grp)"


@view(f"SELECT vault, id, balance, CAST(floor(balance * power({DECAY}, {age('last_activity', NOW)})) AS BIGINT) AS decayed FROM (SELECT vault, id, CAST(sum(amount) AS BIGINT) AS balance, max(timestamp) AS last_activity FROM {VAULT_FLOWS} GROUP BY 1, 2)")
def c_group_vault_balances(t):
    """What each vault holds, decayed from its last activity."""
    held = vault_flows(t).groupBy("vault", "id").agg(F.sum("amount").alias("balance"), F.max("timestamp").alias("last_activity"))
    return held.crossJoin(now(t)).select("vault", "id", "balance", F.floor(decayed("balance", "last_activity")).alias("decayed"))


# sets, counts and scores


_SEED = "(SELECT avatar, max(block_number) AS at FROM affiliate_event WHERE is_seed GROUP BY avatar)"


@view(f"SELECT grp, avatar, block_number FROM {newest(f'(SELECT e.* FROM affiliate_event e LEFT JOIN {_SEED} s ON s.avatar = e.avatar WHERE s.at IS NULL OR e.block_number >= s.at)', 'avatar, grp')} WHERE is_add")
def c_affiliate_members(t):
    """Latest-wins membership; an avatar's last seed voids what came before. Events are compared by the whole key."""
    e = t["affiliate_event"].select("grp", "avatar", "is_add", "is_seed", *KEY).withColumn("at", F.struct(*KEY))
    return core.membership_with_reset(e, "avatar", "grp", "at", "is_add", "is_seed").select("grp", "avatar", "block_number")


@view(f"SELECT e.avatar, count(*) AS conflicts FROM affiliate_event e JOIN {_SEED} s ON s.avatar = e.avatar WHERE e.block_number < s.at GROUP BY e.avatar")
def c_affiliate_seed_conflicts(t):
    e = t["affiliate_event"].select("avatar", "is_seed", F.struct(*KEY).alias("at"))
    seed = e.where("is_seed").groupBy("avatar").agg(F.max("at").alias("seed"))
    return e.join(seed, "avatar").where("at < seed").groupBy("avatar").agg(F.count("*").alias("conflicts"))


_STATS = {
    "avatars_v1": "c_v1_avatars", "organizations_v1": "c_v1_avatars WHERE token IS NULL", "humans_v1": "c_v1_avatars WHERE token IS NOT NULL", "avatars_v2": "c_v2_avatars", "organizations_v2": "register_organization", "humans_v2": "register_human", "groups_v2": "register_group",
    "trusts_v1": "c_v1_trust_relations", "trusts_v2": "c_v2_trust_relations", "tokens_v1": "c_tokens WHERE version = 1", "tokens_v2": "c_tokens WHERE version = 2", "hub_transfers_v1": "v1_hub_transfer", "streams_v2": "stream_completed", "transfers_v1": "v1_transfer", "wrappers_v2": "wrapper_deployed",
}


@view(" UNION ALL ".join(f"SELECT '{k}' AS measure, count(*) AS n FROM {v}" for k, v in _STATS.items()) + " UNION ALL SELECT 'transfers_v2', (SELECT count(*) FROM transfer_single) + (SELECT count(*) FROM transfer_batch)")
def c_stats(t):
    views = {f.__name__: f for f in (c_v1_avatars, c_v2_avatars, c_v1_trust_relations, c_v2_trust_relations, c_tokens)}
    rows = []
    for measure, of in _STATS.items():
        name, _, condition = of.partition(" WHERE ")
        df = views[name](t) if name in views else t[name]
        rows.append((df.where(condition) if condition else df).agg(F.count("*").alias("n")).select(F.lit(measure).alias("measure"), "n"))
    return union(*rows, moves(t).agg(F.count("*").alias("n")).select(F.lit("transfers_v2").alias("measure"), "n"))


def standings(t, ends: Sequence[int | None] = (None,)) -> DataFrame:
    """(avatar, s0, s1, ...): an avatar's (in_degree, out_degree, mutual, age) as of each block of ends, null where it wasn't there yet. Ends rise, and the last is None: all blocks.

    A pair of nodes is one row with the newest trust each way of each span between
    ends, so the trusts are shuffled once for both ways and all ends.
    """
    upto = [F.lit(True) if b is None else F.col("block_number") <= b for b in ends]
    span = F.coalesce(*[F.when(c, k) for k, c in enumerate(upto)])
    nows = F.broadcast(t["system_block"].agg(*[F.coalesce(F.max(F.when(c, F.col("timestamp"))), F.lit(0).cast("long")).alias(f"now{k}") for k, c in enumerate(upto)]))
    forth = F.coalesce(F.col("truster") <= F.col("trustee"), F.lit(True))
    low, high = (F.when(forth, F.col(x)).otherwise(F.col(y)) for x, y in (("truster", "trustee"), ("trustee", "truster")))
    rows = t["trust"].select(low.alias("low"), high.alias("high"), forth.alias("forth"), span.alias("span"), F.struct(*KEY, "expiry_time").alias("last"))
    ways = {"f": F.col("forth"), "b": ~F.col("forth")}
    pairs = rows.groupBy("low", "high").agg(*[F.max(F.when(c & (F.col("span") == k), F.col("last"))).alias(f"{w}{k}") for w, c in ways.items() for k in range(len(ends))]).crossJoin(nows)

    def live(way: str, k: int) -> Column:
        newest_ = F.greatest(*[F.col(f"{way}{j}") for j in range(k + 1)]) if k else F.col(f"{way}0")
        return F.coalesce(newest_["expiry_time"] > F.col(f"now{k}"), F.lit(False))

    pairs = pairs.select("low", "high", *[live(w, k).cast("int").alias(f"{w}{k}") for w in ways for k in range(len(ends))])
    own = (F.col("low") == F.col("high")).cast("int")  # who trusts itself is its own mutual, once

    def leg(node: str, out: str, into: str, alone: Column) -> Column:
        counts = [(F.col(f"{into}{k}").alias(f"i{k}"), F.col(f"{out}{k}").alias(f"o{k}"), F.coalesce(F.greatest(F.col(f"f{k}") * F.col(f"b{k}"), F.col(f"f{k}") * alone), F.lit(0)).alias(f"m{k}")) for k in range(len(ends))]
        return F.struct(F.col(node).alias("avatar"), *[c for three in counts for c in three])

    legs = pairs.select(F.explode(F.array(leg("low", "f", "b", own), leg("high", "b", "f", F.lit(0)))).alias("l")).select("l.*").where("avatar is not null")
    sums = legs.groupBy("avatar").agg(*[F.sum(f"{x}{k}").alias(f"{x}{k}") for x in "iom" for k in range(len(ends))])
    people = c_v2_avatars(t).groupBy("avatar").agg(*[F.max(F.when(c, F.col("timestamp"))).alias(f"at{k}") for k, c in enumerate(upto)], *[F.max(F.when(c, True)).alias(f"is{k}") for k, c in enumerate(upto)])

    def standing(k: int) -> Column:
        degrees = [F.coalesce(f"{x}{k}", F.lit(0)).alias(name) for x, name in (("i", "in_degree"), ("o", "out_degree"), ("m", "mutual"))]
        return F.when(F.col(f"is{k}"), F.struct(*degrees, F.floor(F.greatest(F.lit(0), (F.col(f"now{k}") - F.col(f"at{k}")) / 86400)).alias("age"))).alias(f"s{k}")

    return people.join(sums, "avatar", "left").crossJoin(nows).select("avatar", *[standing(k) for k in range(len(ends))])


def scores(known: DataFrame, k: int = 0) -> DataFrame:
    """Trust scores from one of the standings. They are read twice, first for the mean degree."""
    mean = known.agg(F.greatest(F.lit(1.0), F.avg(F.expr(f"s{k}.in_degree + s{k}.out_degree"))).alias("mean"))
    s = known.where(F.col(f"s{k}").isNotNull()).select("avatar", f"s{k}.*").crossJoin(F.broadcast(mean))
    near = F.least(F.lit(40.0), F.expr("(in_degree * 2 + out_degree) / mean * 20"))
    back = F.when(F.col("in_degree") > 0, F.least(F.lit(35.0), F.expr("mutual / nullif(in_degree, 0) * 35"))).otherwise(0.0)
    s = s.withColumn("score", F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), near + back + F.least(F.lit(25.0), F.expr("age / 7.2D")))) + 0.5))
    level = F.when(F.col("score") >= 85, "VERY_HIGH").when(F.col("score") >= 70, "HIGH").when(F.col("score") >= 50, "MEDIUM").when(F.col("score") >= 30, "LOW").otherwise("VERY_LOW")
    confidence = F.when(F.expr("in_degree > 5 and out_degree > 3"), 90).when(F.col("in_degree") > 2, 60).otherwise(30)
    return s.select("avatar", "score", level.alias("level"), confidence.alias("confidence"), "in_degree", "out_degree", "mutual", "age")


@view(
    f"WITH a AS (SELECT avatar, max(timestamp) AS timestamp FROM c_v2_avatars GROUP BY avatar), tr AS (SELECT truster, trustee FROM c_v2_trust_relations), d AS (SELECT avatar, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT trustee AS avatar, 1 AS i, 0 AS o FROM tr UNION ALL SELECT truster, 0, 1 FROM tr) GROUP BY avatar), m AS (SELECT x.truster AS avatar, count(*) AS mutual FROM tr x WHERE EXISTS (SELECT 1 FROM tr y WHERE y.truster = x.trustee AND y.trustee = x.truster) GROUP BY 1), s AS (SELECT a.avatar, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(mutual, 0) AS mutual, CAST(floor(greatest(0, ({NOW} - a.timestamp) / 86400)) AS BIGINT) AS age FROM a LEFT JOIN d USING (avatar) LEFT JOIN m USING (avatar)), n AS (SELECT greatest(1, avg(in_degree + out_degree)) AS mean FROM s), p AS (SELECT s.*, CAST(floor(least(100, greatest(0, least(40, (in_degree * 2 + out_degree) / mean * 20) + CASE WHEN in_degree > 0 THEN least(35, CAST(mutual AS DOUBLE) / in_degree * 35) ELSE 0 END + least(25, age / 7.2))) + 0.5) AS BIGINT) AS score FROM s CROSS JOIN n) SELECT avatar, score, CASE WHEN score >= 85 THEN 'VERY_HIGH' WHEN score >= 70 THEN 'HIGH' WHEN score >= 50 THEN 'MEDIUM' WHEN score >= 30 THEN 'LOW' ELSE 'VERY_LOW' END AS level, CASE WHEN in_degree > 5 AND out_degree > 3 THEN 90 WHEN in_degree > 2 THEN 60 ELSE 30 END AS confidence, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, mutual, age FROM p"
)
def c_trust_scores(t):
    """Position against the network's mean degree (40), reciprocity (35) and age (25); whole days and halves rounded up."""
    return scores(standings(t))


_SAFE = "(SELECT safe, owner, 1 AS d, block_number FROM safe_setup UNION ALL SELECT safe, owner, 1, block_number FROM safe_added UNION ALL SELECT safe, owner, -1, block_number FROM safe_removed)"


@view(f"SELECT safe, owner, CAST(sum(d) AS BIGINT) AS count, max(block_number) AS last_change FROM {_SAFE} GROUP BY 1, 2 HAVING sum(d) > 0")
def c_safe_owners(t):
    changes = union(*[t[n].select("safe", "owner", F.lit(d).alias("d"), "block_number") for n, d in (("safe_setup", 1), ("safe_added", 1), ("safe_removed", -1))])
    return core.set_by_count(changes, ["safe", "owner"], "d", "block_number")


# time series: buckets are the first second of an hour or a day in UTC


STEPS = {"1h": 3600, "1d": DAY}


def bucket(column: str, step: int) -> F.Column:
    return (F.col(column) - F.col(column) % step).alias("bucket")


def dense(changes: DataFrame, keys: list[str], step: int, t) -> DataFrame:
    """Running totals of the changes (keys, bucket, delta) in every bucket from a key's first to now.

    Totals are run over the buckets that have changes, and each then stands for the
    buckets up to the next, so the series itself is neither shuffled nor sorted.
    Rows with a null key keep 0, as nothing equals them.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    sums = changes.groupBy(*keys, "bucket").agg(F.when(known, F.coalesce(F.sum("delta"), F.lit(0))).otherwise(0).alias("delta"))
    last = F.col("now") - F.col("now") % step
    sums = sums.crossJoin(now(t)).where(F.col("bucket") <= last)
    until = F.coalesce(F.lead("bucket").over(Window.partitionBy(*keys).orderBy("bucket")) - step, last)
    spans = sums.select(*keys, "bucket", until.alias("until"), F.sum("delta").over(running(keys, ["bucket"])).alias("total"))
    return spans.select(*keys, F.explode(F.sequence("bucket", "until", F.lit(step).cast("long"))).alias("bucket"), "total")


def dense_sql(changes: str, keys: str, step: int) -> str:
    on = " AND ".join(f"k.{x.strip()} = s.{x.strip()}" for x in keys.split(","))
    own = ", ".join(f"k.{x.strip()}" for x in keys.split(","))
    return f"SELECT {own}, k.bucket, CAST(sum(coalesce(s.delta, 0)) OVER (PARTITION BY {own} ORDER BY k.bucket) AS BIGINT) AS total FROM (SELECT {keys}, unnest(range(low, {NOW} + 1, {step})) AS bucket FROM (SELECT {keys}, min(bucket) AS low FROM {changes} GROUP BY {keys})) k LEFT JOIN (SELECT {keys}, bucket, sum(delta) AS delta FROM {changes} GROUP BY {keys}, bucket) s ON {on} AND s.bucket = k.bucket"


def member_changes(t) -> DataFrame:
    """+1 where a group's trust starts and -1 where it ends: at the next trust of the pair or its expiry, the sentinel expiries aside."""
    own = t["trust"].join(t["register_group"].select(F.col("grp").alias("truster")), "truster", "left_semi")
    spans = core.intervals(own.select("truster", "trustee", "timestamp", "log_index", "expiry_time"), ["truster", "trustee"], "timestamp", ["timestamp", "log_index"])
    end = F.when(F.col("expiry_time") < 10**10, F.least("until", "expiry_time")).otherwise(F.col("until"))
    points = F.array(F.struct(F.col("timestamp").alias("at"), F.lit(1).alias("delta")), F.struct(end.alias("at"), F.lit(-1).alias("delta")))
    return spans.select(F.col("truster").alias("grp"), F.explode(points).alias("p")).select("grp", "p.*").where("at is not null")


_SPANS = "(SELECT *, lead(timestamp) OVER (PARTITION BY truster, trustee ORDER BY timestamp, log_index) AS nxt FROM (SELECT t.* FROM trust t JOIN register_group g ON g.grp = t.truster))"
_ENDS = f"(SELECT truster AS grp, timestamp, CASE WHEN expiry_time < 10000000000 THEN least(expiry_time, coalesce(nxt, expiry_time)) ELSE nxt END AS ends FROM {_SPANS} WHERE nxt IS NULL OR nxt > timestamp)"


def _members_sql(step: int) -> str:
    return dense_sql(f"(SELECT grp, moment - moment % {step} AS bucket, delta FROM (SELECT grp, timestamp AS moment, 1 AS delta FROM {_ENDS} UNION ALL SELECT grp, ends, -1 FROM {_ENDS} WHERE ends IS NOT NULL))", "grp", step)


def _members(t, step: int) -> DataFrame:
    return dense(member_changes(t).select("grp", "delta", bucket("at", step)), ["grp"], step, t)


def _affiliates_sql(step: int) -> str:
    return dense_sql(f"(SELECT grp, timestamp - timestamp % {step} AS bucket, delta FROM (SELECT new_group AS grp, timestamp, 1 AS delta FROM affiliate_changed UNION ALL SELECT old_group, timestamp, -1 FROM affiliate_changed WHERE old_group <> '{ZERO}'))", "grp", step)


def _affiliates(t, step: int) -> DataFrame:
    e = t["affiliate_changed"]
    moved = F.array(F.struct(F.col("new_group").alias("grp"), F.lit(1).alias("delta")), F.struct(F.when(F.col("old_group") != ZERO, F.col("old_group")).alias("grp"), F.lit(-1).alias("delta")))
    changes = e.select("timestamp", F.explode(moved).alias("m")).where("m.grp is not null").select("m.*", bucket("timestamp", step))
    return dense(changes, ["grp"], step, t)


#: The two vaults of the exchange pool on the given tables; a deployment names its own.
VAULTS = ("0xc" + "3".zfill(39), "0xc" + "9".zfill(39))


def _pool_sql(step: int) -> str:
    return dense_sql(f"(SELECT token, timestamp - timestamp % {step} AS bucket, CASE WHEN to_ IN {VAULTS} THEN value ELSE 0 END - CASE WHEN from_ IN {VAULTS} THEN value ELSE 0 END AS delta FROM {MOVES} WHERE to_ IN {VAULTS} OR from_ IN {VAULTS})", "token", step)


def _pool(t, step: int, vaults=VAULTS) -> DataFrame:
    into, out = F.col("to_").isin(*vaults), F.col("from_").isin(*vaults)
    delta = F.when(into, F.col("value")).otherwise(0) - F.when(out, F.col("value")).otherwise(0)
    return dense(moves(t).where(into | out).select("token", bucket("timestamp", step), delta.alias("delta")), ["token"], step, t)


def _vaults_sql(step: int) -> str:
    return dense_sql(f"(SELECT vault, grp, timestamp - timestamp % {step} AS bucket, amount AS delta FROM {VAULT_FLOWS})", "vault, grp", step)


def _vaults(t, step: int) -> DataFrame:
    return dense(vault_flows(t).select("vault", "grp", bucket("timestamp", step), F.col("amount").alias("delta")), ["vault", "grp"], step, t)


def _supply_sql(step: int, grp: str | None = None) -> str:
    known = f"token = '{grp}'" if grp else "token IN (SELECT avatar FROM c_avatars)"
    sums = f"(SELECT token AS grp, timestamp - timestamp % {step} AS bucket, CAST(sum(CASE WHEN from_ = '{ZERO}' THEN value ELSE 0 END) AS BIGINT) AS minted, CAST(-sum(CASE WHEN to_ = '{ZERO}' THEN value ELSE 0 END) AS BIGINT) AS burned FROM {MOVES} WHERE (from_ = '{ZERO}' OR to_ = '{ZERO}') AND {known} GROUP BY 1, 2)"
    total = f"(SELECT *, CAST(sum(minted + burned) OVER (PARTITION BY grp ORDER BY bucket) AS BIGINT) AS supply FROM {sums})"
    return f"SELECT grp, bucket, minted, burned, supply, {', '.join(f'CAST(floor({c} * power({DECAY}, {age("bucket", NOW)})) AS BIGINT) AS {c}_decayed' for c in ('minted', 'burned', 'supply'))} FROM {total}"


def _supply(t, step: int, grp: str | None = None) -> DataFrame:
    """Minted, burned and running supply in the buckets that have any, for all avatars' tokens or one group's."""
    own = moves(t).where((F.col("from_") == ZERO) | (F.col("to_") == ZERO))
    own = own.where(F.col("token") == grp) if grp else own
    flow = [F.sum(F.when(F.col(side) == ZERO, sign * F.col("value")).otherwise(0)).alias(n) for n, side, sign in (("minted", "from_", 1), ("burned", "to_", -1))]
    sums = own.groupBy(F.col("token").alias("grp"), bucket("timestamp", step)).agg(*flow)
    if not grp:  # what is summed is less than what moved, and a frequent token is no hot task
        sums = sums.join(c_avatars(t).select(F.col("avatar").alias("grp")).hint("shuffle_hash"), "grp", "left_semi")
    out = sums.withColumn("supply", F.sum(F.expr("minted + burned")).over(running(["grp"], ["bucket"]))).crossJoin(now(t))
    return out.select("grp", "bucket", "minted", "burned", "supply", *[F.floor(decayed(c, "bucket")).alias(f"{c}_decayed") for c in ("minted", "burned", "supply")])


def _wraps_sql(step: int, grp: str | None = None) -> str:
    who = f"d.avatar = '{grp}'" if grp else "d.avatar IN (SELECT grp FROM register_group)"
    sums = f"(SELECT d.avatar AS grp, w.token_address AS token, CASE WHEN d.wrapper_kind = 0 THEN 'Demurrage' ELSE 'Inflation' END AS kind, w.timestamp - w.timestamp % {step} AS bucket, CAST(sum(CASE WHEN w.from_ = '{ZERO}' THEN w.amount ELSE 0 END) AS BIGINT) AS wrapped, CAST(sum(CASE WHEN w.to_ = '{ZERO}' THEN -w.amount ELSE 0 END) AS BIGINT) AS unwrapped FROM wrapper_transfer w JOIN wrapper_deployed d ON d.wrapper = w.token_address WHERE {who} GROUP BY 1, 2, 3, 4)"
    return f"SELECT *, CAST(sum(wrapped + unwrapped) OVER (PARTITION BY grp, token ORDER BY bucket) AS BIGINT) AS supply FROM {sums}"


def _wraps(t, step: int, grp: str | None = None) -> DataFrame:
    wrappers = t["wrapper_deployed"].select(F.col("avatar").alias("grp"), F.col("wrapper").alias("token"), F.when(F.col("wrapper_kind") == 0, "Demurrage").otherwise("Inflation").alias("kind"))
    wrappers = wrappers.where(F.col("grp") == grp) if grp else wrappers.join(t["register_group"].select("grp"), "grp", "left_semi")
    own = t["wrapper_transfer"].withColumnRenamed("token_address", "token").join(wrappers, "token")
    flow = [F.sum(F.when(F.col(side) == ZERO, sign * F.col("amount")).otherwise(0)).alias(n) for n, side, sign in (("wrapped", "from_", 1), ("unwrapped", "to_", -1))]
    sums = own.groupBy("grp", "token", "kind", bucket("timestamp", step)).agg(*flow)
    return sums.withColumn("supply", F.sum(F.expr("wrapped + unwrapped")).over(running(["grp", "token"], ["bucket"])))


GROUP, WRAPPED_GROUP = ("0xb" + k.zfill(39) for k in ("3", "4"))


def _series(name: str, f, sql, steps=("1h", "1d"), **more) -> None:
    for s in steps:

        def run(t, step=STEPS[s]):
            return f(t, step, **more)

        run.__name__ = f"{name}_{s}"
        view(sql(STEPS[s], **more))(run)


_series("c_group_members_count", _members, _members_sql)
_series("c_affiliate_members_count", _affiliates, _affiliates_sql)
_series("c_pool_vault_balance", _pool, _pool_sql)
_series("c_group_vault_series", _vaults, _vaults_sql, ("1h",))
_series("c_group_mint_redeem", _supply, _supply_sql)
_series("c_group_wrap_unwrap", _wraps, _wraps_sql)
_series("c_f_group_mint_redeem", _supply, _supply_sql, grp=GROUP)
_series("c_f_group_wrap_unwrap", _wraps, _wraps_sql, grp=WRAPPED_GROUP)
