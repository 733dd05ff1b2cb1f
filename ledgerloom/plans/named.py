"""Named queries over the event tables: lookups, pages, invitations, measures. Each takes its parameters as arguments; the registered query uses the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ledger
from ledgerloom.operators import core
from ledgerloom.plans.chain import DECAY, KEY, NOW, TABLES, ZERO, age, now, view
from ledgerloom.plans.flows import _WRAPPED, c_receive_count, wrapped_balances
from ledgerloom.plans.views import c_affiliate_members, c_avatars, c_group_memberships, c_groups, c_tokens, c_transfers, c_v1_balances, c_v1_trust_relations, c_v2_avatars, c_v2_balances, c_v2_trust_relations, decayed, moves, union


def _a(k: int) -> str:
    return "0xa" + str(k).zfill(39)


def _b(k: int) -> str:
    return "0xb" + str(k).zfill(39)


ME = _a(7)


# balances and tokens


_HELD = f"(SELECT account, balance, decayed FROM c_v2_balances UNION ALL SELECT account, balance, CAST(floor(balance * power({DECAY}, CASE kind WHEN 1 THEN greatest(0, floor(({NOW} - 1602720000) / 86400)) ELSE {age('last_activity', NOW)} END)) AS BIGINT) FROM {_WRAPPED} WHERE balance > 0)"


def held_in(t, native: DataFrame, wrapped: DataFrame) -> DataFrame:
    """(account, balance, decayed): what native and wrapped transfers leave above 0, as it was moved, and what decay leaves of it now; no margin. Static wrappers decay from the ledger's first day."""
    own = core.balances(core.double_entry(native, "from_", "to_", "value", ["token", "timestamp"]), ["token"], "timestamp").where(f"balance > 0 and account <> '{ZERO}'")
    rows = own.withColumn("kind", F.lit(0)).select("account", "kind", "balance", "last_activity").union(wrapped_balances(t, wrapped, t["wrapper_deployed"]).select("account", "kind", "balance", "last_activity"))
    now_left = F.when(F.col("kind") == 1, ledger.decayed(F.col("balance"), ledger.day_index(F.col("now")))).otherwise(decayed("balance", "last_activity"))
    return rows.crossJoin(now(t)).select("account", "balance", F.floor(now_left).alias("decayed"))


def held_by(t, accounts: DataFrame) -> DataFrame:
    """The balances of distinct accounts (account). Only their transfers become two legs."""
    sides = [accounts.select(F.col("account").alias(c), F.lit(True).alias(f"_{c}")) for c in ("from_", "to_")]
    own = lambda df: df.join(sides[0], "from_", "left").join(sides[1], "to_", "left").where("_from_ or _to_").drop("_from_", "_to_")
    return held_in(t, own(moves(t)), own(t["wrapper_transfer"])).join(accounts, "account", "left_semi")


@view(f"SELECT 1 AS version, CAST(coalesce(sum(balance), 0) AS BIGINT) AS units, CAST(NULL AS BIGINT) AS decayed FROM c_v1_balances WHERE account = '{ME}' UNION ALL SELECT 2, CAST(coalesce(sum(balance), 0) AS BIGINT), CAST(coalesce(sum(decayed), 0) AS BIGINT) FROM {_HELD} WHERE account = '{ME}'")
def c_q_total_balance(t, account: str = ME):
    """One row for each version: the sum of an account's balances above 0, wrapped tokens too in version 2: as moved, and in version 2 as decayed to now. These are the user's: the routing graph's margin doesn't apply."""
    mine = (F.col("from_") == account) | (F.col("to_") == account)
    first = c_v1_balances(t).where(F.col("account") == account).agg(F.coalesce(F.sum("balance"), F.lit(0)).alias("units"))
    second = held_in(t, moves(t).where(mine), t["wrapper_transfer"].where(mine)).where(F.col("account") == account).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("balance", "units"), ("decayed", "decayed"))])
    return first.select(F.lit(1).alias("version"), "units", F.lit(None).cast("long").alias("decayed")).union(second.select(F.lit(2).alias("version"), "units", "decayed"))


@view(
    f"SELECT x.version, x.token, x.balance, k.owner, k.kind, k.owner IN (SELECT grp FROM register_group) AS is_group FROM (SELECT 1 AS version, token, balance FROM c_v1_balances WHERE account = '{ME}' UNION ALL SELECT 2, token, balance FROM c_v2_balances WHERE account = '{ME}' UNION ALL SELECT 2, token, balance FROM {_WRAPPED} WHERE account = '{ME}' AND balance > 0) x JOIN c_tokens k ON k.version = x.version AND k.token = x.token"
)
def c_q_token_balances(t, account: str = ME):
    """An account's holdings by token, of both versions and wrapped, with the token's owner and kind."""
    mine = F.col("account") == account
    moved = t["wrapper_transfer"].where((F.col("from_") == account) | (F.col("to_") == account)).withColumnRenamed("token_address", "token")
    wrapped = core.balances(core.double_entry(moved, "from_", "to_", "amount", ["token"]), ["token"]).where(mine & (F.col("balance") > 0)).join(t["wrapper_deployed"].select(F.col("wrapper").alias("token")), "token", "left_semi")
    held = union(*[df.select(F.lit(v).alias("version"), "token", "balance") for v, df in ((1, c_v1_balances(t).where(mine)), (2, c_v2_balances(t).where(mine)), (2, wrapped))])
    groups = t["register_group"].select(F.col("grp").alias("owner"), F.lit(True).alias("g"))
    return held.join(c_tokens(t), ["version", "token"]).join(groups, "owner", "left").select("version", "token", "balance", "owner", "kind", F.coalesce("g", F.lit(False)).alias("is_group"))


_TOKENS = (_a(7), _b(3), "0xd" + "9".zfill(39), "0xe" + "8".zfill(39), "0xf" + "11".zfill(39))


@view(f"SELECT version, token, owner, kind FROM c_tokens WHERE token IN {_TOKENS}")
def c_q_token_info(t, tokens=_TOKENS):
    return c_tokens(t).where(F.col("token").isin(*tokens))


# avatars and profiles


_AVATARS = (_a(7), _a(21), _a(42), _a(18), _b(2))


@view(f"SELECT avatar, version, kind, token, name, digest, avatar IN (SELECT avatar FROM c_v1_avatars) AS has_v1 FROM (SELECT *, row_number() OVER (PARTITION BY avatar ORDER BY version DESC, kind DESC) AS r FROM c_avatars WHERE avatar IN {_AVATARS}) WHERE r = 1")
def c_q_avatar_info(t, avatars=_AVATARS):
    """What is known of avatars: version 2 comes before version 1; has_v1 tells that there is one."""
    own = c_avatars(t).where(F.col("avatar").isin(*avatars))
    top = own.groupBy("avatar").agg(F.max_by(F.struct("version", "kind", "token", "name", "digest"), F.struct("version", "kind")).alias("r"), F.bool_or(F.col("version") == 1).alias("has_v1"))
    return top.select("avatar", "r.*", "has_v1")


@view(f"SELECT a.avatar, p.digest, p.name, p.description FROM (SELECT DISTINCT avatar, digest FROM c_avatars WHERE avatar IN {_AVATARS}) a JOIN profile p ON p.digest = a.digest")
def c_q_profiles(t, avatars=_AVATARS):
    """The profiles behind the latest digests of avatars."""
    return c_avatars(t).where(F.col("avatar").isin(*avatars)).select("avatar", "digest").distinct().join(t["profile"], "digest")


_SEARCH = "SELECT a.avatar, a.kind, p.name, coalesce(r.received, 0) AS received FROM c_v2_avatars a JOIN profile p ON p.digest = a.digest LEFT JOIN c_receive_count r ON r.avatar = a.avatar"


def searchable(t) -> DataFrame:
    """Avatars of version 2 with their profile and what they received."""
    return c_v2_avatars(t).select("avatar", "kind", "digest").join(t["profile"], "digest").join(c_receive_count(t), "avatar", "left").withColumn("received", F.coalesce("received", F.lit(0)))


@view(f"SELECT * FROM ({_SEARCH} WHERE len(list_filter(string_split(lower(p.name), ' '), lambda x: starts_with(x, 'per'))) > 0 AND len(list_filter(string_split(lower(p.name), ' '), lambda x: starts_with(x, '1'))) > 0) ORDER BY received DESC, avatar LIMIT 20")
def c_q_search_profiles(t, text: str = "per 1", size: int = 20):
    """Profiles that have each searched word as the start of a word of their name, the most receiving first."""
    found = searchable(t).where(ledger.prefix_match(F.col("name"), text)).select("avatar", "kind", "name", "received")
    return found.orderBy(F.desc("received"), "avatar").limit(size)


_PREFIX = "0xa" + "0" * 37 + "1"


@view(f"SELECT avatar, kind, name FROM ({_SEARCH}) WHERE (starts_with(avatar, '{_PREFIX}') OR len(list_filter(string_split(lower(name), ' '), lambda x: starts_with(x, 'signup'))) > 0) AND avatar > '{_a(3)}' ORDER BY avatar LIMIT 26")
def c_q_search_by_address_or_name(t, prefix: str = _PREFIX, word: str = "signup", after: str = _a(3), size: int = 25):
    """Avatars whose address starts with a prefix or whose name matches, by address after a cursor; one more than a page."""
    found = searchable(t).where(F.startswith(F.col("avatar"), F.lit(prefix)) | ledger.prefix_match(F.col("name"), word))
    return core.keyset_page(found.select("avatar", "kind", "name"), ["avatar"], size, [after])


@view(f"SELECT a.avatar, p.name, CAST((SELECT sum(units) FROM c_q_total_balance WHERE version = 2) AS BIGINT) AS units, CAST((SELECT sum(decayed) FROM c_q_total_balance WHERE version = 2) AS BIGINT) AS decayed, (SELECT count(*) FROM c_v2_trust_relations WHERE truster = a.avatar) AS trusts, (SELECT count(*) FROM c_v2_trust_relations WHERE trustee = a.avatar) AS trusted_by FROM c_v2_avatars a LEFT JOIN profile p ON p.digest = a.digest WHERE a.avatar = '{ME}'")
def c_q_profile_view(t, account: str = ME):
    own = c_v2_avatars(t).where(F.col("avatar") == account).select("avatar", "digest").join(t["profile"].select("digest", "name"), "digest", "left")
    sides = c_v2_trust_relations(t).where((F.col("truster") == account) | (F.col("trustee") == account)).agg(F.count_if(F.col("truster") == account).alias("trusts"), F.count_if(F.col("trustee") == account).alias("trusted_by"))
    total = c_q_total_balance(t, account).where("version = 2").select("units", "decayed")
    return own.select("avatar", "name").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(sides))


# trust


@view(f"SELECT user_, can_send_to, limit_ FROM c_v1_trust_relations WHERE user_ = '{ME}' OR can_send_to = '{ME}'")
def c_q_trust_relations(t, account: str = ME):
    return c_v1_trust_relations(t).where((F.col("user_") == account) | (F.col("can_send_to") == account)).select("user_", "can_send_to", "limit_")


def relations(t, account: str) -> DataFrame:
    """(other, trusts, trusted_by) of an account: one row for each other party."""
    own = c_v2_trust_relations(t).where((F.col("truster") == account) | (F.col("trustee") == account))
    out = F.col("truster") == account
    return own.groupBy(F.when(out, F.col("trustee")).otherwise(F.col("truster")).alias("other")).agg(F.bool_or(out).alias("trusts"), F.bool_or(F.col("trustee") == account).alias("trusted_by"))


_RELATIONS = f"(SELECT CASE WHEN truster = '{ME}' THEN trustee ELSE truster END AS other, bool_or(truster = '{ME}') AS trusts, bool_or(trustee = '{ME}') AS trusted_by FROM c_v2_trust_relations WHERE truster = '{ME}' OR trustee = '{ME}' GROUP BY 1)"


@view(f"SELECT count(*) FILTER (WHERE trusts) AS trusts, count(*) FILTER (WHERE trusted_by) AS trusted_by, count(*) FILTER (WHERE trusts AND trusted_by) AS mutual, count(*) AS reach FROM {_RELATIONS}")
def c_q_network_summary(t, account: str = ME):
    return relations(t, account).agg(F.count_if("trusts").alias("trusts"), F.count_if("trusted_by").alias("trusted_by"), F.count_if(F.col("trusts") & F.col("trusted_by")).alias("mutual"), F.count("*").alias("reach"))


@view(f"SELECT r.other, CASE WHEN trusts AND trusted_by THEN 'mutuallyTrusts' WHEN trusts THEN 'trusts' ELSE 'trustedBy' END AS relation, a.kind FROM {_RELATIONS} r LEFT JOIN c_v2_avatars a ON a.avatar = r.other WHERE r.other > '{_a(2)}' ORDER BY r.other LIMIT 51")
def c_q_aggregated_trust_enriched(t, account: str = ME, after: str = _a(2), size: int = 50):
    kind = F.when(F.col("trusts") & F.col("trusted_by"), "mutuallyTrusts").when(F.col("trusts"), "trusts").otherwise("trustedBy")
    page = core.keyset_page(relations(t, account).select("other", kind.alias("relation")), ["other"], size, [after])
    return page.join(c_v2_avatars(t).select(F.col("avatar").alias("other"), "kind"), "other", "left")


# groups and communities


@view(f"SELECT grp, name, symbol, members FROM c_groups WHERE (name ILIKE 'sup%' OR symbol ILIKE 'sup%') AND mint IN {tuple(_a(k) for k in range(5))} AND grp > '{_b(1)}' ORDER BY grp LIMIT 11")
def c_q_find_groups(t, prefix: str = "sup", mints=tuple(_a(k) for k in range(5)), after: str = _b(1), size: int = 10):
    like = F.col("name").ilike(f"{prefix}%") | F.col("symbol").ilike(f"{prefix}%")
    return core.keyset_page(c_groups(t).where(like & F.col("mint").isin(*mints)).select("grp", "name", "symbol", "members"), ["grp"], size, [after])


@view(f"SELECT grp, member, member_kind, expiry_time FROM c_group_memberships WHERE grp = '{_b(4)}' AND member > '{_a(9)}' ORDER BY member LIMIT 101")
def c_q_group_members(t, grp: str = _b(4), after: str = _a(9), size: int = 100):
    return core.keyset_page(c_group_memberships(t).where(F.col("grp") == grp).select("grp", "member", "member_kind", "expiry_time"), ["member"], size, [after])


@view(f"SELECT m.avatar, m.grp, g.name, m.grp IN (SELECT truster FROM c_v2_trust_relations WHERE trustee = '{ME}') AS trusted FROM c_affiliate_members m JOIN register_group g ON g.grp = m.grp WHERE m.avatar = '{ME}'")
def c_q_avatar_communities(t, account: str = ME):
    """The groups an avatar is affiliated with; trusted tells that the group trusts it."""
    trusted = c_v2_trust_relations(t).where(F.col("trustee") == account).select(F.col("truster").alias("grp"), F.lit(True).alias("t"))
    own = c_affiliate_members(t).where(F.col("avatar") == account).select("avatar", "grp").join(t["register_group"].select("grp", "name"), "grp")
    return own.join(trusted, "grp", "left").select("avatar", "grp", "name", F.coalesce("t", F.lit(False)).alias("trusted"))


@view(f"SELECT m.avatar, p.name FROM (SELECT avatar FROM c_affiliate_members WHERE grp = '{_b(2)}' ORDER BY avatar LIMIT 20 OFFSET 3) m LEFT JOIN c_v2_avatars a ON a.avatar = m.avatar LEFT JOIN profile p ON p.digest = a.digest")
def c_q_community_members(t, grp: str = _b(2), size: int = 20, skip: int = 3):
    """A page of a community's members; names are joined to the page alone."""
    page = c_affiliate_members(t).where(F.col("grp") == grp).select("avatar").orderBy("avatar").offset(skip).limit(size)
    return page.join(c_v2_avatars(t).select("avatar", "digest"), "avatar", "left").join(t["profile"].select("digest", "name"), "digest", "left").select("avatar", "name")


# history


_HISTORY = ["block_number", "transaction_index", "log_index", "batch_index"]
_MINE = f"(from_ = '{ME}' OR to_ = '{ME}')"


@view(f"SELECT DISTINCT version, block_number, transaction_index, log_index, batch_index, from_, to_, token, amount FROM c_transfers WHERE {_MINE} AND version = 2 AND (block_number < 4000 OR block_number = 4000 AND (transaction_index < 5 OR transaction_index = 5 AND (log_index < 100 OR log_index = 100 AND batch_index < 1)))")
def c_q_history(t, account: str = ME, before=(4000, 5, 100, 1), version: int = 2):
    """An account's transfers before a cursor of four keys, without an end of the page."""
    own = c_transfers(t).where(((F.col("from_") == account) | (F.col("to_") == account)) & (F.col("version") == version))
    behind = F.struct(*_HISTORY) < F.struct(*[F.lit(k).cast("long").alias(c) for c, k in zip(_HISTORY, before, strict=True)])
    return own.where(behind).select("version", *_HISTORY, "from_", "to_", "token", "amount").distinct()


@view(f"SELECT block_number, from_, to_, token, amount, CASE WHEN to_ = '{ME}' THEN 'in' ELSE 'out' END AS direction FROM c_v2_transfers WHERE {_MINE} AND block_number BETWEEN 100 AND 12000 AND (from_ = '{ZERO}' OR to_ = '{ZERO}')")
def c_q_transfer_data(t, account: str = ME, other: str = ZERO, low: int = 100, high: int = 12000):
    """Transfers between an account and another party within blocks, with the direction."""
    own = c_transfers(t).where((F.col("version") == 2) & F.col("block_number").between(low, high))
    own = own.where(((F.col("from_") == account) & (F.col("to_") == other)) | ((F.col("to_") == account) & (F.col("from_") == other)))
    return own.select("block_number", "from_", "to_", "token", "amount", F.when(F.col("to_") == account, "in").otherwise("out").alias("direction"))


@view(
    f"SELECT e.block_number, e.event, e.other, p.name FROM (SELECT block_number, 'transfer' AS event, CASE WHEN from_ = '{ME}' THEN to_ ELSE from_ END AS other FROM c_v2_transfers WHERE {_MINE} UNION ALL SELECT block_number, 'trust', CASE WHEN truster = '{ME}' THEN trustee ELSE truster END FROM trust WHERE truster = '{ME}' OR trustee = '{ME}') e LEFT JOIN c_v2_avatars a ON a.avatar = e.other LEFT JOIN profile p ON p.digest = a.digest"
)
def c_q_history_enriched(t, account: str = ME):
    """Transfers and trusts of an account with the other party's name."""
    parts = []
    for event, df, a, b in (("transfer", c_transfers(t).where("version = 2"), "from_", "to_"), ("trust", t["trust"], "truster", "trustee")):
        own = df.where((F.col(a) == account) | (F.col(b) == account))
        parts.append(own.select("block_number", F.lit(event).alias("event"), F.when(F.col(a) == account, F.col(b)).otherwise(F.col(a)).alias("other")))
    named = c_v2_avatars(t).select(F.col("avatar").alias("other"), "digest").join(t["profile"].select("digest", "name"), "digest", "left").select("other", "name")
    return union(*parts).join(named, "other", "left")


@view(f"SELECT block_number, event, who FROM (SELECT block_number, 'Trust' AS event, truster AS who FROM trust UNION ALL SELECT block_number, 'StreamCompleted', from_ FROM stream_completed UNION ALL SELECT block_number, 'TransferSingle', to_ FROM transfer_single) WHERE block_number >= 50 AND who = '{ME}'")
def c_q_events(t, who: str = ME, low: int = 50):
    """Events of several tables from a block on that name an account; the filter reaches each scan."""
    parts = [t[n].where((F.col("block_number") >= low) & (F.col(c) == who)).select("block_number", F.lit(e).alias("event"), F.col(c).alias("who")) for n, e, c in (("trust", "Trust", "truster"), ("stream_completed", "StreamCompleted", "from_"), ("transfer_single", "TransferSingle", "to_"))]
    return union(*parts)


# invitations


@view(
    f"SELECT address, kind, inviter, amount FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY rank) AS r FROM (SELECT human AS address, 1 AS rank, 'at scale' AS kind, nullif(origin_inviter, '{ZERO}') AS inviter, NULL AS amount FROM at_scale_register UNION ALL SELECT invitee, 2, 'escrow', inviter, amount FROM escrow_redeemed UNION ALL SELECT avatar, 3, 'standard', nullif(inviter, '{ZERO}'), NULL FROM register_human UNION ALL SELECT user_, 4, 'signup', NULL, NULL FROM v1_signup)) WHERE r = 1"
)
def c_q_invitation_origin(t):
    """How each address came in: the first of at-scale, escrow, registration and sign-up that names it."""
    parts = (
        t["at_scale_register"].select(F.col("human").alias("address"), F.lit(1).alias("rank"), F.lit("at scale").alias("kind"), F.nullif("origin_inviter", F.lit(ZERO)).alias("inviter")),
        t["escrow_redeemed"].select(F.col("invitee").alias("address"), F.lit(2).alias("rank"), F.lit("escrow").alias("kind"), "inviter", "amount"),
        t["register_human"].select(F.col("avatar").alias("address"), F.lit(3).alias("rank"), F.lit("standard").alias("kind"), F.nullif("inviter", F.lit(ZERO)).alias("inviter")),
        t["v1_signup"].select(F.col("user_").alias("address"), F.lit(4).alias("rank"), F.lit("signup").alias("kind")),
    )
    top = union(*parts).groupBy("address").agg(F.min_by(F.struct("kind", "inviter", "amount"), "rank").alias("r"))
    return top.select("address", "r.*")


@view(f"SELECT inviter, avatar FROM register_human WHERE inviter <> '{ZERO}'")
def c_q_invitations_accepted(t):
    return t["register_human"].where(F.col("inviter") != ZERO).select("inviter", "avatar")


@view(f"SELECT DISTINCT truster, trustee FROM trust t WHERE expiry_time > {NOW} AND NOT EXISTS (SELECT 1 FROM register_human h WHERE h.avatar = t.trustee) AND NOT EXISTS (SELECT 1 FROM register_group g WHERE g.grp = t.trustee) AND NOT EXISTS (SELECT 1 FROM register_organization o WHERE o.organization = t.trustee)")
def c_q_invitations_pending(t):
    """Trusted addresses that aren't registered: three anti joins. Every trust event counts, not only a pair's latest."""
    out = t["trust"].crossJoin(now(t)).where("expiry_time > now").select("truster", "trustee").distinct()
    for name, column in (("register_human", "avatar"), ("register_group", "grp"), ("register_organization", "organization")):
        out = out.join(t[name].select(F.col(column).alias("trustee")), "trustee", "left_anti")
    return out.select("truster", "trustee")


@view(f"SELECT address, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM (SELECT trustee AS address, 'trust' AS source FROM c_q_invitations_pending UNION ALL SELECT invitee, 'escrow' FROM escrowed e WHERE NOT EXISTS (SELECT 1 FROM escrow_redeemed r WHERE r.invitee = e.invitee AND r.inviter = e.inviter) UNION ALL SELECT human, 'at scale' FROM at_scale_register WHERE origin_inviter <> '{ZERO}') GROUP BY address")
def c_q_all_invitations(t):
    """Everyone invited, by which ways and how often; an escrow that was redeemed is none any more."""
    trust = c_q_invitations_pending(t).select(F.col("trustee").alias("address"), F.lit("trust").alias("source"))
    escrow = t["escrowed"].join(t["escrow_redeemed"].select("inviter", "invitee"), ["inviter", "invitee"], "left_anti").select(F.col("invitee").alias("address"), F.lit("escrow").alias("source"))
    scale = t["at_scale_register"].where(F.col("origin_inviter") != ZERO).select(F.col("human").alias("address"), F.lit("at scale").alias("source"))
    return union(trust, escrow, scale).groupBy("address").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"))


@view(f"SELECT x.truster AS inviter, b.units, b.decayed FROM (SELECT truster FROM c_v2_trust_relations WHERE trustee = '{ME}' AND truster > '{_a(1)}') x JOIN (SELECT account, CAST(sum(balance) AS BIGINT) AS units, CAST(sum(decayed) AS BIGINT) AS decayed FROM {_HELD} GROUP BY account HAVING sum(balance) >= 1000000) b ON b.account = x.truster ORDER BY inviter LIMIT 21")
def c_q_valid_inviters(t, account: str = ME, least: int = 1_000_000, after: str = _a(1), size: int = 20):
    """Who trusts an account and holds at least so much, by address after a cursor."""
    who = c_v2_trust_relations(t).where(F.col("trustee") == account).select(F.col("truster").alias("inviter"))
    held = held_by(t, who.select(F.col("inviter").alias("account"))).groupBy(F.col("account").alias("inviter")).agg(F.sum("balance").alias("units"), F.sum("decayed").alias("decayed"))
    return core.keyset_page(held.where(F.col("units") >= least), ["inviter"], size, [after])


# blocks


@view("SELECT w.ts, coalesce((SELECT max(block_number) FROM system_block b WHERE b.timestamp <= w.ts), (SELECT min(block_number) FROM system_block)) AS before, coalesce((SELECT min(block_number) FROM system_block b WHERE b.timestamp >= w.ts), (SELECT max(block_number) FROM system_block)) AS after FROM (VALUES (0), (1602900001), (99999999999)) AS w(ts)")
def c_q_block_by_timestamp(t, times=(0, 1602900001, 99999999999)):
    """The nearest blocks at or before and at or after each time; the first or last block where there is none. One pass over the blocks."""
    at = [F.max(F.when(F.col("timestamp") <= x, F.col("block_number"))) for x in times], [F.min(F.when(F.col("timestamp") >= x, F.col("block_number"))) for x in times]
    low, high = F.min("block_number"), F.max("block_number")
    rows = F.array(*[F.struct(F.lit(x).cast("long").alias("ts"), F.coalesce(b, low).alias("before"), F.coalesce(a, high).alias("after")) for x, b, a in zip(times, *at, strict=True)])
    return t["system_block"].agg(rows.alias("r")).select(F.inline("r"))


@view("SELECT max(block_number) AS block, max(timestamp) AS timestamp, 1700000000 - max(timestamp) AS lag FROM system_block")
def c_q_health(t, at: int = 1_700_000_000):
    return t["system_block"].agg(F.max("block_number").alias("block"), F.max("timestamp").alias("timestamp")).withColumn("lag", F.lit(at).cast("long") - F.col("timestamp"))


_FOLLOWED = ("trust", "transfer_single", "transfer_batch", "stream_completed")


@view("SELECT min(high) AS safe, max(high) AS furthest FROM (" + " UNION ALL ".join(f"SELECT max(block_number) AS high FROM {n}" for n in ("system_block", *_FOLLOWED)) + ")")
def c_resume_block(t, names=_FOLLOWED):
    """Up to which block all tables agree: the least of their last blocks, and the furthest that any has seen."""
    ends = union(*[t[n].agg(F.max("block_number").alias("high")) for n in ("system_block", *names)])
    return ends.agg(F.min("high").alias("safe"), F.max("high").alias("furthest"))


@view("SELECT DISTINCT digest FROM update_metadata_digest u WHERE NOT EXISTS (SELECT 1 FROM content_file f WHERE f.digest = u.digest) AND NOT EXISTS (SELECT 1 FROM content_queue q WHERE q.digest = u.digest)")
def c_enqueue_content(t):
    """Digests that are neither fetched nor waiting: two anti joins."""
    return t["update_metadata_digest"].select("digest").distinct().join(t["content_file"], "digest", "left_anti").join(t["content_queue"], "digest", "left_anti")


@view("SELECT namespace, count(*) AS columns FROM (VALUES " + ", ".join(f"('{n}')" for n, (_, _, c) in TABLES.items() for _ in c) + ") AS x(namespace) GROUP BY namespace")
def c_q_tables(t):
    """The catalogue: every table and how many columns it has."""
    rows = [(n, c) for n in t for c in t.columns(n)]
    return t.spark.createDataFrame(rows, "namespace string, name string").groupBy("namespace").agg(F.count("*").alias("columns"))


# measures


@view("SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM c_v2_trust_relations r WHERE r.trustee = h.avatar)) AS trusted, count(*) AS humans FROM register_human h")
def c_a_filter_exists(t):
    """A count under an EXISTS: the inner side becomes a flag by a join on distinct keys."""
    flag = c_v2_trust_relations(t).select(F.col("trustee").alias("avatar"), F.lit(True).alias("t")).distinct()
    return t["register_human"].join(flag, "avatar", "left").agg(F.count_if("t").alias("trusted"), F.count("*").alias("humans"))


@view("SELECT offer, count(*) AS claims, count(DISTINCT account) AS accounts, CAST(sum(spent) AS BIGINT) AS spent, CAST(sum(received) AS BIGINT) AS received, round(CAST(sum(spent) AS DOUBLE) / nullif(sum(received), 0), 6) AS price FROM offer_claimed GROUP BY offer")
def c_k_offers(t):
    return t["offer_claimed"].groupBy("offer").agg(F.count("*").alias("claims"), F.count_distinct("account").alias("accounts"), F.sum("spent").alias("spent"), F.sum("received").alias("received"), F.round(F.sum("spent") / F.nullif(F.sum("received"), F.lit(0)), 6).alias("price"))


@view("SELECT g.gateway, g.owner, count(p.payer) AS payments, count(DISTINCT p.payer) AS payers, CAST(coalesce(sum(p.amount), 0) AS BIGINT) AS amount FROM gateway_created g LEFT JOIN payment_received p ON p.gateway = g.gateway GROUP BY 1, 2")
def c_k_gateways(t):
    """Payments by gateway, those without any too; payments are summed before the join."""
    paid = t["payment_received"].groupBy("gateway").agg(F.count("*").alias("payments"), F.count_distinct("payer").alias("payers"), F.sum("amount").alias("amount"))
    return t["gateway_created"].select("gateway", "owner").join(paid, "gateway", "left").fillna(0, ["payments", "payers", "amount"])


_REPUTATION = "(SELECT *, lag(score) OVER (PARTITION BY grp, avatar ORDER BY block_number) AS prev, row_number() OVER (PARTITION BY grp, avatar ORDER BY block_number DESC) AS r FROM reputation_history)"


@view(f"SELECT grp, count(*) AS avatars, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 4) AS median, count(*) FILTER (WHERE score < 20) AS low, count(*) FILTER (WHERE score >= 80) AS high, count(*) FILTER (WHERE avatar IN (SELECT address FROM blacklist)) AS listed FROM {_REPUTATION} WHERE r = 1 GROUP BY grp")
def c_k_reputation(t):
    """The distribution of current scores by group, and how many holders are blacklisted."""
    last = core.latest_by(t["reputation_history"].select("grp", "avatar", "score", *KEY), ["grp", "avatar"], KEY)
    last = last.join(t["blacklist"].select(F.col("address").alias("avatar"), F.lit(True).alias("b")), "avatar", "left")
    s = F.col("score")
    return last.groupBy("grp").agg(F.count("*").alias("avatars"), F.round(F.avg(s), 6).alias("mean"), F.round(F.percentile(s, 0.5), 4).alias("median"), F.count_if(s < 20).alias("low"), F.count_if(s >= 80).alias("high"), F.count_if("b").alias("listed"))


@view(f"SELECT CASE WHEN prev IS NULL THEN 'new' WHEN score - prev >= 40 THEN 'spike' WHEN prev - score >= 40 THEN 'drop' WHEN score = prev THEN 'same' ELSE 'drift' END AS kind, count(*) AS n FROM {_REPUTATION} GROUP BY 1")
def c_k_reputation_anomalies(t):
    """Every score change in one class: new, spike, drop, same or drift."""
    prev = F.lag("score").over(Window.partitionBy("grp", "avatar").orderBy("block_number"))
    d = F.col("score") - F.col("prev")
    kind = F.when(F.col("prev").isNull(), "new").when(d >= 40, "spike").when(d <= -40, "drop").when(d == 0, "same").otherwise("drift")
    return t["reputation_history"].withColumn("prev", prev).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@view("SELECT g.grp, count(DISTINCT x.to_) AS receivers, round(CAST(count(*) FILTER (WHERE x.to_ IN (SELECT avatar FROM reputation_history)) AS DOUBLE) / count(*), 9) AS rated_share FROM register_group g JOIN (SELECT token_address, to_ FROM transfer_single UNION ALL SELECT token_address, to_ FROM transfer_batch) x ON x.token_address = g.grp GROUP BY g.grp")
def c_k_rated_transfers(t):
    """For each group's token the share of transfers that reach someone with a score."""
    rated = t["reputation_history"].select(F.col("avatar").alias("to_"), F.lit(True).alias("rated")).distinct()
    own = t["transfer_single"].select("token_address", "to_").union(t["transfer_batch"].select("token_address", "to_")).withColumnRenamed("token_address", "grp").join(t["register_group"].select("grp"), "grp", "left_semi").join(rated, "to_", "left")
    return own.groupBy("grp").agg(F.count_distinct("to_").alias("receivers"), F.round(F.count_if("rated") / F.count("*"), 9).alias("rated_share"))
