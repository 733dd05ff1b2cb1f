"""Economic, network and anomaly measures. Each aggregates before it shuffles, and "now" is AS_OF."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import compat
from ledgerloom.operators import graph, stats
from ledgerloom.plans.catalogue import AS_OF, EVENTS, TRANSFERS, TRUST, events, folder, kept, query, table, transfers, trust
from ledgerloom.plans.chain import view
from ledgerloom.plans.views import c_v1_trust_relations, scores, standings, union
from ledgerloom.sources.history import DAY, History, changes

WEEK = f"day > DATE '{AS_OF}' - INTERVAL 7 DAY"
MONTH = f"day > DATE '{AS_OF}' - INTERVAL 30 DAY"


def since(days: int):
    return F.col("day") > F.date_sub(F.lit(AS_OF).cast("date"), days)


@query(f"WITH f AS (SELECT user_id, MIN(day) AS day FROM {EVENTS} GROUP BY 1) SELECT COUNT(*) FILTER (WHERE {WEEK}) AS week, COUNT(*) FILTER (WHERE {MONTH}) AS month FROM f")
def k_new_users(spark, sf):
    first = events(spark, sf).groupBy("user_id").agg(F.min("day").alias("day"))
    return stats.windowed_counts(first, "day", F.lit(AS_OF).cast("date"), {"week": "7 days", "month": "30 days"})


@query(f"SELECT event_type, COUNT(*) AS n, CAST(SUM(cents) AS BIGINT) AS volume, round(AVG(cents), 6) AS mean, round(quantile_cont(cents, 0.5), 4) AS median FROM {EVENTS} WHERE {WEEK} GROUP BY 1")
def k_volume(spark, sf):
    return events(spark, sf).where(since(7)).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("volume"), F.round(F.avg("cents"), 6).alias("mean"), F.round(F.percentile("cents", 0.5), 4).alias("median"))


@query(f"SELECT COUNT(*) FILTER (WHERE cents <= 1000) AS micro, COUNT(*) FILTER (WHERE cents >= 9000) AS large FROM {EVENTS} WHERE {MONTH}")
def k_size_classes(spark, sf):
    return events(spark, sf).where(since(30)).agg(F.count_if(F.col("cents") <= 1000).alias("micro"), F.count_if(F.col("cents") >= 9000).alias("large"))


@query(f"SELECT round(COUNT(DISTINCT user_id) FILTER (WHERE event_type = 'purchase' AND {WEEK}) / CAST(COUNT(DISTINCT user_id) AS DOUBLE), 9) AS rate FROM {EVENTS}")
def k_participation_rate(spark, sf):
    """Grouped by user first, so each user is one row when users are counted."""
    per = events(spark, sf).groupBy("user_id").agg(F.bool_or((F.col("event_type") == "purchase") & since(7)).alias("active"))
    return per.agg(F.round(compat.safe_ratio(F.count_if("active"), F.count("*")), 9).alias("rate"))


@query(f"SELECT COUNT(*) AS users FROM (SELECT user_id, MIN(day) AS day FROM {EVENTS} WHERE event_type = 'purchase' GROUP BY 1) WHERE {WEEK}")
def k_first_time(spark, sf):
    first = events(spark, sf).where("event_type = 'purchase'").groupBy("user_id").agg(F.min("day").alias("day"))
    return first.where(since(7)).agg(F.count("*").alias("users"))


@query(f"SELECT round(SUM(CASE WHEN {MONTH} THEN cents ELSE 0 END) / CAST(SUM(cents) AS DOUBLE), 9) AS velocity FROM {EVENTS} WHERE event_type IN ('purchase', 'view')")
def k_velocity(spark, sf):
    moved = F.sum(F.when(since(30), F.col("cents")).otherwise(0))
    return events(spark, sf).where("event_type in ('purchase', 'view')").agg(F.round(compat.safe_ratio(moved, F.sum("cents")), 9).alias("velocity"))


@query(f"SELECT CAST(day AS VARCHAR) AS day, CAST(SUM(CASE event_type WHEN 'purchase' THEN cents WHEN 'error' THEN -cents ELSE 0 END) AS BIGINT) AS inflow FROM {EVENTS} e WHERE e.{MONTH} GROUP BY 1")
def k_net_inflow(spark, sf):
    signed = F.when(F.col("event_type") == "purchase", F.col("cents")).when(F.col("event_type") == "error", -F.col("cents")).otherwise(0)
    return events(spark, sf).where(since(30)).groupBy("day").agg(F.sum(signed).alias("inflow")).select(F.col("day").cast("string").alias("day"), "inflow")


HELD = "(SELECT c_mktsegment AS kind, CAST(floor(c_acctbal * 100) AS BIGINT) AS v FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'SUPPLIER', CAST(floor(s_acctbal * 100) AS BIGINT) FROM supplier WHERE s_acctbal > 0)"


def held(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_mktsegment").alias("kind"), F.floor(F.col("c_acctbal") * 100).cast("long").alias("v"))
    return c.union(table(spark, sf, "supplier").where("s_acctbal > 0").select(F.lit("SUPPLIER"), F.floor(F.col("s_acctbal") * 100).cast("long")))


@query(f"SELECT kind, COUNT(*) AS holders, CAST(SUM(v) AS BIGINT) AS total, round(AVG(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median FROM {HELD} GROUP BY kind")
def k_balance_by_type(spark, sf):
    return held(spark, sf).groupBy("kind").agg(F.count("*").alias("holders"), F.sum("v").alias("total"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.percentile("v", 0.5), 4).alias("median"))


@query(f"SELECT kind, round(SUM(v) / CAST((SELECT SUM(v) FROM {HELD}) AS DOUBLE), 9) AS share FROM {HELD} GROUP BY kind")
def k_supply_share_by_type(spark, sf):
    per = held(spark, sf).groupBy("kind").agg(F.sum("v").alias("v"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("v").alias("all")))).select("kind", F.round(compat.safe_ratio(F.col("v"), F.col("all")), 9).alias("share"))


@query("SELECT c_mktsegment AS segment, COUNT(*) AS accounts FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1")
def k_accounts_without_activity(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("accounts"))


@view("SELECT DISTINCT can_send_to FROM c_v1_trust_relations WHERE can_send_to NOT IN (SELECT user_ FROM c_v1_trust_relations)")
def k_no_incoming_trust(t):
    """Who trusts someone and is trusted by nobody, in version 1."""
    r = c_v1_trust_relations(t)
    return r.select("can_send_to").distinct().join(r.select(F.col("user_").alias("can_send_to")), "can_send_to", "left_anti")


@view("SELECT user_ FROM v1_signup s WHERE NOT EXISTS (SELECT 1 FROM c_v1_trust_relations r WHERE r.user_ = s.user_) AND NOT EXISTS (SELECT 1 FROM c_v1_trust_relations r WHERE r.can_send_to = s.user_)")
def k_isolated(t):
    """Sign-ups without any trust."""
    r = c_v1_trust_relations(t)
    return t["v1_signup"].select("user_").join(r.select("user_").union(r.select("can_send_to")), "user_", "left_anti")


@query(f"SELECT hour, COUNT(*) AS n FROM {EVENTS} WHERE event_type = 'signup' GROUP BY hour HAVING COUNT(*) >= 2")
def k_batch_registrations(spark, sf):
    return events(spark, sf).where("event_type = 'signup'").groupBy("hour").agg(F.count("*").alias("n")).where("n >= 2")


@query(f"SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(SUM(cents) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS got, CAST(SUM(cents) FILTER (WHERE event_type = 'error') AS BIGINT) AS gone FROM {EVENTS} GROUP BY user_id, 2 HAVING SUM(cents) FILTER (WHERE event_type = 'error') >= 0.8 * SUM(cents) FILTER (WHERE event_type = 'purchase')")
def k_gain_and_drain(spark, sf):
    """What came in on a day and for the most part left on it."""
    got, gone = (F.sum(F.when(F.col("event_type") == k, F.col("cents"))) for k in ("purchase", "error"))
    per = events(spark, sf).groupBy("user_id", "day").agg(got.alias("got"), gone.alias("gone")).where("gone >= 0.8 * got")
    return per.select("user_id", F.col("day").cast("string").alias("day"), "got", "gone")


@query(f"SELECT src, COUNT(*) AS invited FROM {TRUST} GROUP BY src HAVING COUNT(*) > 20")
def k_high_volume_inviters(spark, sf):
    return trust(spark, sf).groupBy("src").agg(F.count("*").alias("invited")).where("invited > 20")


@query(f"WITH d AS (SELECT dst AS node, COUNT(*) AS n FROM {TRUST} GROUP BY 1) SELECT CAST(least(n // 5, 10) AS BIGINT) AS bucket, COUNT(*) AS nodes FROM d GROUP BY 1")
def k_trust_buckets(spark, sf):
    d = graph.degrees(trust(spark, sf)).where("in_degree > 0")
    return d.groupBy(F.least(F.floor(F.col("in_degree") / 5), F.lit(10)).cast("long").alias("bucket")).agg(F.count("*").alias("nodes"))


@query(f"SELECT CAST(day AS VARCHAR) AS day, COUNT(*) FILTER (WHERE cents % 2 = 0) AS added, COUNT(*) FILTER (WHERE cents % 2 <> 0) AS removed FROM {EVENTS} e WHERE e.{WEEK} GROUP BY 1")
def k_trust_changes(spark, sf):
    per = events(spark, sf).where(since(7)).groupBy("day").agg(F.count_if(F.col("cents") % 2 == 0).alias("added"), F.count_if(F.col("cents") % 2 != 0).alias("removed"))
    return per.select(F.col("day").cast("string").alias("day"), "added", "removed")


@query(f"WITH s AS (SELECT user_id, SUM(CASE WHEN {WEEK} THEN 0 ELSE cents % 100 END) AS was, SUM(cents % 100) AS now FROM {EVENTS} GROUP BY 1) SELECT COUNT(*) FILTER (WHERE now - was >= 300) AS spikes, COUNT(*) FILTER (WHERE now - was < 50) AS flat FROM s")
def k_score_changes(spark, sf):
    s = events(spark, sf).groupBy("user_id").agg(F.sum(F.when(since(7), 0).otherwise(F.col("cents") % 100)).alias("was"), F.sum(F.col("cents") % 100).alias("now"))
    return s.agg(F.count_if(F.expr("now - was >= 300")).alias("spikes"), F.count_if(F.expr("now - was < 50")).alias("flat"))


@query(f"SELECT sender, COUNT(*) AS n, CAST(SUM(value) AS BIGINT) AS volume, COUNT(DISTINCT receiver) AS receivers FROM {TRANSFERS} WHERE value >= 45 GROUP BY sender")
def k_whales(spark, sf):
    return transfers(spark, sf).where("value >= 45").groupBy("sender").agg(F.count("*").alias("n"), F.sum("value").alias("volume"), F.count_distinct("receiver").alias("receivers"))


@query(
    f"SELECT event_type, CAST(SUM(CASE WHEN day = DATE '2024-01-30' THEN cents ELSE 0 END) AS BIGINT) AS latest, round(SUM(CASE WHEN day < DATE '2024-01-30' THEN cents ELSE 0 END) / 7.0, 6) AS baseline FROM {EVENTS} WHERE day >= DATE '2024-01-23' AND day <= DATE '2024-01-30' GROUP BY event_type"
)
def k_against_baseline(spark, sf):
    """The last whole day beside the mean of the seven before it."""
    last = F.date_sub(F.lit(AS_OF).cast("date"), 1)
    e = events(spark, sf).where((F.col("day") >= F.date_sub(last, 7)) & (F.col("day") <= last))
    return e.groupBy("event_type").agg(F.sum(F.when(F.col("day") == last, F.col("cents")).otherwise(0)).alias("latest"), F.round(F.sum(F.when(F.col("day") < last, F.col("cents")).otherwise(0)) / 7.0, 6).alias("baseline"))


_AGO = {"1d": (DAY, 216), "7d": (7 * DAY, 1152)}  # a window, and how many blocks before the last its snapshot was taken


@view(
    " UNION ALL ".join(
        f"SELECT '{name}' AS period, count(*) AS compared, count(*) FILTER (WHERE w.score - c.score > 20) AS drops, count(*) FILTER (WHERE c.score - w.score > 30) AS spikes, count(*) FILTER (WHERE c.score < w.score) AS fell, count(*) FILTER (WHERE c.score > w.score) AS rose FROM c_trust_scores c JOIN c_trust_scores__{blocks}ago w USING (avatar)"
        for name, (_, blocks) in _AGO.items()
    )
)
def c_score_changes(t):
    """Trust scores against dated snapshots of them, taken as of blocks before the last; the events are read once for all of them."""
    last, at = t["system_block"].agg(F.max("block_number"), F.max("timestamp")).first()
    at = at or 0
    own = History(t.spark, folder(t.spark, "scores"))
    ago = sorted((blocks for _, blocks in _AGO.values()), reverse=True)
    known = kept(standings(t, [-1 if last is None else last - blocks for blocks in ago] + [None]), "standings")
    for k, blocks in enumerate(ago):
        own.add(scores(known, k), at - blocks * 600)
    own.expire(at)
    current = scores(known, len(ago))
    return union(*[changes(own, current, "avatar", "score", at, window).select(F.lit(name).alias("period"), "*") for name, (window, _) in _AGO.items()])
