"""Relational operators of an event ledger, each a composition of DataFrame operations.

``order`` arguments must order rows totally within a key; ties then never decide
a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.compat import after, ordered, running


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest order: max_by aggregates before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def dealt_join(left: DataFrame, right: DataFrame, key: str, most: int = 16_000_000, wide: int = 1_024) -> DataFrame:
    """Inner join of two tables on a key that may be frequent on both sides. Rows of one key must differ on either side.

    A key's right rows are gathered into arrays of about ``wide``, its left rows are
    dealt into blocks that give about ``most`` rows with one array, and each block
    meets each array in a place of its own. So a task holds arrays, never all right
    rows of a key, whatever the size of the result, and rows are made by opening them.
    """
    wide = min(wide, most)
    sizes = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key)
    cells = sizes.select(key, F.ceil(F.col("_l") / (most // wide)).alias("_x"), F.ceil(F.col("_r") / wide).alias("_y")).where("_x > 1 or _y > 1")
    cells = F.broadcast(cells)  # no more keys than blocks and arrays
    nothing, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    x, y = F.coalesce("_x", one), F.coalesce("_y", one)
    blocks = left.join(cells, key, "left").select(*left.columns, F.pmod(F.xxhash64(*left.columns), x).alias("_x"), F.explode(F.sequence(nothing, y - 1)).alias("_y"))
    own = [c for c in right.columns if c != key]
    arrays = right.join(cells, key, "left").groupBy(key, F.pmod(F.xxhash64(*right.columns), y).alias("_y"), x.alias("_n")).agg(F.collect_list(F.struct(*own)).alias("_own"))
    lone = len(own) == 1  # then its values are opened, not rows of one value
    arrays = arrays.select(key, F.explode(F.sequence(nothing, F.col("_n") - 1)).alias("_x"), "_y", F.col(f"_own.{own[0]}" if lone else "_own").alias("_own"))
    # few and small as they are, the places would be put into fewer tasks than there are cores if their number were left open
    spark, at = left.sparkSession, [key, "_x", "_y"]
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    met = blocks.repartition(places, *at).join(arrays.repartition(places, *at).hint("shuffle_hash"), at)
    opened = met.select(*left.columns, F.explode("_own").alias("_own"))
    return opened.select(*left.columns, *[F.col("_own" if lone else f"_own.{c}").alias(c) for c in own])


def double_entry(df: DataFrame, sender: str, receiver: str, value: str, keys: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Balances: each transfer is two legs, summed per account and keys."""
    legs = F.explode(F.array(F.struct(F.col(sender).alias("account"), (-F.col(value)).alias("delta")), F.struct(F.col(receiver).alias("account"), F.col(value).alias("delta"))))
    out = df.select(*keys, *[c for c in extra], legs.alias("_l"))
    return out.select("*", "_l.account", "_l.delta").drop("_l")


def balances(legs: DataFrame, keys: Sequence[str], last: str | None = None) -> DataFrame:
    more = [F.max(last).alias("last_activity")] if last else []
    return legs.groupBy("account", *keys).agg(F.sum("delta").alias("balance"), *more)


def signed_flow(df: DataFrame, keys: Sequence[str], value: str, plus: Column, minus: Column) -> DataFrame:
    """Sum of value where plus holds, less that where minus holds."""
    v = F.col(value)
    return df.groupBy(*keys).agg((F.sum(F.when(plus, v).otherwise(0)) - F.sum(F.when(minus, v).otherwise(0))).alias("supply"))


def dense_series(df: DataFrame, keys: Sequence[str], bucket: str, value: str, end: Column, step: str) -> DataFrame:
    """For each key every bucket from its first to ``end``, with the bucket's value (0 if none) and the running total. bucket is a date or timestamp."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("delta"))
    calendar = sums.groupBy(*keys).agg(F.min(bucket).alias("_from")).where(F.col("_from") <= end)
    calendar = calendar.select(*keys, F.explode(F.sequence("_from", end, F.expr(f"interval {step}"))).alias(bucket))
    out = calendar.join(sums, [*keys, bucket], "left").withColumn("delta", F.coalesce("delta", F.lit(0)))
    return out.withColumn("total", F.sum("delta").over(running([*keys], [bucket])))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "total") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(running([*keys], [*order])))


def intervals(df: DataFrame, keys: Sequence[str], start: str, order: Sequence[str], expiry: str | None = None) -> DataFrame:
    """Each event's validity: to the next event of its key, or its expiry if that comes first; empty intervals go."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(*order))
    end = F.least(following, F.col(expiry)) if expiry else following
    return df.withColumn("until", end).where(F.col("until").isNull() | (F.col("until") > F.col(start)))


def share_of_partition(df: DataFrame, keys: Sequence[str], value: str, name: str = "fraction") -> DataFrame:
    """value over its key's sum, null for a zero sum; the sums are aggregated, then joined back."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    return df.join(sums, list(keys)).withColumn(name, F.col(value).cast("double") / F.nullif(F.col("_sum").cast("double"), F.lit(0.0))).drop("_sum")


def net_by_pair(df: DataFrame, scope: Sequence[str], sender: str, receiver: str, value: str) -> DataFrame:
    """Per scope and unordered pair the net flow from low to high, zero nets dropped."""
    low, high = F.least(sender, receiver), F.greatest(sender, receiver)
    signed = F.when(F.col(sender) <= F.col(receiver), F.col(value)).otherwise(-F.col(value))
    out = df.where(F.col(sender) != F.col(receiver)).groupBy(*scope, low.alias("low"), high.alias("high")).agg(F.sum(signed).alias("net"), F.count("*").alias("transfers"))
    return out.where("net <> 0")


def membership_with_reset(df: DataFrame, member: str, group: str, order: str, is_add: str, is_reset: str) -> DataFrame:
    """Latest-wins membership; a member's latest reset event voids all earlier ones."""
    reset = df.where(F.col(is_reset)).groupBy(member).agg(F.max(order).alias("_reset"))
    live = df.join(reset, member, "left").where(F.col("_reset").isNull() | (F.col(order) >= F.col("_reset"))).drop("_reset")
    return latest_by(live, [member, group], [order]).where(F.col(is_add))


def set_by_count(df: DataFrame, keys: Sequence[str], delta: str, order: str) -> DataFrame:
    """Members whose additions exceed their removals, with the last change."""
    return df.groupBy(*keys).agg(F.sum(delta).alias("count"), F.max(order).alias("last_change")).where("count > 0")


def keyset_page(df: DataFrame, keys: Sequence[str], size: int, cursor: Sequence | None = None, descending: bool = False) -> DataFrame:
    """size + 1 rows after the cursor: the extra one tells that there are more. The comparison reaches the scan and top-k needs no full sort."""
    if cursor is not None:
        df = df.where(after(list(keys), list(cursor), descending))
    return df.orderBy(*ordered([(k, "DESC" if descending else "ASC") for k in keys])).limit(size + 1)


def event_union(tables: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """All tables as one: order columns, event name and the row as JSON."""
    out = None
    for name, df in tables.items():
        part = df.select(*order, F.lit(name).alias("event"), F.to_json(F.struct(*[c for c in df.columns if c not in order])).alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def merge_delta(snapshot: DataFrame, delta: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Additive full-outer merge of a snapshot and what came after it."""
    s, d = snapshot.select(*keys, F.col(value).alias("_s")), delta.select(*keys, F.col(value).alias("_d"))
    return s.join(d, list(keys), "full").select(*keys, (F.coalesce("_s", F.lit(0)) + F.coalesce("_d", F.lit(0))).alias(value))


def affected_recompute(snapshot: DataFrame, recomputed: DataFrame, affected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The snapshot for untouched keys, the recomputed rows for affected ones."""
    return snapshot.join(affected, list(keys), "left_anti").unionByName(recomputed.join(affected, list(keys), "left_semi"))


def drift(incremental: DataFrame, full: DataFrame) -> DataFrame:
    """Rows that only one side has, tagged; empty where incremental state equals full recomputation."""
    return incremental.exceptAll(full).withColumn("side", F.lit("incremental")).unionByName(full.exceptAll(incremental).withColumn("side", F.lit("full")))


def gaps(df: DataFrame, key: str, span: int = 1_000_000) -> DataFrame:
    """Missing ranges of an integer sequence: lead() within key ranges of ``span``, and across them by each range's ends, so no task sees all keys."""
    at = df.select(key).distinct().withColumn("_p", F.floor(F.col(key) / span))
    inner = at.withColumn("_n", F.lead(key).over(Window.partitionBy("_p").orderBy(key))).where("_n is not null").select(key, "_n")
    ends = at.groupBy("_p").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    outer = ends.withColumn("_n", F.lead("low").over(Window.orderBy("_p"))).where("_n is not null").select(F.col("high").alias(key), "_n")
    return inner.union(outer).where(F.col("_n") > F.col(key) + 1).select((F.col(key) + 1).alias("first_missing"), (F.col("_n") - 1).alias("last_missing"))
