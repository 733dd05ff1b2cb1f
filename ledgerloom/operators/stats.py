"""Statistics of the metric library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of positive values: 2 * sum(rank * v) / (n * sum(v)) - (n + 1) / n.

    Ranks need no global window: equal values are counted together, so ranks
    come from a running count over distinct values alone, in ranges.
    """
    counts = df.where(F.col(value) > 0).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranged = counts.withColumn("_p", F.floor(F.log2(F.col("v").cast("double")) * 8))
    before = ranged.groupBy("_p").agg(F.sum("c").alias("pc")).withColumn("before", F.sum("pc").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.sum("c").over(Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    ranks = ranged.withColumn("_o", own).join(before, "_p").select("v", "c", (F.coalesce("before", F.lit(0)) + F.coalesce("_o", F.lit(0))).alias("start"))
    area = F.sum(F.col("v") * (F.col("c") * F.col("start") + F.col("c") * (F.col("c") + 1) / 2))
    n, total = F.sum("c"), F.sum(F.col("v") * F.col("c"))
    return ranks.agg((2 * area / (n * total) - (n + 1) / n).alias("gini"), n.alias("n"))


def top_share(df: DataFrame, value: str, n: int) -> DataFrame:
    """Share of the sum that the n largest values hold."""
    top = df.orderBy(F.desc(value)).limit(n).agg(F.sum(value).alias("top"))
    return top.crossJoin(F.broadcast(df.agg(F.sum(value).alias("total")))).select((F.col("top").cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0))).alias("share"))


def windowed_counts(df: DataFrame, at: str, now: Column, windows: dict[str, str], distinct: str | None = None) -> DataFrame:
    """One pass for all trailing windows ending at now."""
    aggs = []
    for name, span in windows.items():
        inside = (F.col(at) > now - F.expr(f"interval {span}")) & (F.col(at) <= now)
        aggs.append((F.count_distinct(F.when(inside, F.col(distinct))) if distinct else F.count_if(inside)).alias(name))
    return df.agg(*aggs)


def retention(df: DataFrame, user: str, day: str, cohort_days: int) -> DataFrame:
    """Per first day: users, and those seen again within cohort_days after it."""
    first = df.groupBy(user).agg(F.min(day).alias("cohort"))
    later = df.join(first, user).where((F.col(day) > F.col("cohort")) & (F.datediff(day, "cohort") <= cohort_days)).select(user).distinct().withColumn("back", F.lit(1))
    return first.join(later, user, "left").groupBy("cohort").agg(F.count("*").alias("users"), F.count("back").alias("returned"))


def zscore_latest(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """The latest value of a key against mean and sample deviation of its earlier ones."""
    latest = df.groupBy(*keys).agg(F.max(day).alias("_d"))
    joined = df.join(latest, list(keys))
    now, before = F.col(day) == F.col("_d"), F.col(day) < F.col("_d")
    out = joined.groupBy(*keys).agg(F.max(F.when(now, F.col(value))).alias("latest"), F.avg(F.when(before, F.col(value))).alias("mean"), F.stddev_samp(F.when(before, F.col(value))).alias("deviation"))
    return out.withColumn("z", (F.col("latest") - F.col("mean")) / F.nullif(F.col("deviation"), F.lit(0.0)))
