"""Trust-graph metrics and flow routing on edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    legs = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("l"))
    return legs.groupBy("l.node").agg(F.sum("l.o").alias("out_degree"), F.sum("l.i").alias("in_degree"))


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too."""
    return edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def reciprocity(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("b"))
    return edges.join(back, ["src", "dst"], "left").agg(F.count("*").alias("edges"), F.count("b").alias("mutual")).withColumn("reciprocity", F.col("mutual") / F.nullif(F.col("edges"), F.lit(0)))


def density(edges: DataFrame) -> DataFrame:
    n = degrees(edges).agg(F.count("*").alias("nodes"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(F.broadcast(n)).withColumn("density", F.col("edges") / F.nullif(F.col("nodes") * (F.col("nodes") - 1), F.lit(0)))


def two_hop(edges: DataFrame, source) -> DataFrame:
    """Nodes reached over one intermediate from a source and not directly, with the number of ways."""
    first = edges.where(F.col("src") == F.lit(source)).select(F.col("dst").alias("via"))
    out = edges.join(first, edges.src == first.via).where(F.col("dst") != F.lit(source)).groupBy("dst").agg(F.count("*").alias("ways"))
    return out.join(first, out.dst == first.via, "left_anti")


def common_targets(edges: DataFrame, a, b) -> DataFrame:
    left, right = (edges.where(F.col("src") == F.lit(x)).select("dst") for x in (a, b))
    return left.intersect(right)


def capacity_edges(balances: DataFrame, trust: DataFrame) -> DataFrame:
    """(kind, account, token, capacity): each holder sends a token to its pool up to the balance, and the pool sends it on, without a bound of its own, to whoever trusts the token. H holders and T trusters are H + T edges."""
    held = balances.where("balance > 0")
    pools = held.select("token").distinct()
    holders = held.select(F.lit("holder").alias("kind"), "account", "token", F.col("balance").alias("capacity"))
    trusters = trust.select(F.col("src").alias("account"), F.col("dst").alias("token")).join(pools, "token", "left_semi")
    return holders.unionByName(trusters.select(F.lit("truster").alias("kind"), "account", "token"), allowMissingColumns=True)


BLOCKS = 256  # a node's arcs are summed in so many blocks, so that a hot node is no hot task


def before(df: DataFrame, key: str, order: str, value: str, block: Column | None = None) -> DataFrame:
    """df with ``before``: the sum of value over the key's rows ahead of each, in the order of (block, order).

    Blocks are summed apart and offset by the sums of the blocks ahead, so no task
    holds a whole key. Without a block of its own a row's is a hash of its order.
    """
    rows = df.withColumn("_block", F.pmod(F.xxhash64(order), F.lit(BLOCKS)) if block is None else block)
    ahead = rows.groupBy(key, "_block").agg(F.sum(value).alias("_sum"))
    ahead = ahead.withColumn("_ahead", F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = F.sum(value).over(Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return rows.withColumn("_own", own).join(ahead, [key, "_block"]).withColumn("before", F.col("_own") + F.col("_ahead")).drop("_block", "_own", "_ahead")


def touching(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs with an end in a new node of ``nodes`` (v, new) and none in another of them: those that come in with the new nodes."""
    marks = nodes.groupBy("v").agg(F.bool_and("new").alias("new"))
    own = pairs.join(marks.select(F.col("v").alias("u"), F.col("new").alias("_u")), "u", "left").join(marks.select("v", F.col("new").alias("_v")), "v", "left")
    return own.where("coalesce(_u, _v) is not null and coalesce(_u, true) and coalesce(_v, true)").select("u", "v", "cap", "back")


def saturated(whole: DataFrame, source, sink, most: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs (u, v, cap, back, net) of the nodes that the search met; net is what goes from u to v less what comes back, in a largest flow of at most ``most``. All other pairs carry nothing.

    ``whole`` is a written table, as it is read again. Each pair of nodes is one
    row; cap is its room from u to v, back that from v to u. The search works on
    the pairs near both ends: it takes up the pairs of all nodes that the source's
    side leads to and of those that lead to the sink's, a step on both sides, when
    no path of as many steps as are taken up is left. So a step reads the whole
    table once, and a round only what is near. No path is lost: where a side leads
    nowhere new, all that the source can reach, or that can reach the sink, is
    taken up, and paths of any length are looked for.

    Each round finds the nodes' distances to the sink by frontier joins, with
    what each can pass on at most, pushes along shortest paths from the source, and
    takes back what got stuck. A level costs two jobs, one that writes it and one
    that looks whether it has the source.
    """
    spark, kind = whole.sparkSession, whole.schema["u"].dataType.simpleString()
    whole, left = whole.select("u", "v", "cap", "back"), most
    nodes = spark.createDataFrame([(source, True, True), (sink, False, True)], f"v {kind}, ahead boolean, new boolean")
    pairs, steps, closed = keep(touching(whole, nodes).withColumn("net", F.lit(0).cast("long")), "pairs"), 2, False
    while left > 0:
        arcs = pairs.select("u", "v", (F.col("cap") - F.col("net")).alias("room")).union(pairs.select("v", "u", F.col("back") + F.col("net"))).where("room > 0")

        # levels by distance to the sink, with the most that a node can pass on
        levels = [spark.createDataFrame([(sink, left)], f"v {kind}, most long")]
        seen, found, reached = levels[0].select("v"), 1, None
        while found and reached is None and (closed or len(levels) <= steps):
            onward = F.sum(F.least("room", "most").cast("decimal(38,0)"))
            grown = arcs.join(levels[-1], "v").groupBy("u").agg(F.least(onward, F.lit(left)).cast("long").alias("most")).withColumnRenamed("u", "v").join(seen, "v", "left_anti")
            levels.append(keep(grown, "level"))
            found, reached = levels[-1].agg(F.count("*"), F.max(F.when(F.col("v") == F.lit(source), F.col("most")))).first()
            seen = seen.union(levels[-1].select("v"))
        if reached is None and not closed:
            sides = nodes.select("v", "ahead").distinct()
            on = arcs.select(F.col("u").alias("v"), F.col("v").alias("u")).join(sides.where("ahead"), "v").union(arcs.select("v", "u").join(sides.where("not ahead"), "v"))
            more = keep(on.select(F.col("u").alias("v"), "ahead").distinct().join(sides, ["v", "ahead"], "left_anti").withColumn("new", F.lit(True)), "nodes")
            closed = more.agg(F.count_distinct("ahead")).first()[0] < 2
            if closed and not found:
                break
            if not closed:
                nodes = keep(sides.withColumn("new", F.lit(False)).union(more), "nodes")
                pairs, steps = keep(pairs.union(touching(whole, nodes).withColumn("net", F.lit(0).cast("long"))), "pairs"), steps + 2
            continue
        if reached is None:
            break

        # away from the source, a level at a time
        has, pushed = spark.createDataFrame([(source, reached)], f"u {kind}, has long"), []
        for level in levels[-2::-1]:
            out = before(arcs.join(has, "u").join(level, "v").select("u", "v", "has", F.least("room", "most").alias("x")), "u", "v", "x")
            out = out.withColumn("x", F.least(F.col("x"), F.col("has") - F.col("before"))).where("x > 0").select("u", "v", "x")
            pushed.append(keep(out, "pushed"))
            has = pushed[-1].groupBy(F.col("v").alias("u")).agg(F.sum("x").alias("has"))

        # back from the sink: a node takes no more than it passed on
        kept = [pushed[-1]]
        for step in pushed[-2::-1]:
            passed = kept[-1].groupBy(F.col("u").alias("v")).agg(F.sum("x").alias("passed"))
            into = before(step.join(passed, "v"), "v", "u", "x")
            kept.append(keep(into.withColumn("x", F.least(F.col("x"), F.col("passed") - F.col("before"))).where("x > 0").select("u", "v", "x"), "kept"))
        left -= kept[-1].agg(F.sum("x")).first()[0]
        moved = kept[0]
        for step in kept[1:]:
            moved = moved.union(step)
        moved = moved.union(moved.select("v", "u", -F.col("x"))).groupBy("u", "v").agg(F.sum("x").alias("d"))
        pairs = keep(pairs.join(moved, ["u", "v"], "left").select("u", "v", "cap", "back", (F.col("net") + F.coalesce("d", F.lit(0))).alias("net")), "pairs")
    return pairs


def arc_flow(arcs: DataFrame, source, sink, keep: Callable[[DataFrame, str], DataFrame], target: int | None = None) -> DataFrame:
    """(src, dst, flow) above 0 of a largest flow, or of one of ``target`` if as much can pass, on arcs (src, dst, capacity).

    No capacity is no bound; parallel arcs add up; loops, null ends and capacities
    of 0 or less carry nothing. From a node to itself, from a node without arcs and
    for a target of 0 or less there is no flow. A source with an unbounded arc
    needs a target, else it is an error.
    """
    spark = arcs.sparkSession
    kind = arcs.schema["src"].dataType.simpleString()
    arcs = arcs.where("src <> dst and (capacity is null or capacity > 0)")
    n, bounded, out = arcs.where(F.col("src") == F.lit(source)).agg(F.count("*"), F.count("capacity"), F.sum(F.col("capacity").cast("decimal(38,0)"))).first()
    if source == sink or not n or (target is not None and target <= 0):
        return spark.createDataFrame([], f"src {kind}, dst {kind}, flow long")
    if target is None and bounded < n:
        raise ValueError("a source with an unbounded arc needs a target")
    most = min(x for x in (target, int(out) if bounded == n else None) if x is not None)
    room = F.least(F.coalesce(F.col("capacity").cast("decimal(38,0)"), F.lit(most)), F.lit(most))  # no arc carries more than all
    forth = F.col("src") < F.col("dst")

    def total(side: Column) -> Column:
        return F.least(F.coalesce(F.sum(F.when(side, room)), F.lit(0)), F.lit(most)).cast("long")

    pairs = keep(arcs.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(total(forth).alias("cap"), total(~forth).alias("back")), "whole")
    net = saturated(pairs, source, sink, most, keep).where("net <> 0")
    ahead = F.col("net") > 0
    return net.select(F.when(ahead, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(ahead, F.col("v")).otherwise(F.col("u")).alias("dst"), F.abs("net").alias("flow"))


def dealt(sent: DataFrame, got: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Transfers (src, dst, token, amount): what a token's givers send is dealt to its takers in order. sent and got are (t, a, x) with equal sums by token.

    H givers and T takers make at most H + T transfers and are never joined with
    each other: where either side's running sum ends, a transfer ends, and the
    number of ends before it names its giver and its taker.
    """

    def placed(rows: DataFrame, name: str) -> DataFrame:
        sums = before(rows.withColumn("_one", F.lit(1)), "t", "a", "x").withColumnRenamed("before", "lo")
        places = before(sums, "t", "a", "_one").withColumnRenamed("before", "place")
        return keep(places.select("t", F.col("a").alias(name), F.col("lo").alias(f"{name}_lo"), (F.col("lo") + F.col("x")).alias("hi"), F.col("place").alias(f"{name}_place")), name)

    givers, takers = placed(sent, "src"), placed(got, "dst")
    ends = givers.select("t", "hi", F.lit(1).alias("s"), F.lit(0).alias("g")).union(takers.select("t", "hi", F.lit(0), F.lit(1))).groupBy("t", "hi").agg(F.sum("s").alias("s"), F.sum("g").alias("g"))
    ends = keep(ends.repartitionByRange("t", "hi").withColumn("part", F.spark_partition_id()), "ends")
    ends = before(ends, "t", "hi", "s", F.col("part")).withColumnRenamed("before", "src_place")
    ends = before(ends, "t", "hi", "g", F.col("part")).withColumnRenamed("before", "dst_place")
    out = ends.join(givers.drop("hi"), ["t", "src_place"]).join(takers.drop("hi"), ["t", "dst_place"])
    return out.select("src", "dst", F.col("t").alias("token"), (F.col("hi") - F.greatest("src_lo", "dst_lo")).alias("amount"))


def largest_flow(balances: DataFrame, trust: DataFrame, source: int, sink: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Transfers (src, dst, token, amount) of a largest flow over any number of hops, found in Spark; ids are long.

    ``keep`` writes a table and reads it back.
    """
    held = balances.where("balance > 0").select(F.col("account").cast("long").alias("a"), F.col("token").cast("long").alias("t"), F.col("balance"), F.lit(False).alias("takes"))
    takes = trust.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("t"), F.lit(0).alias("balance"), F.lit(True).alias("takes"))
    own = held.union(takes).groupBy("a", "t").agg(F.sum("balance").cast("long").alias("cap"), F.bool_or("takes").alias("takes"))
    return token_flow(keep(own, "own"), source, sink, keep)


def token_flow(own: DataFrame, source: int, sink: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """largest_flow on a written table (a, t, cap, takes), a row each: what an account holds of a token, and whether it trusts it. Rows without either carry nothing.

    Holders and tokens are nodes: a holder sends a token up to its balance to the
    token's node, and that passes all of it on to whoever trusts the token. So a
    balance is shared by all who trust it and capacity edges are never made.
    """
    own = own.where("a is not null and t is not null and (cap > 0 or takes)")
    most = own.where((F.col("a") == source) & (F.col("cap") > 0)).agg(F.sum("cap")).first()[0] or 0
    if source == sink or not most:
        return own.sparkSession.createDataFrame([], "src long, dst long, token long, amount long")
    # accounts are the even nodes, tokens the odd ones
    pairs = own.select(F.shiftleft("a", 1).alias("u"), (F.shiftleft("t", 1) + 1).alias("v"), F.greatest("cap", F.lit(0)).alias("cap"), F.when(F.col("takes"), F.lit(most)).otherwise(0).cast("long").alias("back"))
    net = saturated(pairs, source * 2, sink * 2, most, keep).select(F.shiftright("u", 1).alias("a"), F.shiftright("v", 1).alias("t"), "net")
    return dealt(net.where("net > 0").select("t", "a", F.col("net").alias("x")), net.where("net < 0").select("t", "a", (-F.col("net")).alias("x")), keep)
