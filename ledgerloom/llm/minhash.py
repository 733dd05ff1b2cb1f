"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has t coordinates. In round i < t every shingle is thrown into one
hashed bin with a value in [i, i+1), and each bin keeps its smallest value;
from round t on, round t + j throws every shingle into bin j, so all bins are
full after 2t rounds at most and after few rounds for most texts. Bins then
agree between two texts about as often as the sets' Jaccard similarity, with
concentration as for independent hashes (Dahlgaard, Knudsen, Thorup 2017).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import written
from ledgerloom.llm.textops import distinct, lean, mix, slices, u64, windows

SHINGLE = 5
SLICE = 1 << 20  # bytes of text whose shingles are hashed together
BANDS, ROWS = 36, 5  # a pair at 0.75 shares no band with a chance of 6e-5
PER_CENT = 75
HUB_TURNS = 3  # then the pairs that are left are compared one by one
SIDE = 256  # members of a bucket that are compared with as many others in one group
FEW = 8  # a shingle that so many open texts have at most names its pairs itself

OPEN = ("cls", "n", "shared", "often", "root")


def sketches(doc: np.ndarray, h: np.ndarray, n: int, t: int) -> np.ndarray:
    """(n, t) uint64 sketches of the sets given as (doc, hash); rows of texts without hashes stay at the maximum."""
    full = u64(-1)
    out = np.full(n * t, full, np.uint64)
    active = np.ones(len(h), bool)
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * t):
        if i:
            unfilled = (out.reshape(n, t) == full).any(axis=1)
            active = unfilled[doc]
            doc, h = doc[active], h[active]
        if not len(h):
            break
        v = mix(h + u64((i + 1) * 0xA0761D6478BD642F))
        bins = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, doc * t + bins, (v & low) | (np.uint64(i) << np.uint64(32)))
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) int64 keys; equal keys mean equal rows of a band, but for hash collisions."""
    cut = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), cut.shape[:2]).copy()
    for r in range(rows):
        h = mix(h * u64(0x9FB21C651E98DF25) + cut[:, :, r])
    return h.view(np.int64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: number of texts, then (text, hash) of distinct shingles and their count per text."""
    for s in slices(column, SLICE):
        doc, h = windows(s.words(), k, short=True)
        yield len(s), *distinct(doc, h, len(s))


def _digests(h: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    ends = np.cumsum(n)
    raw = h.tobytes()
    return [hashlib.blake2b(raw[8 * (e - c) : 8 * e], digest_size=16).digest() if c else None for e, c in zip(ends.tolist(), n.tolist(), strict=True)]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.view(np.int64)))


def _sketched(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for size, doc, h, n in shingle_sets(b.column(1), k):
                keys = band_keys(sketches(doc, h, size, bands * rows), bands, rows)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, size), pa.array(n), pa.array(_digests(h, n), pa.binary()), keys], ["id", "n", "cls", "bands"])
                at += size

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, h, n in shingle_sets(b.column(1), k):
                out = pa.RecordBatch.from_arrays([pa.array(_digests(h, n), pa.binary()), _lists(h, n)], ["cls", "hashes"])
                yield out.filter(pa.array(n > 0))

    return run


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node reachable.

    Alternating large-star and small-star steps; each is a grouping and a join
    on the node, so a node of high degree is pre-aggregated and its join split.
    """

    def small(e: DataFrame) -> DataFrame:
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        out = e.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.union(m.select("u", F.col("m").alias("v"))).distinct()

    def large(e: DataFrame) -> DataFrame:
        e = e.union(e.select(F.col("v"), F.col("u")))
        m = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return e.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = written(edges.where("u <> v").select("u", "v").distinct(), name)
    before = None
    while (now := state(edges)) != before and now[0]:
        before = now
        edges = written(small(large(edges)), name)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, per_cent: int = PER_CENT, turns: int = HUB_TURNS) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Texts with equal shingle sets form a class, which has a number. One text of
    each class enters the bands. Each bucket compares its members with one hub,
    and buckets that end in one component are done. In the others only shingles
    that two open texts have count: a text of n shingles, s of them so shared,
    can be linked to one of m only if per_cent * (n + m) <= (100 + per_cent) * s,
    which rules out most members of large groups without meeting in pairs. The
    rest meet further hubs, the least edited first, then each other, large
    buckets in blocks of SIDE members by SIDE. No candidate pair is lost. Every
    link is confirmed on full shingle sets:
    100 * |intersection| >= per_cent * |union|.

    Null and empty texts, and texts without words: no shingles, linked with
    nothing. Repeated rows: each keeps its row, all in one class. Texts with a
    null id are linked like others but never name a component while it has an
    id; a component without any has a null component_id, and all of it is kept.
    Very long texts are taken whole. An empty table gives no rows. Other columns
    are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = written(docs.mapInArrow(lean(_sketched(shingle, bands, rows)), "id long, n long, cls binary, bands array<long>").withColumnRenamed("cls", "digest"), "sketches")
    classes = sig.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.expr("id is null"), "id", "n", "bands")).alias("s"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), "digest", "s.id", "s.n", "s.bands"), "classes")
    spread = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = written(spread.join(hubs, "bucket"), "members")

    wanted = classes.select("cls", "digest", "id").join(members.select("cls").distinct(), "cls", "left_semi")
    named = wanted.where("id is not null").select("id").distinct()
    texts = docs.where("id is not null").join(named.hint("merge"), "id", "left_semi")
    if wanted.where("id is null").limit(1).count():
        texts = texts.union(docs.where("id is null"))
    sets = texts.select("id", "text").mapInArrow(lean(_sets(shingle)), "digest binary, hashes array<long>").join(wanted.select("cls", "digest"), "digest").drop("digest")
    sets = written(sets.dropDuplicates(["cls"]), "sets")

    links = docs.sparkSession.createDataFrame([], "u long, v long")
    labels = docs.sparkSession.createDataFrame([], "node long, root long")
    degree = members.join(members.groupBy("bucket").agg(F.count("*").alias("size")), "bucket").groupBy("cls").agg(F.sum("size").cast("double").alias("centre"))
    rows_ = written(members.join(degree, "cls").select("bucket", "cls", "n", F.col("n").alias("shared"), F.col("n").alias("often"), "centre", F.col("cls").alias("root")), "open")
    for turn in range(turns + 1):
        split = rows_.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high")
        rows_ = written(rows_.join(split.select("bucket", "size"), "bucket"), "split")
        todo = rows_.agg(F.count("*"), F.sum(F.expr("(size - 1) / 2.0"))).first()
        if not todo[0]:
            break
        last = turn == turns or todo[1] <= 2 * todo[0]
        if turn:
            each = common_shingles(sets.join(rows_.select("cls", "root").distinct(), "cls"))
            rows_ = rows_.drop("shared", "often").join(counted(each), "cls").where(100 * F.col("shared") >= per_cent * F.col("n")).withColumn("centre", F.col("shared") / F.col("n"))
            rows_ = written(rows_, "counted")
        if last:
            pairs = all_pairs(rows_)
        else:
            hub = rows_.groupBy("bucket").agg(F.max(F.struct("centre", *OPEN)).alias("hub")).select("bucket", *[F.col(f"hub.{c}").alias(f"{c}_u") for c in OPEN])
            rows_ = written(rows_.join(hub, "bucket").where("cls <> cls_u"), "rest")
            pairs = rows_.withColumnsRenamed({c: f"{c}_v" for c in OPEN})
        # pairs that share a rare shingle are found by it; the others must be close in the frequent ones alone
        bound = "often" if last and turn else "shared"
        may = (F.col("root_u") != F.col("root_v")) & (per_cent * (F.col("n_u") + F.col("n_v")) <= (100 + per_cent) * F.least(f"{bound}_u", f"{bound}_v"))
        pairs = pairs.where(may).select(F.least("cls_u", "cls_v").alias("u"), F.greatest("cls_u", "cls_v").alias("v"))
        if last and turn:
            pairs = pairs.union(sharing(each, rows_))
        pairs = written(pairs.distinct(), "pairs")
        links = written(links.union(verified(pairs, sets, per_cent)), "links")
        labels = written(components(links), "labels")
        if last:
            break
        rows_ = rows_.drop("root").join(labels.withColumnsRenamed({"node": "cls", "root": "seen"}), "cls", "left").withColumn("root", F.coalesce("seen", "cls"))
        split = rows_.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        rows_ = written(rows_.join(split.select("bucket"), "bucket").select("bucket", "cls", "n", "shared", "often", "centre", "root"), "open")

    grouped = classes.select("cls", "digest", "id").join(labels, F.col("cls") == F.col("node"), "left").select("digest", "id", F.coalesce("root", "cls").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    named = written(grouped.join(smallest, "root").select("digest", "component_id"), "named")
    full = sig.where("n > 0").select("id", "n", "digest").join(named, "digest", "left").select("id", "n", "component_id")
    out = full.union(sig.where("n = 0").select("id", "n", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def all_pairs(rows_: DataFrame) -> DataFrame:
    """Every pair of members of a bucket, once, with the columns OPEN of both. A bucket is dealt into blocks of about SIDE members, and two blocks meet in a group of their own, so no task has a whole large bucket."""
    blocks = F.greatest(F.ceil(F.col("size") / SIDE), F.lit(1)).cast("int")
    dealt = rows_.withColumns({"_own": F.pmod(F.xxhash64("cls", "bucket"), blocks).cast("int"), "_other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    dealt = dealt.select("bucket", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"), "_own", *OPEN)
    sides = [dealt.where(f"_own = {side}").select("bucket", "_low", "_high", *[F.col(c).alias(f"{c}_{x}") for c in OPEN]) for side, x in (("_low", "u"), ("_high", "v"))]
    return sides[0].join(sides[1], ["bucket", "_low", "_high"]).where("_low < _high or cls_u < cls_v")


def common_shingles(sets: DataFrame) -> DataFrame:
    """(h, cls, root, c) of the shingles that c > 1 of the sets have."""
    each = sets.select("cls", "root", F.explode("hashes").alias("h"))
    return written(each.join(each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "h"), "common")


def counted(each: DataFrame) -> DataFrame:
    """(cls, shared, often): how many shingles of a set are in another set too, and in more than FEW. Two sets share no more than shared; sets that have none of the rarer ones in common, no more than often."""
    return each.groupBy("cls").agg(F.count("*").alias("shared"), F.count_if(F.col("c") > FEW).alias("often"))


def sharing(each: DataFrame, rows_: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components that have a shingle of at most FEW sets in common. Shingles of the same sets count once."""
    kept = each.where(F.col("c") <= FEW).join(rows_.select("cls").distinct(), "cls", "left_semi")
    lists = kept.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("cls", "root"))).alias("l")).select("l").distinct()
    pair = F.expr("flatten(transform(l, (a, i) -> transform(slice(l, i + 2, size(l)), b -> struct(a.cls as u, b.cls as v, a.root as ru, b.root as rv))))")
    return lists.select(F.explode(F.filter(pair, lambda p: p["ru"] != p["rv"])).alias("p")).select("p.u", "p.v")


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    u, v = (sets.select(F.col("cls").alias(x), F.col("hashes").alias(f"h_{x}")) for x in "uv")
    both = pairs.join(v, "v").join(u, "u")
    shared = F.size(F.array_intersect("h_u", "h_v"))
    return both.where(100 * shared >= per_cent * (F.size("h_u") + F.size("h_v") - shared)).select("u", "v")
