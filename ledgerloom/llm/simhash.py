"""Near duplicates by SimHash: fingerprints of word shingles, an inverted index of their bytes by position, and count filtering.

Fingerprints of 64 bits that differ in 2 bits at most share at least 6 of their 8
bytes, each at its place. Every list of the index has a head of four places: two
of the four pairs of neighbouring places, of which two differing bytes leave one
choice untouched. Within a head the other four bytes are posted by place and
value, each pair's shared ones are tallied, and a pair that reaches 6 with its
head's is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.minhash import components
from ledgerloom.llm.scratch import written
from ledgerloom.llm.textops import Slice, lower_table, slices, u64

SHINGLE = 3
SEED = 42
DIFFER = 2  # bits that linked fingerprints differ in at most
PLACES = range(8)
SHARED = len(PLACES) - DIFFER  # bytes that they share at least
HEADS = tuple(a + b for a, b in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2))
MOST = 16  # fingerprints of a head that are tallied; beyond it, two more places join the head

# The primes of XXH64.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
P1, P2, P3, P4, P5 = map(u64, PRIMES)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of byte spans of data, all spans of a length's step at once."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    h = np.full(len(starts), u64(seed + PRIMES[4]))
    stripes = sizes // 32
    if (long := np.flatnonzero(stripes)).size:
        lanes = [np.full(len(long), u64(x)) for x in (seed + PRIMES[0] + PRIMES[1], seed + PRIMES[1], seed, seed - PRIMES[0])]
        k, on = 0, np.arange(len(long))
        while on.size:
            at = starts[long[on]] + 32 * k
            for i, lane in enumerate(lanes):
                lane[on] = _turned(lane[on] + eight[at + 8 * i] * P2, 31) * P1
            k += 1
            on = on[stripes[long[on]] > k]
        whole = reduce(np.add, (_turned(lane, n) for lane, n in zip(lanes, (1, 7, 12, 18), strict=True)))
        for lane in lanes:
            whole = (whole ^ (_turned(lane * P2, 31) * P1)) * P1 + P4
        h[long] = whole
    h += sizes.astype(np.uint64)
    at, rest = starts + 32 * stripes, sizes % 32
    for k in range(3):
        on = np.flatnonzero(rest >= 8 * (k + 1))
        h[on] = _turned(h[on] ^ (_turned(eight[at[on] + 8 * k] * P2, 31) * P1), 27) * P1 + P4
    at, rest = at + rest // 8 * 8, rest % 8
    on = np.flatnonzero(rest >= 4)
    h[on] = _turned(h[on] ^ (four[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
    at, rest = at + rest // 4 * 4, rest % 4
    for k in range(3):
        on = np.flatnonzero(rest > k)
        h[on] = _turned(h[on] ^ (data[at[on] + k].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def shingle_hashes(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of k words joined by one space, text after text, and how many each text has; a text of fewer words has one, of all its words."""
    w = s.words()
    sizes, n = w.ends - w.starts, w.counts
    at = np.concatenate(([0], np.cumsum(sizes + 1)))  # where each word begins once words are joined
    source = np.arange(at[-1]) + np.repeat(w.starts - at[:-1], sizes + 1)
    joined = lower_table()[s.data[np.minimum(source, max(len(s.data) - 1, 0))]] if len(s.data) else np.zeros(0, np.uint8)
    joined[at[1:] - 1] = 0x20
    per = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    first = np.repeat(w.first[:-1], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    last = first + np.repeat(np.minimum(n, k), per) - 1
    return xxh64(joined, at[first], at[last + 1] - 1 - at[first]), per


def fingerprints(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """A bit of a text's fingerprint is 1 if it is in over half of its hashes; 0 for a text without any."""
    out = np.zeros((len(per), 8, 8), np.uint8)  # by text, byte, bit
    some = np.flatnonzero(per)
    if not some.size:
        return np.zeros(len(per), np.uint64)
    chunks = -(-per[some] // 255)  # a chunk's count of a bit fits in a byte
    of = np.cumsum(chunks) - chunks
    begin = np.repeat((np.cumsum(per) - per)[some], chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(of, chunks))
    for bit in range(8):
        counts = np.add.reduceat((h >> np.uint64(bit)) & u64(0x0101010101010101), begin).astype("<u8").view(np.uint8).reshape(-1, 8)
        out[some, :, bit] = 2 * np.add.reduceat(counts.astype(np.int64), of, axis=0) > per[some, None]
    return np.packbits(out, axis=2, bitorder="little").reshape(len(per), 8).view("<u8").ravel()


def _fingerprinted(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1), 1 << 20):
                print_ = fingerprints(*shingle_hashes(s, k)).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(s)), pa.array(print_)], ["id", "print"])

    return run


def _byte(print_: Column, place: int) -> Column:
    return F.shiftright(print_, 8 * place).bitwiseAND(F.lit(0xFF))


def _masked(print_: Column, places: tuple[int, ...]) -> Column:
    mask = sum(0xFF << 8 * p for p in places)
    return print_.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _close(u: Column, v: Column) -> Column:
    return F.bit_count(u.bitwiseXOR(v)) <= DIFFER


def _each_pair(members: Column) -> Column:
    """Pairs of the members of a list, which is at most MOST long."""
    return F.flatten(F.transform(members, lambda u, i: F.transform(F.slice(members, i + 2, F.size(members)), lambda v: F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")))))


def _headed(prints: DataFrame, heads: tuple[tuple[int, ...], ...]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("places"), _masked(F.col("print"), p).alias("bytes")) for k, p in enumerate(heads)])


def tallied(index: DataFrame) -> DataFrame:
    """Pairs (u, v) of one head that share SHARED bytes with the head's own. Lists of (head, place, byte) hold at most MOST fingerprints."""
    rest = F.array(*[F.struct(F.lit(p).alias("place"), _byte(F.col("print"), p).alias("byte")) for p in PLACES])
    own = F.element_at(F.array(*[F.array(*map(F.lit, h)) for h in HEADS]), F.col("places") + 1)
    posted = index.select("places", "bytes", "print", F.explode(F.filter(rest, lambda x: ~F.array_contains(own, x["place"]))).alias("at"))
    lists = posted.groupBy("places", "bytes", "at").agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1)
    pairs = lists.select("places", F.explode(_each_pair(F.col("prints"))).alias("p")).select("places", "p.u", "p.v")
    return pairs.groupBy("places", "u", "v").agg(F.count("*").alias("shared")).where(F.col("shared") + len(HEADS[0]) >= SHARED).select("u", "v")


def refined(dense: DataFrame) -> DataFrame:
    """Pairs (u, v) of heads with more than MOST fingerprints: a pair that shares SHARED bytes shares a head of so many places.

    Where such a head has more than MOST still, its fingerprints differ in two
    bytes, so those linked have a value in common that is at most one bit from
    each: 17 values of a fingerprint, each with 17 members at most. Linking them
    with the smallest one of the value joins the same fingerprints.
    """
    wider = tuple(p for p in combinations(PLACES, SHARED) if any(set(h) <= set(p) for h in HEADS))
    fits = F.element_at(F.array(*[F.array(*[F.lit(k) for k, p in enumerate(wider) if set(h) <= set(p)]) for h in HEADS]), F.col("places") + 1)
    chosen = dense.groupBy("print").agg(F.array_distinct(F.flatten(F.collect_set(fits))).alias("fits"))
    rows = chosen.select("print", F.explode(F.filter(_headed(dense, wider), lambda x: F.array_contains("fits", x["places"]))).alias("head")).select("head.*", "print")
    rows = written(rows, "wider")
    sizes = rows.groupBy("places", "bytes").agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(sizes, ["places", "bytes"])
    few = rows.where(F.col("size") <= MOST).groupBy("places", "bytes").agg(F.collect_list("print").alias("prints")).select(F.explode(_each_pair(F.col("prints"))).alias("p")).select("p.u", "p.v")
    free = F.element_at(F.array(*[F.array(*[F.lit(8 * q + b) for q in PLACES if q not in p for b in range(8)]) for p in wider]), F.col("places") + 1)
    near = F.concat(F.array("print"), F.transform(free, lambda b: F.col("print").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    many = rows.where(F.col("size") > MOST).select("places", "print", F.explode(near).alias("near"))
    stars = many.groupBy("places", "near").agg(F.array_sort(F.collect_list("print")).alias("prints")).where(F.size("prints") > 1)
    stars = stars.select(F.col("prints")[0].alias("u"), F.explode(F.slice("prints", 2, 16)).alias("v"))
    return few.union(stars)


def links(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) of the distinct fingerprints in the column ``print`` that differ in DIFFER bits at most: all of them, or, in dense parts, enough of them to join the same fingerprints."""
    index = written(prints.select("print", F.explode(_headed(prints, HEADS)).alias("head")).select("head.*", "print"), "index")
    sizes = index.groupBy("places", "bytes").agg(F.count("*").alias("size")).where("size > 1")
    index = written(index.join(sizes, ["places", "bytes"]), "shared")
    pairs = tallied(index.where(F.col("size") <= MOST)).union(refined(index.where(F.col("size") > MOST)))
    return pairs.where(_close(F.col("u"), F.col("v"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id.

    Words are runs without ASCII white space, A-Z lower-cased; shingles of
    ``shingle`` words, repeats included, vote with the bits of their XXH64. A text
    of fewer words is one shingle. Null and empty texts and texts without words
    have the fingerprint zero and are linked like any other.

    Equal fingerprints are one node of the graph, so copies cost no pairs.
    Repeated rows keep their rows. Texts with a null id link others, but never
    name a component while it has an id; one without any has a null component_id.
    Texts of any length are taken whole. An empty table gives no rows; other
    columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = written(own.mapInArrow(_fingerprinted(shingle), "id long, print long"), "prints")
    prints = written(sig.groupBy("print").agg(F.min("id").alias("id")), "distinct_prints")
    labels = components(written(links(prints), "links"))
    grouped = prints.join(labels, F.col("print") == F.col("node"), "left").select("print", "id", F.coalesce("root", "print").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    named = written(grouped.join(smallest, "root").select("print", "component_id"), "named")
    return sig.join(named, "print", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
