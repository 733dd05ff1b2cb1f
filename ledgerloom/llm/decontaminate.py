"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items and documents are partitioned by size (Zhu, Nargesian, Pu, Miller 2016):
a small item in a long text has a tiny Jaccard similarity, so the number of
coordinates must follow the sizes. For each class of items, a document of n
shingles gets n / load bins, rounded up to a power of two; each bin keeps its
smallest hash. A shared shingle stays a bin's minimum with a chance of at least
(1 - exp(-load)) / load, and ``load`` is what lets an item at the threshold
escape with a chance of ``MISS``. Items too small for that have a coordinate
for every shingle; for items of some dozen words the load is about 1, so most
shingles stay. A hit is verified on all shingles of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.minhash import SLICE, _digests, _lists
from ledgerloom.llm.scratch import written
from ledgerloom.llm.textops import Slice, distinct, lean, mix, slices, u64, windows

SHINGLE = 5
PER_CENT = 75
MISS = 1e-8
BLOCK = 4_000_000  # item shingles that one pass over the documents carries: 32 MB


def _load(size: int, per_cent: int) -> float:
    """The load for items of at least ``size`` shingles; 0: every shingle is kept."""
    need = 1 - MISS ** (1 / max(1, math.ceil(size * per_cent / 100)))
    if need > 0.8:
        return 0.0
    low, high = 0.0, 64.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 - math.exp(-mid)) / mid > need else (low, mid)
    return low


class Items:
    """The items of one block: numbers, widths, their sorted shingle hashes, and for each class a sorted hash column with the items that have it."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], widths: list[int], shingle: int, per_cent: int):
        self.ids, self.sets, self.shingle, self.per_cent = ids, [np.sort(s) for s in sets], shingle, per_cent
        self.widths = widths
        groups: dict[tuple[int, float], list[int]] = {}
        for i, (s, width) in enumerate(zip(sets, widths, strict=True)):
            groups.setdefault((width, _load(1 << (len(s).bit_length() - 1), per_cent)), []).append(i)
        self.classes = []
        for (width, load), members in sorted(groups.items()):
            h = np.concatenate([self.sets[i] for i in members])
            owner = np.repeat(members, [len(self.sets[i]) for i in members])
            order = np.argsort(h, kind="stable")
            self.classes.append((width, load, h[order], owner[order]))

    def found(self, s: Slice) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) for every item that a text of the slice contains."""
        w = s.words()
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        pairs: set[tuple[int, int]] = set()
        for width, load, hashes, owner in self.classes:
            if width not in made:
                made[width] = windows(w, width, short=False)
            doc, h = made[width]
            if load:
                doc, h = minima(doc, h, len(s), load)
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            hit = np.flatnonzero(hashes[at] == h)
            for d, x in set(zip(doc[hit].tolist(), h[hit].tolist(), strict=True)):
                pairs.update((d, int(i)) for i in owner[np.searchsorted(hashes, u64(x)) : np.searchsorted(hashes, u64(x), "right")])
        texts: dict[tuple[int, int], np.ndarray] = {}
        for d, i in sorted(pairs):
            width = self.widths[i]
            if (d, width) not in texts:
                doc, h = made[width]
                texts[d, width] = h[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
            shared = int(np.isin(self.sets[i], texts[d, width]).sum())
            if 100 * shared >= self.per_cent * len(self.sets[i]):
                yield d, i, shared


def minima(doc: np.ndarray, h: np.ndarray, n: int, load: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are the smallest of their bin, with about ``load`` shingles to a bin."""
    counts = np.bincount(doc, minlength=n)
    bits = np.ceil(np.log2(np.maximum(counts / load, 1))).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(np.int64(1) << bits)))
    v = mix(h ^ u64(0x5851F42D4C957F2D))
    bins = first[doc] + ((v >> np.uint64(1)) >> (63 - bits[doc]).astype(np.uint64)).astype(np.int64)
    value = mix(v + np.uint64(1))
    least = np.full(first[-1], u64(-1), np.uint64)
    np.minimum.at(least, bins, value)
    keep = least[bins] == value
    return doc[keep], h[keep]


def _item_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for s in slices(b.column(1)):
                w = s.words()
                _, h, n = distinct(*windows(w, shingle, short=True), len(s))
                width = np.minimum(w.counts, shingle)
                out = pa.RecordBatch.from_arrays([b.column(0).slice(at, len(s)), pa.array(width), pa.array(n), pa.array(_digests(h, n), pa.binary()), _lists(h, n)], ["item", "width", "size", "digest", "hashes"])
                at += len(s)
                yield out.filter(pa.array(n > 0))

    return run


def distinct_items(items: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(k, width, size, hashes) of the distinct items, and (item, k) of all: an item that repeats is searched once."""
    each = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_item_sets(shingle)), "item long, width long, size long, digest binary, hashes array<long>")
    own = written(each.drop("item").dropDuplicates(["digest", "width"]).withColumn("k", F.monotonically_increasing_id()), "items")
    return own, each.select("item", "digest", "width").join(own.select("digest", "width", "k"), ["digest", "width"]).select("item", "k")


def blocks(own: DataFrame, shingle: int, per_cent: int, block: int) -> Iterator[Items]:
    """Distinct items in blocks of at most ``block`` shingles, or of one larger item: their numbers are cut by running sums of sizes."""
    cuts, total = [], 0
    for r in own.select("k", "size").orderBy("k").toLocalIterator():
        if not cuts or total + r.size > block:
            cuts.append(r.k)
            total = 0
        total += r.size
    for low, high in zip(cuts, [*cuts[1:], 1 << 62], strict=False):
        got = own.where(F.col("k").between(low, high - 1)).toArrow()
        yield Items(got["k"].to_pylist(), [np.array(x, np.int64).view(np.uint64) for x in got["hashes"].to_pylist()], got["width"].to_pylist(), shingle, per_cent)


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, per_cent: int = PER_CENT, block: int = BLOCK) -> DataFrame:
    """(doc id, item id, n_shared, n_item) for every document and item with 100 * n_shared >= per_cent * n_item.

    n_item is the item's number of distinct shingles; an item of fewer words is
    one window of its own length, looked for anywhere in a text. Null or empty
    texts on either side match nothing. Repeated rows give a row each. Null ids
    come out as null. Texts of any length are searched whole. Empty tables give
    no rows. Other columns are ignored; item_id may be named as doc_id is, then
    the item's column gets the prefix item_.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    names = [doc_id, item_id if item_id != doc_id else f"item_{item_id}", "n_shared", "n_item"]
    own, every = distinct_items(items, item_id, item_text, shingle)
    schema = "doc long, k long, n_shared long, n_item long"
    out = None
    for part in blocks(own, shingle, per_cent, block):
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for b in batches:
                at, rows = 0, []
                for s in slices(b.column(1), SLICE):
                    rows += [(b.column(0)[at + d].as_py(), held.ids[i], shared, len(held.sets[i])) for d, i, shared in held.found(s)]
                    at += len(s)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc", "k", "n_shared", "n_item"])

        found = texts.mapInArrow(lean(run), schema)
        out = found if out is None else out.union(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.join(every, "k").select("doc", "item", "n_shared", "n_item").toDF(*names)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, per_cent: int = PER_CENT, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns as they are, whose text contains no item (see contained_items). No row is moved between tasks."""
    spark = docs.sparkSession
    for part in blocks(distinct_items(items, item_id, item_text, shingle)[0], shingle, per_cent, block):
        sent, at_text = spark.sparkContext.broadcast(part), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at_text=at_text) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for s in slices(b.column(at_text), SLICE):
                    for d, _, _ in own.found(s):
                        clean[s.first + d] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
