"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne 2007).

An n-gram of count c enters the filter once for each level 1 .. 1 + floor(log2 c).
A count is read back by probing levels until one misses. The filter takes
``BITS_A_TOKEN`` bits for each training token at every size and no n-gram is
left out. It is split by hash into parts, each built where its n-grams meet.
Up to ``MOST_BITS`` it is broadcast; a larger one stays a table of parts, and
each chunk of texts sends its distinct n-grams to their parts and gets the
levels back. Scores are the same either way. N-grams travel in blobs of sorted
keys, one for each chunk and part, some four bytes for each n-gram. A key has 16
bits more than the number of training tokens, so one n-gram in 65,536 at most
shares another's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import bucketed, written
from ledgerloom.llm.textops import Slice, mix, slices, u64

BITS_A_TOKEN = 8
MOST_BITS = 1 << 27  # of a filter that is broadcast: 16 MB
PART = 500_000  # training tokens for each part of the filter
CHUNK = 4 << 20  # bytes of texts that are probed together in a filter that isn't broadcast
KNOWN = 1 << 20  # words of exact count that are broadcast at most: 16 MB
LEVELS = 40
WEIGHT = 0.7  # of the bigram estimate, where its context was seen
FLUSH = 2_000_000

END = u64(0x1F83D9ABFB41BD6B)
START = u64(0x5BE0CD19137E2179)


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each token: a text's words, then the end."""
    w = s.words()
    n = len(s)
    at = w.first[1:] + np.arange(n)
    h = np.empty(len(w.hashes) + n, np.uint64)
    inner = np.ones(len(h), bool)
    inner[at] = False
    h[inner] = w.hashes
    h[at] = END
    return np.repeat(np.arange(n), w.counts + 1), h


def bigrams(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context's hash, bigram's hash) for each token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = np.ones(len(h), bool)
    first[1:] = doc[1:] != doc[:-1]
    before[first] = START
    return before, mix(before * u64(0xC2B2AE3D27D4EB4F) + h + u64(2))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c) of words and the start, counted within a task before they are shuffled."""
    for held, starts in _held(batches):
        h, c = np.unique(np.concatenate([*(h for _, h in held), np.full(starts, START)]), return_counts=True)
        for k in range(0, len(h), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 200_000].view(np.int64)), pa.array(c[k : k + 200_000])], ["h", "c"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], int]]:
    """The tokens of some slices of texts, and the number of their texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    texts = size = 0
    for b in batches:
        for s in slices(b.column(0)):
            held.append(tokens(s))
            texts, size = texts + len(s), size + len(held[-1][1])
            if size > FLUSH:
                yield held, texts
                held, texts, size = [], 0, 0
    if held:
        yield held, texts


@dataclass(frozen=True)
class Keys:
    """Keys of n-grams: ``size`` bits of their hashes, the first ``part`` of which name the part."""

    size: int
    part: int

    @property
    def high(self) -> int:
        """Bits of a key within its part that stand before its last three bytes."""
        return max(self.size - self.part - 24, 0)

    def of(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.size)

    def parts(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(self.size - self.part)).astype(np.int64)

    def within(self, key: np.ndarray) -> np.ndarray:
        return key & u64((1 << (self.size - self.part)) - 1)

    def packed(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Distinct sorted keys cut by part: parts, where each begins, and its blob: three bytes for each key, then the bits before them, as a one-byte count for each value or, of few keys, one by one."""
        parts, first = np.unique(self.parts(key), return_index=True)
        own = self.within(key)
        low = own.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        high = (own >> np.uint64(24)).astype(np.int64)
        blobs = []
        for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
            more = np.bincount(high[a:b], minlength=1 << self.high) if 1 << self.high < 2 * (b - a) else None
            if more is not None and more.max() < 256:
                blobs.append(low[a:b].tobytes() + more.astype(np.uint8).tobytes())
            else:
                blobs.append(low[a:b].tobytes() + high[a:b].astype("<u2").tobytes())
        return parts.astype(np.int32), first, blobs

    def unpacked(self, blob: memoryview, n: int) -> np.ndarray:
        """The n keys within a part."""
        low = np.zeros((n, 4), np.uint8)
        low[:, :3] = np.frombuffer(blob, np.uint8, 3 * n).reshape(-1, 3)
        if len(blob) == 5 * n:
            high = np.frombuffer(blob, "<u2", n, 3 * n)
        else:
            high = np.repeat(np.arange(1 << self.high), np.frombuffer(blob, np.uint8, 1 << self.high, 3 * n))
        return low.view("<u4").ravel().astype(np.uint64) | (high.astype(np.uint64) << np.uint64(24))


def _counted_keys(k: Keys):
    """Blobs of the keys and counts of all n-grams, counted within a task before they are shuffled. Counts are a byte each, 0 for those that don't fit and follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, starts in _held(batches):
            every = [x for doc, h in held for x in (h, bigrams(doc, h)[1])]
            key, c = np.unique(k.of(np.concatenate([*every, np.full(starts, START)])), return_counts=True)
            parts, first, blobs = k.packed(key)
            counts = [np.where(x < 256, x, 0).astype(np.uint8).tobytes() + x[x > 255].astype("<u4").tobytes() for x in np.split(c, first[1:])]
            sizes = np.diff(np.append(first, len(key)))
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(sizes), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["part", "n", "keys", "counts"])

    return run


def _counts(raw: memoryview, n: int) -> np.ndarray:
    c = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    c[c == 0] = np.frombuffer(raw, "<u4", -1, n)
    return c


def _places(key: np.ndarray, level: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The part's 64-bit word for (key within the part, level), and the four bits in it."""
    g = mix(key + u64(level * 0x9E3779B97F4A7C15))
    word = (g >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)
    bits = np.zeros_like(g)
    for k in range(4):
        bits |= np.uint64(1) << ((g >> np.uint64(6 * k)) & np.uint64(63))
    return word.astype(np.int64), bits


def build(key: np.ndarray, c: np.ndarray, words: int) -> np.ndarray:
    """One part of the filter, from the keys within it, each once, and their counts."""
    level = np.floor(np.log2(c)).astype(np.int64) + 1
    table = np.zeros(words, np.uint64)
    for j in range(1, LEVELS + 1):
        more = level >= j
        key, level = key[more], level[more]
        if not len(key):
            break
        word, bits = _places(key, j, words)
        np.bitwise_or.at(table, word, bits)
    return table


def levels(table: np.ndarray, key: np.ndarray, first: np.ndarray | int = 0, words: int | None = None) -> np.ndarray:
    """The highest level found in a row, of keys within parts that begin at the words ``first`` of the table."""
    words = words or len(table)
    level = np.zeros(len(key), np.uint8)
    active, own = np.arange(len(key)), key
    base = np.broadcast_to(np.asarray(first, np.int64), len(key))
    for j in range(1, LEVELS + 1):
        word, bits = _places(own, j, words)
        hit = np.flatnonzero((table[word + base] & bits) == bits)
        if not len(hit):
            break
        active, own, base = active[hit], own[hit], base[hit]
        level[active] = j
    return level


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(level < 2, level, 1.5 * 2.0 ** (level.astype(float) - 1))


@dataclass
class Model:
    table: np.ndarray | None  # the filter, all parts; None if it isn't broadcast
    known: np.ndarray  # sorted hashes of frequent words
    counts: np.ndarray  # their exact counts
    tokens: int  # N
    distinct: int  # V
    keys: Keys
    size: int  # 64-bit words of a part
    parts: DataFrame | None = None  # (part, bits), if it isn't broadcast

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Counts read back from the whole filter: 0, or the middle of the highest level found in a row."""
        key = self.keys.of(h)
        return middle(levels(self.table, self.keys.within(key), self.keys.parts(key) * self.size, self.size))

    def log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def chances(self, context: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of each token's smoothed probability, from counts read back: of the word before, the word and both."""
        one = (one + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))
        ratio = np.minimum(two / np.maximum(context, 1), 1)
        weight = np.where(context > 0, WEIGHT, 0.0)
        return np.log10(np.minimum(weight * ratio + (1 - weight) * one, 1.0))

    def rows(self, row: int, ids: pa.Array, doc: np.ndarray, h: np.ndarray, context: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
        """ROWS of some texts; words that aren't known are listed."""
        n = len(ids)
        score = np.bincount(doc, self.chances(context, one, two), n)
        place = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        hit = self.known[place] == h if len(self.known) else np.zeros(len(h), bool)
        base = np.bincount(doc[hit], self.log10(self.counts[place[hit]]), n)
        rare, sizes = h[~hit], np.bincount(doc[~hit], minlength=n)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(rare.view(np.int64)))
        cols = [pa.array(row + np.arange(n)), ids, pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[hit], minlength=n)), pa.array(base), pa.array(score), lists]
        return pa.RecordBatch.from_arrays(cols, ["row", "id", "n_tokens", "known", "base", "score", "rare"])


ROWS = "row long, id long, n_tokens long, known long, base double, score double, rare array<long>"


def trained(docs: DataFrame, text_col: str = "text", most_bits: int = MOST_BITS, known: int = KNOWN) -> tuple[Model, DataFrame]:
    """The model, and the table (h, c) of all words' exact counts, from every text of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    start = int(START.view(np.int64))
    words = written(texts.mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    own = words.where(F.col("h") != start)
    n, v = own.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # frequent words are broadcast with their counts; the finest cut by count that keeps to the bound
    steps = own.groupBy(F.floor(F.log2("c") * 4).alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    total, cut = 0, None
    for r in steps:
        total += r.n
        if total > known:
            break
        cut = r.step
    often = own.where(F.floor(F.log2("c") * 4) >= cut).select("h", "c").toArrow() if cut is not None else pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    hashes, counts = np.asarray(often["h"]).view(np.uint64), np.asarray(often["c"])
    order = np.argsort(hashes)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (4 * PART))
    bits = max(4 * tasks - 1, n // PART).bit_length()
    kinds = Keys(min(64, max(n.bit_length() + 16, bits + 24)), bits)
    size = max(1, -(-int(BITS_A_TOKEN * n) // (64 << bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, got = None, []

        def made() -> Iterator[pa.RecordBatch]:
            if got:
                key, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                c = np.bincount(at, weights=np.concatenate([g[1] for g in got])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([build(key, c, size).tobytes()], pa.binary())], ["part", "bits"])

        for b in batches:
            for p, many, key, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if p != part:
                    yield from made()
                    part, got = p, []
                got.append((kinds.unpacked(key.as_buffer(), many), _counts(c.as_buffer(), many)))
        yield from made()

    counted = texts.mapInArrow(_counted_keys(kinds), "part int, n long, keys binary, counts binary")
    built = counted.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, "part int, bits binary")
    if size * 64 << bits > most_bits:
        return Model(None, hashes[order], counts[order], int(n), int(v), kinds, size, written(built, "filter")), own
    table = np.zeros((1 << bits, size), np.uint64)
    for r in built.toLocalIterator(prefetchPartitions=True):
        table[r.part] = np.frombuffer(bytes(r.bits), np.uint64)
    return Model(table.ravel(), hashes[order], counts[order], int(n), int(v), kinds, size), own


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in chunks of about CHUNK bytes, compressed: they are written once, in buckets, and never shuffled."""
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        at = 0
        for s in slices(b.column(1), CHUNK):
            ids = b.column(0).slice(at, len(s))
            sizes = np.diff(s.offsets)
            data = pa.compress(s.data.tobytes(), "zstd", asbytes=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), x) for x in (pa.concat_arrays([ids]), pa.array(sizes))]
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *lists, pa.array([data], pa.binary())], ["chunk", "ids", "sizes", "data"])
            row += len(s)
            at += len(s)


def _read(sizes: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: text and hash of each token, and each bigram's hash."""
    offsets = np.concatenate(([0], np.cumsum(np.asarray(sizes.values))))
    raw = pa.decompress(data.as_py(), int(offsets[-1]), "zstd") if offsets[-1] else pa.py_buffer(b"")
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), raw])
    found = [(s.first + doc, h) for s in slices(texts, 2 << 20) for doc, h in [tokens(s)]]
    doc, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return doc, h, bigrams(doc, h)[1]


def _by_part(texts: DataFrame, model: Model) -> DataFrame:
    """ROWS of (id, text) with a filter that is a table: n-grams go to their parts once a chunk, and the levels come back."""
    spark = texts.sparkSession
    size, kinds = model.size, model.keys
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), model.tokens // (4 * PART))
    chunks = bucketed(texts.mapInArrow(_chunks, "chunk long, ids array<long>, sizes array<long>, data binary"), "chunks", "chunk", tasks)
    start = np.array([START])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                _, h, two = _read(b.column(1)[k], b.column(2)[k])
                key = np.unique(kinds.of(np.concatenate([start, h, two])))
                parts, first, blobs = kinds.packed(key)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.full(len(parts), b.column(0)[k].as_py())), pa.array(np.diff(np.append(first, len(key)))), pa.array(blobs, pa.binary())], ["part", "chunk", "n", "keys"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, table = None, np.zeros(size, np.uint64)
        for b in batches:
            out: list[tuple] = []
            for p, chunk, n, key in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                if p != part:  # a part without training n-grams has no row of its own
                    part, table = p, np.zeros(size, np.uint64)
                if chunk is None:
                    table = np.frombuffer(key.as_py(), np.uint64)
                else:
                    out.append((chunk, p, levels(table, kinds.unpacked(key.as_buffer(), n)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["chunk", "part", "levels"])

    own = model.parts.select("part", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("long").alias("n"), F.col("bits").alias("keys"))
    met = own.union(chunks.select("chunk", "sizes", "data").mapInArrow(asked, "part int, chunk long, n long, keys binary"))
    met = met.repartition(tasks, "part").sortWithinPartitions("part", F.asc_nulls_first("chunk"))
    back = met.mapInArrow(probed, "chunk long, part int, levels binary").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "levels"))).alias("back"))

    sent = spark.sparkContext.broadcast(replace(model, parts=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for k in range(b.num_rows):
                doc, h, two = _read(b.column(2)[k], b.column(3)[k])
                key, place = np.unique(kinds.of(np.concatenate([start, h, two])), return_inverse=True)
                got = np.frombuffer(b"".join(x["levels"] for x in b.column(4)[k].as_py()), np.uint8)
                c = middle(got)[place]
                one = c[1 : 1 + len(h)]
                context = np.empty_like(one)
                context[1:] = one[:-1]
                first = np.ones(len(doc), bool)
                first[1:] = doc[1:] != doc[:-1]
                context[first] = c[0]
                yield m.rows(b.column(0)[k].as_py(), b.column(1)[k].values, doc, h, context, one, c[1 + len(h) :])

    return chunks.join(back, "chunk").select(*chunks.columns, "back").mapInArrow(run, ROWS)


def _by_broadcast(texts: DataFrame, model: Model) -> DataFrame:
    """ROWS of (id, text) with a filter that every worker holds."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            at = 0
            for s in slices(b.column(1)):
                doc, h = tokens(s)
                before, two = bigrams(doc, h)
                yield m.rows(row, b.column(0).slice(at, len(s)), doc, h, *(m.probe(x) for x in (before, h, two)))
                row += len(s)
                at += len(s)

    return texts.mapInArrow(run, ROWS)


def scored(docs: DataFrame, model: Model, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_tokens, n_known, train_tokens, base_score, score.

    base_score sums the add-0.1 unigram estimate with exact counts: frequent
    words from the broadcast table, the others by a join on their hash. score
    sums the filter's smoothed bigram estimate. Null and empty texts are one end
    token. Repeated rows, null ids and very long texts are scored like others.
    Without training texts every count is 0.
    """
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    rows = written(_by_part(texts, model) if model.table is None else _by_broadcast(texts, model), "scored")
    rare = rows.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("m"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(words, "h", "left").groupBy("row").agg(F.sum(F.col("m") * F.log10((c + 0.1) / F.lit(model.tokens + 0.1 * (model.distinct + 1)))).alias("more"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("seen"))
    out = rows.drop("rare").join(rare, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
