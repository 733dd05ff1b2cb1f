"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning 2012).

Features are the distinct 3- to 5-grams of characters (code points) of a text,
A-Z lower-cased and white space runs made one space, hashed into ``BITS`` bits. Each is scaled by
its log ratio of class frequencies; a logistic regression with an L2 penalty is
fitted on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import with_columns, written
from ledgerloom.llm.textops import Slice, lean, lower_table, mix, slices, space_table, u64

BITS = 18
ORDERS = (3, 4, 5)
SAMPLE = 6_000  # labelled texts that are fitted at most, the first by a hash of their id
MOST = 24_000_000  # features of all fitted texts together at most, which bounds the fitting task's memory (about 0.3 GB)


SLICE = 1 << 20  # bytes of text whose n-grams are hashed together


def features(s: Slice) -> Iterator[np.ndarray]:
    """The distinct hashed n-grams of each text of the slice."""
    data = np.frombuffer(s.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    offsets = np.concatenate(([0], np.cumsum((s.data & 0xC0) != 0x80)))[s.offsets]
    small = data < 128
    data = np.where(small, lower_table()[data & 127], data)
    space = small & space_table()[data & 127]
    data = np.where(space, 32, data)
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    ends = np.concatenate(([0], np.cumsum(keep)))[offsets]
    data = data[keep].astype(np.uint64)
    hashed, rolled = [], data
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            break
        rolled = rolled[:-1] * u64(0x9E3779B97F4A7C15) + data[n - 1 :]
        if n in ORDERS:
            hashed.append((n, (mix(rolled + u64(n)) >> np.uint64(64 - BITS)).astype(np.int32)))
    last = np.empty(1 << BITS, np.int64)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = [h[a : b - n + 1] for n, h in hashed if b - a >= n]
        if not own:
            yield np.zeros(0, np.int32)
            continue
        own = np.concatenate(own)
        place = np.arange(len(own))
        last[own] = place
        yield own[last[own] == place]


def fit(at: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, l2: float = 4.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """(weights, bias) of the scaled classifier, the scaling folded into the weights. at: the features of all texts, one text after the other; sizes: how many each has. Both are changed."""
    n, pos = len(sizes), int(toxic.sum())
    size = 1 << BITS
    if not n or pos in (0, n):
        return np.zeros(size, np.float32), 20.0 if n and pos == n else -20.0
    # beside the features of all texts (4 bytes each) only blocks of them are held
    y = toxic.astype(float)
    counts, ends = np.ones((2, size)), np.cumsum(sizes)
    for k, end in enumerate(ends.tolist()):
        counts[1 if toxic[k] else 0, at[end - sizes[k] : end]] += 1  # a row's features are distinct
    q, p = counts
    df = p + q - 2
    ratio = np.where(df >= 3, np.log(p / (pos + 2)) - np.log(q / (n - pos + 2)), 0.0)
    # features of no weight drop out, the frequent ones come first, and weights and gradients are scaled rather than occurrences
    common = np.argsort(-df, kind="stable")
    common = common[ratio[common] != 0]
    place = np.full(size, -1, np.int32)
    place[common] = np.arange(len(common))
    to = 0
    for k, end in enumerate(ends.tolist()):
        own = place[at[end - sizes[k] : end]]
        own = own[own >= 0]
        at[to : to + len(own)] = own  # never beyond what has been read
        sizes[k] = len(own)
        to += len(own)
    at = at[:to]
    rows_at, starts = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]
    blocks = _blocks(starts, len(at))
    r = ratio[common]
    w, b = np.zeros(len(common)), float(np.log(pos / (n - pos)))
    m = (np.zeros(len(common)), 0.0)
    v = (np.zeros(len(common)), 0.0)
    for k in range(1, steps + 1):
        z = np.full(n, b)
        scaled = w * r
        for first, last, begin, end in blocks:
            z[rows_at[first:last]] += np.add.reduceat(scaled[at[begin:end]], starts[first:last] - begin)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        sums = np.zeros(len(common))
        for first, last, begin, end in blocks:
            own = rows_at[first:last]
            sums += np.bincount(at[begin:end], np.repeat(err[own], sizes[own]), len(common))
        grad = (r * sums + l2 * w / n, err.sum())
        m = tuple(0.9 * x + 0.1 * g for x, g in zip(m, grad, strict=True))
        v = tuple(0.99 * x + 0.01 * g * g for x, g in zip(v, grad, strict=True))
        step = [0.02 * (x / (1 - 0.9**k)) / (np.sqrt(t / (1 - 0.99**k)) + 1e-8) for x, t in zip(m, v, strict=True)]
        w, b = w - step[0], b - 5 * float(step[1])
    weights = np.zeros(size, np.float32)
    weights[common] = w * r
    return weights, b


def _blocks(starts: np.ndarray, total: int, block: int = 1 << 17) -> list[tuple[int, int, int, int]]:
    """(first row, row after the last, its first feature, the one after its last) of runs of rows with about ``block`` features."""
    out, k = [], 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(starts, starts[k] + block, "right")) - 1) if starts[k] + block < total else len(starts)
        out.append((k, to, int(starts[k]), int(starts[to]) if to < len(starts) else total))
        k = to
    return out


def _fitted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sizes, labels, to = np.empty(most, np.int32), [], [], 0
        for b in batches:
            for label, found in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = features_of(found.as_buffer())
                at[to : to + len(own)] = own
                to += len(own)
                sizes.append(len(own))
                labels.append(label)
            del b
        if labels:
            w, bias = fit(at[:to], np.array(sizes), np.array(labels))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([bias])], ["weights", "bias"])

    return run


def steps_of(found: np.ndarray) -> bytes:
    """Distinct features as steps from one to the next, in order, about a byte each: 255 adds to the step that goes on."""
    more, last = np.divmod(np.diff(np.sort(found), prepend=-1), 255)
    out = np.full(int(more.sum()) + len(last), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = last
    return out.tobytes()


def features_of(steps: bytes) -> np.ndarray:
    out = np.frombuffer(steps, np.uint8)
    return np.cumsum(out, dtype=np.int32)[out < 255] - 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices(b.column(1), SLICE):
            rows = list(features(s))
            label, at = (b.column(k).slice(s.first, len(s)) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([label, at, pa.array([len(r) for r in rows], pa.int64()), pa.array(map(steps_of, rows), pa.binary())], ["label", "at", "size", "found"])


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, most: int = MOST) -> tuple[np.ndarray, float]:
    """Fits on at most ``sample`` labelled rows of at most ``most`` features together, in one task; only the weights (1 MB) reach the driver.

    Rows without a label or an id are no examples; of several labels of an id the
    highest counts, and every text of the id is an example.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(picked), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(sample)
    rows = written(texts.select("label", "text", F.xxhash64("id").alias("at")).mapInArrow(lean(_features), "label int, at long, size long, found binary"), "examples")
    # the sample bounds the rows of this window
    sizes = rows.groupBy("at").agg(F.sum("size").alias("size")).withColumn("total", F.sum("size").over(Window.orderBy("at")))
    rows = rows.join(F.broadcast(sizes.where(F.col("total") <= most).select("at")), "at")

    # the sample bounds what comes together here; examples come as steps and are held once
    got = rows.select("label", "found").repartition(1).mapInArrow(lean(_fitted(most)), "weights binary, bias double").collect()
    return (np.frombuffer(bytes(got[0].weights), np.float32), got[0].bias) if got else (np.zeros(1 << BITS, np.float32), -20.0)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs and one more column: the chance, 0 to 1, that label 1 holds.

    Null and empty texts get the chance of a text without features. Whole texts
    of any length count; equal texts get equal scores; other columns, nulls and
    repeated rows stay as they are. A column named ``score_col`` is replaced.
    Without labelled rows, or with label 0 alone, all scores are next to 0. No
    rows: none come out.
    """
    docs = docs.drop(score_col)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = sent.value
        for b in batches:
            z = [float(w[f].sum(dtype=np.float64)) + bias for s in slices(b.column(at), SLICE) for f in features(s)]
            p = 1 / (1 + np.exp(-np.clip(np.array(z), -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, score_col])

    return docs.mapInArrow(lean(run), with_columns(docs, **{score_col: "double"}))
