"""Quality rules: boosted trees over document statistics, with monotone constraints, beside fixed base rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import trees
from ledgerloom.llm.scratch import written
from ledgerloom.llm.textops import Slice, distinct, slices, span_hashes, windows

SAMPLE = 20_000  # labelled rows that the trees are fitted on at most, the first by a hash of their id
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics for the trees: name and the direction in which quality may move.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1, "mark_rate": -1, "digit_rate": -1, "distinct_rate": 0, "words_a_line": 0, "stop_rate": 0, "bar_rate": -1}


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def statistics(s: Slice) -> dict[str, np.ndarray]:
    """The base counts and the features of every text of a slice."""
    data, off, n = s.data, s.offsets, len(s)
    w = s.words(lower=False)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[w.starts] += 1
    np.subtract.at(inside, w.ends, 1)
    word = np.cumsum(inside[:-1]).astype(bool)
    flags = {k: np.isin(data, np.frombuffer(v, np.uint8)) for k, v in {"symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": b"0123456789", "marks": b"!?#*$%&|<>=_~^", "bars": b"|", "stops": b".,;:"}.items()}
    count = {k: _sums(v, off) for k, v in flags.items()}
    chars = _sums(word & ((data & 0xC0) != 0x80), off)

    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], newline + 1)))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.concatenate((starts[1:], [len(data)])), len(data))
    ends = np.where((ends > starts) & (data[ends - 1] == 10), ends - 1, ends) if len(starts) else starts
    owner = np.searchsorted(off, starts, "right") - 1
    words_to = np.concatenate(([0], np.cumsum(word, dtype=np.int64)))
    full = words_to[ends] > words_to[starts]
    owner, lines = owner[full], span_hashes(data, starts[full], ends[full])
    n_lines = np.bincount(owner, minlength=n)
    dup = n_lines - distinct(owner, lines, n)[2]

    doc, h = windows(w, 3, short=False)
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    first = w.first[doc] + np.arange(len(doc)) - np.concatenate(([0], np.cumsum(np.maximum(w.counts - 2, 0))))[doc]
    cover = np.zeros(len(w.hashes) + 3, bool)
    for k in range(3):
        cover[first[again] + k] = True
    repeat = np.bincount(w.doc, cover[: len(w.doc)], n).astype(np.int64)

    some = np.maximum(w.counts, 1)
    distinct_words = distinct(w.doc, w.hashes, n)[2]
    bytes_ = np.maximum(np.diff(off), 1)
    out = {"n_words": w.counts, "word_chars": chars, "n_symbols": count["symbols"], "n_dup_lines": dup, "n_repeat_words": repeat}
    out |= {"log_words": np.log1p(w.counts), "mean_word": chars / some, "symbol_rate": count["symbols"] / some, "dup_line_rate": dup / np.maximum(n_lines, 1), "repeat_rate": repeat / some, "upper_rate": count["upper"] / bytes_, "mark_rate": count["marks"] / bytes_, "digit_rate": count["digits"] / bytes_, "distinct_rate": distinct_words / some, "words_a_line": w.counts / np.maximum(n_lines, 1), "stop_rate": count["stops"] / some, "bar_rate": count["bars"] / some}
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for s in slices(b.column(1)):
            got = statistics(s)
            cols = [pa.array(got[k].astype(np.int64)) for k in BASE] + [pa.array(got[k].astype(float)) for k in FEATURES]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(s)), *cols], ["id", *BASE, *FEATURES])
            at += len(s)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts (long) and the features (double) of every row of docs."""
    schema = ", ".join(["id long", *(f"{k} long" for k in BASE), *(f"{k} double" for k in FEATURES)])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_measured, schema)


def fitted(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> trees.Forest:
    """The trees, fitted on at most ``sample`` labelled rows of statistics (12 numbers each)."""
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("double").alias("label"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = stats.join(F.broadcast(picked), "id").orderBy("id").limit(sample).select("label", *FEATURES).toArrow()
    x = np.stack([np.asarray(rows[k], float) for k in FEATURES], axis=1)
    return trees.fit(x, np.asarray(rows["label"], float), np.array(list(FEATURES.values())))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: id, the base counts, base_failed, quality (the trees' chance of label 1) and kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word
    windows. kept: not base_failed and quality >= threshold. Null and empty
    texts have zero counts and fail. Repeated rows and null ids stay as rows;
    texts of any length count whole. Without labels the trees are a constant
    0.5, so the base rules decide.
    """
    stats = written(measured(docs, id_col, text_col), "stats")
    sent = docs.sparkSession.sparkContext.broadcast(fitted(stats, labels, id_col, label_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.asarray(b.column(k), float) for k in FEATURES], axis=1) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("id", *BASE)), pa.array(sent.value.chance(x))], ["id", *BASE, "quality"])

    scored = stats.mapInArrow(run, ", ".join(["id long", *(f"{k} long" for k in BASE), "quality double"]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), *BASE, failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality")
