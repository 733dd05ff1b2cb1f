"""Language identification with hyperdimensional profiles (Joshi, Halseth, Kanerva 2016).

Every letter has a random vector of +1 and -1. A trigram's vector binds its
letters' vectors, the first permuted twice and the second once; a text's vector
bundles (adds) those of its trigrams, and a language's prototype bundles its
texts. The language with the largest cosine wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import with_columns
from ledgerloom.llm.textops import mix

SIZE = 1024
GAP = 32  # stands for a run of anything but letters, and for both ends


def _letter(codes: np.ndarray, turn: int) -> np.ndarray:
    """(codes, SIZE) int8 vectors, each a function of its code point, permuted ``turn`` times."""
    words = mix(np.arange(SIZE // 64, dtype=np.uint64)[None, :] + mix(codes.astype(np.uint64) + np.uint64(77))[:, None])
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return np.roll(bits.astype(np.int8) * np.int8(2) - np.int8(1), turn, axis=1)


class Bundler:
    """Bundles texts; keeps the vectors of letters seen lately."""

    def __init__(self, keep: int = 4096):
        self.keep, self.known, self.tables = keep, np.zeros(0, np.int64), [np.zeros((0, SIZE), np.int8)] * 3

    def rows(self, codes: np.ndarray) -> np.ndarray:
        new = np.setdiff1d(codes, self.known)
        if len(new):
            self.known = np.unique(np.concatenate((self.known, new) if len(self.known) + len(new) <= self.keep else (codes,)))
            self.tables = [_letter(self.known, 2 - k) for k in range(3)]
        return np.searchsorted(self.known, codes)

    def __call__(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The bundle of trigrams (three 21-bit code points each) as often as counts says."""
        out = np.zeros(SIZE, np.float64)
        for at in range(0, len(grams), 2048):
            g, c = grams[at : at + 2048], counts[at : at + 2048]
            parts = [(g >> np.int64(s)) & np.int64(0x1FFFFF) for s in (42, 21, 0)]
            self.rows(np.unique(np.concatenate(parts)))
            a, b, d = (t[np.searchsorted(self.known, p)] for t, p in zip(self.tables, parts, strict=True))
            out += c.astype(np.float32) @ (a * b * d).astype(np.float32)
        return out


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text's lower-cased letters and gaps, with their counts; none without letters."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = text.lower()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds, at = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
    codes = np.where(letter, kinds, GAP)[at]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate(([GAP], codes, [GAP]))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
    codes = codes[keep]
    grams = (codes[:-2] << np.int64(42)) | (codes[1:-1] << np.int64(21)) | codes[2:]
    return np.unique(grams, return_counts=True)


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """One vector for each non-null language: the bundle of all its texts, each scaled to length 1.

    Tasks bundle what they read, so a row per task and language is shuffled; the
    driver gets SIZE numbers a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, sums = Bundler(), {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                grams, counts = trigrams(text.as_py())
                if len(grams):
                    v = bundle(grams, counts)
                    length = np.linalg.norm(v)
                    if length:
                        sums[lang.as_py()] = sums.get(lang.as_py(), 0.0) + v / length
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * SIZE), pa.array(np.arange(SIZE, dtype=np.int32)), pa.array(v)], ["lang", "at", "part"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).cast("string")).mapInArrow(run, "lang string, at int, part double")
    rows = rows.groupBy("lang", "at").agg(F.sum("part").alias("part")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("v"))
    return {r.lang: (v := np.array([x.part for x in r.v])) / (np.linalg.norm(v) or 1.0) for r in rows.orderBy("lang").collect()}


def identified(docs: DataFrame, learned: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, columns of these names replaced.

    score is (1 + cosine) / 2. Null texts and texts without a letter: ``und``,
    score 0, as are all texts when no language was learned. Ties go to the first
    language by name. Long texts count whole; rows and other columns stay.
    """
    docs = docs.drop("lang_pred", "score")
    sent, at = docs.sparkSession.sparkContext.broadcast((sorted(learned), [learned[k] for k in sorted(learned)])), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        table, bundle = np.array(table), Bundler()
        for b in batches:
            pred, score = [], []
            for text in b.column(at):
                grams, counts = trigrams(text.as_py())
                v = bundle(grams, counts) if len(grams) and names else None
                length = np.linalg.norm(v) if v is not None else 0.0
                if not length:
                    pred.append("und")
                    score.append(0.0)
                    continue
                cos = table @ v / length
                best = int(np.argmax(cos))
                pred.append(names[best])
                score.append(float(min(max((1 + cos[best]) / 2, 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_columns(docs, lang_pred="string", score="double"))
