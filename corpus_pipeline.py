"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, benchmark items go, personal data is redacted, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns the columns of documents (the last one: packed pieces). Between
stages the rows are written as Parquet and read again, so a lost executor costs
no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, minhash, packing, pii, toxicity
from ledgerloom.llm.queries import table
from ledgerloom.llm.scratch import fresh, written

TOXIC = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC, repeated rows and null ids among them; null and empty texts stay. The classifier learns from all labelled documents that are left in docs. No rows: none come out."""
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    own = fresh(docs, "toxicity")
    return toxicity.scored(docs, model, score_col=own).where(F.col(own) < TOXIC).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id; of rows equal in id and text one stays.

    Documents without words are in no group. A document without an id is grouped
    like others and stays if its group has no id. An id that repeats stands for
    all its texts: they stay together. No rows: none come out.
    """
    own = fresh(docs, "row_key")
    far = F.lit(1 << 62)  # keys of rows without an id come after all ids
    keyed = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), far + F.xxhash64("text").bitwiseAND(far - 1)))
    kept = minhash.near_duplicates(keyed, id_col=own).where("kept").select(own).distinct()
    return keyed.join(kept.hint("merge"), own, "left_semi").dropDuplicates([own, "text"]).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts, null ids and repeated rows stay. No rows: none come out."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, n_chars counted again where it is a column; null texts stay null, and so does their n_chars. No rows: none come out."""
    out = pii.redacted(docs, pii.trained(spark))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is a piece of one token; repeated rows give repeated pieces, null ids stay null. No rows: none come out."""
    return packing.packed(packing.pieces(docs, with_ids=False))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", in_sequences),
]

#: SQL can't express the learned stages; tests/llm/test_queries.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all stages; each stage's docstring says what nulls, repeated rows and empty tables do."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
