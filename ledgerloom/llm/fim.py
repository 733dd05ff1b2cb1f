"""Fill-in-middle examples, made by DuckDB on Arrow batches.

A text is cut at two places, chosen by a hash of its id, into prefix, middle and
suffix, which are written in another order behind markers. All of it is SQL on a
registered batch. A text becomes a list of blocks of ``BLOCK`` code points, and
only the blocks that a cut falls in become lists of single code points, so a list
has about a thirtieth of the entries that one of all code points has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import with_columns
from ledgerloom.llm.textops import slices

BLOCK = 32  # code points that are one entry of a text's list
SLICE = 2 << 20  # bytes of text that are registered together; a longer text is alone
MARKERS = ("<P>", "<S>", "<M>")
KEPT = 90  # of 100 texts, how many are transformed
SPM = 20  # of 100 transformed ones, how many begin with the suffix

_MACROS = f"""
    CREATE MACRO cut(u, a, b) AS CASE
        WHEN a // {BLOCK} = b // {BLOCK} THEN coalesce(array_to_string(list_slice(regexp_extract_all(u[a // {BLOCK} + 1], '(?s).'), a % {BLOCK} + 1, b % {BLOCK}), ''), '')
        ELSE array_to_string(list_slice(regexp_extract_all(u[a // {BLOCK} + 1], '(?s).'), a % {BLOCK} + 1, {BLOCK}), '')
            || array_to_string(list_slice(u, a // {BLOCK} + 2, b // {BLOCK}), '')
            || coalesce(array_to_string(list_slice(regexp_extract_all(u[b // {BLOCK} + 1], '(?s).'), 1, b % {BLOCK}), ''), '') END;
    CREATE MACRO number(h, k) AS CAST('0x' || substr(h, 8 * k - 7, 8) AS UBIGINT)"""


def _transforming(seed: int, kept: int, spm: int, markers: tuple[str, str, str]) -> str:
    p, s, m = ("'" + x.replace("'", "''") + "'" for x in markers)
    return f"""
        WITH hashed AS (SELECT id, text, regexp_extract_all(text, '(?s).{{1,{BLOCK}}}') AS u, sha256('{seed}:' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM batch),
        sized AS (SELECT *, CASE WHEN len(u) = 0 THEN 0 ELSE {BLOCK} * (len(u) - 1) + length(u[-1]) END AS n FROM hashed),
        placed AS (SELECT *, least(number(h, 1) % (n + 1), number(h, 2) % (n + 1))::BIGINT AS a, greatest(number(h, 1) % (n + 1), number(h, 2) % (n + 1))::BIGINT AS b,
            CASE WHEN n = 0 OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR number(h, 3) % 100 >= {kept} THEN 'plain' WHEN number(h, 4) % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM sized)
        SELECT id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || cut(u, 0, a) || {s} || cut(u, b, n) || {m} || cut(u, a, b) ELSE {s} || cut(u, b, n) || {p} || cut(u, 0, a) || {m} || cut(u, a, b) END AS output FROM placed"""


def _restoring(markers: tuple[str, str, str]) -> str:
    p, s, m = ("'" + x.replace("'", "''") + "'" for x in markers)
    return f"""
        WITH halves AS (SELECT *, string_split(output, {m}) AS half FROM batch),
        parts AS (SELECT *, CASE form WHEN 'psm' THEN string_split(substr(half[1], {len(markers[0]) + 1}), {s}) WHEN 'spm' THEN string_split(substr(half[1], {len(markers[1]) + 1}), {p}) END AS part FROM halves)
        SELECT CASE form WHEN 'plain' THEN output WHEN 'psm' THEN part[1] || half[2] || part[2] WHEN 'spm' THEN part[2] || half[2] || part[1] END AS restored FROM parts"""


def _duck():
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1})
    db.execute("SET temp_directory = ''; SET preserve_insertion_order = true")
    return db


def _asked(db, sql: str, columns: dict[str, pa.Array]) -> pa.Table:
    db.register("batch", pa.table(columns))
    out = db.execute(sql).to_arrow_table()
    db.unregister("batch")
    return out


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, kept: int = KEPT, spm: int = SPM, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """One row for each row of docs: the id (a long), n, form, prefix_chars, middle_chars, output.

    Four numbers h1 to h4 are the first groups of 8 hex digits of the sha256 of
    ``seed:id``. The prefix has the smaller of h1 and h2 modulo n + 1 code points,
    the middle ends after the larger. A text stays as it is (form plain, no
    counts) if it is empty or has a marker in it, or if h3 modulo 100 is ``kept``
    or more; of the others those with h4 modulo 100 below ``spm`` are spm:
    suffix, prefix, middle, and the rest psm: prefix, suffix, middle.

    A null text is empty; a null id counts as an empty one. Equal rows give equal
    rows; a text of any length is transformed whole, about 3 times its bytes are
    held beside it. An empty table gives no rows; other columns are ignored.
    """
    sql = _transforming(seed, kept, spm, markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _duck()
        db.execute(_MACROS)
        for b in batches:
            text = b.column(1).cast(pa.large_string())
            for s in slices(text, SLICE):
                got = _asked(db, sql, {"id": b.column(0).slice(s.first, len(s)), "text": text.slice(s.first, len(s))})
                yield from got.cast(schema).to_batches()
        db.close()

    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """df and one more column: the text that ``output`` was made of, by its form; null for a null output or a form that isn't known. A column of that name is replaced."""
    df = df.drop(name)
    sql, at, form = _restoring(markers), df.columns.index(output_col), df.columns.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _duck()
        for b in batches:
            text = b.column(at).cast(pa.large_string())
            for s in slices(text, SLICE):
                part = b.slice(s.first, len(s))
                got = _asked(db, sql, {"output": text.slice(s.first, len(s)), "form": part.column(form)})
                yield pa.RecordBatch.from_arrays([*part.columns, got.column(0).cast(pa.string()).combine_chunks()], [*b.schema.names, name])
        db.close()

    return df.mapInArrow(run, with_columns(df, **{name: "string"}))


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of ``transformed``: id, n, form, both counts, and the digests of the output and of what it is restored to."""
    out = restored(transformed(docs, id_col, text_col))
    return out.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
