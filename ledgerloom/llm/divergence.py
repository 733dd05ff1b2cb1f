"""Which sources of a language differ in their words, and by which terms: shares smoothed by one, compared exactly in integers.

Terms of a group (language, source) that occur equally often there have the same
share, so they are one bucket, and the smallest share that any of them has in the
whole language bounds what each can score. Buckets are evaluated best bound
first, and none whose bound is strictly below the k-th value found so far. Pairs
of sources need the terms that both have; what a term gives where one source
lacks it depends on its bucket alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import written
from ledgerloom.llm.textops import lower_table, lean, slices

UNIT = 1_000_000_000  # shares are parts of it, and 1 more
LEAST = 3  # documents of a language that a kept term is in
TOP = 200
SLICE = 8 << 20  # bytes of text whose terms are counted together


def term_table() -> np.ndarray:
    """Bytes of terms, A-Z lower-cased; all others are spaces."""
    t = lower_table()
    t[:0x41] = t[0x5B:0x61] = t[0x7B:0x80] = 0x20
    return t


def share(n: str, size: str) -> Column:
    """1 + floor(UNIT * n / size) for SQL expressions of longs, n at most size: three steps of a long division, exact below 9 * 10**15."""
    steps, left = "1L", f"({n})"
    for k in (1_000_000, 1_000, 1):
        steps, left = f"{steps} + ({left} * 1000L) div ({size}) * {k}L", f"(({left} * 1000L) % ({size}))"
    return F.expr(steps)


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of shares."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed over a slice of texts; a row without a term stands for each group that occurs."""
    table = term_table()
    for b in batches:
        lang, source = (b.column(k).cast(pa.large_string()) for k in (0, 1))
        for s in slices(b.column(2), SLICE):
            n, data = len(s), table[s.data]
            texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(s.offsets, np.int64)), pa.py_buffer(data))
            lists = pc.ascii_split_whitespace(texts)
            rows, terms = pc.list_parent_indices(lists), pc.list_flatten(lists)
            some = pc.not_equal(terms, "")
            coded = terms.filter(some).dictionary_encode()  # terms and groups are grouped by their numbers
            found = pa.table({"row": rows.filter(some), "term": coded.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
            langs, sources = (c.slice(s.first, n).dictionary_encode() for c in (lang, source))
            width = max(1, len(sources.dictionary))
            group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
            found = pa.table({"group": group[found["row"].to_numpy()], "term": found["term"], "n": found["count_all"]})
            found = found.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])

            def named(of: np.ndarray) -> tuple[pa.Array, pa.Array]:
                return langs.dictionary.take(pa.array(of // width)), sources.dictionary.take(pa.array(of % width))

            groups = np.unique(group)
            none = pa.nulls(len(groups), pa.large_string()), pa.array(np.zeros(len(groups), np.int64))
            out = pa.concat_tables([
                pa.table([*named(found["group"].to_numpy()), coded.dictionary.take(found["term"].combine_chunks()), found["n_sum"], found["n_count"]], _SCHEMA.names),
                pa.table([*named(groups), none[0], none[1], none[1]], _SCHEMA.names),
            ])
            yield from out.cast(_SCHEMA).to_batches()


_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): how often a term occurs in a group and in how many of its documents; each group has a row without a term besides. Nulls are empty strings; each row is a document."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return own.mapInArrow(lean(_occurrences), "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(groups, postings). groups: lang, source, terms (kept ones that occur), v (all kept ones of the language), p0 (the share of a term that doesn't occur; null if v = 0). postings: lang, source, term, n, p, p0, q for each kept term that occurs in a group."""
    own = Window.partitionBy("lang", "term")
    found = counts.where("term is not null").select("lang", "source", "term", "n", F.sum("docs").over(own).alias("in_docs"), F.sum("n").over(own).alias("total"), F.row_number().over(own.orderBy("source")).alias("place"))
    found = written(found.where(F.col("in_docs") >= least).drop("in_docs"), "found_terms")
    langs = written(found.where("place = 1").groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all")), "langs")
    sums = found.groupBy("lang", "source").agg(F.count("*").alias("terms"), F.sum("n").alias("size"))
    groups = counts.where("term is null").select("lang", "source").join(langs.select("lang", "v"), "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["v", "terms", "size"]).withColumn("p0", F.when(F.col("v") > 0, share("1", "size + v")))
    groups = written(groups, "groups")
    sized = groups.join(langs.select("lang", "all"), "lang").select("lang", "source", "size", "v", "p0", "all")
    postings = found.join(sized, ["lang", "source"]).select("lang", "source", "term", "n", share("n + 1", "size + v").alias("p"), "p0", share("total + 1", "all + v").alias("q"))
    return groups, written(postings, "postings")


def best_terms(postings: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group has more of than its language, by how far, the first ``top``.

    Two waves: the best buckets that hold ``top`` terms, then whatever bound
    isn't strictly below the value that is the last one then. A wave is a join,
    its first ranks are cut in every task before the groups meet.
    """
    group = ["lang", "source"]
    buckets = postings.groupBy(*group, "n", "p").agg(F.count("*").alias("terms"), F.min("q").alias("low")).where("p > low").withColumn("bound", distance("p", "low"))
    seen = Window.partitionBy(*group).orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1)
    buckets = written(buckets.select(*group, "n", "bound", F.coalesce(F.sum("terms").over(seen), F.lit(0)).alias("before")), "buckets")

    def evaluated(chosen: DataFrame) -> DataFrame:
        return postings.join(chosen.select(*group, "n"), [*group, "n"], "left_semi").where("p > q").select(*group, F.col("term").alias("item"), distance("p", "q").alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    first = written(ranked(evaluated(buckets.where(F.col("before") < top))), "first_wave")
    last = first.where(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
    rest = buckets.where(F.col("before") >= top).join(last, group, "left").where("kth is null or bound >= kth")
    return ranked(first.drop("rank").union(evaluated(rest)))


def source_pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each other source of the language, by the sum over all kept terms.

    Of sources a and b, the terms of a count as if b had none, those of b as if a
    had none, and the rest as if neither had any; terms that both have are then
    corrected, from their postings.
    """
    one, two = (groups.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "terms", "p0")], *(["v"] if x == "a" else [])) for x in "ab")
    pairs = one.join(two, "lang").where("source_a <> source_b")
    buckets = postings.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("terms"))
    apart = buckets.join(groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("none")), "lang").where("source <> other")
    apart = apart.groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * distance("p", "none")).alias("own"), F.sum(F.col("terms") * distance("none", "p")).alias("back"))
    left, right = (postings.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "p", "p0")]) for x in "ab")
    fix = lambda a, b: distance(f"p_{a}", f"p_{b}") - distance(f"p_{a}", f"p0_{b}") - distance(f"p0_{a}", f"p_{b}") + distance(f"p0_{a}", f"p0_{b}")
    both = left.join(right, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(fix("a", "b")).alias("ab"), F.sum(fix("b", "a")).alias("ba"))
    sums = [
        apart.select("lang", F.col("source").alias("source_a"), F.col("other").alias("source_b"), F.col("own").alias("part")),
        apart.select("lang", F.col("other").alias("source_a"), F.col("source").alias("source_b"), F.col("back").alias("part")),
        both.select("lang", "source_a", "source_b", F.col("ab").alias("part")),
        both.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), F.col("ba").alias("part")),
        pairs.select("lang", "source_a", "source_b", F.when(F.col("v") > 0, (F.col("v") - F.col("terms_a") - F.col("terms_b")) * distance("p0_a", "p0_b")).otherwise(F.lit(0)).alias("part")),
    ]
    rows = sums[0]
    for more in sums[1:]:
        rows = rows.union(more)
    rows = rows.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum("part").cast("long").alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audited(docs: DataFrame, top: int = TOP, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks all other sources of a language, part ``term`` the first ``top`` terms of a source.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased;
    a language keeps those in ``least`` of its documents or more. Null text, lang
    and source are empty strings, which are groups like others. Each row is a
    document, so repeated rows count again; texts are taken whole. Ties are
    ranked by item in the order of UTF-8. A language without kept terms has
    pairs of value 0 and no terms; one source alone has no pairs. An empty table
    gives no rows; other columns are ignored.
    """
    groups, postings = shares(written(counted(docs, text_col, lang_col, source_col), "occurrences"), least)
    pairs, terms = source_pairs(groups, postings), best_terms(postings, top)
    order = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*order).union(terms.withColumn("part", F.lit("term")).select(*order))
