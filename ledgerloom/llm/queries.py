"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rest(col: str, n: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo n. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n, F.lit(0))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.quality import judged

    return judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.urls import judged, labelled, trained

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, trained(labelled(spark).where("not held"))).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.pii import KINDS, counted, found, listed, trained

    out = found(table(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark))
    return out.select("doc_id", *counted(*KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.toxicity import scored, trained

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels").where(rest("doc_id", 5) != 0))
    out = scored(docs, model).select("doc_id", (rest("doc_id", 5) == 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.html import extracted

    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.language import identified, prototypes

    docs = table(spark, sf_dir, "documents")
    learned = prototypes(docs.where(rest("doc_id", 3) != 1))
    out = identified(docs.select("doc_id", "text"), learned)
    return out.select("doc_id", (rest("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.lm import scored, trained

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, words = trained(docs.where(rest("doc_id", 10) != 0))
    out = scored(docs, model, words).withColumn("held_out", rest("doc_id", 10) == 0)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.packing import packed, pieces

    return packed(pieces(table(spark, sf_dir, "documents"), with_ids=False))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.fim import digested

    return digested(table(spark, sf_dir, "documents"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.divergence import audited

    return audited(table(spark, sf_dir, "documents"))


# What SQL can express of the operators: columns that a rule defines.


def llm_quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op2."""
    from ledgerloom.llm.quality import BASE, measured

    return measured(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), *BASE)


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op3, without a model."""
    from ledgerloom.llm.urls import SIZE, judged

    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), ([0.0] * SIZE, 0.0)).select("page_id", "host", "path", "rule")


def llm_personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op4 whose checks SQL has: addresses, ip numbers and phone numbers."""
    from ledgerloom.llm.pii import base_spans, counted

    docs = table(spark, sf_dir, "documents").select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    return docs.select("doc_id", *counted("email", "ip", "phone"))


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_quality_rules, op3_url_filter, op4_pii, op5_toxicity, op6_html_extraction, op7_language_id, op8_lm_scoring, op9_packing, op10_decontamination, op11_fill_in_middle, op12_simhash_dedup, op13_source_divergence, llm_quality_base, llm_url_rules, llm_personal_data_counts)}
ORACLE_SQL: dict[str, str] = {
    "llm_quality_base": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
        h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d)
        SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)""",
    "llm_url_rules": """WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        r(h, x) AS (VALUES ('org', '/'), ('example.org', '/es/'), ('example.org', '/en/1'), ('com', '/fr/'), ('com', '/de/'))
        SELECT page_id, host, path, max_by(h || x, length(h || x)) AS rule FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x) GROUP BY 1, 2, 3""",
    "llm_personal_data_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
        len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255)) AS n_ip,
        len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone FROM d""",
    "op11_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        k AS (SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d),
        c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, CASE WHEN n = 0 OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
        o AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM o""",
    "op13_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
        t AS (SELECT lang, term, count(*)::HUGEINT AS total FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
        l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM t GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM o JOIN t USING (lang, term) GROUP BY ALL),
        s AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT s.lang, s.source, t.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (s.n + l.v) AS p, 1 + 1000000000 * (t.total + 1) // (l.n + l.v) AS q FROM s JOIN l USING (lang) JOIN t USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200""",
}
