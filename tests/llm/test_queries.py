"""The queries of the corpus operators, and the pipeline's stages, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import actual, expected
from test_text_operators import LOWER, base_list, grouped, key, shingles, words

import corpus_pipeline
from ledgerloom.llm import pii, queries, urls
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n if i is not None else 0


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_what_sql_can_express(spark, name):
    assert actual(QUERIES[name](spark, SF)) == expected(SF, queries.ORACLE_SQL[name])


def test_op1(spark, rows):
    got = QUERIES["op1_minhash_dedup"](spark, SF).collect()
    assert key([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == key(grouped(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op2(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w = words(t, lower=False)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        repeats = len({k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[g] > 1 for d in range(3)})
        failed = len(w) < 50 or 100 * repeats > 50 * len(w)
        assert (got[i].n_words, got[i].n_repeat_words, got[i].base_failed) == (len(w), repeats, failed) and not (failed and got[i].kept)
        assert failed or got[i].kept == (got[i].quality >= 0.5)


def test_op3(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    verdicts = {h + p: v for v, h, p in urls.RULES}
    got = QUERIES["op3_url_filter"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        rest = (pages[r.page_id] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        assert (r.host, r.path) == (host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0])
        fits = [h + p for _, h, p in urls.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert r.rule == max(fits, key=len, default=None)
        assert r.verdict == (verdicts[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow")


def test_op4(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op4_pii"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = base_list(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(f"{k}:") for x in base) for k in pii.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        own = [x for x in got[i].spans.split(",") if x]
        assert set(base) <= set(own) and own == sorted(own, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))
        assert all(0 <= int(a) < int(b) <= len(t or "") for _, a, b in (x.split(":") for x in own))


def test_op5(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(got) == {i for i, _ in rows}
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [i for i in labels if i in got and got[i].held_out]
    assert sum(got[i].predicted == labels[i] for i in held) >= 0.85 * len(held)


def test_op6(spark):
    n = spark.read.parquet(f"{SF}/pages.parquet").count()
    got = QUERIES["op6_html_extraction"](spark, SF).collect()
    assert len(got) == n and all(r.n_chars == len(r.text) and r.text == "\n".join(x.strip() for x in r.text.split("\n")) for r in got)


def test_op7(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, SF).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.held_out == (fold(i, 3) == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, t in rows if got[i].held_out and langs[i] and any(c.isalpha() for c in t or "")]
    assert sum(got[i].lang_pred == langs[i] for i in held) >= 0.97 * len(held)
    assert all((got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for i, t in rows)


def test_op8(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op8_lm_scoring"](spark, SF).collect()}
    seen = Counter(w for i, t in rows if fold(i, 10) for w in [*words(t), None])
    total = sum(seen.values())
    for i, t in rows:
        own = [*words(t), None]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (fold(i, 10) == 0, len(own), sum(seen[w] > 0 for w in own), total)


def packs(pieces, texts):
    """Each text's pieces are its ids and 2, cut into full pieces behind a first one, and sequences are gapless."""
    from tokenizers import Tokenizer
    import numpy as np
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = []
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert key([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces]) == key(want)
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    return len(sequences)


def test_op9(spark, rows):
    got = QUERIES["op9_packing"](spark, SF).collect()
    n = packs(got, rows)
    assert n <= -(-sum(r.length for r in got) // 1024) + 2


def test_op10(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    own = {i: shingles(t) for i, t in items}
    want = []
    for d, t in rows:
        have = shingles(t)
        want += [(d, i, len(s & have), len(s)) for i, s in own.items() if s and 100 * len(s & have) >= 75 * len(s)]
    assert key([tuple(r) for r in QUERIES["op10_decontamination"](spark, SF).collect()]) == key(want)


# the pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, toxicity string, shard int, base string"
STORY = " ".join(f"tale{k}" for k in range(80))
AWKWARD = [
    (1, STORY), (2, STORY), (3, STORY.replace("tale9", "other")), (None, STORY), (None, "own words of a text that has no id at all"), (None, "own words of a text that has no id at all"), (None, None), (None, None),
    (4, None), (5, ""), (6, " \n"), (7, "write to a@b.cd or +49 30 1234567, é"), (7, "write to a@b.cd or +49 30 1234567, é"), (8, "one two"), (9, " ".join(f"w{k * 7919 % 9973}" for k in range(20_000))),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, None, "s", len(t) if t is not None else None, "k", "t", 1, "b") for i, t in AWKWARD], DOCS)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, awkward, name, stage):
    out = stage(spark, awkward, SF)
    assert out.columns == awkward.columns
    assert {tuple(r[5:]) for r in out.collect()} == {("k", "t", 1, "b")}
    assert stage(spark, awkward.limit(0), SF).count() == 0


def test_toxic_stage(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = {r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, SF).collect()}
    known = [r.doc_id for r in docs.collect() if r.doc_id in labels]
    assert sum((i in out) == (labels[i] == 0) for i in known) >= 0.97 * len(known)
    left = corpus_pipeline.without_toxic(spark, awkward, SF).collect()
    assert sum(r.text is None for r in left) == sum(t is None for _, t in AWKWARD)


def test_near_copies_stage(spark, awkward, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {i for i, _, c in grouped(rows) if i == c}
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect()) == sorted(want)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, awkward, SF).collect()]
    assert key([(i, hash(t)) for i, t in got]) == key([(i, hash(t)) for i, t in dict.fromkeys(AWKWARD) if i not in (2, 3) and (i, t) != (None, STORY)])


def test_decontamination_stage(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [i for i, t in rows if not any(s and 100 * len(s & shingles(t)) >= 75 * len(s) for s in items)]
    assert sorted(r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, SF).collect()) == sorted(want)


def test_personal_data_stage(spark, awkward):
    got = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.without_personal_data(spark, awkward, SF).collect()}
    want = {(i, t.replace("a@b.cd", "[EMAIL]").replace("+49 30 1234567", "[PHONE]") if t else t) for i, t in AWKWARD}
    assert got == {(i, t, len(t) if t is not None else None) for i, t in want}


def test_packing_stage(spark, awkward):
    packs(corpus_pipeline.in_sequences(spark, awkward, SF).collect(), AWKWARD)


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    packs(got, [(r.doc_id, r.text) for r in docs.collect()])
