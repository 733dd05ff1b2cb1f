"""Fill-in-middle, SimHash and the divergence audit against plain versions, on awkward rows and on the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations
from math import floor

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from oracle import actual, expected
from test_text_operators import DOCS, LONG, LOWER, TEXTS, key, words

from ledgerloom.llm import divergence, fim, simhash
from ledgerloom.llm.queries import ORACLE_SQL, QUERIES
from ledgerloom.llm.textops import slices

SF = "/root/testdata/sf0.001"
MORE = [(14, "a<M>b"), (15, "<" * 70), (16, "S>P>M>" * 9), (17, "é\U0001f600" * 33), (18, "\x00x\n" * 11), (20, "y" * 32), (21, "y" * 64), (22, "'")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if k % 3 else "aa", "s" if k % 2 else None, 1, "x", 1, 0.5) for k, (i, t) in enumerate(TEXTS + MORE)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# fill in middle


def filled(i, t, seed=1, kept=90, spm=20):
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= kept:
        return i, len(t), "plain", None, None, t
    if h[3] % 100 < spm:
        return i, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return i, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.mark.parametrize("seed, kept, spm", [(1, 90, 20), (1, 100, 0), (7, 100, 100), (3, 100, 50)])
def test_fill_in_middle(odd, seed, kept, spm):
    out = fim.transformed(odd, seed=seed, kept=kept, spm=spm)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert key([tuple(r) for r in out.collect()]) == key([filled(i, t, seed, kept, spm) for i, t in TEXTS + MORE])
    back = fim.restored(out).collect()
    assert key([(r.doc_id, r.restored) for r in back]) == key([(i, t or "") for i, t in TEXTS + MORE])


def test_fill_in_middle_in_small_slices(odd, monkeypatch):
    monkeypatch.setattr(fim, "SLICE", 1)
    assert key([tuple(r) for r in fim.transformed(odd).collect()]) == key([filled(i, t) for i, t in TEXTS + MORE])


def test_every_cut_of_a_text():
    db = fim._duck()
    db.execute(fim._MACROS)
    t = "".join(chr(0x61 + k % 26) if k % 7 else "é" for k in range(70))
    for n in (1, 31, 32, 33, 64, 70):
        got = db.execute("SELECT a, b, cut(regexp_extract_all($1, '(?s).{1,32}'), a, b) FROM range(0, $2 + 1) x(a), range(0, $2 + 1) y(b) WHERE a <= b", [t[:n], n]).fetchall()
        assert len(got) == (n + 1) * (n + 2) // 2 and all(x == t[:n][a:b] for a, b, x in got)


def test_other_markers_come_back(odd):
    marks = ("[it's]", "[suffix]", "[m]")
    out = fim.transformed(odd, kept=100, markers=marks)
    assert any("[it's]" in r.output for r in out.collect())
    assert key([(r.doc_id, r.restored) for r in fim.restored(out, markers=marks).collect()]) == key([(i, t or "") for i, t in TEXTS + MORE])


def test_fill_in_middle_of_no_rows(none):
    assert fim.digested(none).collect() == []


# fingerprints


def printed(t, k=3):
    w = words(t)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def linked(prints, ids):
    """The smallest id of each row's component by comparing all pairs."""
    parent = {p: p for p in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    low = defaultdict(list)
    for p, i in zip(prints, ids, strict=True):
        if i is not None:
            low[find(p)].append(i)
    return [min(low[find(p)], default=None) for p in prints]


def test_hashes_of_all_lengths():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    sizes = np.concatenate((np.arange(0, 140), [255, 256, 1023, 4000]))
    starts = rng.integers(0, 900, len(sizes))
    want = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), seed=42) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    assert simhash.xxh64(data, starts, sizes).tolist() == want


def test_votes_beyond_a_byte():
    text = " ".join(f"w{k % 37}" for k in range(2000)) + " x" * 700
    (s,) = slices(pa.array([text, None, "One  two"]))
    assert simhash.fingerprints(*simhash.shingle_hashes(s, 3)).tolist() == [printed(text), 0, printed("one two")]


def simhashed(rows):
    prints = [printed(t) for _, t in rows]
    return key(list(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], linked(prints, [i for i, _ in rows]), strict=True)))


def test_simhash_of_odd_rows(odd, none):
    assert key([tuple(r) for r in simhash.near_duplicates(odd).collect()]) == simhashed(TEXTS + MORE)
    assert simhash.near_duplicates(none).collect() == []


def test_op12(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert key([tuple(r) for r in QUERIES["op12_simhash_dedup"](spark, SF).collect()]) == simhashed(rows)


def near(rng, n, bits):
    base = int(rng.integers(1 << 63))
    out = []
    for _ in range(n):
        x = base
        for b in rng.choice(64, int(rng.integers(0, bits + 1)), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize("kind", ["spread", "close", "two bytes", "one byte", "random", "most"])
def test_links_join_what_all_pairs_join(spark, kind, monkeypatch):
    """Sparse and dense parts of the index: fingerprints around a centre, and all that differ in two bytes."""
    rng = np.random.default_rng(len(kind))
    prints = {
        "spread": lambda: near(rng, 500, 9), "close": lambda: near(rng, 600, 3), "random": lambda: [int(x) for x in rng.integers(0, 1 << 63, 500)] + near(rng, 20, 2) + near(rng, 20, 2),
        "two bytes": lambda: [0x0123456789ABCDEF ^ int(a) << 8 ^ int(b) << 40 for a, b in rng.integers(0, 256, (400, 2))], "one byte": lambda: [(1 << 63) ^ k << 56 for k in range(256) if k % 3], "most": lambda: near(rng, 300, 4),
    }[kind]()
    if kind == "most":
        monkeypatch.setattr(simhash, "MOST", 2)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"))).collect()
    roots = {r.node & (2**64 - 1): r.root for r in got}
    want = linked(prints, signed)
    assert [roots.get(p, s) for p, s in zip(prints, signed, strict=True)] == want
    assert len(set(want)) < len(want)


# divergence


def audit(rows, top=200, least=3):
    found, groups = defaultdict(Counter), set()
    seen = defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        found[lang, source].update(own)
        seen[lang].update(set(own))
    out = []
    for lang in {g for g, _ in groups}:
        terms = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]

        def shares(counts, terms=terms):
            size = sum(counts[t] for t in terms) + len(terms)
            return {t: 1 + floor(Fraction(10**9 * (counts[t] + 1), size)) for t in terms}

        p = {s: shares(found[lang, s]) for s in sources}
        q = shares(sum((found[lang, s] for s in sources), Counter()))
        far = lambda a, b: floor(Fraction((a - b) ** 2, b))
        for s in sources:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in terms), o) for o in sources if o != s]
            best = [(-far(p[s][t], q[t]), t) for t in terms if found[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", best)):
                items = sorted(items, key=lambda x: (x[0], x[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, x, -v, k) for k, (v, x) in enumerate(items, 1)]
    return sorted(out)


def test_divergence_of_odd_rows(odd, none):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.audited(odd).collect()) == audit(rows)
    assert sorted(tuple(r) for r in divergence.audited(odd, least=1, top=5).collect()) == audit(rows, 5, 1)
    assert divergence.audited(none).collect() == []


@pytest.mark.parametrize("top", [1, 4, 30])
def test_waves_find_the_best_terms(spark, top):
    """Many ties, buckets whose bound is far above what they hold, and groups with fewer terms than are asked for."""
    rng = np.random.default_rng(top)
    rows = []
    for k in range(240):
        lang, source = "ab"[k % 2], f"s{min(int(rng.geometric(0.4)), 6)}"
        rows.append((" ".join(f"é{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26)}" for x in rng.zipf(1.3, int(rng.integers(0, 60))) % 600), lang, source))
    got = divergence.audited(spark.createDataFrame(rows, "text string, lang string, source string"), top=top).collect()
    assert sorted(tuple(r) for r in got) == audit(rows, top)


def test_exact_shares(spark):
    rows = [(n, d) for d in (1, 7, 10**9 + 7, 8 * 10**15 + 3) for n in (0, 1, d // 3, d - 1, d) if n <= d]
    got = spark.createDataFrame(rows, "n long, d long").select("n", "d", divergence.share("n", "d").alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.n // r.d for r in got)


def test_divergence_of_texts_beyond_words(spark):
    rows = [(LONG, "x", "a"), (LONG, "x", "b"), (LONG.upper(), "x", "b"), (None, "x", "c"), ("1 2 3", "y", "a"), ("", "y", "b"), (None, None, None)]
    got = divergence.audited(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert sorted(tuple(r) for r in got) == audit(rows)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_source_divergence"])
def test_against_sql(spark, name):
    assert actual(QUERIES[name](spark, SF)) == expected(SF, ORACLE_SQL[name])
