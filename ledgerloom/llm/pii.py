"""Personal data in DataFrame functions: candidates from wide patterns, boosted trees over format and context, calibrated thresholds.

Base patterns give spans that always stay. Wider generators propose more,
overlapping ones among them; trees trained on texts made by rule score each from
its format and the words before it, and a kind's threshold, set on held-out
made texts, selects what is redacted besides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import fresh

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the base patterns, equal in what they match: no class that
# repeats can take the character that follows it. The guards before them only
# skip starts inside a run that failed from its beginning.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Wider generators: kind and pattern.
WIDE = (
    ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,4}+"),
    ("ip", r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:.])"),
    ("phone", r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z.+-])00[1-9][0-9]{0,2}(?:[\x20.-]?[0-9]{2,4}){3,5}+(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z.])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9A-Za-z.])"),
)
NEAR = 8
BEFORE = 32  # characters of context that features look at
_GOOD = {"email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b", "ip": r"(?i)\b(?:ip|host|server|address|login|from)\b", "card": r"(?i)\b(?:card|visa|credit|debit|payment|pay)\b", "phone": r"(?i)\b(?:call|tel|telephone|phone|mobile|fax|dial)\b"}
_BAD = r"(?i)\b(?:order|id|isbn|version|invoice|token|ref|build|serial|no|number|sku|part)\b"
_DOMAIN = r"(?i)[^a-z0-9](?:com|org|net|edu|gov|info|io|eu|at|be|ch|de|es|fr|it|mx|nl|pl|pt|uk|us)$"
FEATURES = ("kind", "size", "digits", "marks", "groups", "luhn", "good", "bad", "glued", "plus", "bracket", "domain")

SPAN = "array<struct<start:long,kind:int,end:long,found:string>>"


BLOCK = 64  # elements of an array that a fold appends to at most


def _none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what a lambda names is computed for each element otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefixed(values: Column, zero: Column, join: Callable[[Column, Column], Column], last: bool = False) -> Column:
    """Of each element what join makes of zero and all elements before it, with ``last`` of the whole array as one more.

    A fold that appends copies what it has, so it runs in blocks of BLOCK
    elements, then over the blocks' results: n elements cost n * BLOCK copies and
    (n / BLOCK) squared.
    """

    def fold(of: Column) -> Column:
        return F.aggregate(of, F.array(zero), lambda acc, x: F.array_append(acc, join(F.element_at(acc, -1), x)))

    def blocks(v: Column) -> Column:
        last_ = F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last_), lambda k: fold(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))

    def joined(inner: Column, starts: Column) -> Column:
        out = F.flatten(F.transform(inner, lambda b, k: let(F.get(starts, k), lambda at: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: join(at, x)))))
        return F.concat(out, F.array(F.element_at(starts, -1))) if last else out

    return let(let(values, blocks), lambda inner: let(fold(F.transform(inner, lambda b: F.element_at(b, -1))), lambda starts: joined(inner, starts)))


def spans(text: Column, kind: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start, kind, end, found), in code points: lengths of what stands between and of matches, added up."""
    between = F.transform(F.split(text, F.lit(pattern), -1), lambda x: F.char_length(x).cast("long"))

    def placed(found: Column) -> Column:
        sizes = F.transform(F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("f")), lambda x: x["b"] + F.char_length(x["f"]))
        ends = F.slice(prefixed(sizes, F.lit(0).cast("long"), lambda x, y: x + y, last=True), 2, F.size(found))
        return F.transform(F.arrays_zip(found.alias("f"), ends.alias("e")), lambda x: F.struct((x["e"] - F.char_length(x["f"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["e"].alias("end"), x["f"].alias("found")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(_none()))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds. Texts without a kind's mark skip its pattern."""
    none = _none()
    email = F.when(F.contains(text, F.lit("@")), spans(text, "email", EMAIL)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), spans(text, "ip", IP)).otherwise(none)
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), spans(text, "card", CARD)).otherwise(none)
    phone = F.when(text.rlike(r"\+[0-9]"), spans(text, "phone", PHONE)).otherwise(none)
    ip = F.filter(ip, lambda s: F.forall(F.split(s["found"], r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.lpad(F.ltrim(p, F.lit("0")), 3, "0"), F.lit("999")), F.lit(0)) <= 255)))
    card = F.filter(card, lambda s: F.char_length(digits(s["found"])).between(12, 19) & F.call_function("luhn_check", digits(s["found"])))
    phone = F.filter(phone, lambda s: F.char_length(digits(s["found"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def wide_spans(text: Column) -> Column:
    found = []
    for kind, pattern in WIDE:
        mark = r"(?i)[\[(\x20]at[\])\x20]" if kind == "email" else r"(?i)[0-9a-f]:[0-9a-f]{1,4}:" if kind == "ip" else r"[0-9]{3}"
        found.append(F.when(text.rlike(mark), spans(text, kind, pattern)).otherwise(_none()))
    return F.concat(*found)


def described(text: Column, s: Column) -> Column:
    """The features of a candidate, in the order of FEATURES."""
    value = s["found"]
    first = F.greatest(s["start"] - BEFORE, F.lit(0))
    before = F.substr(text, (first + 1).cast("int"), (s["start"] - first).cast("int"))
    after = F.substr(text, (s["end"] + 1).cast("int"), F.lit(1))
    good = reduce(lambda a, k: F.when(s["kind"] == KINDS.index(k), before.rlike(_GOOD[k])).otherwise(a), KINDS, F.lit(False))
    number = digits(value)
    values = (s["kind"], F.char_length(value), F.char_length(number), F.char_length(F.regexp_replace(value, "[A-Za-z0-9]", "")), F.size(F.split(value, "[^A-Za-z0-9]+")), F.call_function("luhn_check", number), good, before.rlike(_BAD), before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]"), F.startswith(value, F.lit("+")), value.rlike(r"[(\[]"), value.rlike(_DOMAIN))
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def made_texts(spark: SparkSession, variants: int = 12) -> DataFrame:
    """The training texts, by rule: text, label and whether it is held out; each has one candidate. Numbers come from a hash of the row.

    No lead decides alone: good forms stand after words of four languages or none,
    and each kind has forms that are wrong after any lead. {z} is the digit that
    makes a card's number right, {y} another one.
    """
    leads = {
        "phone": ("call me on", "phone:", "tel.", "mobile", "fax", "dial", "rufen Sie mich an", "Durchwahl", "appelez-moi au", "joignable au", "llámame al", "mi teléfono es"),
        "email": ("mail", "contact", "write to", "reach me:", "schreiben Sie an", "Anschrift:", "écrivez à", "courriel", "escribe a", "correo"),
        "card": ("card", "visa", "pay by credit card", "Karte", "bezahlt mit", "carte bancaire", "réglé par", "tarjeta", "pagado con"),
        "ip": ("host", "server", "login from ip", "Rechner", "Adresse", "serveur", "adresse", "servidor", "desde"),
    }
    bare = ("", "Anna Roth,", "| 7 |", "--", "et", "y", "und")
    forms = {
        "phone": ("{a}{b}{c}-{d}{e}{f}-{g}{h}{i}{j}", "({a}{b}{c}) {d}{e}{f}-{g}{h}{i}{j}", "{a}{b}{c} {d}{e}{f} {g}{h}{i}{j}", "0049 {a}{b}{c} {d}{e}{f} {g}{h}{i}", "0033 {a}{b} {c}{d} {e}{f} {g}{h}", "{a}{b}{c}.{d}{e}{f}.{g}{h}{i}{j}"),
        "email": ("anna{a}{b} [at] mail{c} [dot] com", "li.{a} [at] host{b} [dot] org", "jo{a}(at)site{c}(dot)net", "jo.roth(at)site(dot)blog", "roth[at]casa[dot]shop", "anna{a} at mail{b} dot com", "li{a}{b} at host{c} dot org", "roth at example dot de", "jo.roth at mail dot example dot fr"),
        "card": ("4{a}{b}{c}.{d}{e}{f}{g}.{h}{i}{j}{a}.{b}{c}{d}{z}", "5{a}{b}{c}/{d}{e}{f}{g}/{h}{i}{j}{a}/{b}{c}{d}{z}"),
        "ip": ("2{a}{b}1:db{c}:{d}{e}:{f}:{g}a:{h}:{i}:{j}f", "2{a}{b}1:0db{c}:{d}{e}a3:{f}{g}{h}{i}:00{j}f:{a}c2e:0{b}70:7{c}{d}4"),
    }
    wrong = {
        "phone": ("00{b}1 {a}{b}{c}{d} {e}{f}{g}{h} {i}{j}{a}{b} {c}{d}{e}{f} {g}{h}{i}{j}", "{a}{b}{c}- {d}{e}{f}-{g}{h}{i}{j}", "{a}{b}{c}.-{d}{e}{f} {g}{h}{i}{j}"),
        "email": ("now at home dot com{a}", "still at work dot and so", "often at sea dot sky{c}"),
        "card": ("4{a}{b}{c}.{d}{e}{f}{g}.{h}{i}{j}{a}.{b}{c}{d}{y}", "5{a}{b}{c}/{d}{e}{f}{g}/{h}{i}{j}{a}/{b}{c}{d}{y}", "{a}{b}{c}{d}/{e}{f}{g}{h}/{i}{j}{a}{b}/{c}{d}{e}{y}"),
        "ip": ("{a}:{b}:{c}:{d}:{e}:{f}:{g}:{h}",),
    }
    bad = ("order no", "part number", "isbn", "version", "invoice id", "serial", "ref", "sku")
    texts = [(leads_, own, label) for kind in forms for leads_, own, label in (((*leads[kind], *bare), forms[kind], 1), ((*leads[kind], *bare), wrong[kind], 0), (bad if kind != "email" else (), forms[kind], 0))]
    texts.append((("we stay", "look", "they are"), [f"{word} at home dot {tail}" for word in ("now", "still", "often") for tail in ("com{a}", "and{b}", "sky{c}")], 0))
    # held out are whole leads and, where a kind has three or more, whole forms
    rows = [(f"{lead} {form}", label, i % 3 == 2 or j % 3 == 2) for leads_, own, label in texts for i, lead in enumerate(leads_) for j, form in enumerate(own)]
    shapes = spark.createDataFrame(rows, "shape string, label int, held boolean")
    out = shapes.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    text = F.concat(F.lit("the same "), F.col("shape"), F.lit(" and so on"))
    for k, c in enumerate("abcdefghij"):
        text = F.replace(text, F.lit("{" + c + "}"), F.pmod(F.xxhash64("shape", "v", F.lit(k)), F.lit(10)).cast("string"))
    out = out.select(text.alias("text"), "label", "held")
    number = digits(F.regexp_extract("text", r"[0-9]{4}(?:[./][0-9]{4}){2}[./][0-9]{3}(?=\{)", 0))
    right = reduce(lambda a, z: F.when(F.call_function("luhn_check", F.concat(number, F.lit(str(z)))), F.lit(z)).otherwise(a), range(10), F.lit(0))
    last = F.replace(F.col("text"), F.lit("{z}"), right.cast("string"))
    return out.withColumn("text", F.replace(last, F.lit("{y}"), F.pmod(right + 1 + F.pmod(F.crc32("text"), F.lit(9)), F.lit(10)).cast("string")))


def flattened(model) -> Callable[[Column], Column]:
    """The trees' sum over an array of features, as nested conditions."""

    def of(node, x: Column) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(float(node.prediction()))
        return F.when(F.get(x, F.lit(node.split().featureIndex())) <= F.lit(float(node.split().threshold())), of(node.leftChild(), x)).otherwise(of(node.rightChild(), x))

    def score(x: Column) -> Column:
        parts = [w * of(t._java_obj.rootNode(), x) for w, t in zip(model.treeWeights, model.trees, strict=True)]
        return 1 / (1 + F.exp(-2 * reduce(lambda a, p: a + p, parts)))

    return score


def trained(spark: SparkSession, precision: float = 0.95) -> tuple[Callable[[Column], Column], dict[int, float]]:
    """(score of an array of features, threshold of each kind). A threshold lies halfway below the lowest held-out score from which the made texts reach the precision; a kind that never does selects nothing."""
    rows = made_texts(spark).withColumn("c", F.explode(wide_spans(F.col("text"))))
    rows = rows.select("held", F.col("label").cast("double").alias("label"), F.col("c.kind").alias("kind"), described(F.col("text"), F.col("c")).alias("features")).cache()
    vectors = rows.select("held", "label", array_to_vector("features").alias("vector"))
    model = GBTClassifier(featuresCol="vector", maxIter=16, maxDepth=3, stepSize=0.3, seed=7).fit(vectors.where("not held"))
    score = flattened(model)
    held = rows.where("held").select("kind", "label", score(F.col("features")).alias("score")).collect()
    cuts = {}
    for k in range(len(KINDS)):
        own = sorted(((r.score, r.label) for r in held if r.kind == k), reverse=True)
        right, cuts[k] = 0.0, 2.0
        for n, (s, y) in enumerate(own, 1):
            right += y
            if right >= precision * n and (n == len(own) or own[n][0] < s):
                cuts[k] = (s + own[n][0]) / 2 if n < len(own) else s
    rows.unpersist()
    return score, cuts


def found(docs: DataFrame, model: tuple[Callable[[Column], Column], dict[int, float]], text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """docs with the base spans and all spans (these and the selected ones), arrays of (start, kind, end, found) in order; columns of the two names are replaced.

    Offsets are code points, end exclusive; kind indexes KINDS. A candidate that
    overlaps a base span adds nothing; of overlapping candidates of one kind the
    best is kept, ties to the first. Null and empty texts have no spans. Whole
    texts of any length and any number of spans; rows are independent, so
    repeated rows and nulls or other columns, of whatever name, stay. No rows:
    none come out.
    """
    text, own = fresh(docs, "text_read"), fresh(docs, "wide_spans")
    kept = [c for c in docs.columns if c.lower() not in (base_col.lower(), spans_col.lower())]
    out = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumns({base_col: F.array_sort(base_spans(F.col(text))), own: wide_spans(F.col(text))})
    out = out.withColumn(own, F.when(F.size(own) > 0, _selected(F.col(text), F.col(own), F.col(base_col), model)).otherwise(_none()))
    return out.select(*kept, base_col, F.array_sort(F.array_distinct(F.concat(F.col(base_col), F.col(own)))).alias(spans_col))


def _selected(text: Column, wide: Column, base: Column, model: tuple[Callable[[Column], Column], dict[int, float]]) -> Column:
    """The wide candidates that score enough, touch no base span, and are the best of those of their kind that they overlap."""
    score, cuts = model
    cut = F.create_map(*[x for k, v in cuts.items() for x in (F.lit(k), F.lit(v))])
    fields = ("start", "kind", "end", "found")
    rows = F.transform(wide, lambda s: F.struct(*[s[c].alias(c) for c in fields], described(text, s).alias("features")))
    rows = F.transform(rows, lambda s: F.struct(*[s[c].alias(c) for c in fields], score(s["features"]).alias("score")))
    rows = F.filter(rows, lambda s: s["score"] >= cut[s["kind"]])
    # base spans and candidates in order of their starts: one overlaps a base span before it if that ends later, or after it if that starts earlier
    none = [F.lit(None).cast(k).alias(c) for c, k in (("kind", "int"), ("found", "string"), ("score", "double"))]
    every = F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"), *none)), F.transform(rows, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), *[s[c].alias(c) for c in ("end", "kind", "found", "score")])))
    near_, far = F.lit(0).cast("long"), F.lit(2**62)

    def apart(every: Column) -> Column:
        low = prefixed(F.transform(every, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(near_)), near_, lambda x, y: F.greatest(x, y))
        high = F.reverse(prefixed(F.transform(F.reverse(every), lambda s: F.when(s["own"] == 0, s["start"]).otherwise(far)), far, lambda x, y: F.least(x, y)))
        free = F.filter(F.arrays_zip(every.alias("s"), low.alias("low"), high.alias("high")), lambda x: (x["s"]["own"] == 1) & (x["low"] <= x["s"]["start"]) & (x["high"] >= x["s"]["end"]))
        return F.transform(free, lambda x: F.struct(*[x["s"][c].alias(c) for c in ("kind", "start", "end", "found", "score")]))

    def better(o: Column, s: Column) -> Column:
        first = (o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["end"] > s["end"]))
        return (o["kind"] == s["kind"]) & (o["start"] < s["end"]) & (s["start"] < o["end"]) & ((o["score"] > s["score"]) | ((o["score"] == s["score"]) & first))

    def best(free: Column) -> Column:
        """In order of kind and start; the patterns' lengths let a candidate overlap less than NEAR others on each side."""
        around = F.transform(free, lambda s, k: F.struct(s.alias("s"), F.exists(F.slice(free, F.greatest(k - NEAR + 1, F.lit(1)), F.lit(2 * NEAR + 1)), lambda o: better(o, s)).alias("beaten")))
        return F.transform(F.filter(around, lambda x: ~x["beaten"]), lambda x: F.struct(*[x["s"][c].alias(c) for c in fields]))

    return let(F.array_sort(let(F.array_sort(every), apart)), best)


def counted(*kinds: str, of: str = "base") -> list[Column]:
    """n_KIND: how many spans of each kind."""

    def one(number: int) -> Column:
        return F.size(F.filter(of, lambda s: s["kind"] == number)).cast("long")

    return [one(KINDS.index(k)).alias(f"n_{k}") for k in kinds]


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


PIECE = 1024  # code points of a text's pieces, which ranges are cut from


def redacted(docs: DataFrame, model: tuple[Callable[[Column], Column], dict[int, float]], text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets, as [EMAIL]; overlapping spans are one, named by the first.

    Null texts stay null, empty and very long ones are taken whole; rows are
    independent and no other column, whatever its name, changes. No rows: none
    come out.
    """
    base, every = fresh(docs, "spans_base"), fresh(docs, "spans_all")
    out = found(docs, model, text_col, base, every)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text, spans_ = F.col(text_col).cast("string"), F.col(every)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(parts: Column, a: Column, b: Column) -> Column:
        """The text from a to b, from the pieces that hold it."""
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        start, size = (a % PIECE + 1).cast("int"), (b - a).cast("int")
        over = F.concat(F.substr(F.get(parts, i), start), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substr(F.get(parts, j), F.lit(1), (b % PIECE).cast("int")), F.lit("")))
        return F.when(a >= b, "").when(i == j, F.substr(F.get(parts, i), start, size)).otherwise(over)

    before = prefixed(F.transform(spans_, lambda s: s["end"]), F.lit(0).cast("long"), lambda x, y: F.greatest(x, y))
    heads = F.filter(F.arrays_zip(spans_.alias("s"), before.alias("at")), lambda x: x["s"]["start"] >= x["at"])

    def whole(parts: Column) -> Column:
        redone = F.transform(heads, lambda x: F.concat(cut(parts, x["at"], x["s"]["start"]), F.get(names, x["s"]["kind"])))
        return F.concat(F.array_join(redone, ""), cut(parts, F.array_max(F.transform(spans_, lambda s: s["end"])), F.char_length(text).cast("long")))

    out = out.withColumn(text_col, F.when(F.size(every) > 0, F.get(F.transform(F.array(pieces), whole), F.lit(0))).otherwise(F.col(text_col)))
    return out.select(*docs.columns)
