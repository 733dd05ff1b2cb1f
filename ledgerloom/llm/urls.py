"""URL filters in DataFrame functions: host and path rules, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import fresh

SIZE = 4096
ORDERS = (3, 4, 5)
MOST_RULES = 10_000  # rules become one literal map

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# The labelled URL table is pairs of words of a topic with forms of urls. Every fourth pair is held out, to measure the error on names that weren't learned.
UNWANTED = ("casino poker bets slots jackpot roulette", "pills viagra pharmacy meds diet loss", "adult dating singles escort cams hookup", "loans payday credit cash rich earn", "ads tracker clicks popup spam promo", "crack keygen warez torrent fake replica")
WANTED = ("library museum archive history notes letters", "school science physics math lab campus", "news daily herald gazette times report", "garden cooking recipes kitchen bakery farm", "city council county bridge harbor station", "music choir theatre cinema gallery books", "hiking travel cycling birds weather maps", "software code docs kernel compiler wiki")
WORDS = "north blue old green little open river stone".split()
FORMS = ("www.{}.test/en/12", "{}.test/articles/{}.html", "blog.{}.test/fr/7/", "m.{}.test/2021/05/post", "{}.test", "pages.test/{}/index", "{}.test/de/3?id=9")


def _names(topics: tuple[str, ...]) -> list[str]:
    """Pairs of a topic's words, words with a general one, and each word alone."""
    out = []
    for k, topic in enumerate(topics):
        own = topic.split()
        out += [f"{a}-{b}" if (i + j) % 2 else a + b for i, a in enumerate(own) for j, b in enumerate(own) if i != j]
        out += [f"{WORDS[(i + k) % len(WORDS)]}{a}" for i, a in enumerate(own)] + own
    return out


def invented(n: int) -> list[str]:
    """Names of no topic, ordinary ones: syllables dealt by multiplication."""
    made = [c + v for c in "bdfgklmnprstvz" for v in ("a", "e", "i", "o", "u", "an", "er", "is")]
    return ["".join(made[(i * m + o) % len(made)] for m, o in ((37, 0), (53, 11), (71, 29))[: 2 + i % 2]) for i in range(1, n + 1)]


def located(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of size, rule and verdict; null if none does. Ties go to the rule that is later by name."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; {MOST_RULES} at most fit in one literal")
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(p).alias("path"), F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    table = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))])
    parts = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = F.flatten(F.transform(hosts, lambda h: F.coalesce(table[h], F.array().cast("array<struct<path:string,size:int,rule:string,verdict:string>>"))))
    found = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(found, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def grams(host: Column, path: Column) -> Column:
    """The distinct hashed character n-grams of host and path, as indexes below SIZE."""

    def of(name: str, text: Column, n: int) -> Column:
        text = F.concat(F.lit("^"), text, F.lit("$"))
        size = F.char_length(text) - n + 1
        at = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(name), F.substr(text, i, F.lit(n))), F.lit(SIZE)).cast("int"))

    return F.array_distinct(F.concat(*[of(k, v, n) for k, v in (("h", host), ("p", path)) for n in ORDERS]))


def labelled(spark: SparkSession) -> DataFrame:
    """The small training table: url, label (1: unwanted) and whether its name is held out."""
    rows = []
    for label, names in ((1.0, _names(UNWANTED)), (0.0, _names(WANTED) + invented(120))):
        rows += [("http://" + FORMS[f].replace("{}", s), label, k % 4 == 3) for k, s in enumerate(names) for f in {k % len(FORMS), (k * 3 + 1) % len(FORMS)}]
    return spark.createDataFrame(rows, "url string, label double, held boolean")


def trained(table: DataFrame) -> tuple[list[float], float]:
    """(weights, bias); the features of the table are expanded in Spark."""
    host, path = located(F.col("url"))
    found = table.select("label", grams(host, path).alias("found")).cache()  # else each element below would hash again
    dense = F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda j: F.array_contains("found", j).cast("double"))
    rows = found.select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=0.003, standardization=False, maxIter=60).fit(rows)
    found.unpersist()
    return [float(x) for x in model.coefficients], float(model.intercept)


def judged(pages: DataFrame, model: tuple[list[float], float], url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and score (columns of these names replaced).

    The longest fitting rule decides; else the model blocks from ``threshold``
    on. A null url, or one without ://, has an empty host and path, no rule, and
    the model's verdict on empty text. Urls of any length are read whole. Rows
    are independent: repeated rows, other columns, of whatever name, and nulls in
    them stay. No rows: none come out.
    """
    weights, bias = model
    names = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in pages.columns if c.lower() not in names]
    fits, found, at = (fresh(pages, n) for n in ("fitting", "grams", "located"))
    w = F.split(F.lit(",".join(f"{x:.9g}" for x in weights)), ",").cast("array<double>")
    host, path = located(F.col(url_col).cast("string"))
    out = pages.withColumn(at, F.struct(host.alias("host"), path.alias("path")))
    host, path = F.col(at)["host"], F.col(at)["path"]
    out = out.withColumns({fits: fitting_rule(host, path, rules), found: grams(host, path)})
    z = F.aggregate(found, F.lit(bias), lambda a, i: a + F.get(w, i))
    score = 1 / (1 + F.exp(-z))
    verdict = F.coalesce(F.col(fits)["verdict"], F.when(score >= threshold, "block").otherwise("allow"))
    return out.select(*kept, host.alias("host"), path.alias("path"), F.col(fits)["rule"].alias("rule"), verdict.alias("verdict"), score.alias("score"))
