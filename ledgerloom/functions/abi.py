"""Contract data in 32-byte words, read and written by expressions: no Python in the plan.

A value of a dynamic type has an offset in the head and its length and content in
the tail. Numbers are decimal text, so 256 bits fit; addresses and bytes are hex
text; an array is an array of such texts, anything else an array of one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32
MOST = 2_147_483_647  # offsets and lengths beyond it are broken
_PART = 15  # hex digits that conv() takes without an end of its range
_GROUP = 10**18  # decimal digits that a long holds in any case


def piece(data: Column, at: Column, n: Column | int) -> Column:
    """n bytes from a place on, fewer at the end of the data."""
    return F.substr(data, at.cast("int") + 1, (F.lit(n) if isinstance(n, int) else n).cast("int"))


def named(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it; plans stay small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def number(digits: Column) -> Column:
    """Up to 15 hex digits as decimal(20,0)."""
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def size(word: Column) -> Column:
    """A word as an offset or a length; null beyond MOST and for less than a word."""

    def read(h: Column) -> Column:
        return F.when((F.length(h) == 64) & F.startswith(h, F.lit("0" * 56)), F.conv(F.right(h, F.lit(8)), 16, 10).cast("long"))

    return named(named(F.hex(word), read), lambda n: F.when(n <= MOST, n))


def unsigned(word: Column) -> Column:
    """A word as decimal text: decimals up to 120 bits. Beyond them each limb of 60 bits is multiplied by the groups of 18 digits of its place's power, and the sums of groups are carried on once."""
    whole = F.lit(_GROUP).cast("decimal(19,0)")

    def sums(limbs: Column) -> Column:
        each = lambda g: [F.get(limbs, F.lit(k)) * F.lit(16 ** (_PART * k) // _GROUP**g % _GROUP).cast("decimal(18,0)") for k in range(5)]
        return F.array(*[reduce(lambda a, b: a + b, each(g)).cast("decimal(38,0)") for g in range(5)])

    def step(s: Column, x: Column) -> Column:
        return named((x + s["carry"]).cast("decimal(38,0)"), lambda t: F.struct(F.call_function("div", t, whole).alias("carry"), F.concat(F.lpad((t % whole).cast("string"), 18, "0"), s["out"]).alias("out")))

    def read(h: Column) -> Column:
        few = (number(F.substr(h, F.lit(65 - 2 * _PART), F.lit(_PART))) * F.lit(16**_PART).cast("decimal(20,0)") + number(F.right(h, F.lit(_PART)))).cast("string")
        limbs = F.array(*[number(F.substr(h, F.lit(65 - _PART * k), F.lit(_PART))) for k in range(1, 5)], number(F.left(h, F.lit(64 - 4 * _PART))))
        begin = F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("out"))
        many = F.ltrim(F.aggregate(named(limbs, sums), begin, step)["out"], F.lit("0"))
        return F.when(F.startswith(h, F.lit("0" * (64 - 2 * _PART))), few).otherwise(many)

    return named(F.hex(word), read)


def address(word: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(F.hex(word), F.lit(40))))


def raw(data: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))


#: Kinds of values: the types of a signature that are read alike.
KINDS = {"address": "address", "bool": "bool", "string": "string", "bytes": "bytes", "bytes32": "word", "address[]": "address[]", "uint256[]": "uint[]"}


def kind(solidity: str) -> str:
    """The kind of a type; ValueError for one that isn't known."""
    if solidity in KINDS:
        return KINDS[solidity]
    if solidity.startswith("uint") and not solidity.endswith("]"):
        return "uint"
    raise ValueError(f"unknown type {solidity}")


def dynamic(solidity: str) -> bool:
    return kind(solidity) in ("string", "bytes", "address[]", "uint[]")


def _tail(data: Column, at: Column, each: int, read: Callable[[Column, Column], Column]) -> Column:
    """read(where the content begins, its length) of what is at a place; null if the data ends before."""

    def whole(p: Column) -> Column:
        return named(size(piece(data, p, WORD)), lambda n: F.when((p >= 0) & (p + WORD + each * n <= F.length(data)), read(p + WORD, n)))

    return named(at, whole)


def bytes_at(data: Column, at: Column) -> Column:
    """The bytes whose length is at a place; null if the data ends before."""
    return _tail(data, at, 1, lambda p, n: piece(data, p, n))


def words_at(data: Column, at: Column) -> Column:
    """The words of the array whose length is at a place; null if the data ends before."""
    return _tail(data, at, WORD, lambda p, n: F.transform(F.slice(F.sequence(F.lit(0), n.cast("int")), F.lit(1), n.cast("int")), lambda k: piece(data, p + WORD * k, WORD)))


def value(kind_: Column, word: Column, data: Column) -> Column:
    """The texts of a value whose head is a word; null if the word or what it points at isn't whole."""

    def one(w: Column) -> Column:
        return (
            F.when(kind_ == "address", address(w))
            .when(kind_ == "uint", unsigned(w))
            .when(kind_ == "bool", F.hex(w).rlike("[1-9A-F]").cast("string"))
            .when(kind_ == "word", raw(w))
        )

    def text(tail: Column) -> Column:
        return F.when(tail.isNotNull(), F.array(F.when(kind_ == "bytes", raw(tail)).otherwise(F.make_valid_utf8(tail.cast("string")))))

    def read(w: Column) -> Column:
        scalar = F.when(F.length(w) == WORD, F.array(one(w)))
        array = F.transform(words_at(data, size(w)), lambda x: F.when(kind_ == "uint[]", unsigned(x)).otherwise(address(x)))
        return F.when(kind_.isin("address", "uint", "bool", "word"), scalar).when(kind_.isin("bytes", "string"), named(bytes_at(data, size(w)), text)).otherwise(array)

    return named(word, read)


# writing


def written_number(x: Column | int) -> Column:
    """A number (long, decimal or its text, below 10^38) or hex text (0x...) as a word."""
    if isinstance(x, int):
        return F.lit(x.to_bytes(WORD, "big"))
    step, whole = F.lit(16**_PART).cast("decimal(38,0)"), F.lit(16**_PART).cast("decimal(19,0)")
    hexed = lambda n: F.lpad(F.conv((n % step).cast("decimal(20,0)").cast("string"), 10, 16), _PART, "0")
    rest = lambda n: F.floor((n - n % step) / whole).cast("decimal(38,0)")
    decimal = lambda n: named(rest(n), lambda m: F.concat(hexed(rest(m)), hexed(m), hexed(n)))
    short = lambda t: named(t.try_cast("long"), lambda n: F.when(n >= 0, F.hex(n)).otherwise(named(t.cast("decimal(38,0)"), decimal)))
    digits = lambda t: F.when(F.startswith(t, F.lit("0x")), F.substr(t, F.lit(3))).otherwise(short(t))
    return F.unhex(F.lpad(named(x.cast("string"), digits), 64, "0"))


def written_length(n: Column) -> Column:
    """A length or a place (int) as a word."""
    return F.unhex(F.lpad(F.hex(n), 2 * WORD, "0"))


def written_bytes(b: Column) -> Column:
    """The tail of bytes: their length, and they filled up to whole words."""
    return named(b, lambda x: F.concat(written_length(F.length(x)), x, F.unhex(F.repeat(F.lit("00"), F.pmod(-F.length(x), F.lit(WORD))))))


def written_value(solidity: str, x: Column | int) -> Column:
    """The word of a static value, or the tail of a dynamic one."""
    k = kind(solidity)
    if k == "bool":
        return written_number(x.cast("int"))
    if k in ("string", "bytes"):
        return written_bytes(x.cast("binary") if k == "string" else x)
    if k.endswith("[]"):
        return F.concat(written_length(F.size(x)), F.aggregate(F.transform(x, written_number), F.lit(b""), lambda a, w: F.concat(a, w)))
    return x if k == "word" else written_number(x)


def written_head_and_tail(values: list[tuple[str, Column | int]]) -> Column:
    """Values by type: heads in order, then the tails of the dynamic ones."""
    own = [k for k, (t, _) in enumerate(values) if dynamic(t)]

    def read(tails: Column) -> Column:
        heads, at = [], F.lit(WORD * len(values))
        for k, (solidity, x) in enumerate(values):
            heads.append(written_length(at) if k in own else written_value(solidity, x))
            at = at + F.length(F.get(tails, F.lit(own.index(k)))) if k in own else at
        return F.concat(F.lit(b""), *heads, *[F.get(tails, F.lit(k)) for k in range(len(own))])

    return named(F.array(*[written_value(*values[k]) for k in own]), read) if own else read(F.array())
