"""Domain arithmetic: days, decaying values, unit conversion, identifiers."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The ledger's epoch, the seconds of a day and of a year, and the yearly decay and growth.
EPOCH = 1_602_720_000
DAY = 86_400
YEAR = 31_556_952
DECAY_A_YEAR = 0.93
DAYS_A_YEAR = 365.25
GROWTH = 107
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

# A day's decay and growth as 64.64 fixed-point numbers.
DECAY_64 = 18_443_079_296_116_538_654
GROWTH_64 = 18_450_409_579_521_241_655

GAMMA = DECAY_A_YEAR ** (1 / DAYS_A_YEAR)


def day_index(ts: Column) -> Column:
    """Whole days since the epoch, 0 before it."""
    return F.greatest(F.expr("0L"), F.floor((ts.cast("long") - F.lit(EPOCH)) / F.lit(DAY)).cast("long"))


def decayed(value: Column, days: Column) -> Column:
    """The value after days of decay, in double arithmetic (about 15 digits): inside codegen, for reports."""
    return value.cast("double") * F.pow(F.lit(GAMMA), days.cast("double"))


def _factor(days: int, inverse: bool) -> int:
    """A day's decay, or growth, to the power of days as a 64.64 fixed-point number: squared with 127 bits behind the point, each product rounded half up."""
    half, one = 1 << 126, 1 << 127
    base, out = (GROWTH_64 if inverse else DECAY_64) << 63, one
    while days:
        if days & 1:
            out = (out * base + half) >> 127
        base = (base * base + half) >> 127
        days >>= 1
    return out >> 63


def exact_decay(inverse: bool = False):
    """A pandas UDF (integer text, days) -> integer text in 64.64 fixed point, whatever the number of digits. Factors are computed once for each distinct day of a batch."""

    @F.pandas_udf(StringType())
    def run(value: pd.Series, days: pd.Series) -> pd.Series:
        factors = {d: _factor(int(d), inverse) for d in days.dropna().unique()}
        return pd.Series([None if v is None or pd.isna(d) else str(int(v) * factors[d] >> 64) for v, d in zip(value, days, strict=True)])

    return run


def inflated(value: Column, ts: Column) -> Column:
    """A version-1 amount in version-2 units: linear between the yearly growth factors."""
    elapsed = ts.cast("long") - F.lit(EPOCH)
    year = F.floor(elapsed / YEAR)
    into = elapsed - year * YEAR
    f0, f1 = (F.floor(1e8 * F.pow(F.lit(GROWTH / 100), year + k)) for k in (0, 1))
    return value.cast("double") * 3 * 1e8 * YEAR / (f0 * (YEAR - into) + f1 * into)


def truncated(atto: Column) -> Column:
    """Atto units cut to six decimals as a long, clamped at the largest long."""
    cut = F.floor(atto.cast("decimal(38,0)") / F.lit(10**12).cast("decimal(13,0)"))
    return F.least(cut.cast("decimal(38,0)"), F.lit(9_223_372_036_854_775_807).cast("decimal(38,0)")).cast("long")


def whole_units(atto: Column) -> Column:
    """Atto units as whole ones, exact: a decimal(38,18), null beyond 20 digits before the point."""
    digits = F.lpad(F.abs(atto.cast("decimal(38,0)")).cast("string"), 38, "0")
    text = F.concat(F.left(digits, F.lit(20)), F.lit("."), F.right(digits, F.lit(18)))
    out = text.try_cast("decimal(38,18)")
    return F.when(atto.cast("decimal(38,0)") < 0, -out).otherwise(out)


def atto_units(whole: Column) -> Column:
    """Whole units as atto ones, what is beyond 18 decimals cut off."""
    return F.replace(whole.cast("decimal(38,18)").cast("string"), F.lit("."), F.lit("")).cast("decimal(38,0)")


def address(text: Column) -> Column:
    """A lower-cased address, null if it is none."""
    low = F.lower(F.trim(text))
    return F.when(low.rlike("^0x[0-9a-f]{40}$"), low)


def hex_text(raw: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(raw)))


@F.pandas_udf(StringType())
def base58(raw: pd.Series) -> pd.Series:
    """Base 58 of a binary column."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        n, out = int.from_bytes(b, "big"), ""
        while n:
            n, k = divmod(n, 58)
            out = ALPHABET[k] + out
        return "1" * (len(b) - len(b.lstrip(b"\0"))) + out

    return raw.map(one)


def content_id(digest: Column) -> Column:
    """The content identifier (version 0) of a 32-byte digest."""
    return base58(F.concat(F.unhex(F.lit("1220")), digest))


@F.pandas_udf(StringType())
def token_address(number: pd.Series) -> pd.Series:
    """The address that a decimal token id stands for."""
    return number.map(lambda x: None if x is None else f"0x{int(x):040x}")


@F.pandas_udf(StringType())
def token_id(addr: pd.Series) -> pd.Series:
    return addr.map(lambda x: None if x is None else str(int(x, 16)))


def word(data: Column, k: int) -> Column:
    """The k-th 32-byte word of hex call data (no 0x), as 64 hex digits."""
    return F.substr(data, F.lit(64 * k + 1), F.lit(64))


def word_address(data: Column, k: int) -> Column:
    return F.concat(F.lit("0x"), F.right(word(data, k), F.lit(40)))


def word_long(data: Column, k: int) -> Column:
    """A word as long, clamped at the largest long."""
    w = word(data, k)
    small = F.left(w, F.lit(48)).rlike("^0*$") & (F.conv(F.right(w, F.lit(16)), 16, 10).cast("decimal(20,0)") <= F.lit(9_223_372_036_854_775_807))
    return F.when(small, F.conv(F.right(w, F.lit(16)), 16, 10).cast("decimal(20,0)").cast("long")).otherwise(F.lit(9_223_372_036_854_775_807))


def tokens(text: Column) -> Column:
    """Lower-cased search tokens."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def prefix_match(text: Column, query: str) -> Column:
    """Every query token is a prefix of some token of the text."""
    own, wanted = tokens(text), query.lower().split()

    def has(token: str) -> Column:
        return F.exists(own, lambda x: F.startswith(x, F.lit(token)))

    return reduce(lambda a, t: a & has(t), wanted, F.lit(bool(wanted)))
