"""Expressions whose meaning differs between SQL dialects, fixed once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INT64_MAX = 9_223_372_036_854_775_807


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero; null for a zero divisor."""
    return F.when(b == 0, F.lit(None)).otherwise(F.try_divide(a - a % b, b).cast("long"))


def round_to_int(x: Column) -> Column:
    """Cast of a double to an integer that rounds half to even instead of truncating."""
    return F.bround(x, 0).cast("int")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def count_distinct_tuples(*cols: str) -> Column:
    """Distinct tuples, those with null members included."""
    return F.count_distinct(F.struct(*cols))


def floor_exact(x: Column) -> Column:
    """floor() of amounts of up to 38 digits, without saturating at the long range; null beyond."""
    out = F.floor(x).try_cast("decimal(38,0)")  # exact for decimals; for doubles a long, which stops at its ends
    return F.when(out.isin(INT64_MAX, -INT64_MAX - 1), x.try_cast("decimal(38,0)")).otherwise(out)


def clamp_long(x: Column) -> Column:
    """An integer text of any length as long, clamped at the largest long; null if it is no integer."""
    text = F.trim(x.cast("string"))
    digits = F.regexp_replace(text, r"^\+?0*", "")
    long_ = F.try_to_number(F.lpad(digits, 19, "0"), F.lit("9" * 19)).cast("decimal(19,0)")
    wide = (F.length(digits) > 19) | (long_ > F.lit(INT64_MAX))
    return F.when(~text.rlike(r"^[+-]?[0-9]+$"), None).when(text.startswith("-"), text.cast("decimal(38,0)").cast("long")).when(wide, F.lit(INT64_MAX)).otherwise(F.coalesce(long_, F.lit(0)).cast("long"))


def ordered(spec: list[tuple[str, str]]) -> list[Column]:
    """Sort columns with nulls last ascending and first descending, the ledger's convention; any direction but DESC is ascending."""
    return [F.col(c).desc_nulls_first() if d.upper() == "DESC" else F.col(c).asc_nulls_last() for c, d in spec]


def after(keys: list[str], values: list, descending: bool = False) -> Column:
    """Row-value comparison (keys) > (values), or < where descending, as a predicate that can be pushed down."""
    parts = []
    for i, (k, v) in enumerate(zip(keys, values, strict=True)):
        same = [F.col(a) == F.lit(b) for a, b in zip(keys[:i], values[:i], strict=True)]
        parts.append(reduce(lambda x, y: x & y, [*same, F.col(k) < F.lit(v) if descending else F.col(k) > F.lit(v)]))
    return reduce(lambda x, y: x | y, parts)


def running(partition: list[str], order: list[str]) -> Window:
    """Partition rows up to and with the current one; order must be unique within a partition."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
