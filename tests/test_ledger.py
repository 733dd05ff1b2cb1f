"""Domain arithmetic and identifiers against plain Python and published values."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import compat, ledger

# Golden values of 10^24 after days of decay in 64.64 fixed point.
GOLDEN = {1: 999801332008598957440219, 365: 930046196044190274631463, 1461: 748052010000000010487078}


def one(spark, column, **values):
    kinds = {int: "long", str: "string", float: "double", bytes: "binary", Decimal: "decimal(38,18)"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("days", GOLDEN)
def test_exact_decay(spark, days):
    assert one(spark, ledger.exact_decay()(F.col("v"), F.col("d")), v=str(10**24), d=days) == str(GOLDEN[days])
    back = int(one(spark, ledger.exact_decay(inverse=True)(F.col("v"), F.col("d")), v=str(GOLDEN[days]), d=days))
    assert abs(back - 10**24) < 10**24 // 10**12
    near = one(spark, ledger.decayed(F.col("v"), F.col("d")), v=1e24, d=days)
    assert abs(near / GOLDEN[days] - 1) < 1e-12


def test_exact_decay_of_nulls_and_long_numbers(spark):
    rows = spark.createDataFrame([("7" * 70, 0), (None, 1), ("5", None)], "v string, d long")
    assert [r[0] for r in rows.select(ledger.exact_decay()("v", "d")).collect()] == ["7" * 70, None, None]


def test_days(spark):
    for ts, day in ((0, 0), (1_602_719_999, 0), (1_602_720_000, 0), (1_602_806_399, 0), (1_602_806_400, 1)):
        assert one(spark, ledger.day_index(F.col("t")), t=ts) == day


def test_whole_and_atto_units(spark):
    for atto in (0, 1, -1, 10**18, 123456789 * 10**12 + 7, 10**37, -(10**37)):
        whole = one(spark, ledger.whole_units(F.col("v").cast("decimal(38,0)")), v=str(atto))
        assert whole == Decimal(atto).scaleb(-18)
        assert int(one(spark, ledger.atto_units(F.col("w")), w=whole)) == atto
    assert one(spark, ledger.truncated(F.col("v").cast("decimal(38,0)")), v=str(3 * 10**12 + 999)) == 3
    assert one(spark, ledger.truncated(F.col("v").cast("decimal(38,0)")), v="9" * 37) == 2**63 - 1


def test_inflated_is_linear_within_a_year(spark):
    start = ledger.EPOCH
    got = [one(spark, ledger.inflated(F.col("v"), F.col("t")), v=1e6, t=start + s) for s in (0, ledger.YEAR // 2, ledger.YEAR)]
    assert got[0] == pytest.approx(3e6) and got[2] == pytest.approx(3e6 / 1.07) and got[0] > got[1] > got[2]
    assert got[1] == pytest.approx(3e6 / 1.035, rel=1e-9)


def test_identifiers(spark):
    address = "0x" + "ab12" * 10
    number = str(int(address, 16))
    assert one(spark, ledger.token_id(F.col("a")), a=address) == number and one(spark, ledger.token_address(F.col("n")), n=number) == address
    assert one(spark, ledger.address(F.col("a")), a=f" {address.upper().replace('0X', '0x')} ") == address
    assert one(spark, ledger.address(F.col("a")), a="0x12") is None
    assert one(spark, ledger.hex_text(F.col("b")), b=bytes([0, 255])) == "0x00ff"
    assert one(spark, ledger.content_id(F.col("b")), b=bytes(32)) == one(spark, ledger.base58(F.col("b")), b=bytes([0x12, 0x20]) + bytes(32))
    assert one(spark, ledger.base58(F.col("b")), b=b"\0\0hello") == "11Cn8eVZg"


def test_words(spark):
    data = f"{5:064x}" + f"{2**200:064x}" + "0" * 24 + "cd" * 20
    assert one(spark, ledger.word_long(F.col("d"), 0), d=data) == 5
    assert one(spark, ledger.word_long(F.col("d"), 1), d=data) == 2**63 - 1
    assert one(spark, ledger.word_address(F.col("d"), 2), d=data) == "0x" + "cd" * 20


def test_rounding_and_clamps(spark):
    for x, r in ((0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0), (-1.5, -2)):
        assert one(spark, compat.round_to_int(F.col("x")), x=x) == r
    for a, b in ((7, 2), (-7, 2), (7, -2), (6, 3)):
        assert one(spark, compat.int_div(F.col("a"), F.col("b")), a=a, b=b) == int(a / b)
    assert one(spark, compat.int_div(F.col("a"), F.col("b")), a=1, b=0) is None
    rng = random.Random(1)
    for text in ("0", "12", "-5", "9" * 19, str(2**63 - 1), str(2**63), "9" * 60, "0" * 30 + "7", *(str(rng.getrandbits(80)) for _ in range(5))):
        assert one(spark, compat.clamp_long(F.col("t")), t=text) == min(int(text), 2**63 - 1)
    assert one(spark, compat.clamp_long(F.col("t")), t="1e5") is None
    for x in ("-2.5", "2.5", "9" * 19 + ".25", "-" + "9" * 19 + ".75"):
        assert int(one(spark, compat.floor_exact(F.col("x").cast("decimal(38,18)")), x=x)) == int(Decimal(x).to_integral_value("ROUND_FLOOR"))
    assert int(one(spark, compat.floor_exact(F.col("x")), x=1e30)) == 10**30


def test_prefix_match(spark):
    for text, query, fits in (("Café au lait", "caf la", True), ("Café au lait", "afe", False), (None, "a", False), ("a", "", False), ("A1-b2", "b", True)):
        row = spark.createDataFrame([(text,)], "t string")
        assert row.select(ledger.prefix_match(F.col("t"), query)).first()[0] is fits
