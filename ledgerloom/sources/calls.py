"""What a transaction's call data holds: nested wrapper calls opened level by level, and the transfers inside with their data.

All calls of a transaction are one array, whose wrappers are replaced by what
they wrap, once a level; one scan and one explode, whatever the depth. What a
call wraps is a part of it, so nesting ends by itself, and after LEVELS anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.abi import WORD, address, bytes_at, named, number, piece, size, words_at

# Selectors of wrappers and of calls that move tokens.
HANDLE_OPS, EXEC, MULTI_SEND, USER_OP = "765E827F", "6A761202", "8D80FF0A", "541D63C8"
WRAPPERS = (HANDLE_OPS, EXEC, MULTI_SEND, USER_OP)
TRANSFER, BATCH_TRANSFER, FLOW_MATRIX = "F242432A", "2EB2C2D6", "0D22D9B5"
# Levels below the first that are opened, operations and packed calls that are taken, bytes before a packed call's data.
LEVELS, OPERATIONS, PACKED, PACKED_HEAD = 5, 100, 1000, 85

_CALLS = "array<binary>"


def _word(data: Column, at: Column | int) -> Column:
    return piece(data, F.lit(at) if isinstance(at, int) else at, WORD)


def _range(n: Column) -> Column:
    """0 to n - 1."""
    return F.slice(F.sequence(F.lit(0), n.cast("int")), F.lit(1), n.cast("int"))


def _filled(calls: Column) -> Column:
    return F.filter(calls, lambda c: c.isNotNull() & (F.length(c) > 0))


def _operations(p: Column) -> Column:
    """The calls of an array of operations; none if one's place is broken, operations whose call is broken are left out."""

    def call(struct: Column) -> Column:
        return named(size(_word(p, struct + 96)), lambda at: F.when(struct + 128 <= F.length(p), bytes_at(p, struct + at)))

    def each(first: Column) -> Column:
        n = size(_word(p, first - WORD))
        inside = F.least(n, F.floor((F.length(p) - first) / WORD))
        places = F.transform(F.when(n <= OPERATIONS, _range(inside)), lambda k: size(_word(p, first + WORD * k)))
        return named(places, lambda xs: F.when(~F.exists(xs, lambda x: x.isNull()), F.transform(xs, lambda x: call(first + x))))

    return named(size(_word(p, 0)) + WORD, lambda first: F.when(first <= F.length(p), each(first)))


def _packed(p: Column) -> Column:
    """The calls of packed bytes, one behind the other, up to the first whose length can't be."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_CALLS).alias("out"))

    def read(b: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            n = F.when(s["at"] + PACKED_HEAD <= F.length(b), size(_word(b, s["at"] + PACKED_HEAD - WORD)))
            fits = named(n, lambda n: F.when(s["at"] + PACKED_HEAD + n <= F.length(b), n))
            return named(fits, lambda n: F.struct(F.coalesce(s["at"] + PACKED_HEAD + n, F.length(b).cast("long")).alias("at"), F.concat(s["out"], F.when(n > 0, F.array(piece(b, s["at"] + PACKED_HEAD, n))).otherwise(F.array().cast(_CALLS))).alias("out")))

        return F.aggregate(_range(F.least(F.lit(PACKED), F.floor(F.length(b) / PACKED_HEAD))), begin, step)["out"]

    return named(bytes_at(p, size(_word(p, 0))), read)


def opened(call: Column) -> Column:
    """The calls that a call wraps, empty for broken data; the call alone if it is no wrapper."""

    def read(head: Column) -> Column:
        p, n = piece(call, F.lit(4), F.length(call)), F.length(call)
        third = F.array(bytes_at(p, size(_word(p, 64))))
        inner = F.when((head == HANDLE_OPS) & (n >= 68), _operations(p)).when((head == EXEC) & (n >= 324), third).when((head == USER_OP) & (n >= 132), third).when((head == MULTI_SEND) & (n >= 36), _packed(p))
        return F.when(head.isin(*WRAPPERS), F.coalesce(_filled(inner), F.array().cast(_CALLS))).otherwise(F.array(call))

    return named(F.hex(piece(call, F.lit(0), 4)), read)


_MOVES = "array<struct<from_: string, to_: string, data: binary>>"


def _stream(p: Column, at: Column, vertices: Column, packed: Column) -> Column:
    """(from_, to_, data) of a stream: its source vertex, and the receiver of its first edge; null if a part is missing or there is no data."""
    source = number(F.right(F.hex(_word(p, at)), F.lit(4))).cast("int")
    edges, data = words_at(p, at + size(_word(p, at + 32))), bytes_at(p, at + size(_word(p, at + 64)))
    edge = size(F.get(edges, F.lit(0))) * 6
    to = number(F.hex(F.when(edge + 6 <= F.length(packed), piece(packed, edge + 4, 2)))).cast("int")
    out = F.struct(F.get(vertices, source).alias("from_"), F.get(vertices, to).alias("to_"), data.alias("data"))
    return F.when(at + 96 <= F.length(p), out)


def moves(call: Column) -> Column:
    """The transfers of a call that carry data: array of (from_, to_, data)."""

    def read(head: Column) -> Column:
        p, n = piece(call, F.lit(4), F.length(call)), F.length(call)
        single = F.array(F.struct(address(_word(p, 0)).alias("from_"), address(_word(p, 32)).alias("to_"), bytes_at(p, size(_word(p, 128))).alias("data")))

        def streams(first: Column) -> Column:
            vertices, packed = F.transform(words_at(p, size(_word(p, 0))), address), bytes_at(p, size(_word(p, 96)))
            count = F.least(size(_word(p, first - WORD)), F.floor((F.length(p) - first) / WORD))
            each = lambda v: named(packed, lambda q: F.transform(_range(count), lambda k: _stream(p, first + size(_word(p, first + WORD * k)), v, q)))
            return named(vertices, each)

        matrix = named(size(_word(p, 64)) + WORD, lambda first: F.when(first <= F.length(p), streams(first)))
        found = F.when(head.isin(TRANSFER, BATCH_TRANSFER) & (n >= 164), single).when((head == FLOW_MATRIX) & (n >= 132), matrix)
        return F.coalesce(F.filter(found, lambda m: m["from_"].isNotNull() & m["to_"].isNotNull() & (F.length(m["data"]) > 0)), F.array().cast(_MOVES))

    return named(F.hex(piece(call, F.lit(0), 4)), read)


def transfer_data(transactions: DataFrame, input_col: str = "input") -> DataFrame:
    """Every transfer with data in the transactions' call data, however it is wrapped: their columns, then place (from 0 within a transaction), from_, to_, data.

    Null, short, unknown and broken calls give no rows; of a wrapper's calls those
    before broken packed data stay. Wrappers deeper than LEVELS are not opened.
    """
    df = transactions.withColumn("_calls", F.array(input_col))
    for _ in range(LEVELS):
        df = df.withColumn("_calls", F.flatten(F.transform("_calls", opened)))
    df = df.withColumn("_moves", F.flatten(F.transform("_calls", moves)))
    # of an inner explode Spark infers that its array has elements, and reads all calls twice more to test that
    rows = df.select(*transactions.columns, F.posexplode_outer("_moves").alias("place", "_m")).where("place is not null")
    return rows.select(*transactions.columns, "place", "_m.from_", "_m.to_", "_m.data")
