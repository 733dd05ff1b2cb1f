"""Keccak against published digests, contract data written and read back, broken data, and nested calls."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import abi, keccak
from ledgerloom.sources import logs
from ledgerloom.sources.logs import Event

# Published digests and topics.
DIGESTS = {
    b"": "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470",
    b"abc": "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45",
    b"Transfer(address,address,uint256)": "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
    b"TransferSingle(address,address,address,uint256,uint256)": "c3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62",
    b"TransferBatch(address,address,address,uint256[],uint256[])": "4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb",
    b"ApprovalForAll(address,address,bool)": "17307eab39ab6107e8899845ad3d59bd9653f200f220920489ca2b5937696c31",
}
SINGLE = Event("L", "event TransferSingle(address indexed operator, address indexed from, address indexed to, uint256 id, uint256 value)")
BATCH = Event("L", "event TransferBatch(address indexed operator, address indexed from, address indexed to, uint256[] ids, uint256[] values)", batch=True)
GROUP = Event("L", "event RegisterGroup(address indexed group, address indexed mint, address indexed treasury, string indexed name, string indexed symbol)")
DATA = Event("L", "event Locked(address indexed group, uint256 indexed id, uint256 value, bytes userData)")
FLAG = Event("L", "event Flag(address indexed avatar, bytes32 flag, bool on, uint16 k)")
MANY = Event("L", "event Offer(address indexed offer, address[] accepted, uint256 limit)")
HEADER = "block_number long, timestamp long, transaction_index long, log_index long, transaction_hash string"
A, B, C = ("0x" + x * 40 for x in "abc")


def test_digests():
    assert [d.hex() for d in keccak.digests(list(DIGESTS))] == list(DIGESTS.values())
    assert keccak.digests([]) == []
    rng = random.Random(1)
    long = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 135, 136, 137, 271, 272, 1000)]
    assert keccak.digests(long) == [keccak.digests([m])[0] for m in long]


def test_digests_of_a_column(spark):
    rows = spark.createDataFrame([(m,) for m in [*DIGESTS, None]], "m binary").select("m", keccak.keccak256("m").alias("d")).collect()
    assert {None if r.m is None else bytes(r.m): r.d and bytes(r.d).hex() for r in rows} == {**DIGESTS, None: None}


def test_topics():
    assert SINGLE.topic.hex() == DIGESTS[b"TransferSingle(address,address,address,uint256,uint256)"]
    assert BATCH.topic.hex() == DIGESTS[b"TransferBatch(address,address,address,uint256[],uint256[])"]
    assert Event("L", "ApprovalForAll(address indexed account,address indexed operator,bool approved)").topic.hex() == DIGESTS[b"ApprovalForAll(address,address,bool)"]


def word(x):
    return (int(x, 16) if isinstance(x, str) else x).to_bytes(32, "big")


def tail(b):
    return word(len(b)) + b + b"\0" * (-len(b) % 32)


@pytest.fixture(scope="module")
def of(spark):
    def make(*rows):
        return spark.createDataFrame([(1, 5, 0, k, "h", "0xe", [None if t is None else bytearray(t) for t in topics], bytearray(data)) for k, (topics, data) in enumerate(rows)], f"{HEADER}, emitter string, topics array<binary>, data binary")

    return make


def test_numbers_of_all_sizes(spark):
    numbers = [0, 1, 9, 2**32 - 1, 2**60, 2**64 - 1, 10**18, 2**120 - 1, 2**120, 2**128 - 1, 10**38, 2**160 - 1, 10**50, 10**77, 2**256 - 1, 1000000000, 5 * 10**27]
    rows = spark.createDataFrame([(str(n), bytearray(word(n))) for n in numbers], "n string, w binary").select("n", abi.unsigned(F.col("w")).alias("got"), abi.size(F.col("w")).alias("size")).collect()
    assert all(r.got == r.n and r.size == (int(r.n) if int(r.n) <= abi.MOST else None) for r in rows)
    small = [n for n in numbers if n < 10**38]
    back = spark.createDataFrame([(str(n),) for n in small], "n string").select("n", abi.written_number(F.col("n").cast("decimal(38,0)")).alias("w")).collect()
    assert all(bytes(r.w) == word(int(r.n)) for r in back)


def test_logs_come_back(spark, of):
    """Written by hand: every kind of value, numbers of 78 digits, broken UTF-8, unknown topics."""
    big = 2**256 - 1
    rows = of(
        ([SINGLE.topic, word(A), word(B), word(C)], word(B) + word(big)),
        ([BATCH.topic, word(A), word(B), word(C)], word(64) + word(160) + word(2) + word(7) + word(8) + word(2) + word(70) + word(big)),
        ([GROUP.topic, word(A), word(B), word(C)], word(64) + word(128) + tail("Grüße".encode()) + tail(b"\xff!")),
        ([DATA.topic, word(A), word(11)], word(5) + word(64) + tail(b"\x01\x02\x03")),
        ([FLAG.topic, word(A)], word(9) + word(1) + word(77)),
        ([MANY.topic, word(A)], word(64) + word(3) + word(2) + word(B) + word(C)),
        ([b"\x01" * 32], b""), ([], b""), ([BATCH.topic, word(A), word(B), word(C)], word(64) + word(96) + word(0) + word(0)),
    )
    got = logs.decoded(rows, [SINGLE, BATCH, GROUP, DATA, FLAG, MANY])
    assert {r.log_index: r.values for r in got.collect()} == {
        0: [[A], [B], [C], [str(int(B, 16))], [str(big)]], 1: [[A], [B], [C], ["7", "8"], ["70", str(big)]], 2: [[A], [B], [C], ["Grüße"], ["�!"]], 3: [[A], ["11"], ["5"], ["0x010203"]],
        4: [[A], ["0x" + "0" * 63 + "9"], ["true"], ["77"]], 5: [[A], [B, C], ["3"]], 8: [[A], [B], [C], [], []],
    }
    one = logs.typed(got, SINGLE).collect()
    assert [(r.operator, r.value, r.wide) for r in one] == [(A, None, {"id": str(int(B, 16)), "value": str(big)})]
    batch = logs.typed(got, BATCH).orderBy("batch_index").collect()
    assert [(r.batch_index, r.ids, r["values"], r.wide) for r in batch] == [(0, 7, 70, None), (1, 8, None, {"values": str(big)})]
    assert [(r.value, bytes(r.userData)) for r in logs.typed(got, DATA).collect()] == [(5, b"\x01\x02\x03")]
    assert [(r.on, r.k, bytes(r.flag)) for r in logs.typed(got, FLAG).collect()] == [(True, 77, word(9))]
    assert [(r.accepted, r.limit) for r in logs.typed(got, MANY).collect()] == [(f'["{B}","{C}"]', 3)]
    assert [c for c, _ in SINGLE.table.columns] == logs.typed(got, SINGLE).columns[:-1]


def test_broken_logs(of):
    """Each names the field it ends in and goes to a table of its own."""
    whole = [BATCH.topic, word(A), word(B), word(C)]
    rows = of(
        (whole[:3], word(64) + word(96) + word(0) + word(0)), (whole, word(64)), (whole, word(2**255) + word(64) + word(0)), (whole, word(64) + word(96) + word(9) + word(0)), (whole, word(64) + word(128) + word(1) + word(5) + word(0)),
        ([DATA.topic, word(A), word(1)], word(5) + word(64) + word(33) + b"\1" * 32), ([DATA.topic, word(A), word(1)], word(5) + word(2**31)), ([DATA.topic, word(A), b"\1"], word(5) + word(64) + word(0)), ([GROUP.topic, word(A), word(B), word(C)], word(64) + word(4096) + tail(b"x")), ([SINGLE.topic, None, word(B), word(C)], word(1) * 2),
    )
    got = logs.decoded(rows, [SINGLE, BATCH, GROUP, DATA])
    assert {r.log_index: (r.broken, r.values) for r in got.collect()} == {0: ("to", None), 1: ("ids", None), 2: ("ids", None), 3: ("ids", None), 4: ("lengths", None), 5: ("userData", None), 6: ("userData", None), 7: ("id", None), 8: ("symbol", None), 9: ("operator", None)}
    assert logs.typed(got, BATCH).count() == 0


def test_emitters_tell_events_apart(of):
    """Two modules declare one signature."""
    own, other = (Event(n, "CreateVault(address indexed group, address indexed vault)", emitter=e) for n, e in (("X", "0xe"), ("Y", "0xf")))
    got = logs.decoded(of(([own.topic, word(A), word(B)], b"")), [own, other]).collect()
    assert [r.event for r in got] == ["X_CreateVault"]


def test_written_logs_come_back(spark, tmp_path):
    head = [(k, k * 5, k % 3, k, f"h{k}") for k in range(40)]
    single = spark.createDataFrame([(*h, A, B, C, f"0x{h[0]:040x}", Decimal(10**19 + h[0])) for h in head], f"{HEADER}, operator string, `from` string, `to` string, id string, value decimal(38,0)")
    batch = spark.createDataFrame([(*h, A, B, C, list(range(h[0] % 4)), [7 * k for k in range(h[0] % 4)]) for h in head], f"{HEADER}, operator string, `from` string, `to` string, ids array<long>, values array<long>")
    group = spark.createDataFrame([(*h, A, B, C, "é" * h[0], "s" * (h[0] % 33)) for h in head], f"{HEADER}, group string, mint string, treasury string, name string, symbol string")
    both = logs.encoded(single, SINGLE).union(logs.encoded(batch, BATCH)).union(logs.encoded(group, GROUP))
    logs.split(both, [SINGLE, BATCH, GROUP], str(tmp_path / "events"))
    read = lambda e: logs.stored(spark, str(tmp_path / "events"), e).drop("emitter", "wide")
    assert sorted(map(tuple, read(SINGLE).withColumn("id", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("id").cast("long"))), 40, "0"))).collect())) == sorted(map(tuple, single.collect()))
    assert sorted((r.block_number, r.batch_index, r.ids, r["values"]) for r in read(BATCH).collect()) == sorted((h[0], k, k, 7 * k) for h in head for k in range(h[0] % 4))
    assert sorted(map(tuple, read(GROUP).collect())) == sorted(map(tuple, group.collect()))


# nested calls


def head_and_tail(*values):
    heads, tails = b"", b""
    for v in values:
        if isinstance(v, bytes):
            heads += word(32 * len(values) + len(tails))
            tails += tail(v)
        else:
            heads += word(v)
    return heads + tails


def transfer(a, b, data):
    return bytes.fromhex("f242432a") + head_and_tail(a, b, 1, 2, data)


def batch_transfer(a, b, data):
    return bytes.fromhex("2eb2c2d6") + word(a) + word(b) + word(160) + word(192) + word(224) + word(0) + word(0) + tail(data)


def exec_(call):
    return bytes.fromhex("6a761202") + head_and_tail(A, 0, call, *[0] * 7)


def user_op(call):
    return bytes.fromhex("541d63c8") + head_and_tail(A, 0, call, 0)


def multi(*own, extra=b""):
    return bytes.fromhex("8d80ff0a") + head_and_tail(b"".join(b"\0" + b"\1" * 20 + word(0) + word(len(c)) + c for c in own) + extra)


def handle(*own, n=None):
    structs = [head_and_tail(A, 0, b"", c, 0, 0, 0, b"", b"") for c in own]
    at, places = 32 * len(own), []
    for s in structs:
        places.append(at)
        at += len(s)
    return bytes.fromhex("765e827f") + word(64) + word(0) + word(len(own) if n is None else n) + b"".join(map(word, places)) + b"".join(structs)


def flow(vertices, edges, *streams):
    """streams: (source, first edge, data)"""
    packed = b"".join(b"\0\0" + a.to_bytes(2, "big") + b.to_bytes(2, "big") for a, b in edges)
    v = word(len(vertices)) + b"".join(map(word, vertices))
    own = [word(s) + word(96) + word(96 + 32 + 32 * len(e)) + word(len(e)) + b"".join(map(word, e)) + tail(d) for s, e, d in streams]
    at, places = 32 * len(own), []
    for x in own:
        places.append(at)
        at += len(x)
    s = word(len(own)) + b"".join(map(word, places)) + b"".join(own)
    return bytes.fromhex("0d22d9b5") + word(128) + word(128 + len(v)) + word(160 + len(v)) + word(160 + len(v) + len(s)) + v + word(0) + s + tail(packed)


def test_nested_calls(spark):
    from ledgerloom.sources import calls

    one, two, deep = transfer(A, B, b"x"), batch_transfer(B, C, b"yy" * 40), transfer(A, B, b"z")
    for _ in range(5):
        deep = exec_(deep)
    cut = multi(one, two)
    given = {
        "plain": (one, [(A, B, b"x")]), "batch": (two, [(B, C, b"yy" * 40)]), "no data": (transfer(A, B, b""), []), "none": (None, []), "short": (b"\xf2", []), "unknown": (b"\1\2\3\4" + one, []),
        "exec": (exec_(one), [(A, B, b"x")]), "user": (user_op(two), [(B, C, b"yy" * 40)]), "many": (multi(one, b"", two, one), [(A, B, b"x"), (B, C, b"yy" * 40), (A, B, b"x")]),
        "all": (handle(exec_(multi(one, user_op(two))), b"", exec_(one)), [(A, B, b"x"), (B, C, b"yy" * 40), (A, B, b"x")]), "deep": (deep, [(A, B, b"z")]), "too deep": (exec_(deep), []), "in itself": (exec_(exec_(exec_(b"\x6a\x76\x12\x02" * 90))), []),
        "cut off": (exec_(one)[:-40], []), "packed cut": (cut[:4] + word(32) + word(200) + cut[68:], []), "packed rest": (multi(one, extra=b"\0" * 84), [(A, B, b"x")]), "packed length": (multi(one, extra=b"\0" * 53 + word(2**200) + b"\0" * 9), [(A, B, b"x")]),
        "operations": (handle(one, n=101), []), "operations missing": (handle(one, n=0), []), "far offset": (one[:132] + word(2**40) + one[164:], []),
        "flow": (flow([A, B, C], [(0, 1), (1, 2)], (0, [1], b"q"), (2, [0, 1], b"r"), (1, [], b"s"), (0, [0], b""), (9, [0], b"t"), (0, [7], b"u")), [(A, C, b"q"), (C, B, b"r")]), "flow in many": (multi(flow([A, B], [(0, 1)], (0, [0], b"v"))), [(A, B, b"v")]), "flow short": (flow([A], [])[:120], []),
    }
    rows = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, (c, _) in given.items()], "k string, input binary")
    got = {k: [] for k in given}
    for r in calls.transfer_data(rows).orderBy("k", "place").collect():
        got[r.k].append((r.from_, r.to_, bytes(r.data)))
    assert got == {k: want for k, (_, want) in given.items()}
    assert calls.transfer_data(rows.limit(0)).collect() == []


def test_wide_numbers_are_carried_once(spark):
    """one pass over a number's groups, for any number of 256 bits."""
    assert abi.unsigned(F.col("w"))._jc.toString().count("aggregate(") == 1
    numbers = [0, 2**120 - 1, 2**120, 10**36, 10**72, 10**77, 2**160 - 1, 2**256 - 1, *[(7**k) % 2**256 for k in range(40, 140)]]
    rows = spark.createDataFrame([(str(n), bytearray(n.to_bytes(32, "big"))) for n in numbers], "n string, w binary")
    assert rows.where(abi.unsigned(F.col("w")) != F.col("n")).count() == 0
