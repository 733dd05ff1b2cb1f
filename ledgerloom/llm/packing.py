"""Tokenised documents packed into sequences by bin completion.

Bin completion (Korf 2002, after Martello and Toth) takes the largest piece
that is left, enumerates undominated fillings of the room beside it, of any
number of pieces, and branches on them, fullest first. A branch is cut once its
waste exceeds what an improvement of the incumbent allows; the first incumbent
comes from best fit decreasing, and a packing that meets the lower bound ends
the search. A shard is searched as a whole first, mostly a dive; what is then
above the bound is searched in sets of the sequences that waste most.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import fresh, written
from ledgerloom.llm.textops import Slice, lean, slices

CAPACITY = 1024
TOKENIZER = "byte_bpe_50k.json"
END = 2
SHARD = 20_000  # pieces packed together; a shard wastes at most its last sequences
NODES = 1  # search nodes for each sequence of a shard, and EXTRA more: a dive, and returns at its end
EXTRA = 500
SETS, SET_PIECES, SET_NODES = 16, 200, 800  # sets of wasteful sequences searched again, their pieces and nodes
WIDTH = 12  # lengths that a filling, and its end of three pieces, is tried with as the largest
BRANCHES = 4  # fillings that a node branches on, the fullest
TEXTS = 2 << 20  # bytes of text encoded together
PART = 256  # bytes of distinct chunks joined for the tokenizer


def _white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``at`` may be white space. Too often yes does no harm: less is cut."""
    last, second, third = data[at], data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    plain = (last == 32) | ((last >= 9) & (last <= 13)) | ((last >= 28) & (last <= 31))
    two = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    general = (third == 0xE2) & (second == 0x80) & ((last <= 0x8F) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    others = ((third == 0xE2) & (second == 0x81) & (last == 0x9F)) | ((third == 0xE3) & (second == 0x80) & (last == 0x80)) | ((third == 0xE1) & ((second == 0x9A) | (second == 0xA0)))
    return plain | two | general | others


def _letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``at`` is a letter of ASCII or Latin-1. Too often no does no harm: less is cut."""
    last, second = data[at], data[np.maximum(at - 1, 0)]
    return ((last | 32) >= 97) & ((last | 32) <= 122) & (last < 128) | (second == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)


_MARK = np.array([k < 128 and k != 32 and not chr(k).isalpha() for k in range(256)])


class Encoder:
    """Ids of many texts at once.

    A pre-token of byte-level BPE never goes on over a space that follows
    something else than white space, nor from a letter to another ASCII
    character, and BPE never crosses a pre-token. So texts are cut there, each
    distinct chunk is encoded once a slice, and the ids are gathered by the
    chunks' places. Distinct chunks that may follow each other without a new
    pre-token across them are joined again for the tokenizer; the ids' byte
    lengths tell where each chunk ends.
    """

    def __init__(self, path: str | None):
        import json

        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.sizes[k] = len(token)  # a character for each byte

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, end to end, and how many each text has."""
        if not self.by_chunk:
            raw = s.data.tobytes()
            found = self.whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)])
            return _joined(found), np.fromiter(map(len, found), np.int64, len(found))
        data, offsets, n = s.data, s.offsets, len(s.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(s), np.int64)
        edge = np.zeros(n + 1, bool)
        cuts = np.flatnonzero(data[1:] == 32) + 1
        edge[cuts[~_white(data, cuts - 1)]] = True
        cuts = np.flatnonzero(_MARK[data[1:]]) + 1
        edge[cuts[_letter(data, cuts - 1)]] = True
        edge[offsets] = True
        edge[n] = False
        starts = np.flatnonzero(edge)
        bounds = np.append(starts, n).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        table, first, size = self._distinct(chunks.dictionary)
        codes = chunks.indices.to_numpy()
        sizes = size[codes]
        ends = np.cumsum(sizes)
        out = table[np.repeat(first[codes] - (ends - sizes), sizes) + np.arange(ends[-1])]
        per = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]
        return out, np.diff(per)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct chunks, and where each chunk's begin and how many it has."""
        _, off, data = chunks.buffers()
        bounds, data = np.frombuffer(off, np.int32)[: len(chunks) + 1].astype(np.int64), np.frombuffer(data, np.uint8)
        start, last = data[bounds[:-1]], bounds[1:] - 1
        spaced = (start == 32) & ~_white(data, last)
        groups = [spaced, ~spaced & _MARK[start] & _letter(data, last)]
        first, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        table, total, rest = [], 0, ~(groups[0] | groups[1])
        for own in groups:
            got = self._rejoined(chunks.filter(pa.array(own)))
            if got is None:
                rest |= own
                continue
            table.append(got[0])
            first[own], size[own] = total + got[1], got[2]
            total += len(got[0])
        others = self.whole([c.decode("utf-8", "replace") for c in chunks.filter(pa.array(rest)).to_pylist()])
        counts = np.fromiter(map(len, others), np.int64, len(others))
        first[rest], size[rest] = total + np.cumsum(counts) - counts, counts
        return np.concatenate([*table, _joined(others)]), first, size

    def _rejoined(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """As _distinct, of chunks that may follow each other; None if the byte lengths don't show where each ends."""
        if not len(chunks):
            return None
        _, off, data = chunks.buffers()
        ends, raw = np.frombuffer(off, np.int32)[: len(chunks) + 1].astype(np.int64), data.to_pybytes()
        parts = np.append(ends[:-1][np.unique(ends[:-1] // PART, return_index=True)[1]], ends[-1])
        ids = _joined(self.whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True)]))
        at = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        place = np.searchsorted(at, ends)
        if place[-1] >= len(at) or (at[place] != ends).any():  # not UTF-8
            return None
        return ids, place[:-1], np.diff(place)


def _joined(found: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """Tokenised pieces: id, piece, start, length, ids_crc32 and, with_ids, ids.

    A text is its ids and ``end``; a null or empty text is just ``end``. Only a
    longer one is cut: into full pieces, the first one shorter if need be. Rows
    are independent: nulls in ids stay, repeated rows give repeated pieces, very
    long texts are taken whole. Other columns don't come out, so none can clash,
    but id_col may not be named like an output column. No rows: no pieces.
    """
    names = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    if id_col in names:
        raise ValueError(f"id_col {id_col!r} is an output column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = Encoder(tokenizer)
        for b in batches:
            at = 0
            for s in slices(b.column(1), TEXTS):
                ids, counts = encoder.ids(s)
                own = np.insert(ids, np.cumsum(counts), end).astype("<u4", copy=False)
                yield _pieces(b.column(0).slice(at, len(s)), own, counts + 1)
                at += len(s)

    def _pieces(keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """The pieces of some texts of ``counts`` ids each."""
        per = -(-counts // capacity)
        doc = np.repeat(np.arange(len(counts)), per)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        short = counts - (per - 1) * capacity  # ids of the first piece
        start = np.where(piece > 0, short[doc] + (piece - 1) * capacity, 0)
        length = np.where(piece > 0, capacity, short[doc])
        ends = np.cumsum(length)
        raw = memoryview(ids).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
        cols = [keys.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.view(np.int32))))
        return pa.RecordBatch.from_arrays(cols, ["id", *names])

    schema = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(run), schema)


def lower_bound(counts: list[int], capacity: int) -> int:
    """At least so many bins (Martello and Toth's L2), for counts of each length."""
    total = sum(k * c for k, c in enumerate(counts))
    best = -(-total // capacity)
    over = [0] * (capacity + 2)  # pieces longer than k, and their sum
    summed = [0] * (capacity + 2)
    for k in range(capacity, -1, -1):
        over[k] = over[k + 1] + counts[k]
        summed[k] = summed[k + 1] + k * counts[k]
    for t in range(0, capacity // 2 + 1):
        large, half = over[capacity - t + 1], over[capacity // 2 + 1]
        middle = summed[capacity // 2 + 1] - summed[capacity - t + 1]
        small = summed[t] - summed[capacity // 2 + 1]
        best = max(best, half + max(0, -(-(small - ((half - large) * capacity - middle)) // capacity)), large)
    return best


def best_fit(counts: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    for k in range(capacity, 0, -1):
        for _ in range(counts[k]):
            at = bisect_left(room, (k, -1))
            if at < len(room):
                left, i = room.pop(at)
                bins[i].append(k)
                left -= k
            else:
                i, left = len(bins), capacity - k
                bins.append([k])
            if left:
                insort(room, (left, i))
    return bins



class Left:
    """The pieces that are left, counted by length; a bit for each length, in both directions, names what fits."""

    def __init__(self, counts: list[int], capacity: int):
        self.counts, self.capacity, self.mask, self.back = [0] * (capacity + 1), capacity, 0, 0
        for k, c in enumerate(counts):
            if k and c:
                self.put(k, c)

    def put(self, k: int, by: int = 1) -> None:
        if not self.counts[k]:
            self.mask ^= 1 << k
            self.back ^= 1 << (self.capacity - k)
        self.counts[k] += by

    def take(self, k: int) -> None:
        self.counts[k] -= 1
        if not self.counts[k]:
            self.mask ^= 1 << k
            self.back ^= 1 << (self.capacity - k)

    def below(self, room: int) -> int:
        """The longest piece that fits, or 0."""
        return max((self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1, 0) if room > 0 else 0

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two pieces of exactly this total, none longer than most, the longer one as long as can be."""
        both = self.mask & (self.back >> (self.capacity - total)) & ((1 << (min(most, total - 1) + 1)) - 1)
        b = both.bit_length() - 1
        if b <= 0 or 2 * b < total or 2 * b == total and self.counts[b] < 2:
            return None
        return b, total - b

    def triple(self, total: int, most: int) -> tuple[int, ...] | None:
        """Three pieces of exactly this total, the longest one of the WIDTH longest that are not over most."""
        for _ in range(WIDTH):
            if 3 * most < total:
                return None
            self.take(most)
            two = self.pair(total - most, most) if total > most else None
            self.put(most)
            if two:
                return most, *two
            most = self.below(most - 1)
        return None

    def best_pair(self, room: int, more: int) -> tuple[int, int] | None:
        """The fullest two pieces of more than ``more`` in all."""
        one = self.below(room)
        for total in range(min(room, 2 * one), more, -1):
            if found := self.pair(total, one):
                return found
        return None

    def filled(self, room: int, first: int) -> tuple[int, ...]:
        """``first`` and then the longest pieces that fit, until up to three end the room exactly or nothing fits."""
        held, most, r = [first], first, room - first
        self.take(first)
        end: tuple[int, ...] | None = None
        while one := self.below(min(r, most)):
            if one < r and (end := self.pair(r, most) or self.triple(r, one)):
                break
            held.append(one)
            self.take(one)
            r, most = r - one, one
        for k in held:
            self.put(k)
        return (*held, *(end or ()))

    def fillings(self, room: int) -> list[tuple[int, ...]]:
        """Undominated fillings of the room, fullest first, those of longer pieces first among equals; BRANCHES of them at most."""
        one = self.below(room)
        if one in (0, room):  # nothing fits, or one piece that dominates every filling
            return [(one,)] if one else [()]
        found = [(one,)]
        if two := self.best_pair(room, one):
            found.append(two)
        k = one
        for _ in range(WIDTH):
            if not k:
                break
            found.append(self.filled(room, k))
            k = self.below(k - 1)
        found = sorted(dict.fromkeys(found), key=lambda f: (-sum(f), len(f)))
        out: list[tuple[int, ...]] = []
        for f in found:
            if len(out) == BRANCHES:
                break
            if not any(dominated(f, g) for g in out):
                out.append(f)
        return out


def dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether a's pieces, in order, fit where b's are: then b leaves no worse pieces behind. First fit: it may miss a dominance, and never finds a wrong one."""
    if len(a) < len(b) or sum(a) > sum(b):
        return False
    rooms = list(b)
    for k in a:
        for i, r in enumerate(rooms):
            if r >= k:
                rooms[i] -= k
                break
        else:
            return False
    return True


def completed(counts: list[int], capacity: int, incumbent: list[list[int]], bound: int, nodes: int) -> list[list[int]]:
    """The incumbent, or fewer bins by depth-first bin completion over at most so many nodes."""
    left = Left(counts, capacity)
    total = sum(k * c for k, c in enumerate(counts))
    path: list[tuple[int, Iterator, tuple[int, ...] | None]] = []  # largest piece, fillings to come, filling taken
    waste = 0

    def branch() -> None:
        largest = left.mask.bit_length() - 1
        left.take(largest)
        path.append((largest, iter(left.fillings(capacity - largest)), None))

    if left.mask:
        branch()
    while path and nodes and len(incumbent) > bound:
        largest, more, own = path.pop()
        if own is not None:
            waste -= capacity - largest - sum(own)
            for k in own:
                left.put(k)
        own = next(more, None)
        if own is None:
            left.put(largest)
            continue
        nodes -= 1
        for k in own:
            left.take(k)
        waste += capacity - largest - sum(own)
        path.append((largest, more, own))
        if waste > (len(incumbent) - 1) * capacity - total:
            continue  # the rest can't be fewer bins than the incumbent
        if left.mask:
            branch()
        elif len(path) < len(incumbent):
            incumbent = [[b, *f] for b, _, f in path]
    return incumbent


def pack(counts: list[int], capacity: int = CAPACITY, nodes: int = NODES, sets: int = SETS) -> list[list[int]]:
    """Bins of lengths that use up the counts of each length.

    Work is bounded by nodes, never by time, so results repeat. After the search
    of the whole, sets of the bins that waste most are searched again, each set
    joined by other bins in turn.
    """
    bound = lower_bound(counts, capacity)
    bins = best_fit(counts, capacity)
    bins = completed(counts, capacity, bins, bound, nodes * len(bins) + EXTRA)
    for turn in range(sets):
        if len(bins) <= bound:
            break
        bins.sort(key=lambda b: sum(b))
        size = waste = at = 0
        while at < len(bins) and (waste < capacity or turn and size < SET_PIECES // 2):
            size, waste, at = size + len(bins[at]), waste + capacity - sum(bins[at]), at + 1
        if waste < capacity or size > SET_PIECES:
            break  # no set so small can save a bin
        chosen = list(range(at))
        step = max(1, (len(bins) - at) // (sets + 1))
        for k in range(at + turn * step, len(bins)):
            if (size := size + len(bins[k])) > SET_PIECES:
                break
            chosen.append(k)
        own = [bins[k] for k in chosen]
        some = [0] * (capacity + 1)
        for b in own:
            for k in b:
                some[k] += 1
        better = completed(some, capacity, own, max(lower_bound(some, capacity), len(own) - 1), SET_NODES)
        if len(better) < len(own):
            bins = [b for k, b in enumerate(bins) if k not in set(chosen)] + better
    return bins


def _placed(capacity: int, length_col: str, shard_col: str):
    def run(table: pa.Table) -> pa.Table:
        lengths = np.asarray(table[length_col])
        shard = table[shard_col][0].as_py()
        order = np.argsort(lengths, kind="stable")
        counts = np.bincount(lengths, minlength=capacity + 1)
        waiting = (np.cumsum(counts) - counts).tolist()  # where the next piece of each length stands in the order
        place, sequence, offset = [], [], []
        for s, parts in enumerate(pack(counts.tolist(), capacity)):
            at = 0
            for k in parts:
                place.append(waiting[k])
                waiting[k] += 1
                sequence.append(s)
                offset.append(at)
                at += k
        back = np.empty(len(lengths), np.int64)
        back[order[np.array(place, np.int64)]] = np.arange(len(lengths))
        sequence = (shard << 32) + np.array(sequence, np.int64)[back]
        return table.drop_columns([shard_col]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(np.array(offset, np.int64)[back]))

    return run


def packed(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, length_col: str = "length") -> DataFrame:
    """parts, each row once, with sequence_id and offset: sequences of at most ``capacity`` tokens.

    parts has lengths from 1 to capacity; its own sequence_id and offset are
    replaced, other columns stay as they are. It is written once; its rows are
    dealt over shards by their place, never by a value, so no key can fill a
    shard, and each shard is packed by itself. Ties and repeated rows are
    separate pieces. No rows: none come out.
    """
    parts = written(parts.drop("sequence_id", "offset"), "pieces")
    n = max(1, -(-parts.count() // shard))
    own = fresh(parts, "shard")
    dealt = parts.withColumn(own, F.pmod(F.monotonically_increasing_id(), F.lit(n)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema), "sequence_id long", "offset long"])
    return dealt.groupBy(own).applyInArrow(_placed(capacity, length_col, own), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The ids of each sequence, from packed pieces with ids."""
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)).alias("ids"))
