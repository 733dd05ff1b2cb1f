"""Keccak-256 with the original padding, all messages of a batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

RATE = 136  # bytes of a block


def _turns() -> np.ndarray:
    """By how many bits each lane (x + 5y) is turned: triangular numbers along the walk that the lanes are permuted on."""
    out, x, y = np.zeros(25, np.uint64), 1, 0
    for t in range(24):
        out[x + 5 * y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


def _constants() -> list[int]:
    """Each round's constant: bits 2^j - 1 from a shift register with x^8 + x^6 + x^5 + x^4 + 1."""
    out, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            c |= (r & 1) << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(c)
    return out


_TURNS, _CONSTANTS = _turns(), _constants()
_FROM = np.array([(x + 3 * y) % 5 + 5 * x for y in range(5) for x in range(5)])  # the lane that moves to x + 5y


def _permuted(s: np.ndarray) -> np.ndarray:
    """24 rounds over states of shape (25, messages)."""
    left = _TURNS[:, None]
    right = (np.uint64(64) - left) % np.uint64(64)
    for c in _CONSTANTS:
        sums = np.bitwise_xor.reduce(s.reshape(5, 5, -1), axis=0)
        near = np.roll(sums, -1, axis=0)
        s = s ^ np.tile(np.roll(sums, 1, axis=0) ^ ((near << np.uint64(1)) | (near >> np.uint64(63))), (5, 1))
        s = np.where(left == 0, s, (s << left) | (s >> right))[_FROM]
        rows = s.reshape(5, 5, -1)
        s = (rows ^ (~np.roll(rows, -1, axis=1) & np.roll(rows, -2, axis=1))).reshape(25, -1)
        s[0] ^= np.uint64(c)
    return s


def digests(messages: list[bytes]) -> list[bytes]:
    """The 32-byte digest of each message; messages with a next block go on together."""
    blocks = np.array([len(m) // RATE + 1 for m in messages], np.int64)
    state = np.zeros((25, len(messages)), np.uint64)
    for k in range(int(blocks.max(initial=0))):
        on = np.flatnonzero(blocks > k)
        rows = np.zeros((len(on), RATE), np.uint8)
        for row, i in zip(rows, on.tolist(), strict=True):
            part = messages[i][RATE * k : RATE * (k + 1)]
            row[: len(part)] = np.frombuffer(part, np.uint8)
            if blocks[i] == k + 1:
                row[len(part)] ^= 1
                row[-1] ^= 0x80
        state[:17, on] ^= rows.view("<u8").T
        state[:, on] = _permuted(state[:, on])
    return [x.tobytes() for x in np.ascontiguousarray(state[:4].T).astype("<u8")]


@F.pandas_udf(BinaryType())
def keccak256(raw: pd.Series) -> pd.Series:
    """The digest of a binary column; null for null."""
    there = raw.notna()
    out = pd.Series([None] * len(raw), index=raw.index, dtype=object)
    out[there] = pd.Series(digests([bytes(x) for x in raw[there]]), index=raw.index[there], dtype=object)
    return out


def topic(signature: str) -> bytes:
    """The first topic of an event: the digest of its name and types, without names of columns and spaces."""
    return digests([signature.encode()])[0]
