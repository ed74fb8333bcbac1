"""Random numbers that depend on a salt and a key alone, and so are the same in every run and in other engines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(salt: str | Column, key: str | Column) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of md5(salt || key)."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    key = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.md5(F.concat(salt, key.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


ROTATIONS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1)
SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ROWS = 1 << 14  # messages that are hashed together


def _first_word(words: list[np.ndarray | np.uint32], n: int) -> np.ndarray:
    """The first word of the MD5 of ``n`` padded messages, given word by word; a word that all share is a number."""
    state = [np.full(n, x, np.uint32) for x in START]
    t = np.empty(n, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                k = i
                np.bitwise_xor(c, d, out=t)
                t &= b
                t ^= d
            elif i < 32:
                k = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=t)
                t &= d
                t ^= c
            elif i < 48:
                k = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=t)
                t ^= d
            else:
                k = 7 * i % 16
                np.invert(d, out=t)
                t |= b
                t ^= c
            t += a
            word = words[at + k]
            if isinstance(word, np.ndarray):
                t += word
                t += SINES[i]
            else:
                t += np.uint32((int(word) + int(SINES[i])) & 0xFFFFFFFF)
            np.left_shift(t, np.uint32(ROTATIONS[i]), out=a)
            t >>= np.uint32(32 - ROTATIONS[i])
            a |= t
            a += b
            a, b, c, d = d, a, b, c
        for x, y in zip(state, (a, b, c, d), strict=True):
            x += y
    return state[0]


def uniforms(heads: pa.Array, middles: list[str], tails: pa.Array) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """``uniform`` of head || middle || tail for many rows and each of the middles, in batches for use within tasks:
    (rows, which middle, numbers) of some rows at a time. Heads and tails are strings, without nulls."""
    sides = []
    for x in (heads, tails):
        x = x.cast(pa.large_binary())
        ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
        data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] is not None else np.zeros(0, np.uint8)
        sides.append((data, ends[:-1], np.diff(ends)))
    (head, head_at, head_len), (tail, tail_at, tail_len) = sides
    kinds, kind = np.unique(np.stack((head_len, tail_len)), axis=1, return_inverse=True)
    for which, (a, b) in enumerate(kinds.T.tolist()):
        same = np.flatnonzero(kind.reshape(-1) == which)
        for start in range(0, len(same), ROWS):
            rows = same[start : start + ROWS]
            first = [head[head_at[rows] + j].astype(np.uint32) for j in range(a)]
            last = [tail[tail_at[rows] + j].astype(np.uint32) for j in range(b)]
            ready: dict[int, list] = {}
            for m, middle in enumerate(x.encode() for x in middles):
                c = len(middle)
                size = -(-(a + c + b + 9) // 64) * 64
                if c not in ready:  # words of all but the middle
                    base: list = [np.uint32(0)] * (size // 4)
                    for at, byte in [*enumerate(first), *enumerate(last, a + c)]:
                        base[at // 4] = base[at // 4] + (byte << np.uint32(8 * (at % 4)))
                    ready[c] = base
                words = list(ready[c])
                for at, byte in [*enumerate(middle, a), (a + c + b, 0x80), *enumerate((8 * (a + c + b)).to_bytes(8, "little"), size - 8)]:
                    if byte:
                        words[at // 4] = words[at // 4] + np.uint32(byte << (8 * (at % 4)))
                yield rows, m, _first_word(words, len(rows)).byteswap() / 4294967296.0
