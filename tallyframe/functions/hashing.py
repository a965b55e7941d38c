"""Seeded randomness as pure column expressions (K1, K4).

A draw depends on ``(seed, key)`` alone, so results are the same for every partitioning and after
every task retry. ``xxhash64`` costs a few nanoseconds per row; ``md5`` is slower, but any SQL engine
can repeat it. ``xxhash64`` depends on the type of a key: an int and a bigint draw differently.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

HASH_FN = "xxhash64"
HASH_BITS = 48
HASH_RANGE = float(1 << HASH_BITS)


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash48(seed: int | str, *cols: str | Column, fn: str = HASH_FN) -> Column:
    """48-bit hash of the seed and the key columns as a non-negative bigint."""
    columns = [as_column(c) for c in cols]
    if fn == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(F.lit(str(seed)), *columns), 64 - HASH_BITS)
    if fn == "md5":
        text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint")
    raise ValueError("hash function must be 'md5' or 'xxhash64'")


def u01(seed: int | str, *cols: str | Column, fn: str = HASH_FN) -> Column:
    """K1: uniform in [0, 1) per key."""
    return hash48(seed, *cols, fn=fn) / F.lit(HASH_RANGE)


def n01(seed: int | str, *cols: str | Column, fn: str = HASH_FN) -> Column:
    """K4: standard normal per key (Box-Muller over two uniforms)."""
    u = F.greatest(u01(f"{seed}a", *cols, fn=fn), F.lit(1.0 / HASH_RANGE))
    v = u01(f"{seed}b", *cols, fn=fn)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0) * F.pi() * v)


def pick_index(seed: int | str, size: Column, *cols: str | Column, fn: str = HASH_FN) -> Column:
    """Uniform 0-based index below ``size``."""
    return F.floor(u01(seed, *cols, fn=fn) * size).cast("bigint")


# -- the same md5 draws inside a task, many keys at once ------------------------------------------

_MD5_START = [np.array([[x]], np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_MD5_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_MD5_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_MD5_WORDS = [[i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16][i // 16] for i in range(64)]
_MD5_STEPS = [(i // 16, w, added, np.uint32(s), np.uint32(32 - s)) for i, (w, added, s) in enumerate(zip(_MD5_WORDS, _MD5_ADDED, _MD5_SHIFTS))]


def _md5_block(state: list[np.ndarray], words: list[np.ndarray], room: list[np.ndarray]) -> list[np.ndarray]:
    """State after one block of 16 words, each of which has a number per text or one that several share.

    The result stands in the first four of the six arrays of ``room``, which are overwritten.
    """
    for x, y in zip(state, room):
        np.copyto(y, x)
    a, b, c, d, f, t = room
    for turn, word, added, left, right in _MD5_STEPS:
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[word]
        np.add(f, word + added if word.size < f.size else np.add(word, added, out=t), out=f)
        np.left_shift(f, left, out=a)
        np.right_shift(f, right, out=f)
        np.bitwise_or(a, f, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [np.add(x, y, out=y) for x, y in zip(state, (a, b, c, d))]


class Md5Draws:
    """``hash48`` by md5 of ``seed:key`` and a rest, for many keys and, one after the other, many rests.

    A text goes into as many blocks of 16 words as it fills. Where a key stands and what it adds to the
    words is found once; a rest adds the same to all keys of equal length.
    """

    def __init__(self, seeds: list[str], keys: list[str | None]):
        """A null key is left out, as ``concat_ws`` does."""
        texts = [b"" if k is None else b":" + k.encode() for k in keys]
        self.seeds = [s.encode() for s in seeds]
        sizes = np.array([len(x) for x in texts], np.int64)
        self.sizes, self.which = np.unique(sizes, return_inverse=True)
        self.longest = int(self.sizes.max(initial=0))
        padded = np.frombuffer(b"".join(x.ljust(self.longest, b"\0") for x in texts), np.uint8).reshape(len(texts), self.longest)
        self.room = [np.empty((len(seeds), len(texts)), np.uint32) for _ in range(6)]
        self.own: dict[int, np.ndarray] = {}  # word: what the keys add to it, for every seed
        for i, seed in enumerate(self.seeds):
            first, last = len(seed) // 4, -(-(len(seed) + self.longest) // 4)
            room = np.zeros((len(texts), 4 * (last - first)), np.uint8)
            room[:, len(seed) - 4 * first : len(seed) - 4 * first + self.longest] = padded
            for k, column in enumerate(room.view("<u4").T, first):
                self.own.setdefault(k, np.zeros((len(seeds), len(texts)), np.uint32))[i] = column

    def hash48(self, rests: list[str]) -> np.ndarray:
        """A row per seed, whose text ends in the rest of the same place; a column per key."""
        if not len(self.which):
            return np.empty((len(self.seeds), 0), np.int64)
        ends = [r.encode() for r in rests]
        blocks = np.array([[(len(s) + n + len(e) + 8) // 64 + 1 for s, e in zip(self.seeds, ends)] for n in self.sizes.tolist()])
        most = int(blocks.max(initial=1))
        rows = []
        for n, counts in zip(self.sizes.tolist(), blocks.tolist()):
            for s, e, count in zip(self.seeds, ends, counts):
                length = len(s) + n + len(e)
                rows.append((s + bytes(n) + e + b"\x80").ljust(64 * count - 8, b"\0") + (8 * length).to_bytes(8, "little") + bytes(64 * (most - count)))
        shared = np.frombuffer(b"".join(rows), "<u4").reshape(len(self.sizes), len(ends), 16 * most)
        state = _MD5_START
        for block in range(most):
            words = []
            for k in range(16 * block, 16 * block + 16):
                word = shared[:, :, k]
                if (word == word[:1, :1]).all():  # one number for all is added at once, others a row at a time
                    word = word[:1, :1]
                else:
                    word = word[0][:, None] if (word == word[:1]).all() else word.T.take(self.which, axis=1)
                words.append(word + self.own[k] if k in self.own else word)
            after = _md5_block(state, words, self.room)
            filled = blocks.T > block
            done = block + 1 == most and filled.all()
            state = after if done else [np.where(filled[:, self.which], x, y) for x, y in zip(after, state)]
        high, low = (x.byteswap().astype(np.int64) for x in state[:2])
        return (high << 16) | (low >> 16)


def box_muller(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Standard normals of two draws of ``hash48``, as ``n01`` makes them."""
    u = np.maximum(first / HASH_RANGE, 1.0 / HASH_RANGE)
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * math.pi * (second / HASH_RANGE))
