"""Byte-level BPE from a file of ranks: encoding and decoding.

Every match of the splitting pattern is encoded by itself. Its bytes, read as Latin-1, go through an
Aho-Corasick automaton of all tokens once, which gives the tokens that begin at every byte. From the
left, the longest token is taken that may stand next to the one before it; where none may, the last
token gives way to the next shorter one, and the byte is never tried again. Two tokens may stand side
by side when merging their joint bytes by rank gives just these two; that answer is remembered. A
sequence whose neighbours all may stand side by side is the one that merging by rank ends with, so the
result is exact, and every byte is left at most once.

Defined cases: a null or empty text has no ids; a null list of ids decodes to nothing; unknown ids
raise; all other columns of a table pass through.
"""

from __future__ import annotations

import base64
from array import array
import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c
from .pieces import Pieces

#: Pairs of tokens that a worker remembers.
PAIRS = 1 << 18
#: Matches of the pattern that it remembers.
MATCHES = 1 << 16
NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._found = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._found.add_word(token.decode("latin-1"), (len(token), rank))
        self._found.make_automaton()
        in_order = [self.tokens.get(x, b"") for x in range(max(self.tokens) + 1)]
        self._sizes = np.array([len(x) for x in in_order])
        self._begin = np.cumsum(self._sizes) - self._sizes
        self._pool = np.frombuffer(b"".join(in_order), np.uint8)

    def merged(self, data: bytes) -> list[int]:
        """Merging by rank, step by step; only used on pairs of tokens."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        joint = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while joint:
            lowest = min(joint)
            if lowest == NONE:
                break
            at = joint.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joint[at]
            if at:
                joint[at - 1] = rank(parts[at - 1] + parts[at], NONE)
            if at < len(joint):
                joint[at] = rank(parts[at] + parts[at + 1], NONE)
        return [self.ranks[x] for x in parts]

    def neighbours(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            self._pairs[pair] = known
        return known

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        signs = data.decode("latin-1")
        ids = [rank for _, (_, rank) in self._found.iter_long(signs)]
        if all(map(self.neighbours, ids, ids[1:])) and sum(len(self.tokens[x]) for x in ids) == len(data):
            return ids  # the longest matches may stand as they are
        size = len(data)
        begin: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for last, (length, rank) in self._found.iter(signs):
            begin[last + 1 - length].append((length, rank))  # for a byte, in order of length
        left = bytearray(size + 1)  # bytes from which no way leads to the end
        ids = []
        taken: list[int] = []
        at, choice = 0, len(begin[0]) - 1
        while at < size:
            options = begin[at]
            while choice >= 0:
                length, rank = options[choice]
                if not left[at + length] and (not ids or self.neighbours(ids[-1], rank)):
                    break
                choice -= 1
            if choice >= 0:
                ids.append(rank)
                taken.append(choice)
                at += length
                choice = len(begin[at]) - 1 if at < size else 0
            elif ids:
                left[at] = 1
                at -= len(self.tokens[ids.pop()])
                choice = taken.pop() - 1
            else:
                raise ValueError("the ranks lack a byte of the text")
        return ids

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The joint bytes of the ids, and where those of each id begin and the last end."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self._sizes):
            raise ValueError("an id is not in the vocabulary")
        sizes = self._sizes[ids]
        if (sizes == 0).any():
            raise ValueError("an id is not in the vocabulary")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self._pool[np.repeat(self._begin[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes(), ends


_LOADED: dict[tuple[str, str], tuple[ByteBPE, Pieces]] = {}


def _loaded(path: str, pattern: str, white_space: bool) -> tuple[ByteBPE, Pieces]:
    """Once per Python worker."""
    if (path, pattern) not in _LOADED:
        bpe, split = ByteBPE(load_ranks(path)), regex.compile(pattern)
        memo: dict[str, bytes] = {}

        def one(match: str) -> bytes:
            ids = memo.get(match)
            if ids is None:
                ids = array("I", bpe.encode(match.encode())).tobytes()
                if len(match) <= 24:
                    if len(memo) >= MATCHES:
                        memo.clear()
                    memo[match] = ids
            return ids

        def all_matches(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:  # a piece may hold a word and a full stop
            ids = [b"".join(map(one, split.findall(x.decode("utf-8", "replace")))) for x in new]
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)

        _LOADED[path, pattern] = bpe, Pieces(all_matches, white_space)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", white_space: bool = True) -> DataFrame:
    """Append the ids of every whole text.

    ``white_space`` says that the pattern starts a match at every run of white space and looks no
    further ahead than that run's next character, as the usual patterns do; else False.
    """
    schema = c.schema_with(docs, (ids, T.ArrayType(T.IntegerType(), False)))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        _, pieces = _loaded(path, pattern, white_space)
        flat, ends = pieces(c.as_bytes(c.column(batch, text)))
        return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view("<i4")))]

    return c.passing(docs, text, schema, work)


def decoded(ids: str, path: str, pattern: str):
    """The bytes of a list of ids, as a column; null for null."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        bpe, _ = _loaded(path, pattern, True)
        if not len(lists):
            return pa.array([], pa.binary())
        joint, ends = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False))
        own = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return c.binary_array(joint, ends[own])

    return decode(F.col(ids))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", white_space: bool = True) -> DataFrame:
    """Append n_ids, ids (little-endian unsigned 32-bit integers) and the bytes decoded from these ids.

    The same as ``encode`` and then ``decoded``, in one pass and one worker.
    """
    schema = c.schema_with(docs, ("n_ids", T.LongType()), ("ids", T.BinaryType()), ("decoded", T.BinaryType()))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe, pieces = _loaded(path, pattern, white_space)
        flat, ends = pieces(c.as_bytes(c.column(batch, text)))
        joint, places = bpe.decode(flat)
        return [pa.array(np.diff(ends)), c.binary_array(flat.tobytes(), ends * 4), c.binary_array(joint, places[ends])]

    return c.passing(docs, text, schema, work)
