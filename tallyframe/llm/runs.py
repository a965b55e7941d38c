"""Periodic runs of words, found by recompression.

The words of a batch of documents stand in one sequence, each document between marks that occur once.
The sequence is compressed in turns: a block of equal symbols becomes one symbol, then pairs of a left
and a right symbol become one, until every document is a single symbol. The levels are a run-length
grammar: equal symbols of a level stand for equal words. How far two places agree is asked by going up
the levels while the symbols agree and down again to the first words that differ, for many pairs of
places at once; the same levels read backwards tell how far they agree to the left.

A run of period q and at least 3 q words holds a place x of every grid with step 2 q (of a finer one
where the least length is what binds) at which words x and x + q agree. Only such places are asked, and
the answers to both sides give the run exactly. All periods up to a third of a document are tried, n log n
places in all.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; repeated rows
are searched each; all other columns pass through; an empty table gives an empty result. The words of a
single text, however long, are held by one worker.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: A run has at least so many words, and at least so many periods.
WORDS, PERIODS = 24, 3
#: Places that are asked at once.
ASKED = 1 << 18

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])

_ODD = 0x9E37_79B9_7F4A_7C15


# -- the grammar ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """Symbols of a level, and how they make up those of the next: symbol j of it begins at ``first[j]``."""

    symbols: np.ndarray
    first: np.ndarray | None  # one more than the next level has symbols; None at the top
    up: np.ndarray | None  # the next level's symbol that a symbol is in
    blocks: bool

    def mirrored(self) -> Level:
        if self.first is None:
            return Level(self.symbols[::-1], None, None, self.blocks)
        return Level(self.symbols[::-1], len(self.symbols) - self.first[::-1], len(self.first) - 2 - self.up[::-1], self.blocks)


def _coded(keys: np.ndarray) -> np.ndarray:
    """Equal numbers for equal keys, from 0."""
    return pa.array(keys).dictionary_encode().indices.to_numpy()


def _level(symbols: np.ndarray, begins: np.ndarray, blocks: bool) -> Level:
    return Level(symbols, np.append(np.flatnonzero(begins), len(symbols)), np.cumsum(begins) - 1, blocks)


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels over a sequence of symbols; negative ones are marks, which occur once and are never merged."""
    levels, fresh, turn = [], int(symbols.max(initial=0)) + 1, 0
    marks = int((symbols < 0).sum())
    while len(symbols) > 2 * marks and turn < 400:
        begins = np.concatenate([[True], symbols[1:] != symbols[:-1]])
        if not begins.all():
            level = _level(symbols, begins, True)
            counts = np.diff(level.first)
            many = np.flatnonzero(counts > 1)
            symbols = symbols[level.first[:-1]]
            codes = _coded(symbols[many] * (int(counts.max()) + 1) + counts[many])
            symbols[many] = fresh + codes
            fresh += int(codes.max()) + 1
            levels.append(level)
        turn += 1
        mixed = symbols.astype(np.uint64) * np.uint64(_ODD * (2 * turn + 1) % (1 << 64))  # other halves in every turn
        side = (mixed >> np.uint64(61) & np.uint64(1)).astype(np.int8)
        side[symbols < 0] = 2
        one, two = ((side[:-1] == a) & (side[1:] == 1 - a) for a in (0, 1))
        pairs = np.flatnonzero(one if one.sum() >= two.sum() else two)
        if not len(pairs):
            continue
        begins = np.ones(len(symbols), bool)
        begins[pairs + 1] = False
        level = _level(symbols, begins, False)
        codes = _coded(symbols[pairs] * fresh + symbols[pairs + 1])
        merged = symbols.copy()
        merged[pairs] = fresh + codes
        symbols = merged[begins]
        fresh += int(codes.max()) + 1
        levels.append(level)
    return [*levels, Level(symbols, None, None, False)]


def agreement(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols of the lowest level agree from place x and from place y on, for each pair of places.

    The two places of a pair differ, and a mark follows after each. Two symbols of a level that differ
    have their first difference within themselves or just behind the shorter block; so a level takes
    one step on the way up and one on the way down.
    """
    stopped = []
    who, a, b = np.arange(len(x)), x, y
    for level in levels[:-1]:
        up, first = level.up, level.first
        off = (first[up[a]] != a) | (first[up[b]] != b)
        stays = off & (level.symbols[a] != level.symbols[b])
        step = off & ~stays
        if level.blocks:
            left, right = first[up[a] + 1] - a, first[up[b] + 1] - b
            by = np.where(step, np.minimum(left, right), 0)
            stays |= step & (left != right)  # one block ends, and what follows it is another symbol
        else:
            by = step
        a, b = a + by, b + by
        stopped.append((who[stays], a[stays], b[stays]))
        who, a, b = who[~stays], up[a[~stays]], up[b[~stays]]
    top = levels[-1].symbols
    while (same := top[a] == top[b]).any():
        a, b = a + same, b + same
    for level, (held, p, q) in zip(levels[-2::-1], stopped[::-1]):
        a, b = level.first[a], level.first[b]
        same = level.symbols[a] == level.symbols[b]
        if level.blocks:
            up, first = level.up, level.first
            by = np.where(same, np.minimum(first[up[a] + 1] - a, first[up[b] + 1] - b), 0)
        else:
            by = same
        who, a, b = np.concatenate([held, who]), np.concatenate([p, a + by]), np.concatenate([q, b + by])
    found = np.empty(len(x), np.int64)
    found[who] = a - x[who]
    return found


# -- runs -------------------------------------------------------------------------------------------


def runs_of(symbols: np.ndarray, sizes: np.ndarray, words: int = WORDS, periods: int = PERIODS) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, in that order.

    ``symbols`` are the words of all documents one after the other, as numbers from 0; ``sizes`` how many
    each document has.
    """
    none = np.empty((0, 4), np.int64)
    able = np.argsort(-sizes, kind="stable")
    able = able[sizes[able] >= max(words, periods)]  # longest first: a period is tried on a prefix
    if not len(able):
        return none
    begins = np.cumsum(sizes) - sizes
    held = sizes[able]
    at = np.cumsum(held + 1) - held  # where each begins between its marks
    joint = np.empty(int((held + 1).sum()) + 1, np.int64)
    joint[np.append(at - 1, len(joint) - 1)] = -1 - np.arange(len(at) + 1)
    inner = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
    joint[np.repeat(at, held) + inner] = symbols[np.repeat(begins[able], held) + inner]

    levels: list[Level] = []
    mirrored: list[Level] = []
    rows, places, shifts, waiting = [none[:, :3]], [], [], 0

    def ask() -> None:
        """Extend the places so far, and keep the runs among them."""
        if not levels:
            levels.extend(grammar(joint))
            mirrored.extend(level.mirrored() for level in levels)
        x, period = np.concatenate(places), np.concatenate(shifts)
        end = len(joint) - 1
        left = agreement(mirrored, end - (x + period) + 1, end - x + 1)
        length = left + agreement(levels, x, x + period) + period
        wide = length >= np.maximum(words, periods * period)
        rows.append(np.unique(np.column_stack([x - left, length, period])[wide], axis=0))

    for period in range(1, int(held[0]) // periods + 1):
        long = max(words, periods * period)
        count = int(np.searchsorted(-held, -long, "right"))
        if not count:
            break
        last = int(at[count - 1] + held[count - 1])
        step = long - period
        same = np.flatnonzero(joint[: last - period : step] == joint[period:last:step])
        if len(same):
            places.append(same * step)
            shifts.append(np.full(len(same), period))
            waiting += len(same)
        if waiting >= ASKED:
            ask()
            places, shifts, waiting = [], [], 0
    if waiting:
        ask()
    start, length, period = np.concatenate(rows).T
    order = np.lexsort((period, length, start))  # of equal stretches the one of the smallest period
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    place = np.searchsorted(at, start, "right") - 1
    found = np.column_stack([able[place], start - at[place], length, period])
    return found[np.lexsort((period, found[:, 1], found[:, 0]))]


# -- texts ------------------------------------------------------------------------------------------


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``data`` one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joint bytes of the texts with a space after each; begin and size of every word; words of each text."""
    joint = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(joint):
        joint = np.frombuffer(b" ", np.uint8)
    space = (joint == 0x20) | (joint >= 0x09) & (joint <= 0x0D)
    edge = np.diff(space.astype(np.int8), prepend=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    after = np.cumsum([len(x) + 1 for x in texts])
    return joint, begin, end - begin, np.diff(np.searchsorted(begin, after), prepend=0)


def _work(texts: list[bytes], words: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs, runs of each text, joint collapsed texts and where they begin and end."""
    joint, begin, size, counts = words_of(texts)
    ends = np.concatenate([[0], np.cumsum(size)])
    letters = pa.py_buffer(_gathered(joint, begin, size))
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), letters])
    symbols = pieces.dictionary_encode().indices.to_numpy().astype(np.int64)
    found = runs_of(symbols, counts, words, periods)
    first = np.cumsum(counts) - counts
    cover = np.zeros(len(begin) + 1, np.int64)  # +1 where a repetition begins, -1 behind it
    np.add.at(cover, first[found[:, 0]] + found[:, 1] + found[:, 3], 1)
    np.add.at(cover, first[found[:, 0]] + found[:, 1] + found[:, 2], -1)
    kept = np.cumsum(cover[:-1]) == 0
    owner = np.repeat(np.arange(len(texts)), counts)[kept]
    # each kept word with the space behind it; the last word of a text goes without
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    spaced = size[kept] + ~last
    out = _gathered(joint, begin[kept], spaced)
    bounds = np.cumsum(spaced)
    out[bounds[~last] - 1] = 0x20
    sums = np.concatenate([[0], bounds])
    return found, np.bincount(found[:, 0], minlength=len(texts)), out, sums[np.searchsorted(owner, np.arange(len(texts) + 1))]


def collapsed(
    docs: DataFrame, text: str = "text", out: tuple[str, str] = ("runs", "collapsed"), words: int = WORDS, periods: int = PERIODS
) -> DataFrame:
    """Append the runs of every whole text, (start, length, period) in words, by start and then period, and
    the text as UTF-8 without the words that repeat: those of a run behind its first period.

    Words are parted by ASCII white space; kept ones are joined by one space.
    """
    if periods < 3 or words < 1:
        raise ValueError("a run has at least three periods")
    schema = c.schema_with(docs, (out[0], T.ArrayType(RUN, False)), (out[1], T.BinaryType()))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        found, each, joint, bounds = _work(c.as_bytes(c.column(batch, text)), words, periods)
        fields = [pa.array(found[:, k]) for k in (1, 2, 3)]
        rows = pa.StructArray.from_arrays(fields, fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), rows)
        return [lists, c.binary_array(joint.tobytes(), bounds)]

    return c.passing(docs, text, schema, work)


def foremost(runs: str) -> Column:
    """The run with the greatest exact length / period; of ties the first, so the one of the smallest start, then period."""
    ahead = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: F.when(ahead(best, x), x).otherwise(best))


def echoed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Plant repetitions: with h the crc32 of the key and g = floor(h / 10), a text of n words with
    h % 10 = 0 has its words from a = g % n on replaced by its p = 1 + floor((n - a) / (3 + g % 8)) words
    from there, again and again. All other texts stay as they are. A null key counts as the empty text."""
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    g, words, n, a, p = (c.fresh(docs, x) for x in ("g", "words", "n", "a", "p"))
    found = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn(g, F.floor(h / 10)).withColumn(words, F.when(h % 10 == 0, found))
    rows = rows.withColumn(n, F.when(F.size(words) > 0, F.size(words))).withColumn(a, F.col(g) % F.col(n))
    rows = rows.withColumn(p, 1 + F.floor((F.col(n) - F.col(a)) / (3 + F.col(g) % 8)))
    place = lambda i: F.when(i < F.col(a), i).otherwise(F.col(a) + (i - F.col(a)) % F.col(p))
    again = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.get(F.col(words), place(i).cast("int")))
    planted = F.when(F.col(n).isNotNull(), F.array_join(again, " ")).otherwise(F.col(text))
    return rows.withColumn(text, planted).select(*docs.columns)
