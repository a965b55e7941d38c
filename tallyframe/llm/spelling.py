"""Spelling variants: words that differ by one inserted, deleted or replaced letter, by a bit-sliced index.

Words are runs of Latin-1 letters, so a letter is one byte. A block of some thousand words is indexed by
a bitset per position and letter: which words have this letter there. A word of the block is held
against all of it at once, letter by letter. One state holds the words that agree so far, and three
hold those with one error, at places shifted by what the error was:

    exact[j+1]     = exact[j] & at(j, x)
    replaced[j+1]  = replaced[j] & at(j, x)  |  exact[j] & ~at(j, x)
    longer[j+1]    = (longer[j] | exact[j]) & at(j + 1, x)
    shorter[j+1]   = shorter[j] & at(j - 1, x)  |  exact[j]

with x the j-th letter; the lengths decide at the end.

Words that could be near meet in a block by what one error leaves alone: cut in three, two words that
are near agree in two of the parts. A block holds whole groups of words that agree so, up to BLOCK words.
Larger groups are told apart by halves of the part that is left open, until it is one letter; there are
at most 90 + 90^2 words with one or two letters open, so no group grows with the data.

Defined cases: a null or empty text has no words; a null key counts as the empty text; rows that repeat
count each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.joins import fits_broadcast

from . import common as c

#: Shortest word, and fewest occurrences.
LETTERS, OCCURRENCES = 6, 5
#: A form has at least so many times the occurrences of its variant.
TIMES = 5
#: Words of a block, and letters of a block with all words filled to the longest.
BLOCK, CELLS = 4_096, 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


# -- words of texts ---------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB8_8320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_after(start: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of each slice of ``data``, going on from the crc32 of what stands before it."""
    order = np.argsort(-size, kind="stable")
    begin, falling = begin[order], -size[order]
    state = ~start[order].astype(np.uint32)
    for j in range(int(-falling[0]) if len(order) else 0):
        n = int(np.searchsorted(falling, -j, "left"))  # slices with more than j bytes
        state[:n] = _CRC[(state[:n] ^ data[begin[:n] + j]) & 0xFF] ^ state[:n] >> 8
    found = np.empty(len(order), np.uint32)
    found[order] = ~state
    return found


def _slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices one after the other, and where each begins and the last ends."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(begin - ends[:-1], size) + np.arange(int(ends[-1]))], ends


def _runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joint lower-cased bytes; begin and size of every run of letters; the text it is in."""
    joint = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    lead = joint == 0xC3  # U+00C0 to U+00FF: this byte and one more
    inside = _LETTER[joint] | lead
    inside[1:] |= lead[:-1]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), begin, "right")
    return _LOWER[joint], begin, end - begin, owner


def words_of(texts: list[bytes], keys: list[str], rare: int = 0, letters: int = LETTERS) -> tuple[list[str], np.ndarray]:
    """Distinct words of at least so many letters, and their occurrences.

    With ``rare``, a run loses its letter h % length if rare divides h, the crc32 of "<key>:<run>".
    """
    data, begin, size, owner = _runs(texts)
    able = size >= letters
    begin, size, owner = begin[able], size[able], owner[able]
    if rare:
        before = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
        chosen = np.empty(len(begin), np.uint32)
        short = size <= 64
        chosen[short] = crc32_after(before[owner[short]], data, begin[short], size[short])
        for k in np.flatnonzero(~short).tolist():
            chosen[k] = zlib.crc32(data[begin[k] : begin[k] + size[k]].tobytes(), int(before[owner[k]]))
    letter, bounds = _slices(data, begin, size)
    second = np.zeros(len(letter), bool)
    second[1:] = letter[:-1] == 0xC3
    first = letter == 0xC3
    letter = np.where(second, letter | 0x40, letter)  # the bytes of Latin-1
    places = np.concatenate([[0], np.cumsum(~first)])
    bounds = places[bounds]
    letter = letter[~first]
    if rare and len(begin):
        hit = np.flatnonzero(chosen % rare == 0)
        gone = bounds[hit] + chosen[hit].astype(np.int64) % np.diff(bounds)[hit]
        kept = np.ones(len(letter), bool)
        kept[gone] = False
        letter, bounds = letter[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]
    long = np.diff(bounds) >= letters
    letter, bounds = _slices(letter, bounds[:-1][long], np.diff(bounds)[long])
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(letter)])
    folded = runs.dictionary_encode()
    words = [x.decode("latin-1") for x in folded.dictionary.to_pylist()]
    return words, np.bincount(folded.indices.to_numpy(), minlength=len(words))


def counted(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rare: int = 0, letters: int = LETTERS, occurrences: int = OCCURRENCES
) -> DataFrame:
    """(word, n): the words of all whole texts with their occurrences; ``rare`` as in ``words_of``."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.small_batches(batches, "text"):
            words, n = words_of(c.as_bytes(batch.column(1)), batch.column(0).to_pylist(), rare, letters)
            for at in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 16)], pa.string()), pa.array(n[at : at + (1 << 16)], pa.int64())], names=["word", "n"])

    parts = rows.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


# -- the index ----------------------------------------------------------------------------------------


class _Slices:
    """Bitsets over the words of a block, per position and letter; made when a position is reached."""

    def __init__(self, letters: np.ndarray):
        self._letters = letters  # position x word; 0 behind the end of a word
        self._made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.lanes = -(-letters.shape[1] // 64)

    def bits(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), self.lanes * 8), np.uint8)
        packed = np.packbits(rows, axis=1)
        wide[:, : packed.shape[1]] = packed
        return wide.view(np.uint64)

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter: the words that have it at the position."""
        if position not in self._made:
            self._made.pop(position - 3, None)
            place = np.zeros(256, np.int64)
            sets = np.zeros((1, self.lanes), np.uint64)
            if 0 <= position < len(self._letters):
                own = np.unique(self._letters[position])
                own = own[own > 0]
                place[own] = np.arange(1, len(own) + 1)
                sets = np.concatenate([sets, self.bits(self._letters[position][None, :] == own[:, None])])
            self._made[position] = place, sets
        place, sets = self._made[position]
        return sets[place[letters]]


def near_in(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places (of a word, of a word one letter away from it) among distinct words in Latin-1, both ways round."""
    size = np.array([len(x) for x in words])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    longest = int(size[0])
    filled = b"".join(words[k].ljust(longest, b"\0") for k in order.tolist())
    letters = np.ascontiguousarray(np.frombuffer(filled, np.uint8).reshape(len(words), longest).T)
    index = _Slices(letters)
    sizes, of_size = np.unique(size, return_inverse=True)
    ended = dict(zip(sizes.tolist(), index.bits(of_size[None, :] == np.arange(len(sizes))[:, None])))
    none = np.zeros(index.lanes, np.uint64)

    exact = np.repeat(index.bits(np.ones((1, len(words)), bool)), len(words), axis=0)
    replaced, longer, shorter = (np.zeros_like(exact) for _ in range(3))
    ones, others = [], []
    for j in range(longest + 1):
        done = int(np.searchsorted(-size, -j, "left"))  # words with more than j letters go on
        if done < len(exact):
            length = ended.get(j, none)
            found = replaced[done:] & length | (longer[done:] | exact[done:]) & ended.get(j + 1, none) | shorter[done:] & ended.get(j - 1, none)
            row, lane = np.nonzero(found)
            bit = np.unpackbits(found[row, lane].view(np.uint8).reshape(-1, 8), axis=1)
            which, place = np.nonzero(bit)
            ones.append(order[done + row[which]])
            others.append(order[lane[which] * 64 + place])
        if not done:
            break
        x = letters[j, :done]
        here = index.at(j, x)
        exact, replaced, longer, shorter = exact[:done], replaced[:done], longer[:done], shorter[:done]
        shorter = shorter & index.at(j - 1, x) | exact
        longer = (longer | exact) & index.at(j + 1, x)
        replaced = replaced & here | exact & ~here
        exact = exact & here
    return np.concatenate(ones), np.concatenate(others)


# -- near words ---------------------------------------------------------------------------------------


def _keyed(words: DataFrame) -> DataFrame:
    """A word, as the shorter or equal and as the longer one of a pair, by two of its three parts.

    ``size`` is the length of the shorter word; the letters outside ``head`` and ``tail`` are open.
    """
    size = F.explode(F.array(F.length("word"), F.length("word") - 1))
    part = F.explode(F.array(*map(F.lit, range(3))))
    rows = words.withColumn("size", size).filter(F.col("size") >= LETTERS).withColumn("part", part)
    third = F.floor(F.col("size") / 3).cast("int")
    head = F.when(F.col("part") == 0, 0).when(F.col("part") == 1, third).otherwise(2 * third)
    tail = F.when(F.col("part") == 0, F.col("size") - third).when(F.col("part") == 1, F.col("size") - 2 * third).otherwise(0)
    return rows.withColumns({"head": head, "tail": tail}).drop("part")


def _grouped(rows: DataFrame) -> DataFrame:
    letters = F.concat(F.substring("word", F.lit(1), F.col("head")), F.lit(" "), F.expr("right(word, tail)"))
    return rows.withColumn("group", F.xxhash64("size", "head", "tail", letters))


def _told_apart(rows: DataFrame, block: int) -> DataFrame:
    """The rows in groups of at most ``block`` words, or with a single letter open."""
    rows, small = _grouped(rows), []
    while True:
        rows = c.written(rows)
        large = rows.filter(F.col("size") - F.col("head") - F.col("tail") > 1).groupBy("group").count().filter(F.col("count") > block).select("group")
        large = c.written(large)
        if large.isEmpty():
            return _union([*small, rows])
        if fits_broadcast(large):
            large = F.broadcast(large)
        small.append(rows.join(large, "group", "left_anti"))
        half = F.floor((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")
        rest = F.col("size") - F.col("head") - F.col("tail") - half
        ways = F.array(
            F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
            F.struct(F.col("head").alias("head"), (F.col("tail") + rest).alias("tail")),
        )
        hot = rows.join(large, "group", "left_semi").withColumn("way", F.explode(ways))
        rows = _grouped(hot.select("word", "n", "size", F.col("way.head").alias("head"), F.col("way.tail").alias("tail")))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n) of words (word, n): every pair of near words, both ways round, once."""
    keyed = _told_apart(_keyed(words), block).select("group", "word", "n")
    dealt = keyed.repartition(c.partitions(words.sparkSession), "group").sortWithinPartitions("group")

    def met(rows: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
        own = dict((word, n) for _, word, n in rows)  # a word may come by several groups
        names = list(own)
        one, other = near_in(names)
        texts = pa.array([x.decode("latin-1") for x in names], pa.string())
        n = pa.array(own.values(), pa.int64())
        return pa.RecordBatch.from_arrays([texts.take(pa.array(one)), n.take(pa.array(one)), texts.take(pa.array(other)), n.take(pa.array(other))], names=["word", "n", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int]] = []  # whole groups, and the one that is being read
        whole, longest, group = 0, 0, None
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), (x.encode("latin-1") for x in batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if row[0] != group:
                    whole, group = len(held), row[0]
                longest = max(longest, len(row[1]))
                if whole and (len(held) >= block or (len(held) + 1) * longest > CELLS):
                    if whole > 1:
                        yield met(held[:whole])
                    held, whole = held[whole:], 0
                    longest = max([len(row[1]), *(len(x) for _, x, _ in held)])
                held.append(row)
        if held:
            yield met(held)

    found = dealt.mapInArrow(run, "word string, n long, near string, near_n long")
    return found.groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n")).select("word", "n", "near", "near_n")


def variants(words: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    ``form`` is the near word of largest n (of equal ones the first in code-point order) if that is at
    least ``times`` the word's own; else null. ``root`` is where forms lead to in the end.
    """
    words = c.written(words)
    ahead = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    pairs = near_words(words, block).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), ahead)
    takes = -F.col("best.less") >= times * F.col("n")
    found = pairs.select("word", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    found = c.written(found)
    roots = _roots(found.filter("form is not null").select("word", F.col("form").alias("root")))
    whole = words.join(found, "word", "left").join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): links followed to the last, in twice as long steps each time. Occurrences grow along
    a link, so there are no rings, and a chain is as long as a logarithm."""
    while True:
        links = c.written(links)
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = links.join(on, "root")
        if longer.isEmpty():
            return links
        links = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
