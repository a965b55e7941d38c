"""Training sequences by power-of-two decomposition.

A document of n tokens is cut into n // LONGEST pieces of the longest length and one piece for every
binary digit of the rest, longest first. A piece is a sequence of its own, so no sequence crosses
documents and none needs padding; sequences of equal length form a bucket, from which a trainer
draws batches of one shape.

Defined cases: a null or empty text has its end token only; repeated rows are cut once each; a null
key passes through; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .pieces import CHUNK, Pieces, tokenizer_pieces, with_end

#: Parts of a bucket within which pieces are ranked: no task gets a whole bucket.
CELLS = 4_096

_LOADED: dict[tuple[str, bool], Pieces] = {}


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """Powers of two that add up to ``tokens``, none above ``longest``, in falling order."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def cuts(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all pieces of documents of so many tokens: the document, where the piece starts in it, its length."""
    whole, rest = np.divmod(tokens, longest)
    counts = whole + np.bitwise_count(rest)
    first = np.cumsum(counts) - counts
    lengths = np.full(int(counts.sum()), longest, np.int64)
    for k in range(longest.bit_length() - 1):
        has = np.flatnonzero(rest >> k & 1)
        lengths[(first + whole + np.bitwise_count(rest >> (k + 1)))[has]] = 1 << k  # behind the larger ones
    parents = np.repeat(np.arange(len(tokens)), counts)
    after = np.cumsum(lengths) - lengths
    return parents, after - np.repeat(np.cumsum(tokens) - tokens, counts), lengths


def cut(docs: DataFrame, path: str, end_id: int, longest: int = 2_048, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """Pieces: key, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens; ``added`` as in ``tokenizer_pieces``."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    kind = docs.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, start long, length int, ids binary, ids_crc32 long, doc_tokens long"
    rows = docs.select(F.col(key), F.col(text).alias("__text"))

    def cut_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = _LOADED.get((path, added)) or _LOADED.setdefault((path, added), tokenizer_pieces(path, added))
        flat, ends = with_end(*pieces(c.as_bytes(batch.column(1))), end_id)
        parents, starts, lengths = cuts(np.diff(ends), longest)
        bounds = np.append(ends[:-1][parents] + starts, len(flat))  # pieces lie one after the other
        joint = flat.tobytes()
        view = memoryview(joint)
        crcs = [zlib.crc32(view[a:b]) for a, b in pairwise((4 * bounds).tolist())]
        keys = batch.column(0).take(pa.array(parents))
        totals = pa.array(np.diff(ends)[parents], pa.int64())
        arrays = [keys, pa.array(starts), pa.array(lengths, pa.int32()), c.binary_array(joint, 4 * bounds), pa.array(crcs, pa.int64()), totals]
        return pa.RecordBatch.from_arrays(arrays, names=[key, "start", "length", "ids", "ids_crc32", "doc_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.small_batches(batches, "__text", CHUNK):
            yield cut_batch(batch)
            c.released()

    return rows.mapInArrow(run, schema)


def bucketed(pieces: DataFrame, key: str = "doc_id", cells: int = CELLS) -> DataFrame:
    """Append ``bucket_rank`` (the piece's number in its bucket, unique), sequence_id and offset.

    Ranks are counted per cell of a hash and interleaved, so a bucket is shuffled into many tasks and
    no count over the whole bucket is needed. A bucket's ranks have gaps only past its smallest cell.
    """
    bits = F.bit_count(F.col("length") - 1).cast("long")  # of 2^k: k
    cell, rank = c.fresh(pieces, "cell"), c.fresh(pieces, "rank")
    order = Window.partitionBy("length", cell).orderBy(key, "start", "ids_crc32", "doc_tokens")
    placed = pieces.withColumn(cell, F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(cells)))
    placed = placed.withColumn(rank, F.row_number().over(order) - 1)
    placed = placed.withColumn("bucket_rank", F.col(rank) * cells + F.col(cell)).drop(cell, rank)
    return placed.withColumn("sequence_id", F.col("bucket_rank") * 64 + bits).withColumn("offset", F.lit(0).cast("long"))


def packed(docs: DataFrame, path: str, end_id: int, longest: int = 2_048, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """Pieces with their sequences; drop ``ids`` where they are not wanted, they are then not shuffled."""
    return bucketed(cut(docs, path, end_id, longest, key, text, added), key)
