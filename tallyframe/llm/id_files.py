"""Token ids in files of fixed-width bit packing, written and read by Spark tasks.

A file holds the documents of one range of keys, in ascending order:

    header    8 x uint64: magic, bits per id, ids per block, ids, documents, blocks, 0, 0
    keys      documents x int64, then documents x uint8 (1: the key is null)
    ends      documents x uint64: ids up to and with the document
    blocks    (blocks + 1) x uint64: the byte at which each block begins, from the start of the payload
    payload   every id in ``bits`` bits, highest bit first; a block begins at a byte

All numbers are little-endian. Any block is unpacked by itself with numpy, so a document is read
without what lies before it. ``manifest`` (a Parquet table in the folder) names the files that count,
with the ids before each; a task that was run twice leaves a file that it does not name.

Defined cases: a null or empty text has its end id only; a null key comes first; rows of equal keys
are ordered by their ids; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from .pieces import CHUNK, Pieces, tokenizer_pieces, with_end

MAGIC = 0x31534449_42495431
BLOCK = 4_096
#: Payload after which a range goes on in a further file; bounds the memory of writer and reader.
FILE_BYTES = 32 << 20

_LOADED: dict[tuple[str, bool], Pieces] = {}


def width(vocabulary: int) -> int:
    """Bits for ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, highest bit first. Ids are put into 64-bit lanes; one that crosses an edge goes in two parts."""
    if not len(ids):
        return b""
    at = np.arange(len(ids), dtype=np.int64) * bits
    lane, shift = at >> 6, 64 - bits - (at & 63)
    wide = ids.astype(np.uint64)
    first = np.flatnonzero(np.diff(lane, prepend=-1))
    over = np.flatnonzero(shift < 0)
    parts = wide << np.maximum(shift, 0).astype(np.uint64)
    parts[over] = wide[over] >> (-shift[over]).astype(np.uint64)
    lanes = np.zeros(int(lane[-1]) + 2, np.uint64)
    lanes[lane[first]] = np.bitwise_or.reduceat(parts, first)
    lanes[lane[over] + 1] |= wide[over] << (64 + shift[over]).astype(np.uint64)
    return lanes.astype(">u8").tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of one block."""
    size = (count * bits + 63) // 64 + 1
    lanes = np.frombuffer(data[: 8 * size].ljust(8 * size, b"\0"), ">u8").astype(np.uint64)
    at = np.arange(count, dtype=np.int64) * bits
    lane, off = at >> 6, (at & 63).astype(np.uint64)
    found = lanes[lane] << off
    over = np.flatnonzero(off > 64 - bits)
    found[over] |= lanes[lane[over] + 1] >> (np.uint64(64) - off[over])
    return (found >> np.uint64(64 - bits)).astype("<u4")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


class _File:
    """Documents that go into one file."""

    def __init__(self, bucket: int, bits: int):
        self.bucket, self.bits = bucket, bits
        self.keys: list[int | None] = []
        self.ends: list[int] = []
        self.ids = 0
        self._blocks: list[bytes] = []
        self._rest = np.empty(0, "<u4")
        self.bytes = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.ids += len(ids)
        self.ends.append(self.ids)
        self._rest = np.concatenate([self._rest, ids])
        full = len(self._rest) // BLOCK * BLOCK
        for at in range(0, full, BLOCK):
            self._put(self._rest[at : at + BLOCK])
        self._rest = self._rest[full:]

    def _put(self, ids: np.ndarray) -> None:
        self._blocks.append(pack(ids, self.bits))
        self.bytes += len(self._blocks[-1])

    def write(self, folder: str) -> str:
        if len(self._rest):
            self._put(self._rest)
        begins = np.concatenate([[0], np.cumsum([len(x) for x in self._blocks])]).astype("<u8")
        header = np.array([MAGIC, self.bits, BLOCK, self.ids, len(self.keys), len(self._blocks), 0, 0], "<u8")
        fs, path = _filesystem(f"{folder}/{self.bucket:08d}-{uuid.uuid4().hex}.ids")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(header.tobytes())
            out.write(np.array([k or 0 for k in self.keys], "<i8").tobytes())
            out.write(np.array([k is None for k in self.keys], np.uint8).tobytes())
            out.write(np.array(self.ends, "<u8").tobytes())
            out.write(begins.tobytes())
            for block in self._blocks:
                out.write(block)
        return path.rpartition("/")[2]


def encoded(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", id_bytes: int = 4, added: bool = False) -> DataFrame:
    """(key, ids): ids of every whole text and the end id, little-endian, ``id_bytes`` bytes each; ``added`` as in ``tokenizer_pieces``."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = _LOADED.get((path, added)) or _LOADED.setdefault((path, added), tokenizer_pieces(path, added))
        flat, ends = with_end(*pieces(c.as_bytes(batch.column(1))), end_id)
        narrow = flat.view(np.uint8).reshape(-1, 4)
        if narrow[:, id_bytes:].any():
            raise ValueError("an id needs more bytes")
        return pa.RecordBatch.from_arrays([batch.column(0), c.binary_array(narrow[:, :id_bytes].tobytes(), ends * id_bytes)], names=["key", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.small_batches(batches, "text", CHUNK):
            yield encode(batch)
            c.released()

    return rows.mapInArrow(run, "key long, ids binary")


def write(ids: DataFrame, folder: str, vocabulary: int, splits: list[int], id_bytes: int = 4) -> DataFrame:
    """Write (key, ids) in ascending order of keys, one range per task at a time; returns the manifest.

    ``splits`` are the keys between ranges, as ``common.range_splits`` gives them. Ids of fewer bytes
    make a smaller shuffle.
    """
    bits = width(vocabulary)
    spark = ids.sparkSession
    take = id_bytes

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number = None, 0

        def done() -> pa.RecordBatch:
            values = [file.bucket, number, file.write(folder), file.ids, len(file.keys)]
            return pa.RecordBatch.from_pylist([dict(zip(("bucket", "part", "file", "ids", "docs"), values))], MANIFEST)

        for batch in batches:
            for bucket, key, slim in zip(*(x.to_pylist() for x in batch.columns)):
                if file is None or file.bucket != bucket or file.bytes >= FILE_BYTES:
                    if file is not None:
                        yield done()
                    number = number + 1 if file is not None and file.bucket == bucket else 0
                    file = _File(bucket, bits)
                wide = np.zeros((len(slim) // take, 4), np.uint8)
                wide[:, :take] = np.frombuffer(slim, np.uint8).reshape(-1, take)
                values = wide.view("<u4").ravel()
                if len(values) and int(values.max()) >= 1 << bits:
                    raise ValueError("an id is outside the vocabulary")
                file.add(key, values)
        if file is not None:
            yield done()

    ranged = ids.select(c.range_bucket(F.col("key"), splits).alias("bucket"), "key", "ids")
    dealt = ranged.repartitionById(len(splits) + 1, "bucket").sortWithinPartitions("bucket", F.col("key").asc_nulls_first(), "ids")
    return c.written(dealt.mapInArrow(store, "bucket int, part int, file string, ids long, docs long"), f"{folder}/manifest")


MANIFEST = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("ids", pa.int64()), ("docs", pa.int64())])


class Reader:
    """One file; blocks are read when they are asked for."""

    def __init__(self, path: str):
        fs, local = _filesystem(path)
        self._in = fs.open_input_file(local)
        magic, self.bits, self.block, self.ids, docs, blocks, _, _ = np.frombuffer(self._in.read(64), "<u8").tolist()
        if magic != MAGIC:
            raise ValueError(f"{path} is not a file of ids")
        keys = np.frombuffer(self._in.read(8 * docs), "<i8").tolist()
        null = np.frombuffer(self._in.read(docs), np.uint8).tolist()
        self.keys = [None if x else k for k, x in zip(keys, null)]
        self.ends = np.frombuffer(self._in.read(8 * docs), "<u8").astype(np.int64)
        self._begins = np.frombuffer(self._in.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self._payload = 64 + 17 * docs + 8 * (blocks + 1)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self._in.close()

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` - 1, from the blocks that hold them."""
        if last <= first:
            return np.empty(0, "<u4")
        a, b = first // self.block, (last - 1) // self.block
        self._in.seek(self._payload + int(self._begins[a]))
        data = self._in.read(int(self._begins[b + 1] - self._begins[a]))
        parts = []
        for k in range(a, b + 1):
            count = min(self.block, self.ids - k * self.block)
            parts.append(unpack(data[int(self._begins[k] - self._begins[a]) : int(self._begins[k + 1] - self._begins[a])], self.bits, count))
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]

    def document(self, number: int) -> np.ndarray:
        return self.read(int(self.ends[number - 1]) if number else 0, int(self.ends[number]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, ids): every document of the manifest's files, with the ids before it."""
    files = spark.read.schema("bucket int, part int, file string, ids long, docs long").parquet(f"{folder}/manifest")
    # ids before a file: those of the ranges before its own, of which there are few, and of the files before it in its range
    ranges = files.groupBy("bucket").agg(F.sum("ids").alias("whole"))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("bucket", F.coalesce(F.sum("whole").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("ids").over(within), F.lit(0))
    table = files.join(F.broadcast(ranges), "bucket").select("file", start.alias("start"))
    table = table.repartition(4 * c.partitions(spark), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(x.to_pylist() for x in batch.columns)):
                with Reader(f"{folder}/{file}") as held:
                    for a in range(0, len(held.keys), c.CHUNK_ROWS):
                        keys = held.keys[a : a + c.CHUNK_ROWS]
                        base = int(held.ends[a - 1]) if a else 0
                        ends = [base, *held.ends[a : a + len(keys)].tolist()]
                        ids = held.read(base, ends[-1])
                        lists = [ids[x - base : y - base].tobytes() for x, y in zip(ends, ends[1:])]
                        starts = [start + x for x in ends[:-1]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lists, pa.binary())], names=["key", "start", "ids"]
                        )

    return table.mapInArrow(run, "key long, start long, ids binary")
