"""What several operators of this subpackage share: folds, shared tables, range buckets, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of text that a Python worker handles at once; bounds its memory together with CHUNK_BYTES.
CHUNK_ROWS = 1_000
CHUNK_BYTES = 4 << 20


def fold(key: str, parts: int) -> Column:
    """Remainder of crc32 of the key as text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not use, in any letter case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table, written once to the shared folder and read again: recomputation stops here, and what was
    shuffled for it is no longer needed on the executors' disks."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a function writes for itself and drops when it has read them for the last time."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark)
        table = written(df, path)
        self.held.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """These tables go; without an argument all that are left."""
        gone = [(t, p) for t, p in self.held if not tables or any(t is x for x in tables)]
        self.held = [x for x in self.held if not any(x is g for g in gone)]
        for _, name in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def schema_with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


# -- key ranges ---------------------------------------------------------------------------------


def range_splits(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending keys that cut the table into ranges of similar numbers of rows.

    One aggregate over the key column alone; what reaches the driver is bounded by ``parts``.
    """
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    accuracy = max(10_000, 20 * parts)
    row = df.agg(F.percentile_approx(F.col(key), F.array(*map(F.lit, at)), accuracy).alias("at")).first()
    return sorted(set(row["at"] or []))


def range_bucket(key: Column, splits: list[int]) -> Column:
    """Number of splits below the key (null: 0), found in two steps of about the square root of their number."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits) - 1) + 1
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]

    def literal(values: list[int]) -> Column:
        return F.array(*(F.lit(v).cast("long") for v in values))

    below = lambda values: F.size(F.filter(values, lambda x: x < key))
    group = below(literal([g[-1] for g in groups]))
    inside = below(F.element_at(F.array(*map(literal, groups)), F.least(group + 1, F.lit(len(groups)))))
    bucket = F.when(group == len(groups), F.lit(len(splits))).otherwise(group * step + inside)
    return F.when(key.isNull(), F.lit(0)).otherwise(bucket).cast("int")


# -- batches of text ----------------------------------------------------------------------------


def released() -> None:
    """Give back what Arrow and the C library hold in reserve: an idle worker keeps it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(batches: Iterable[pa.RecordBatch], text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most CHUNK_ROWS rows and about ``size`` bytes of text."""
    for batch in batches:
        at = 0
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()))
        sizes = sizes.fill_null(0).to_numpy(zero_copy_only=False)
        while at < batch.num_rows:
            part = sizes[at : at + CHUNK_ROWS].cumsum()
            rows = max(1, int((part <= size).sum()))
            yield batch.slice(at, rows)
            at += rows
    released()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(values: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is the empty text."""
    return values.cast(pa.large_binary()).fill_null(b"").to_pylist()


def as_texts(values: pa.Array) -> list[str]:
    """Every text; null is the empty text, bytes that are not UTF-8 become the replacement character."""
    return [x.decode("utf-8", "replace") for x in as_bytes(values)]


def binary_array(data: bytes, ends: np.ndarray) -> pa.Array:
    """Slices of ``data`` between neighbouring ends, without a copy. Beyond 2 GB, which a single text must bring, it raises."""
    if len(ends) and int(ends[-1]) >= 1 << 31:
        raise ValueError("a text gives more than 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def appended(batch: pa.RecordBatch, schema: T.StructType, *columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns, named as the last fields of the result's schema."""
    names = [f.name for f in schema.fields]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)


def passing(df: DataFrame, text: str, schema: T.StructType, work) -> DataFrame:
    """Append columns that ``work(batch)`` returns as Arrow arrays to every row, in bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            yield appended(batch, schema, *work(batch))

    return df.mapInArrow(run, schema)
