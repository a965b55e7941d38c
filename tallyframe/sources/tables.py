"""Source of responses, sinks for splits, samples and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.config import ResponseConfig
from tallyframe.operators.responses import canonicalize


def read_responses(spark: SparkSession, path: str, cfg: ResponseConfig, source: str = "parquet", **options) -> DataFrame:
    """Responses under canonical names; columns and filters reach the scan."""
    return canonicalize(spark.read.format(source).options(**options).load(path), cfg)


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per side, so that reading a side skips the others."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_sides(spark: SparkSession, path: str, wanted: DataFrame, side: str = "split") -> DataFrame:
    """The rows of the wanted sides, or levels, of what :func:`write_split` or :func:`write_samples` wrote.

    ``wanted`` has the column ``side``, few rows and a filter of its own: its values prune the folders
    while the query runs, and the others are not opened.
    """
    return spark.read.parquet(path).join(F.broadcast(wanted.select(side).distinct()), side)  # as many rows as folders


def write_samples(df: DataFrame, level: str, path: str, mode: str = "errorifexists") -> None:
    """Samples of a study, one folder per level."""
    df.write.mode(mode).partitionBy(level).parquet(path)


def write_batches(df: DataFrame, path: str, files: int, mode: str = "errorifexists") -> None:
    """Files hold whole runs of batches in order, so a batch is found from file statistics."""
    ordered = df.repartitionByRange(files, F.col("batch_id")).sortWithinPartitions("batch_id", "pos")
    ordered.write.mode(mode).parquet(path)


BATCHES_PER_FILE = 16_384


def write_loader(df: DataFrame, path: str, per_file: int = BATCHES_PER_FILE, mode: str = "errorifexists") -> DataFrame:
    """S4 for a trainer: every file holds ``per_file`` whole batches, in order of batch and place.

    ``df`` comes from ``assign_batches``. Batch i lies in the folder ``file=i // per_file``, which is one
    file, as one stretch of rows. Returns the index, which is also written: (batch_id, file, path,
    first_row, n_rows), so that a trainer reads a batch as one range of one file.
    """
    spark = df.sparkSession
    numbered = df.withColumn("file", F.floor(F.col("batch_id") / per_file).cast("bigint"))
    dealt = numbered.repartition("file").sortWithinPartitions("file", "batch_id", "pos")
    dealt.write.mode(mode).partitionBy("file").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows").select("batch_id", "file", "_metadata.file_path", "_metadata.row_index")
    index = stored.groupBy("batch_id", F.col("file").cast("bigint").alias("file"), F.col("file_path").alias("path")).agg(
        F.min("row_index").alias("first_row"), F.count(F.lit(1)).alias("n_rows")
    )
    index.write.mode(mode).parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_batch(spark: SparkSession, path: str, batch: int, per_file: int = BATCHES_PER_FILE) -> DataFrame:
    """One batch, from its one file, in order."""
    rows = spark.read.parquet(f"{path}/rows").filter((F.col("file") == batch // per_file) & (F.col("batch_id") == batch))
    return rows.drop("file").orderBy("pos")
