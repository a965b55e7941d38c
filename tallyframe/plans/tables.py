"""The driver's tables seen as tables of this package (FIXTURES.md, section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SEED = 42
HASH = "md5"  # repeatable in any SQL engine; the library default is faster
FEATURES = ["l_returnflag", "l_linestatus"]
ROW_KEY = ["l_orderkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: part = task, supplier = worker, quantity = score."""
    return table(spark, sf_dir, "lineitem").withColumnsRenamed(
        {"l_partkey": "qid", "l_suppkey": "uid", "l_quantity": "human_score"}
    )


def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the columns that tell rows apart; equal rows get a copy number."""
    return responses(spark, sf_dir).select("qid", "uid", *ROW_KEY)


def event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a unique row id: event type = task, user = worker."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("qid"), F.col("user_id").alias("uid"), F.col("value").alias("human_score"), "event_id"
    )


def task_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").alias("yref_llm"))


def task_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline ratings r1, r2; r3 is absent."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("qid"), F.col("p_size").alias("r1"), F.col("p_retailprice").alias("r2")
    )


def errors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("agent"), (F.col("user_id") % 20 + 1).cast("int").alias("num_workers"),
        F.col("value").alias("error"),
    )


def error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per line: errors of two agents, the second absent from records of open lines."""
    both = F.create_map(
        F.lit("pure"), F.array("l_discount", "l_tax"), F.lit("blended"), F.array(F.col("l_quantity"))
    )
    one = F.create_map(F.lit("pure"), F.array("l_discount", "l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20 + 1).cast("int").alias("num_workers"), F.col("l_extendedprice").alias("time"),
        F.when(F.col("l_linestatus") == "O", one).otherwise(both).alias("errors"),
    )


def mean_times(spark: SparkSession, sf_dir: str, agent: str) -> DataFrame:
    return (
        errors_long(spark, sf_dir).filter(F.col("agent") == agent)
        .groupBy("num_workers").agg(F.round(F.avg("error"), 6).alias("time"))
    )


def grid_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with a vector and a reference rating."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qid"), (F.col("label") % 5 + 1).cast("double").alias("ref"), F.col("embedding").alias("x")
    )


def worker_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid"))
