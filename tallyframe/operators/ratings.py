"""Prompts and ratings from text replies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tallyframe.constants import (
    MANY_NUMBERS, NO_NUMBER, NO_PERSONA, PERSONA_SEPARATOR, STATUS_INVALID, STATUS_VALID,
)
from tallyframe.functions.hashing import as_column
from tallyframe.operators.joins import join_by_key
from tallyframe.session import checkpointed

TEMPLATE = """Answer as this person would: {persona}.

How hard would it be for you to answer the question below?
1 means very easy, 2 easy, 3 medium, 4 hard and 5 very hard.

Question:
{text}

Reply with the line "Difficulty: <number>" and no reason."""


def stripped(c: str | Column) -> Column:
    """Without white space around it, line breaks included."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+\z", "")


def persona_text(columns: list[str] | None) -> Column:
    """'Gender: x | Race: y' from the persona columns, or the general persona."""
    if not columns:
        return F.lit(NO_PERSONA)
    parts = [F.concat(F.lit(f"{c.capitalize()}: "), F.col(c).cast("string")) for c in columns]
    return F.concat_ws(PERSONA_SEPARATOR, *parts)


def build_prompts(
    tasks: DataFrame, persona_columns: list[str] | None = None, template: str = TEMPLATE, text: str = "text"
) -> DataFrame:
    """Adds ``prompt`` from the slots {persona} and {text} of the template, in any order and number.

    A template without {text} is an error, one without {persona} asks everybody alike. A task without
    a text has no prompt.
    """
    if "{text}" not in template:
        raise ValueError("the template has no {text}")
    slots = {"{persona}": persona_text(persona_columns), "{text}": F.col(text)}
    parts = [slots[x] if x in slots else F.lit(x) for x in re.split(r"(\{persona\}|\{text\})", template) if x]
    return tasks.withColumn("prompt", stripped(F.concat(*parts)))


def validate_ratings(df: DataFrame, column: str, lo: int = 1, hi: int = 5, error: str | None = None) -> DataFrame:
    """Adds ``llm_rating`` and ``validation_status``.

    Valid is a reply with exactly one free-standing digit of the range. ``error`` names a column
    with the message of a failed call.
    """
    if not 0 <= lo <= hi <= 9:
        raise ValueError("ratings are single digits")
    reply = stripped(column)
    found = F.regexp_extract_all(reply, F.lit(rf"(?U)\b[{lo}-{hi}]\b"), F.lit(0))
    quoted = F.concat(F.lit("['"), F.array_join(found, "', '"), F.lit("']"))
    problem = F.when(F.size(found) == 0, F.concat(F.lit(NO_NUMBER), reply)).when(
        F.size(found) > 1, F.concat(F.lit(MANY_NUMBERS), quoted)
    )
    if error is not None:
        problem = F.coalesce(F.col(error), problem)
    problem = F.when(F.col(column).isNull() & problem.isNull(), F.lit(NO_NUMBER)).otherwise(problem)
    return df.withColumns({
        "llm_rating": F.when(problem.isNull(), F.try_element_at(found, F.lit(1)).cast("int")),
        "validation_status": F.coalesce(F.concat(F.lit(STATUS_INVALID), problem), F.lit(STATUS_VALID)),
    })


def _replies(responder: Callable[[list[str]], list[str]], prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(reply, error) per prompt; a failing batch is asked again prompt by prompt."""
    try:
        out = responder(prompts)
        if len(out) != len(prompts):
            raise ValueError(f"{len(out)} replies to {len(prompts)} prompts")
        return [(r, None) for r in out]
    except Exception as e:  # the error of a call is a result, as for any invalid reply
        if len(prompts) == 1:
            return [(None, str(e))]
        return [_replies(responder, [p])[0] for p in prompts]


# Prompts that the model function gets at a time, and characters of them at about; bounds a task's memory.
ASKED_ROWS, ASKED_BYTES = 1_000, 4 << 20


def _asked(responder: Callable[[list[str]], list[str]], batch: pa.RecordBatch, prompt: str) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
    """Slices of a batch with their replies and errors; only the prompts of one slice are Python texts at a time."""
    column = batch.column(batch.schema.get_field_index(prompt))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")
    at = 0
    while at < batch.num_rows:
        rows = max(1, int((sizes[at : at + ASKED_ROWS].cumsum() <= ASKED_BYTES).sum()))
        prompts = column.slice(at, rows).to_pylist()
        there = [p for p in prompts if p is not None]
        found = iter(_replies(responder, there) if there else [])
        answers = [next(found) if p is not None else (None, None) for p in prompts]
        yield batch.slice(at, rows), pa.array([a for a, _ in answers], pa.string()), pa.array([e for _, e in answers], pa.string())
        at += rows


def rate(
    df: DataFrame, responder: Callable[[list[str]], list[str]], concurrency: int, prompt: str = "prompt",
    lo: int = 1, hi: int = 5, keep: bool = True,
) -> DataFrame:
    """T4: asks the caller's model function for every prompt, at most ``concurrency`` batches at a time.

    Each task streams its prompts in slices of Arrow batches; the function must be safe to ask twice, since a
    lost executor's prompts are asked again. A row without a prompt is invalid and not asked.

    The replies are kept in a reliable checkpoint, so later actions on the result ask nobody again;
    ``keep=False`` leaves that to the caller.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("_error", T.StringType())])

    names = schema.names

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, replies, errors in _asked(responder, batch, prompt):
                yield pa.RecordBatch.from_arrays([*part.columns, replies, errors], names)

    asked = df.repartition(concurrency).mapInArrow(ask, schema)
    if keep:
        asked = checkpointed(asked)
    return validate_ratings(asked, "reply", lo, hi, error="_error").drop("_error")


LEDGER = T.StructType([
    T.StructField("prompt_hash", T.StringType(), False),
    T.StructField("reply", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("run", T.StringType(), False),
])
# Prompts of a wave; what a broken run loses is at most one.
WAVE_PROMPTS = 1_000_000


def prompt_hash(prompt: str | Column) -> Column:
    return F.sha2(as_column(prompt).cast("binary"), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The last reply of every prompt that was asked; without a ledger yet an empty table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(LEDGER).parquet(ledger) if there else spark.createDataFrame([], LEDGER)
    # asked twice only where a first call failed, or two runs met: a reply counts before an error
    first = F.min_by(F.struct("reply", "error", "run"), F.struct(F.col("error").isNotNull(), F.col("run")))
    return rows.groupBy("prompt_hash").agg(first.alias("_r")).select("prompt_hash", "_r.*")


def rate_resumed(
    df: DataFrame, responder: Callable[[list[str]], list[str]], concurrency: int, ledger: str, run: str,
    prompt: str = "prompt", lo: int = 1, hi: int = 5, retry_failed: bool = False, wave_prompts: int = WAVE_PROMPTS,
) -> DataFrame:
    """T4 with a ledger: equal prompts are asked once, and no prompt that the ledger has a reply to is asked again.

    Only hash and prompt travel to the model, in waves of about ``wave_prompts``; the replies of a wave are
    appended to the ledger (a folder that all executors share) before the next begins, so a run that breaks
    loses at most its last wave, and the next one goes on from there. The rows then meet their replies
    where they lie, and are validated at full parallelism. ``retry_failed`` asks again what ended in an error.
    Adds ``run``, the run that asked; a row without a prompt is invalid, not asked and has none.
    """
    spark = df.sparkSession
    keyed = df.withColumn("prompt_hash", prompt_hash(prompt))
    known = read_ledger(spark, ledger)
    if retry_failed:
        known = known.filter(F.col("error").isNull())
    wanted = keyed.filter(F.col(prompt).isNotNull()).groupBy("prompt_hash").agg(F.first(prompt).alias("prompt"))
    wanted = checkpointed(wanted.join(known.select("prompt_hash"), "prompt_hash", "left_anti"))
    waves = -(-wanted.count() // wave_prompts)
    wave = F.pmod(F.xxhash64("prompt_hash"), F.lit(max(1, waves)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, replies, errors in _asked(responder, batch, "prompt"):
                columns = [part.column("prompt_hash"), replies, errors, pa.array([run] * part.num_rows, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, LEDGER.names)

    for k in range(waves):
        part = wanted.filter(wave == k).repartition(concurrency)
        part.mapInArrow(ask, LEDGER).write.mode("append").parquet(ledger)
    replies = read_ledger(spark, ledger).withColumnRenamed("error", "_error")
    answered = join_by_key(keyed, replies, "prompt_hash")
    return validate_ratings(answered, "reply", lo, hi, error="_error").select(
        *df.columns, "reply", "llm_rating", "validation_status", "run"
    )


def rating_summary(df: DataFrame) -> DataFrame:
    """T5: count and share per rating and kind of status."""
    status = F.col("validation_status")
    kind = (
        F.when(status == STATUS_VALID, "valid")
        .when(status.startswith(STATUS_INVALID + NO_NUMBER), "no number")
        .when(status.startswith(STATUS_INVALID + MANY_NUMBERS), "several numbers")
        .otherwise("failed")
    )
    counts = df.groupBy(kind.alias("kind"), "llm_rating").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # a handful of rows: one per rating and kind
    return counts.withColumn("share", F.col("n") / F.sum("n").over(everything))
