"""Rows and batches for a trainer outside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.constants import BASELINE, EMBEDDING, QID, REFERENCE, SCORE, UID
from tallyframe.functions.columns import as_float_array, parse_embedding
from tallyframe.functions.hashing import HASH_FN
from tallyframe.operators.keyorder import bucket_bits, number_copies, rank_rows, rank_sorted, with_row_hash
from tallyframe.operators.responses import modal_length_filter, one_hot_sparse
from tallyframe.operators.splits import TRAIN, VALIDATION, side, train_val_split
from tallyframe.sources.tables import BATCHES_PER_FILE, write_loader


def training_rows(
    df: DataFrame, features: list[str], variant: str = "full", context_vector: str = "comment", encoding: str = "columns",
) -> DataFrame:
    """S3: context, task vector, score and reference of every response as floats.

    'full' also has the baseline ratings; 'parsed' reads the task vector from text;
    'vector_context' takes the context from a vector column and keeps rows of its modal length.
    With ``encoding='sparse'`` the features are not 0/1 columns but the original ones, of any number of
    categories, and the context is ``context_idx``, the places of its ones.
    """
    if encoding not in ("columns", "sparse"):
        raise ValueError("encoding must be 'columns' or 'sparse'")
    if encoding == "sparse":
        if variant == "vector_context":
            raise ValueError("a context that is a vector has no sparse form")
        coded = one_hot_sparse(df, features)
        vector = parse_embedding(EMBEDDING) if variant == "parsed" else as_float_array(df, EMBEDDING)
        extra = [as_float_array(df, BASELINE).alias(BASELINE)] if variant == "full" else []
        return coded.select(
            QID, UID, "context_idx", vector.alias(EMBEDDING),
            F.col(SCORE).cast("float").alias(SCORE), F.col(REFERENCE).cast("float").alias(REFERENCE), *extra,
        )
    if variant not in ("full", "parsed", "vector_context"):
        raise ValueError("variant must be 'full', 'parsed' or 'vector_context'")
    rows = modal_length_filter(df, context_vector) if variant == "vector_context" else df
    context = (
        as_float_array(df, context_vector)
        if variant == "vector_context"
        else F.array(*[F.col(f"`{f}`").cast("float") for f in features])
    )
    vector = parse_embedding(EMBEDDING) if variant == "parsed" else as_float_array(df, EMBEDDING)
    extra = [as_float_array(df, BASELINE).alias(BASELINE)] if variant == "full" else []
    return rows.select(
        QID, UID, context.alias("context"), vector.alias(EMBEDDING),
        F.col(SCORE).cast("float").alias(SCORE), F.col(REFERENCE).cast("float").alias(REFERENCE), *extra,
    )


def assign_batches(
    df: DataFrame,
    batch_size: int,
    shuffle: bool = True,
    seed: int = 42,
    epoch: int = 0,
    row_key: list[str] | None = None,
    order_by: list[str] | None = None,
    hash_fn: str = HASH_FN,
    bits: int | None = None,
) -> DataFrame:
    """Adds ``batch_id`` and ``pos``; the last batch may be short.

    Shuffled batches follow a random order of the rows that differs per epoch; otherwise rows are
    taken in the order of ``order_by``.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    if shuffle:
        hashed, ties = with_row_hash(df, f"{seed}/{epoch}", row_key, hash_fn=hash_fn)
        ranked = rank_rows(hashed, ["_h", *ties], bits if bits is not None else bucket_bits(df.count()))
    elif not order_by:
        raise ValueError("unshuffled batches need order_by")
    else:
        numbered = df if row_key else number_copies(df)
        rest = [c for c in (row_key or numbered.columns) if c not in order_by]
        ranked = rank_sorted(numbered, [*order_by, *rest])
    place = F.col("_rk") - 1
    return ranked.select(
        *df.columns, F.floor(place / batch_size).cast("bigint").alias("batch_id"),
        (place % batch_size).cast("int").alias("pos"),
    )


def train_val_files(
    df: DataFrame, path: str, batch_size: int, val_size: float = 0.1, seed: int = 42, epoch: int = 0,
    row_key: list[str] | None = None, order_by: list[str] | None = None, per_file: int = BATCHES_PER_FILE,
    hash_fn: str = HASH_FN,
) -> DataFrame:
    """R1v, S4: rows split by task, cut into batches and written for a trainer: those of the train side in an
    order that differs per epoch, those of the validation side in the order of ``order_by``.

    Returns the index of both sides (split, batch_id, file, path, first_row, n_rows).
    """
    split = train_val_split(df, val_size, seed, hash_fn=hash_fn)
    sides = {
        TRAIN: assign_batches(side(split, TRAIN), batch_size, True, seed, epoch, row_key, hash_fn=hash_fn),
        VALIDATION: assign_batches(side(split, VALIDATION), batch_size, False, row_key=row_key, order_by=order_by),
    }
    parts = [write_loader(rows, f"{path}/{name}", per_file).withColumn("split", F.lit(name)) for name, rows in sides.items()]
    return parts[0].unionByName(parts[1])
