"""Preparing the responses table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.config import ResponseConfig
from tallyframe.constants import BASELINE, DEFAULT_SCORE_MAX, DEFAULT_SCORE_MIN, EMBEDDING, QID, REFERENCE, SCORE, UID
from tallyframe.functions.columns import category_text, fill_zero, missing_as_null, parse_embedding, ratings_to_array, zeros
from tallyframe.operators.joins import MAX_BROADCAST_ROWS, join_by_key
from tallyframe.operators.keyorder import rank_sorted

MAX_CATEGORIES = 1_000


def canonicalize(df: DataFrame, cfg: ResponseConfig) -> DataFrame:
    """Fixed column names; the text column is dropped if it is there."""
    names = {cfg.qid_col: QID, cfg.uid_col: UID, cfg.human_score_col: SCORE}
    if cfg.embedding_col:
        names[cfg.embedding_col] = EMBEDDING
    renamed = df.withColumnsRenamed({a: b for a, b in names.items() if a != b})
    return renamed.drop(cfg.text_col) if cfg.text_col else renamed


def validate_responses(df: DataFrame) -> DataFrame:
    """Contract of the responses table in one pass: keys must not be null."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(QID).isNull()).alias("null_qid"),
        F.count_if(F.col(UID).isNull()).alias("null_uid"),
        F.count_if(missing_as_null(SCORE).isNull()).alias("missing_score"),
    )
    return counts.withColumn("valid", (F.col("null_qid") == 0) & (F.col("null_uid") == 0))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column (null, and NaN in floating columns), in one pass."""

    def missing(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        floating = isinstance(field.dataType, (T.FloatType, T.DoubleType))
        return F.count_if((c.isNull() | F.isnan(c)) if floating else c.isNull()).alias(field.name)

    return df.agg(*[missing(f) for f in df.schema.fields]).unpivot([], df.columns, "column", "n_missing")


def vector_report(df: DataFrame, column: str | None, keys: tuple[str, ...] = (QID, UID)) -> DataFrame:
    """One row of counts: rows, rows without a key, missing vectors, vectors that cannot be read
    (no list, or a null in it), and the shortest and longest length of the others."""
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count_if(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).alias("n_without_key")]
    if column is None:
        return df.agg(*counts)
    text = isinstance(df.schema[column].dataType, T.StringType)
    read = parse_embedding(column) if text else F.when(~F.exists(column, lambda x: x.isNull()), F.col(column))
    length = F.when(F.col("_v").isNotNull(), F.size("_v"))
    return df.withColumn("_v", read).agg(
        *counts,
        F.count_if(F.col(column).isNull()).alias("n_missing"),
        F.count_if(F.col(column).isNotNull() & F.col("_v").isNull()).alias("n_unreadable"),
        F.min(length).alias("shortest"),
        F.max(length).alias("longest"),
    )


def profile_frame(df: DataFrame, rows: int = 3) -> DataFrame:
    """A few rows to look at."""
    return df.limit(rows)


# Sizes of the sketches of a profile: 2^LG_DISTINCT counters, and the k of the quantiles.
LG_DISTINCT, QUANTILE_K = 12, 200


def profile_sketches(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per column (and per group of ``by``) in one pass, of a size that does not grow:

    rows, missing cells (null, and NaN), smallest and largest value as a number or a text, and sketches of
    the distinct values and of the distribution of numbers. Rows of parts of a table can be merged
    (:func:`merge_profiles`), so a profile is kept per day or per split and added up later.
    """
    keys = by or []
    return df.groupBy(*keys).agg(F.array(*[_sketched(df, c) for c in columns]).alias("_s")).select(*keys, F.inline("_s"))


def _sketched(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.BooleanType)):
        raise ValueError(f"{name}: a profile needs numbers, texts, dates or truth values")
    cell = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        cell = F.when(~F.isnan(cell), cell)
    numeric = isinstance(kind, T.NumericType)
    number = cell.cast("double") if numeric else F.lit(None).cast("double")
    text = F.lit(None).cast("string") if numeric else cell.cast("string")
    return F.struct(
        F.lit(name).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(cell.isNull()).alias("n_missing"),
        F.min(number).alias("smallest"), F.max(number).alias("largest"),
        F.min(text).alias("smallest_text"), F.max(text).alias("largest_text"),
        F.hll_sketch_agg(cell.cast("string"), F.lit(LG_DISTINCT)).alias("distinct"),
        F.kll_sketch_agg_double(number, F.lit(QUANTILE_K)).alias("quantiles"),
    )


def merge_profiles(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Profiles of parts as profiles of the whole, or of larger groups ``by``."""
    return sketches.groupBy(*(by or []), "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"),
        F.min("smallest").alias("smallest"), F.max("largest").alias("largest"),
        F.min("smallest_text").alias("smallest_text"), F.max("largest_text").alias("largest_text"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def read_profile(sketches: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A profile to look at: approximate number of distinct values, and approximate quantiles of numbers."""
    at = F.array(*[F.lit(float(x)) for x in shares])
    counted = F.kll_sketch_get_n_double("quantiles") > 0
    return sketches.withColumns({
        "n_distinct": F.hll_sketch_estimate("distinct"),
        "quantiles": F.when(counted, F.kll_sketch_get_quantile_double("quantiles", at)),
    }).drop("distinct")


def score_range(df: DataFrame, column: str = SCORE) -> DataFrame:
    """A1: smallest and largest score; the default range when there is none. NaN is ignored."""
    score = missing_as_null(column)
    return df.agg(
        F.coalesce(F.min(score), F.lit(DEFAULT_SCORE_MIN)).alias("score_min"),
        F.coalesce(F.max(score), F.lit(DEFAULT_SCORE_MAX)).alias("score_max"),
    )


def string_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Categorical columns as strings."""
    return df.withColumns({f: category_text(df, f) for f in features})


def _feature_values(df: DataFrame, features: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(i).alias("position"), category_text(df, f).alias("value")) for i, f in enumerate(features)]
    return df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.position", "_c.value").distinct()


def one_hot_fit(
    df: DataFrame, features: list[str], max_categories: int = MAX_CATEGORIES
) -> dict[str, list[str]]:
    """Sorted categories per feature. Columns are made from them, so their number is checked;
    larger vocabularies have :func:`one_hot_sparse`."""
    if not features:
        return {}
    bound = max_categories * len(features)
    rows = _feature_values(df, features).limit(bound + 1).collect()  # at most bound + 1 values
    vocabulary = {f: sorted(r["value"] for r in rows if r["position"] == i) for i, f in enumerate(features)}
    if len(rows) > bound or any(len(v) > max_categories for v in vocabulary.values()):
        raise ValueError(f"more than {max_categories} categories in a feature: use one_hot_sparse")
    return vocabulary


def one_hot_names(vocabulary: dict[str, list[str]]) -> list[str]:
    return [f"{f}_{v}" for f, values in vocabulary.items() for v in values]


def one_hot_apply(df: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Features replaced by 0/1 columns in one projection; an unseen category gives zeros."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in vocabulary]
    coded = [
        F.when(category_text(df, f) == F.lit(v), 1.0).otherwise(0.0).cast("float").alias(f"{f}_{v}")
        for f, values in vocabulary.items()
        for v in values
    ]
    return df.select(*kept, *coded)


def one_hot(df: DataFrame, features: list[str], max_categories: int = MAX_CATEGORIES) -> tuple[DataFrame, list[str]]:
    vocabulary = one_hot_fit(df, features, max_categories)
    return one_hot_apply(df, vocabulary), one_hot_names(vocabulary)


def vocabulary_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Vocabulary of any size as (position, value, idx), idx in feature and category order."""
    return rank_sorted(_feature_values(df, features), ["position", "value"]).select(
        "position", "value", (F.col("_rk") - 1).alias("idx")
    )


def one_hot_sparse(df: DataFrame, features: list[str], vocabulary: DataFrame | None = None) -> DataFrame:
    """I3 for vocabularies too large for columns: ``context_idx``, the places of the ones.

    The vocabulary stays a table; every feature is one equi-join on its value, whose heavy values are
    looked up in ``df`` itself, not behind the joins before it.
    """
    table = vocabulary_table(df, features) if vocabulary is None else vocabulary
    out = df
    for i, f in enumerate(features):
        values = table.filter(F.col("position") == i).select(F.col("value").alias(f"_v{i}"), F.col("idx").alias(f"_i{i}"))
        coded = category_text(df, f).alias(f"_v{i}")
        out = join_by_key(out.withColumn(f"_v{i}", category_text(df, f)), values, f"_v{i}", measured=df.select(coded)).drop(f"_v{i}")
    places = F.array_compact(F.array(*[F.col(f"_i{i}") for i in range(len(features))]))
    return out.withColumn("context_idx", places).select(*[c for c in df.columns if c not in features], "context_idx")


def _check_unique(table: DataFrame, key: str, on_duplicate: str) -> None:
    if on_duplicate == "fanout":
        return
    if on_duplicate != "error":
        raise ValueError("on_duplicate must be 'fanout' or 'error'")
    if not table.groupBy(key).count().filter(F.col("count") > 1).isEmpty():
        raise ValueError(f"duplicate {key} in the table to attach")


def attach_reference(
    df: DataFrame, refs: DataFrame, cfg: ResponseConfig = ResponseConfig(), on_duplicate: str = "fanout",
    max_rows: int = MAX_BROADCAST_ROWS, **join,
) -> DataFrame:
    """Reference rating per task as ``yref_llm``; 0 where there is none. ``join`` as in ``join_by_key``."""
    table = refs.select(F.col(cfg.qid_col).alias(QID), F.col(cfg.reference_score_col).alias(REFERENCE))
    _check_unique(table, QID, on_duplicate)
    return join_by_key(df, table, QID, max_rows=max_rows, **join).withColumn(REFERENCE, fill_zero(REFERENCE))


def attach_baseline(
    df: DataFrame, base: DataFrame, cfg: ResponseConfig, on_duplicate: str = "fanout",
    max_rows: int | None = None,
) -> DataFrame:
    """Baseline ratings per task as one list; zeros where there are none."""
    n = cfg.num_baseline_ratings
    table = base.select(
        F.col(cfg.qid_col).alias(QID), ratings_to_array(base, cfg.baseline_prefix, n).alias(BASELINE)
    )
    _check_unique(table, QID, on_duplicate)
    bound = max_rows if max_rows is not None else MAX_BROADCAST_ROWS // max(1, n // 8)
    return join_by_key(df, table, QID, max_rows=bound).withColumn(
        BASELINE, F.coalesce(F.col(BASELINE), zeros(n))
    )


def length_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per vector length."""
    return df.groupBy(F.array_size(column).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def modal_length_filter(df: DataFrame, column: str) -> DataFrame:
    """Whole rows whose vector has the most frequent length; the smallest such length on a tie."""
    counts = length_counts(df, column).filter(F.col("length").isNotNull())
    modal = counts.orderBy(F.desc("n"), F.asc("length")).limit(1).select("length").scalar()
    return df.filter(F.array_size(column) == modal)


def check_dim(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest vector length, and whether all are equal."""
    bounds = df.agg(
        F.min(F.array_size(column)).alias("dim_min"),
        F.max(F.array_size(column)).alias("dim_max"),
        F.count_if(F.col(column).isNull()).alias("n_null"),
    )
    return bounds.withColumn("equal", (F.col("dim_min") == F.col("dim_max")) & (F.col("n_null") == 0))
