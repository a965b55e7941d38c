"""The whole preparation as one plan per output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from tallyframe.config import ResponseConfig
from tallyframe.constants import BASELINE, EMBEDDING, QID, REFERENCE, SCORE, UID
from tallyframe.functions.columns import parse_embedding
from tallyframe.functions.hashing import HASH_FN
from tallyframe.operators.responses import (
    MAX_CATEGORIES, attach_baseline, attach_reference, canonicalize, one_hot_apply, one_hot_fit, one_hot_names,
    one_hot_sparse, score_range, vector_report, vocabulary_table,
)
from tallyframe.operators.splits import TEST, TRAIN, group_split, side


@dataclass(frozen=True)
class Prepared:
    """``table`` has the column ``split``; sides are filters on it."""

    table: DataFrame
    features: list[str]
    vocabulary: dict[str, list[str]] | DataFrame
    score_range: DataFrame
    report: DataFrame

    @property
    def train(self) -> DataFrame:
        return side(self.table, TRAIN)

    @property
    def test(self) -> DataFrame:
        return side(self.table, TEST)


def prepare(
    responses: DataFrame,
    refs: DataFrame,
    base: DataFrame,
    cfg: ResponseConfig,
    frac: float = 1.0,
    by: str = QID,
    fit_on: str = "all",
    hash_fn: str = HASH_FN,
    encoding: str = "columns",
    max_categories: int = MAX_CATEGORIES,
) -> Prepared:
    """Canonical names, one-hot features, vectors, reference and baseline ratings, and the split.

    The categories are those of the whole table, or of the train side with ``fit_on='train'``. With
    ``encoding='columns'`` every category is a column, so their number has a bound, which is checked;
    with ``encoding='sparse'`` a row has the places of its ones in ``context_idx``, and the vocabulary is
    a table of any size. ``report`` counts vectors that cannot be read and unequal lengths.
    """
    if encoding not in ("columns", "sparse"):
        raise ValueError("encoding must be 'columns' or 'sparse'")
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    raw = canonicalize(responses, cfg)
    split = group_split(raw, by, cfg.test_size, frac, cfg.seed, hash_fn)
    features = list(cfg.categorical_features)
    source = side(split, TRAIN) if fit_on == "train" else raw
    if encoding == "sparse":
        vocabulary = vocabulary_table(source, features)
        names, df = ["context_idx"], one_hot_sparse(split, features, vocabulary)
    else:
        vocabulary = one_hot_fit(source, features, max_categories)
        names, df = one_hot_names(vocabulary), one_hot_apply(split, vocabulary)
    if cfg.embedding_col and isinstance(raw.schema[EMBEDDING].dataType, T.StringType):
        df = df.withColumn(EMBEDDING, parse_embedding(EMBEDDING))
    df = attach_baseline(attach_reference(df, refs, cfg), base, cfg)
    df = df.withColumn(SCORE, F.col(SCORE).cast("float"))
    vector = [EMBEDDING] if cfg.embedding_col else []
    table = df.select(QID, UID, SCORE, *vector, REFERENCE, BASELINE, *[f"`{n}`" for n in names], "split")
    return Prepared(table, names, vocabulary, score_range(raw), vector_report(raw, EMBEDDING if cfg.embedding_col else None))
