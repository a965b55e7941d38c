"""Column mapping and parameters. Immutable; derived values are returned, never written back."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ResponseConfig:
    """Names of the raw columns and the parameters of preparation, split and batching."""

    qid_col: str = "qid"
    uid_col: str = "uid"
    human_score_col: str = "human_score"
    embedding_col: str | None = None
    text_col: str | None = None
    categorical_features: tuple[str, ...] = ()
    reference_score_col: str = "yref_llm"
    baseline_prefix: str = "r"
    num_baseline_ratings: int = 0
    test_size: float | int = 0.2
    validation_size: float | int = 0.1
    batch_size: int = 64
    seed: int = 42


@dataclass(frozen=True)
class ScoringConfig:
    """Parameters of the scoring job. ``diversity`` is the spread of the answer noise; ``precision``
    is that of the hidden layer."""

    score_min: float
    score_max: float
    diversity: float = 0.5
    noise_scale: float = 1.0
    fixed_reference: float | None = None
    seed: int = 42
    hash_fn: str = "xxhash64"
    precision: str = "float32"
