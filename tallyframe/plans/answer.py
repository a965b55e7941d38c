"""From tasks to validated ratings in one plan: persona, prompt, model, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyframe.functions.hashing import HASH_FN
from tallyframe.operators import ratings
from tallyframe.operators.population import assign_persona


def answer_tasks(
    tasks: DataFrame,
    responder: Callable[[list[str]], list[str]],
    attributes: DataFrame | None = None,
    columns: list[str] | None = None,
    multi_persona: bool = True,
    seed: int = 42,
    concurrency: int = 8,
    key: str = "qid",
    template: str = ratings.TEMPLATE,
    hash_fn: str = HASH_FN,
) -> DataFrame:
    """Every task with its persona, prompt, reply, rating and status.

    With ``multi_persona`` each task gets a persona of its own, drawn from the ``columns`` of
    ``attributes``; otherwise all are asked as the general persona. The model is asked once.
    """
    if multi_persona:
        if attributes is None or not columns:
            raise ValueError("personas need attributes and columns")
        tasks = assign_persona(tasks, attributes, columns, seed, key, hash_fn)
    prompts = ratings.build_prompts(tasks, columns if multi_persona else None, template)
    return ratings.rate(prompts, responder, concurrency)
