"""Counts and coverage of (task, worker) answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.session import checkpointed

# Levels of samples that one number marks, a bit for each.
MASK_BITS = 62


def _ratios() -> list[Column]:
    """Mean distinct partners per key = distinct pairs / distinct keys; NULL without keys."""
    return [
        F.try_divide(F.col("n_pairs"), F.col("n_qid")).alias("avg_workers_per_qid"),
        F.try_divide(F.col("n_pairs"), F.col("n_uid")).alias("avg_qids_per_uid"),
    ]


def entity_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """A2: distinct tasks, distinct workers and rows, in one pass; with ``approx`` within a few percent and without a shuffle of keys."""
    if approx:
        return df.agg(
            F.approx_count_distinct("qid", 0.02).alias("n_qid"),
            F.approx_count_distinct("uid", 0.02).alias("n_uid"),
            F.count(F.lit(1)).alias("n_obs"),
        )
    return df.agg(
        F.count_distinct("qid").alias("n_qid"),
        F.count_distinct("uid").alias("n_uid"),
        F.count(F.lit(1)).alias("n_obs"),
    )


def coverage_stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A3: coverage of the table, or of each group of ``by`` (for example a split)."""
    keys = by or []
    counts = df.groupBy(*keys).agg(
        F.count_distinct("qid").alias("n_qid"),
        F.count_distinct("uid").alias("n_uid"),
        F.count_distinct("qid", "uid").alias("n_pairs"),
        F.count(F.lit(1)).alias("n_obs"),
    )
    return counts.select(*keys, "n_qid", "n_uid", *_ratios(), "n_obs")


def covers_all(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Whether a part still holds every task and every worker of the whole.

    A subset equals its superset exactly when the distinct counts are the same.
    """
    few = part.agg(F.count_distinct("qid").alias("q"), F.count_distinct("uid").alias("u"))
    all_ = whole.agg(F.count_distinct("qid").alias("q"), F.count_distinct("uid").alias("u"))
    return few.select(
        (F.col("q") == all_.select("q").scalar()).alias("all_tasks"),
        (F.col("u") == all_.select("u").scalar()).alias("all_workers"),
    )


def level_coverage(rows: DataFrame, positions: DataFrame, by_pair: bool = False) -> DataFrame:
    """Coverage of nested samples, one row per position.

    ``rows(qid, uid, lvl)``: the first position at which a row is in the sample; ``positions(pos)``
    lists the positions, 0 being the smallest sample. A task, worker or pair is in a sample from its
    smallest ``lvl`` on, so one grouping-sets aggregate over the rows and a running sum over the
    positions give all samples at once, without a copy of the rows per sample. ``by_pair`` says that
    the level follows from task and worker, so rows can be counted with their pair.
    """
    leveled = rows.select("qid", "uid", "lvl", F.col("lvl").alias("_at"))
    sets = [[F.col("qid"), F.col("uid")], [F.col("qid")], [F.col("uid")], *([] if by_pair else [[F.col("_at")]])]
    entities = leveled.groupingSets(sets, "qid", "uid", "_at").agg(F.min("lvl").alias("pos"), F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_kind"))
    # Fixed by the order (qid, uid, _at): a set bit marks a column that is not grouped on.
    pair, task, worker, level = 1, 3, 5, 6
    added = entities.groupBy("pos").agg(
        F.count_if(F.col("_kind") == task).alias("n_qid"),
        F.count_if(F.col("_kind") == worker).alias("n_uid"),
        F.count_if(F.col("_kind") == pair).alias("n_pairs"),
        F.sum(F.when(F.col("_kind") == (pair if by_pair else level), F.col("_n"))).alias("n_obs"),
    )
    running = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one row per position
    names = ["n_qid", "n_uid", "n_pairs", "n_obs"]
    sums = positions.join(added, "pos", "left").select(
        "pos", *[F.coalesce(F.sum(n).over(running), F.lit(0)).alias(n) for n in names]
    )
    return sums.select("pos", "n_qid", "n_uid", *_ratios(), "n_obs")


def level_masks(held: list[Column]) -> list[Column]:
    """The levels that hold a row as bits of as few numbers as they need; ``held`` has a condition per level."""
    one = F.lit(1).cast("bigint")
    bits = [F.when(h, F.shiftleft(one, i % MASK_BITS)).otherwise(0) for i, h in enumerate(held)]
    return [reduce(lambda a, b: a.bitwiseOR(b), bits[at:at + MASK_BITS]) for at in range(0, len(bits), MASK_BITS)]


def mask_bit(mask: str | Column, i: int) -> Column:
    """Condition: bit ``i`` of a mask is set."""
    column = F.col(mask) if isinstance(mask, str) else mask
    return column.bitwiseAND(F.lit(1 << i)) != 0


def masked_coverage(rows: DataFrame, masks: list[str], levels: int, n_obs: DataFrame | None = None) -> DataFrame:
    """Coverage counts of samples that need not be nested, one row (_pos, n_qid, n_uid, n_pairs, n_obs) per level.

    A task, worker or pair is in the samples of all its rows, so its mask is the OR of theirs: one
    grouping-sets aggregate, combined before the shuffle, and then counts per bit. Rows are never
    unfolded by level. Rows are counted with their pair, whose mask then must follow from task and
    worker; where it does not, ``n_obs`` (_pos, n_obs) gives their numbers.
    """
    held = rows.filter(reduce(lambda a, b: a | b, [F.col(m) != 0 for m in masks])).select("qid", "uid", *masks)
    sets = [[F.col("qid"), F.col("uid")], [F.col("qid")], [F.col("uid")]]
    entities = held.groupingSets(sets, "qid", "uid").agg(
        *[F.bit_or(m).alias(m) for m in masks], F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_kind")
    )
    if len(masks) > 1:
        entities = checkpointed(entities)
    # Fixed by the order (qid, uid): a set bit marks a column that is not grouped on.
    pair, task, worker = (F.col("_kind") == k for k in (0, 1, 2))
    kinds = {
        "n_qid": task & F.col("qid").isNotNull(),
        "n_uid": worker & F.col("uid").isNotNull(),
        "n_pairs": pair & F.col("qid").isNotNull() & F.col("uid").isNotNull(),
    }
    parts = []
    for word, mask in enumerate(masks):
        own = range(min(MASK_BITS, levels - word * MASK_BITS))
        counts = [F.count_if(k & mask_bit(mask, i)).alias(f"{n}{i}") for i in own for n, k in kinds.items()]
        if n_obs is None:
            counts += [F.sum(F.when(pair & mask_bit(mask, i), F.col("_n"))).alias(f"n_obs{i}") for i in own]
        names = [*kinds, "n_obs"] if n_obs is None else list(kinds)
        row = [
            F.struct(F.lit(word * MASK_BITS + i).alias("_pos"), *[F.coalesce(f"{n}{i}", F.lit(0)).alias(n) for n in names])
            for i in own
        ]
        parts.append(entities.agg(*counts).select(F.inline(F.array(*row))))
    found = reduce(DataFrame.unionByName, parts)
    return found if n_obs is None else found.join(F.broadcast(n_obs), "_pos")  # one row per level
