"""Reduction studies: how little data still covers every task and worker.

Samples of one study are nested: rows carry the first level at which they are in the sample, so all
levels come from one pass (see ``level_coverage``). ``samples`` unfolds the levels only on request.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyframe.constants import (
    ABLATION_POINTS, CHECK_POINTS, MAX_RESPONSES_PER_TASK, MAX_TASKS_PER_WORKER, RATIO_END, RATIO_START,
    TASK_COUNTS, TRIALS, WORKER_COUNTS,
)
from tallyframe.functions.columns import linspace_values
from tallyframe.functions.hashing import HASH_FN, HASH_RANGE, hash48
from tallyframe.operators.coverage import MASK_BITS, level_coverage, level_masks, mask_bit, masked_coverage
from tallyframe.operators.joins import MAX_BROADCAST_ROWS, fits_broadcast, join_by_key
from tallyframe.operators.keyorder import (
    SPLIT_ROWS, choose_keys, choose_many, floor_size, rank_in_group, top_in_group, with_row_hash,
)
from tallyframe.session import checkpointed

# Draws that stand side by side in one aggregate; more of them take further aggregates.
UNROLLED_DRAWS = 64
# Draws of a group (its rows times the levels) that are made and sorted in one list.
LISTED_DRAWS = 200_000
# Keys whose masks of levels may be broadcast, if their bytes fit too.
BROADCAST_KEYS = 1_000_000
# Holders that give the bound for many draws; their number changes the work, not the result.
MAX_LEADERS = 10_000


@dataclass(frozen=True)
class Study:
    """``stats``: one row per level. ``rows``: every kept row with ``lvl``, its first position;
    position 0 is the smallest sample. ``labels``: the level of each position."""

    name: str
    labels: DataFrame
    rows: DataFrame
    stats: DataFrame

    def samples(self) -> DataFrame:
        """Long table of all samples; equal levels (a capped count) appear once."""
        levels = self.labels.groupBy(self.name).agg(F.min("pos").alias("_pos"))
        last = self.labels.agg(F.max("pos")).scalar()
        unfolded = self.rows.withColumn("_pos", F.explode(F.sequence("lvl", last)))
        return unfolded.join(F.broadcast(levels), "_pos").select(  # one row per level
            self.name, *[c for c in self.rows.columns if c != "lvl"]
        )


def _labels(spark: SparkSession, name: str, values: list) -> DataFrame:
    """(pos, <name>): the level of each position, ascending in sample size."""
    table = F.array(*[F.lit(v) for v in values])
    pos = F.col("id").cast("int")
    return spark.range(len(values)).select(pos.alias("pos"), table[pos].alias(name))


def _study(name: str, labels: DataFrame, rows: DataFrame, by_pair: bool = False) -> Study:
    stats = level_coverage(rows, labels.select("pos"), by_pair)
    return Study(name, labels, rows, labels.join(stats, "pos").drop("pos"))


def safe_ratio(
    df: DataFrame,
    mode: str = "task",
    min_count: int = 1,
    check_points: int = CHECK_POINTS,
    trials: int = TRIALS,
    seed: int = 42,
    nested: bool = True,
    hash_fn: str = HASH_FN,
) -> DataFrame:
    """R2: smallest ratio of the leading grid at which, in every trial, each worker still has
    ``min_count`` tasks (mode 'task'), or each task that many workers (mode 'worker').

    A worker has m tasks among the first k of a random task order exactly when its m-th task comes
    at place k or before. So one aggregate finds the smallest k of a trial: the largest m-th place
    over all workers. All grid ratios are then judged by that k. With ``nested=False`` every ratio
    gets trials of its own instead of sharing the orders.

    Returns one row (safe_ratio, required_k, total, feasible).
    """
    if mode not in ("task", "worker"):
        raise ValueError("mode must be 'task' or 'worker'")
    target, holder = ("qid", "uid") if mode == "task" else ("uid", "qid")
    draws = trials if nested else trials * check_points
    answers = df.select(target, holder)
    drawn = F.explode(F.sequence(F.lit(1), F.lit(draws)))
    h = hash48(seed, "trial", target, fn=hash_fn)

    if nested:
        parts = [range(a, min(a + UNROLLED_DRAWS, draws + 1)) for a in range(1, draws + 1, UNROLLED_DRAWS)]
        places = [
            _first_place(answers, target, holder, part, seed, hash_fn) if min_count == 1
            else _later_place(answers, target, holder, part, min_count, seed, hash_fn)
            for part in parts
        ]
        reach = reduce(DataFrame.unionByName, places)
    else:
        answers = checkpointed(answers.filter(F.col(target).isNotNull() & F.col(holder).isNotNull()).distinct())
        reach = _place_by_leaders(answers, target, holder, draws, min_count, seed, hash_fn)
    everyone = answers.agg(F.count_distinct(holder)).scalar()
    all_met = F.lit(True) if min_count == 1 else F.min("n_holders") == everyone  # who answers has one answer
    required = (
        answers.select(target).distinct().withColumn("trial", drawn)
        .join(F.broadcast(reach), "trial", "left")  # one row per trial
        .groupBy("trial")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(h <= F.col("reach")).alias("required_k"),
            F.max(F.coalesce("n_holders", F.lit(0))).alias("n_holders"),
        )
    )
    grid = linspace_values(RATIO_START, RATIO_END, check_points)
    at = F.sequence(F.lit(0), F.lit(check_points - 1))
    point = F.explode(at) if nested else F.floor((F.col("trial") - 1) / trials).cast("int")
    needed = [
        F.max("total").alias("total"),
        F.max("required_k").alias("required_k"),
        all_met.alias("feasible"),
    ]
    if nested:
        points = required.agg(*needed).withColumn("i", point)
    else:
        points = required.groupBy(point.alias("i")).agg(*needed)
    kept = F.greatest((F.col("total") * F.array(*[F.lit(r) for r in grid])[F.col("i")]).cast("bigint"), F.lit(min_count))
    judged = points.agg(
        F.min(F.when(~F.col("feasible") | (kept < F.col("required_k")), F.col("i"))).alias("failed"),
        F.max("required_k").alias("required_k"),
        F.max("total").alias("total"),
        F.min("feasible").alias("feasible"),
    )
    last_good = F.coalesce(F.col("failed"), F.lit(check_points)) - 1
    return judged.select(
        F.when(last_good < 0, F.lit(RATIO_START))
        .otherwise(F.array(*[F.lit(r) for r in grid])[F.greatest(last_good, F.lit(0))])
        .alias("safe_ratio"),
        F.when(F.col("feasible"), F.col("required_k")).alias("required_k"),
        "total",
        "feasible",
    )


def _first_place(
    answers: DataFrame, target: str, holder: str, draws: range, seed: int | str, hash_fn: str
) -> DataFrame:
    """(trial, reach, n_holders): the latest first target of any holder, per trial.

    The trials stand side by side in one partial aggregate; rows are not unfolded by trial.
    """
    names = [f"h{t}" for t in draws]
    hashes = [hash48(seed, F.lit(t), target, fn=hash_fn) for t in draws]
    first = answers.groupBy(holder).agg(*[F.min(h).alias(n) for h, n in zip(hashes, names)])
    last = first.agg(F.count(F.lit(1)).alias("n_holders"), *[F.max(n).alias(n) for n in names])
    trial = F.explode(F.sequence(F.lit(draws[0]), F.lit(draws[-1])))
    return last.withColumn("trial", trial).select(
        "trial", F.array(*names)[F.col("trial") - draws[0]].alias("reach"), "n_holders"
    )


def _mth_place(drawn: DataFrame, target: str, holder: str, m: int, h: Column) -> DataFrame:
    """As above for the m-th target, from distinct pairs unfolded by trial."""
    hashed = drawn.withColumn("h", h)
    if m == 1:
        mth = hashed.groupBy("trial", holder).agg(F.min("h").alias("h"))
    else:
        place = Window.partitionBy("trial", holder).orderBy("h", target)
        mth = hashed.withColumn("rn", F.row_number().over(place)).filter(F.col("rn") <= m).filter(F.col("rn") == m)
    return mth.groupBy("trial").agg(F.max("h").alias("reach"), F.count(F.lit(1)).alias("n_holders"))


def _later_place(
    answers: DataFrame, target: str, holder: str, draws: range, m: int, seed: int | str, hash_fn: str
) -> DataFrame:
    """As above for m > 1 without sorting all pairs of all trials.

    The latest m-th target is not before the latest first one. A holder with m targets up to there
    cannot be the latest, so only the few others are ranked. The holder of the latest first target
    is always one of them.
    """
    first = _first_place(answers, target, holder, draws, seed, hash_fn)
    rows = first.collect()  # one row per trial
    bounds = {r["trial"]: r["reach"] for r in rows if r["reach"] is not None}
    if not bounds:
        return first
    pairs, n_holders = answers.distinct(), rows[0]["n_holders"]
    early = [
        F.count_if(hash48(seed, F.lit(t), target, fn=hash_fn) <= F.lit(b)).alias(f"n{t}") for t, b in sorted(bounds.items())
    ]
    counts = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"n{t}").alias("n")) for t in sorted(bounds)])
    short = F.transform(F.filter(counts, lambda x: x["n"] < m), lambda x: x["t"])
    late = checkpointed(
        pairs.groupBy(holder).agg(*early).select(holder, short.alias("_trials")).filter(F.size("_trials") > 0)
    )
    open_pairs = join_by_key(pairs, late, holder, "inner", max_rows=MAX_BROADCAST_ROWS // len(bounds))
    unfolded = open_pairs.select(target, holder, F.explode("_trials").alias("trial"))
    ranked = _mth_place(unfolded, target, holder, m, hash48(seed, "trial", target, fn=hash_fn)).select(
        "trial", F.col("reach").alias("_reach"), F.col("n_holders").alias("_met")
    )
    missing = late.select(F.explode("_trials").alias("trial")).groupBy("trial").agg(F.count(F.lit(1)).alias("_late"))
    return (
        missing.join(ranked, "trial", "left").select(
            "trial", F.col("_reach").alias("reach"),
            (F.lit(n_holders) - F.col("_late") + F.coalesce("_met", F.lit(0))).alias("n_holders"),
        )
    )


def _place_by_leaders(
    pairs: DataFrame, target: str, holder: str, draws: int, m: int, seed: int | str, hash_fn: str
) -> DataFrame:
    """(trial, reach, n_holders) as above for very many draws, from distinct pairs.

    The holders with the fewest targets lead: the latest m-th target among them is a bound that the
    answer cannot be below. Every target gets a mask of the trials in which it comes up to that bound;
    masks are made once per target, and joined by OR for each holder. Only holders that lack their m-th
    target up to there in some trial are ranked, in those trials alone. For m > 1 a holder's targets are
    dealt to some cells: a trial in the masks of m cells has m targets, and one that is not is ranked.
    """
    degrees = checkpointed(pairs.groupBy(holder).agg(F.count(F.lit(1)).alias("_deg")).filter(F.col("_deg") >= m))
    able = degrees.count()
    leaders = degrees.orderBy("_deg", holder).limit(min(MAX_LEADERS, math.ceil(math.sqrt(able)))).select(holder)
    every = F.sequence(F.lit(1), F.lit(draws))
    h = hash48(seed, "trial", target, fn=hash_fn)
    led = pairs.join(F.broadcast(leaders), holder).select(target, holder, F.explode(every).alias("trial"))
    least = checkpointed(_mth_place(led, target, holder, m, h).select("trial", "reach"))
    bounds = {r["trial"]: r["reach"] for r in least.collect()}  # one row per trial
    if not bounds:
        return pairs.sparkSession.range(1, draws + 1).select(
            F.col("id").cast("int").alias("trial"), F.lit(None).cast("bigint").alias("reach"), F.lit(0).cast("bigint").alias("n_holders")
        )

    bound = F.array(*[F.lit(bounds[t]) for t in range(1, draws + 1)])
    words = -(-draws // MASK_BITS)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    size = lambda j: F.least(F.lit(MASK_BITS), F.lit(draws) - j * MASK_BITS)

    def word(j: Column) -> Column:
        def mark(mask: Column, i: Column) -> Column:
            trial = j * MASK_BITS + i + 1
            early = hash48(seed, trial, target, fn=hash_fn) <= F.element_at(bound, trial)
            return mask.bitwiseOR(F.when(early, bit(i)).otherwise(F.lit(0).cast("bigint")))

        return F.aggregate(F.sequence(F.lit(0), size(j) - 1), F.lit(0).cast("bigint"), mark)

    place = F.sequence(F.lit(0), F.lit(words - 1))
    masks = checkpointed(pairs.select(target).distinct().withColumn("_masks", F.transform(place, word)))
    cells = 1 if m == 1 else 4 * m
    joined = [F.bit_or(F.col("_masks")[j]).alias(f"_w{j}") for j in range(words)]
    marked = join_by_key(pairs.join(degrees.select(holder), holder, "left_semi"), masks, target, "inner")
    marked = marked.withColumn("_cell", F.pmod(F.xxhash64(F.lit(31), target), F.lit(cells)))
    held = marked.groupBy(holder, "_cell").agg(*joined).select(holder, F.array(*[f"_w{j}" for j in range(words)]).alias("_masks"))
    if m > 1:
        held = held.groupBy(holder).agg(F.collect_list("_masks").alias("_cells")).select(holder, _mth_mask("_cells", words, m).alias("_masks"))

    def missing(trial: Column) -> Column:
        at = trial - 1
        return F.get("_masks", (at / MASK_BITS).cast("int")).bitwiseAND(bit(at % MASK_BITS)) == 0

    late = checkpointed(held.select(holder, F.filter(every, missing).alias("_trials")).filter(F.size("_trials") > 0))
    unfolded = join_by_key(pairs, late, holder, "inner").select(target, holder, F.explode("_trials").alias("trial"))
    further = _mth_place(unfolded, target, holder, m, h).select("trial", F.col("reach").alias("_further"))
    return least.join(F.broadcast(further), "trial", "left").select(  # one row per trial
        "trial", F.greatest("reach", "_further").alias("reach"), F.lit(able).cast("bigint").alias("n_holders")
    )


def _mth_mask(cells: str, words: int, m: int) -> Column:
    """Bits that are set in at least m of the masks of a list: masks are put one by one into m levels,
    of which each takes what it shares with the one below."""
    none = F.array_repeat(F.lit(0).cast("bigint"), words)

    def put(levels: Column, mask: Column) -> Column:
        def level(k: Column) -> Column:
            below = F.when(k == 0, mask).otherwise(F.zip_with(F.get(levels, k - 1), mask, lambda a, b: a.bitwiseAND(b)))
            return F.zip_with(F.get(levels, k), below, lambda a, b: a.bitwiseOR(b))

        return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), level)

    return F.aggregate(cells, F.array_repeat(none, m), put, lambda levels: F.get(levels, F.lit(m - 1)))


def _keep_choices(df: DataFrame, choices: list) -> DataFrame:
    """Rows in the largest sample with ``lvl``; with two choices a row must be in both samples."""
    rows = df
    for i, choice in enumerate(choices):
        rows = choice.keep(rows, f"_l{i}")
    names = [f"_l{i}" for i in range(len(choices))]
    level = F.col(names[0]) if len(names) == 1 else F.greatest(*names)
    return rows.withColumn("lvl", level).drop(*names)


def ratio_ablation(
    df: DataFrame,
    mode: str = "worker",
    min_workers_per_task: int = 1,
    min_tasks_per_worker: int = 1,
    points: int = ABLATION_POINTS,
    check_points: int = CHECK_POINTS,
    trials: int = TRIALS,
    seed: int = 42,
    hash_fn: str = HASH_FN,
    nested: bool = True,
) -> Study:
    """Coverage of samples of workers, tasks or both, from all of them down to the safe ratio.

    ``nested=False`` draws every level on its own.
    """
    if mode not in ("worker", "task", "both"):
        raise ValueError("mode must be 'worker', 'task' or 'both'")
    smallest = RATIO_END
    if mode != "both":
        least = min_tasks_per_worker if mode == "task" else min_workers_per_task
        row = safe_ratio(df, mode, least, check_points, trials, seed, nested, hash_fn).first()
        smallest = row["safe_ratio"]
    ratios = linspace_values(RATIO_START, smallest, points)[::-1]
    labels = _labels(df.sparkSession, "ratio", [round(r, 2) for r in ratios])
    keys = {"worker": ["uid"], "task": ["qid"], "both": ["uid", "qid"]}[mode]
    if not nested:
        return _independent("ratio", labels, df, keys, seed, lambda n: [floor_size(n, r) for r in ratios], hash_fn)
    choices = [
        choose_keys(df, key, f"{seed}{key}", lambda n: [floor_size(n, r) for r in ratios], hash_fn) for key in keys
    ]
    return _study("ratio", labels, _keep_choices(df, choices), by_pair=True)


def _independent(
    name: str, labels: DataFrame, df: DataFrame, keys: list[str], seed: int | str,
    sizes: Callable[[int], list[int]], hash_fn: str,
) -> "IndependentStudy":
    """Study of samples drawn apart from each other: the order of the keys is salted with the level.

    The cuts of all levels come from one pass over the distinct keys. A key is marked with the levels
    that hold it, a bit for each, and its rows take over the mark, so nothing is drawn per row; rows are
    unfolded only where the samples themselves are asked for.
    """
    choices = {key: choose_many(df, key, f"{seed}{key}", sizes, hash_fn) for key in keys}
    levels = list(zip(*choices.values()))
    held = [reduce(lambda a, b: a & b, [c.chosen() for c in level]) for level in levels]
    marked, words = df.select("qid", "uid"), []
    for key in keys:
        masks = level_masks([c.chosen() for c in choices[key]])
        own = [f"_{key}{j}" for j in range(len(masks))]
        table = checkpointed(df.select(key).filter(F.col(key).isNotNull()).distinct().withColumns(dict(zip(own, masks))))
        marked = join_by_key(marked, table, key, max_rows=BROADCAST_KEYS, measured=df.select(key))
        words.append([F.when(F.col(key).isNull(), mask).otherwise(F.col(name)) for mask, name in zip(masks, own)])
    names = [f"_m{j}" for j in range(len(words[0]))]
    marked = marked.select("qid", "uid", *[reduce(lambda a, b: a.bitwiseAND(b), word).alias(n) for word, n in zip(zip(*words), names)])
    counts = masked_coverage(marked, names, len(held))
    rows = df.withColumn("_pos", F.explode(F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(held)]))))
    return IndependentStudy(name, labels, rows, _sample_stats(name, labels, counts))


def _sample_stats(name: str, labels: DataFrame, counts: DataFrame) -> DataFrame:
    names = ["n_qid", "n_uid", "n_pairs", "n_obs"]
    full = labels.join(counts, labels["pos"] == counts["_pos"], "left").select(
        name, *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )
    return full.select(
        name, "n_qid", "n_uid",
        F.try_divide("n_pairs", "n_qid").alias("avg_workers_per_qid"),
        F.try_divide("n_pairs", "n_uid").alias("avg_qids_per_uid"),
        "n_obs",
    )


@dataclass(frozen=True)
class IndependentStudy(Study):
    """As :class:`Study`; ``rows`` already holds each sample, marked by ``_pos``."""

    def samples(self) -> DataFrame:
        levels = self.labels.groupBy(self.name).agg(F.min("pos").alias("_pos"))  # of equal labels the smallest sample
        return self.rows.join(F.broadcast(levels), "_pos").select(  # one row per level
            self.name, *[c for c in self.rows.columns if c != "_pos"]
        )


@dataclass(frozen=True)
class _LevelDraw:
    """The first rows of every group in an order of its own at each level, without a rank of all rows.

    The rows of a small group are gathered, and drawn and marked with the levels that hold them where they
    are. For every other group and level the last kept row is found; a row then compares its own hash with
    that cut, and marks the levels that hold it. The hashes of a group of up to ``piece_rows`` rows are sorted
    where they were gathered. In a larger one the cut lies near the same share of the range of
    hashes: rows below that neighbourhood are counted, and only those within it are ranked. A
    neighbourhood that turns out not to hold the cut is widened. Rows are told apart by 48 bits of the
    level's hash and 64 of the row's.
    """

    group: str
    levels: int
    last: int
    step: int
    min_keep: int
    seed: int | str
    hash_fn: str

    def remove(self, pos: Column) -> Column:
        return (F.lit(self.last) - pos * self.step).cast("int")

    def kept(self, pos: Column) -> Column:
        return F.greatest(F.col("_d") - self.remove(pos), F.lit(self.min_keep))

    def hash(self, pos: Column, h: str | Column = "_h") -> Column:
        return hash48(self.seed, self.remove(pos), h, fn=self.hash_fn)

    @property
    def _all(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.levels - 1))

    def marked(self, keyed: DataFrame, sizes: DataFrame, piece_rows: int) -> DataFrame:
        """Rows with masks ``_m0``, …: bit i % MASK_BITS of number i // MASK_BITS for position i."""
        small = F.col("_n") <= min(piece_rows, LISTED_DRAWS // self.levels)
        others = checkpointed(sizes.filter(~small))
        if others.isEmpty():
            return self.listed(keyed, sizes)
        few = sizes.filter(small)
        near = self.listed(join_by_key(keyed, few.select(self.group), self.group, "left_semi", measured=keyed.select(self.group)), few)
        return near.unionByName(self._by_cuts(keyed, others, piece_rows))

    def listed(self, keyed: DataFrame, sizes: DataFrame) -> DataFrame:
        """The marked rows of groups whose draws fit into a list: of every row and level one hash."""
        columns = [c for c in keyed.columns if c not in (self.group, "_h", "_t")]
        rows = F.collect_list(F.struct(*columns, "_h", "_t")).alias("_all")
        lists = keyed.filter(F.col(self.group).isNotNull()).groupBy(self.group).agg(rows).join(sizes, self.group)

        def held(pos: Column) -> Column:
            own = F.transform("_all", lambda x, i: F.struct(self.hash(pos, x["_h"]).alias("h"), x["_t"].alias("t"), i.alias("i")))
            last = F.least(self.kept(pos).cast("int"), F.size("_all")) - 1
            both = F.transform(F.array(own), lambda all_: F.struct(all_.alias("all"), F.get(F.sort_array(all_), last).alias("cut")))
            return F.get(F.transform(both, lambda x: F.transform(x["all"], lambda y: y <= x["cut"])), F.lit(0))

        def word(first: int) -> Column:
            def mark(masks: Column, i: Column) -> Column:
                bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
                return F.zip_with(masks, held(i + first), lambda m, h: m.bitwiseOR(F.when(h, bit).otherwise(F.lit(0).cast("bigint"))))

            none = F.array_repeat(F.lit(0).cast("bigint"), F.size("_all"))
            return F.aggregate(F.sequence(F.lit(0), F.lit(min(MASK_BITS, self.levels - first) - 1)), none, mark)

        names = [f"_m{j}" for j in range(-(-self.levels // MASK_BITS))]
        words = lists.select(self.group, "_all", *[word(j * MASK_BITS).alias(n) for j, n in enumerate(names)])
        unfolded = words.select(self.group, F.inline(F.arrays_zip("_all", *names)))
        return unfolded.select(self.group, *[F.col("_all")[c].alias(c) for c in columns], *names)

    def _by_cuts(self, keyed: DataFrame, sizes: DataFrame, piece_rows: int) -> DataFrame:
        cuts = self._gathered(keyed, sizes.filter(F.col("_n") <= piece_rows))
        large = checkpointed(sizes.filter(F.col("_n") > piece_rows))
        if not large.isEmpty():
            found = self._narrowed(keyed, large)
            listed = F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_cut"))), lambda x: x["_cut"])
            cuts = cuts.unionByName(found.groupBy(self.group).agg(listed.alias("_cuts")))
        rows = join_by_key(keyed, checkpointed(cuts), self.group, "inner")
        if self.levels <= UNROLLED_DRAWS:  # plain expressions are compiled, lambdas are not
            held = [self._held(F.get("_cuts", F.lit(i)), F.lit(i)) for i in range(self.levels)]
            return rows.withColumns({f"_m{j}": w for j, w in enumerate(level_masks(held))}).drop("_cuts", "_h", "_t")

        def word(first: int) -> Column:
            def mark(mask: Column, i: Column) -> Column:
                held = self._held(F.get("_cuts", i + first), i + first)
                return mask.bitwiseOR(F.when(held, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))

            size = min(MASK_BITS, self.levels - first)
            return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("bigint"), mark)

        words = range(0, self.levels, MASK_BITS)
        return rows.withColumns({f"_m{j}": word(first) for j, first in enumerate(words)}).drop("_cuts", "_h", "_t")

    def _held(self, cut: Column, pos: Column) -> Column:
        return F.struct(self.hash(pos).alias("h"), F.col("_t").alias("t")) <= cut  # the hash is made once

    def _gathered(self, keyed: DataFrame, sizes: DataFrame) -> DataFrame:
        """(group, _cuts) of groups whose hashes fit into a list."""
        hashes = join_by_key(keyed.select(self.group, "_h", "_t"), sizes, self.group, "inner")
        lists = hashes.groupBy(self.group).agg(F.collect_list(F.struct("_h", "_t")).alias("_all"), F.first("_d").alias("_d"))

        def cut(pos: Column) -> Column:
            own = F.transform("_all", lambda x: F.struct(self.hash(pos, x["_h"]).alias("h"), x["_t"].alias("t")))
            return F.get(F.sort_array(own), F.least(self.kept(pos).cast("int"), F.size("_all")) - 1)

        nothing = F.struct(F.lit(-1).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("t"))
        return lists.select(self.group, F.transform(self._all, lambda pos: F.coalesce(cut(pos), nothing)).alias("_cuts"))

    def _narrowed(self, keyed: DataFrame, sizes: DataFrame) -> DataFrame:
        """(group, _pos, _cut) of groups of any size."""
        sought = sizes.withColumn("_pos", F.explode(self._all)).withColumn("_k", F.least("_n", self.kept(F.col("_pos"))))
        none = F.struct(F.lit(-1).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("t")).alias("_cut")
        parts, width = [sought.filter(F.col("_k") < 1).select(self.group, "_pos", none)], 8.0
        sought = sought.filter(F.col("_k") > 0)
        while True:
            share = F.col("_k") / F.col("_n")
            spread = F.sqrt(share * (1 - share) / F.col("_n")) + 1 / F.col("_n")
            low = F.greatest((share - width * spread) * HASH_RANGE, F.lit(-1.0)).cast("bigint")
            high = F.least((share + width * spread) * HASH_RANGE, F.lit(HASH_RANGE)).cast("bigint")
            ranges = F.array_sort(F.collect_list(F.struct("_pos", low.alias("low"), high.alias("high"), "_k"))).alias("_ranges")
            rows = join_by_key(keyed.select(self.group, "_h", "_t"), checkpointed(sought.groupBy(self.group).agg(ranges)), self.group, "inner")
            placed = F.transform("_ranges", lambda x: F.struct(x["_pos"], x["low"], x["high"], x["_k"], self.hash(x["_pos"]).alias("h")))
            rows = rows.withColumn("_placed", placed)
            below = F.transform("_placed", lambda x: (x["h"] < x["low"]).cast("bigint"))
            counts = None
            for first in range(0, self.levels, UNROLLED_DRAWS):  # of all levels but one word side by side
                own = range(first, min(first + UNROLLED_DRAWS, self.levels))
                sums = rows.select(self.group, "_ranges", below.alias("_below")).groupBy(self.group).agg(
                    F.first("_ranges").alias("_ranges"), *[F.sum(F.get("_below", F.lit(i))).alias(f"_b{i}") for i in own]
                )
                at = F.array(*[F.struct(F.get("_ranges", F.lit(i))["_pos"].alias("_pos"), F.col(f"_b{i}").alias("_before")) for i in own])
                part = sums.select(self.group, F.inline(F.filter(at, lambda x: x["_pos"].isNotNull())))
                counts = part if counts is None else counts.unionByName(part)
            near = F.filter("_placed", lambda x: (x["h"] >= x["low"]) & (x["h"] <= x["high"]))
            near = rows.select(self.group, "_t", F.inline(near))
            place = Window.partitionBy(self.group, "_pos").orderBy("h", "_t")
            ranked = near.withColumn("_rk", F.row_number().over(place)).join(counts, [self.group, "_pos"])
            cut = F.struct(F.col("h"), F.col("_t").alias("t")).alias("_cut")
            found = checkpointed(ranked.filter(F.col("_before") + F.col("_rk") == F.col("_k")).select(self.group, "_pos", cut))
            parts.append(found)
            sought = checkpointed(sought.join(found, [self.group, "_pos"], "left_anti"))
            if sought.isEmpty():
                return reduce(DataFrame.unionByName, parts)
            width *= 8


@dataclass(frozen=True)
class _CountDraw(_LevelDraw):
    """As above where the levels keep given numbers of rows of every group."""

    counts: tuple[int, ...] = ()

    def remove(self, pos: Column) -> Column:
        return pos

    def kept(self, pos: Column) -> Column:
        return F.get(F.array(*[F.lit(c) for c in self.counts]), pos)


def fixed_entity_ablation(
    df: DataFrame,
    mode: str = "responses_per_task",
    step: int = 1,
    min_keep: int = 1,
    seed: int = 42,
    row_key: list[str] | None = None,
    hash_fn: str = HASH_FN,
    nested: bool = True,
    piece_rows: int = SPLIT_ROWS,
) -> Study:
    """Remove more and more rows of every group while all tasks and workers remain.

    At level ``remove`` a group with d distinct partners keeps its first max(d - remove, min_keep)
    rows, so the row at place j is last kept at level d - j (at every level if j <= min_keep).
    Levels after the first one that loses a task or a worker are left out. ``nested=False`` orders
    the rows anew for every level (see ``_LevelDraw``).
    """
    if mode == "responses_per_task":
        group, entity = "qid", "uid"
    elif mode == "tasks_per_worker":
        group, entity = "uid", "qid"
    else:
        raise ValueError("mode must be 'responses_per_task' or 'tasks_per_worker'")
    sizes = checkpointed(df.groupBy(group).agg(F.count_distinct(entity).alias("_d"), F.count(F.lit(1)).alias("_n")))
    least = sizes.agg(F.min("_d")).first()[0]
    removed = range(0, max((least or 0) - min_keep, 0) + 1, step)
    pos = F.col("id").cast("int")
    labels = df.sparkSession.range(len(removed)).select(pos.alias("pos"), (F.lit(removed[-1]) - pos * step).cast("int").alias("remove"))
    kept_rows = F.greatest(F.col("_d") - F.col("remove"), F.lit(min_keep))
    levels = F.explode(F.sequence(F.lit(0), F.lit(removed[-1]), F.lit(step)))
    groups, entities = sizes.count(), df.agg(F.count_distinct(entity)).scalar()
    complete = (F.col(f"n_{group}") == groups) & (F.col(f"n_{entity}") == entities)

    if not nested:
        hashed, ties = with_row_hash(df, seed, row_key, hash_fn=hash_fn)
        keyed = hashed.withColumn("_t", F.xxhash64(F.lit(7), *ties))
        draw = _LevelDraw(group, len(removed), removed[-1], step, min_keep, seed, hash_fn)
        marked = draw.marked(keyed, sizes, piece_rows)
        masks = [f"_m{j}" for j in range(-(-len(removed) // MASK_BITS))]
        every = F.explode(F.sequence(F.lit(0), F.lit(len(removed) - 1)))
        n_obs = sizes.withColumn("_pos", every).groupBy("_pos").agg(F.sum(F.least("_n", draw.kept(F.col("_pos")))).alias("n_obs"))
        every = _sample_stats("remove", labels, checkpointed(masked_coverage(marked, masks, len(removed), n_obs)))  # a row per level
        failed = every.filter(~complete).agg(F.coalesce(F.min("remove"), F.lit(removed[-1] + 1))).scalar()
        stats = every.filter(F.col("remove") < failed).select(F.lit(mode).alias("mode"), *every.columns)
        kept = labels.join(stats.select("remove"), "remove", "left_semi")
        held = F.array_compact(F.array(*[F.when(mask_bit(masks[i // MASK_BITS], i % MASK_BITS), F.lit(i)) for i in range(len(removed))]))
        return IndependentStudy("remove", kept, marked.withColumn("_pos", F.explode(held)).select(*df.columns, "_pos"), stats)

    hashed, ties = with_row_hash(df, seed, row_key, hash_fn=hash_fn)
    ranked = rank_in_group(hashed, [group], ["_h", *ties], sizes, piece_rows)
    last = F.when(F.col("_rk") <= min_keep, F.lit(len(removed) - 1)).otherwise(
        F.least(F.floor((F.col("_d") - F.col("_rk")) / step), F.lit(len(removed) - 1))
    )
    rows = (
        ranked.withColumn("lvl", (F.lit(len(removed) - 1) - last).cast("int"))
        .filter(F.col("lvl") < len(removed))
        .select(*df.columns, "lvl")
    )
    study = _study("remove", labels, rows)
    stats = study.stats.filter(complete).select(F.lit(mode).alias("mode"), *study.stats.columns)
    kept = labels.join(stats.select("remove"), "remove", "left_semi")
    return Study("remove", kept, rows, stats)


def scenario(
    df: DataFrame,
    scenario_id: str,
    seed: int = 42,
    counts: list[int] | None = None,
    row_key: list[str] | None = None,
    hash_fn: str = HASH_FN,
    nested: bool = True,
) -> Study:
    """Coverage with k workers, k tasks, t tasks per worker, or w responses per task."""
    spark = df.sparkSession
    if scenario_id in ("worker", "task"):
        key, name, default = (
            ("uid", "workers", WORKER_COUNTS) if scenario_id == "worker" else ("qid", "tasks", TASK_COUNTS)
        )
        wanted = counts or default
        choice = choose_keys(df, key, seed, lambda n: [min(c, n) for c in wanted], hash_fn)
        labels = _labels(spark, name, choice.ks)
        if nested:
            return _study(name, labels, _keep_choices(df, [choice]), by_pair=True)
        return _independent(name, labels, df, [key], seed, lambda n: choice.ks, hash_fn)
    if scenario_id in ("tasks_per_worker", "responses_per_task"):
        group, name, default = (
            ("uid", "tasks_per_worker", MAX_TASKS_PER_WORKER)
            if scenario_id == "tasks_per_worker"
            else ("qid", "workers_per_task", MAX_RESPONSES_PER_TASK)
        )
        wanted = counts or list(range(1, default + 1))
        labels = _labels(spark, name, wanted)

        hashed, ties = with_row_hash(df, str(seed), row_key, hash_fn=hash_fn)
        if not nested:
            return _group_draws(df, hashed, ties, group, wanted, name, labels, seed, hash_fn)
        level = sum((F.when(F.col("_rk") > c, 1).otherwise(0) for c in wanted[:-1]), F.lit(0))
        rows = top_in_group(hashed, group, ["_h", *ties], wanted[-1]).withColumn("lvl", level).select(*df.columns, "lvl")
        return _study(name, labels, rows)
    raise ValueError("scenario_id must be 'worker', 'task', 'tasks_per_worker' or 'responses_per_task'")


def _group_draws(
    df: DataFrame, hashed: DataFrame, ties: list[str], group: str, wanted: list[int], name: str, labels: DataFrame, seed: int | str, hash_fn: str
) -> IndependentStudy:
    """Study of a number of rows per group at each level, every level with an order of its own.

    Rows of small groups are drawn and marked where they are gathered. Of a larger group every task keeps the
    first rows of each level before the shuffle, so its levels are unfolded map-side only; such a row comes
    once per level that holds it.
    """
    levels = len(wanted)
    draw = _CountDraw("_g", levels, levels - 1, 1, 0, str(seed), hash_fn, tuple(wanted))
    keyed = hashed.withColumns({"_g": F.struct(group), "_t": F.xxhash64(F.lit(7), *ties)})  # rows without a key are a group too
    sizes = checkpointed(df.groupBy(F.struct(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")))
    large = checkpointed(sizes.filter(F.col("_n") > max(LISTED_DRAWS // levels, 2 * max(wanted))).select("_g"))
    names = [f"_m{j}" for j in range(-(-levels // MASK_BITS))]
    if large.isEmpty():
        marked = draw.listed(keyed, sizes)
    else:
        few = fits_broadcast(large)
        near = join_by_key(keyed, sizes.join(large, "_g", "left_anti").select("_g"), "_g", "left_semi", measured=df.select(F.struct(group).alias("_g")))
        far = keyed.join(F.broadcast(large) if few else large, "_g", "left_semi")
        far = far.withColumn("_pos", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_h", draw.hash(F.col("_pos")))
        place = Window.partitionBy("_g", "_pos").orderBy("_h", *ties)
        far = far.withColumn("_rk", F.row_number().over(place)).filter(F.col("_rk") <= max(wanted)).filter(F.col("_rk") <= draw.kept(F.col("_pos")))
        words = {n: w for n, w in zip(names, level_masks([F.col("_pos") == i for i in range(levels)]))}
        marked = draw.listed(near, sizes).unionByName(far.withColumns(words).select("_g", *[c for c in keyed.columns if c not in ("_g", "_h", "_t")], *names))
    every = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    n_obs = sizes.withColumn("_pos", every).groupBy("_pos").agg(F.sum(F.least(F.col("_n"), draw.kept(F.col("_pos")).cast("bigint"))).alias("n_obs"))
    held = F.array_compact(F.array(*[F.when(mask_bit(names[i // MASK_BITS], i % MASK_BITS), F.lit(i)) for i in range(levels)]))
    rows = marked.withColumn("_pos", F.explode(held)).select(*df.columns, "_pos")
    return IndependentStudy(name, labels, rows, _sample_stats(name, labels, masked_coverage(marked, names, levels, n_obs)))
