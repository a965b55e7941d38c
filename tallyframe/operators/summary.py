"""Error summaries and tables for curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.constants import Z95
from tallyframe.functions.student import t_quantile_column


def _mean_std_n(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )


def error_summary(
    df: DataFrame,
    keys: tuple[str, ...] = ("agent", "num_workers"),
    value: str = "error",
    method: str = "normal",
    confidence: float = 0.95,
) -> DataFrame:
    """A4: mean, standard deviation and half-width per group; a group of one has half-width 0.

    'normal' is 1.96 * std / sqrt(n) whatever the level; 't' uses Student's t at ``confidence``.
    """
    if method not in ("normal", "t"):
        raise ValueError("method must be 'normal' or 't'")
    groups = _mean_std_n(df, list(keys), value)
    factor = F.lit(Z95) if method == "normal" else t_quantile_column((1 + confidence) / 2, F.col("n") - 1)
    ci = F.when(F.col("n") > 1, factor * F.col("std") / F.sqrt("n")).otherwise(0.0)
    return groups.withColumn("ci", ci).select(*keys, "mean", "std", "ci")


def mean_ci(df: DataFrame, keys: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """A5: mean and Student-t half-width per group; NULL half-width for a group of one."""
    groups = _mean_std_n(df, keys, value)
    half = F.col("std") / F.sqrt("n") * t_quantile_column((1 + confidence) / 2, F.col("n") - 1)
    return groups.withColumn("h", half).select(*keys, "n", "mean", "h")


def flatten_errors(df: DataFrame, agents: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records (num_workers, time, errors: map agent -> list) as two long tables."""
    by_agent = df.select("num_workers", F.explode("errors").alias("agent", "_list"))
    errors = by_agent.filter(F.col("agent").isin(list(agents))).select(
        "num_workers", "agent", F.explode("_list").alias("error")
    )
    return errors, df.select("num_workers", "time")


def compare_times(
    a: DataFrame, b: DataFrame, key: str = "num_workers",
    names: tuple[str, str] = ("time_a", "time_b"), values: tuple[str, str] | None = None,
) -> DataFrame:
    """Two timing tables side by side; the value column is the second one unless named."""
    left, right = values or (a.columns[1], b.columns[1])
    return a.select(key, F.col(left).alias(names[0])).join(b.select(key, F.col(right).alias(names[1])), key)


def _labelled(agent: Column, labels: dict[str, str]) -> Column:
    plain = F.replace(agent, F.lit("_"), F.lit(" "))
    if not labels:
        return plain
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(known[agent], plain)


def band_table(summary: DataFrame, agents: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """Curve and band of the chosen agents, in the given order (``ord``)."""
    order = F.array_position(F.array(*[F.lit(a) for a in agents]), F.col("agent")).cast("int") - 1
    return summary.filter(F.col("agent").isin(list(agents))).select(
        order.alias("ord"), "agent", _labelled(F.col("agent"), labels or {}).alias("label"),
        F.col("num_workers").alias("x"), F.col("mean").alias("y"),
        (F.col("mean") - F.col("ci")).alias("lower"), (F.col("mean") + F.col("ci")).alias("upper"),
    )


def band_pair(
    df: DataFrame, k: str, first: tuple[str, str], second: tuple[str, str], labels: tuple[str, str],
) -> DataFrame:
    """A8 for two series: columns (mean, ci) of each over the same axis, as one long table."""
    series = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.col(mean).alias("y"),
            (F.col(mean) - F.col(ci)).alias("lower"), (F.col(mean) + F.col(ci)).alias("upper"),
        )
        for (mean, ci), label in zip((first, second), labels)
    ])
    return df.select(F.col(k).alias("x"), F.explode(series).alias("_s")).select("x", "_s.*")


# Places of an axis that are made at once.
AXIS_PIECE = 65_536


def _common_axis(runs: DataFrame) -> DataFrame:
    """From (n, first, last) per run: mean length rounded half to even, latest start, earliest end.

    The axis is cut into pieces that leave in an exchange, and its places are made piece by piece, so
    one as long as the data is spread over tasks and never stands in one array.
    """
    axis = runs.agg(
        F.bround(F.avg("n")).cast("int").alias("length"),
        F.max("first").cast("double").alias("k_start"), F.min("last").cast("double").alias("k_end"),
    ).filter(F.col("length") > 0)
    pieces = axis.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(AXIS_PIECE))))
    spread = pieces.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_from")  # a given number is not merged again
    upto = F.least(F.col("length"), F.col("_from") + AXIS_PIECE) - 1
    places = spread.select("length", "k_start", "k_end", F.explode(F.sequence("_from", upto)).alias("pos"))
    step = (F.col("k_end") - F.col("k_start")) / F.nullif(F.col("length") - 1, F.lit(0))
    k = F.when(F.col("length") == 1, F.col("k_start")).when(F.col("pos") == F.col("length") - 1, F.col("k_end"))
    return places.select("length", "pos", k.otherwise(F.col("k_start") + F.col("pos") * step).alias("k"))


def fixed_k(df: DataFrame, runs: str) -> DataFrame:
    """Common axis of runs given as arrays. Empty runs are left out (see ``empty_runs``)."""
    k = F.col(runs)
    return _common_axis(
        df.filter(F.array_size(k) > 0).select(
            F.array_size(k).alias("n"), F.element_at(k, 1).alias("first"), F.element_at(k, -1).alias("last")
        )
    )


def empty_runs(df: DataFrame, runs: str) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(F.array_size(runs), F.lit(0)) == 0).alias("n_empty"))


def fixed_k_long(df: DataFrame, run: str, k: str) -> DataFrame:
    """A6 for runs kept as rows (run, k) with a rising axis: no run is ever gathered."""
    return _common_axis(
        df.groupBy(run).agg(F.count(k).alias("n"), F.min(k).alias("first"), F.max(k).alias("last"))
    )
