"""Categorical marginals and synthetic populations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyframe.constants import DISTRICTS, PREFERENCE_SCORES, RANDOM_VECTOR_SIZE
from tallyframe.functions.columns import category_text
from tallyframe.functions.hashing import HASH_BITS, HASH_FN, hash48, pick_index, u01
from tallyframe.operators.joins import MAX_BROADCAST_ROWS
from tallyframe.operators.keyorder import BUCKET_BITS
from tallyframe.session import checkpointed

WEIGHT_UNIT = float(1 << 40)
MIN_CELLS, MAX_CELLS = 64, 1 << 20
FEW_CATEGORIES = 10_000


def fit_marginals(df: DataFrame, features: list[str], drop_missing: bool = False) -> DataFrame:
    """(feature, value, n, p) of every category; counted before the shuffle."""
    if not features:
        raise ValueError("no features to learn")
    cells = [
        F.struct(
            F.lit(f).alias("feature"), category_text(df, f).alias("value"), F.col(f).isNull().alias("missing")
        )
        for f in features
    ]
    long = df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    if drop_missing:
        long = long.filter(~F.col("missing"))
    return _shares(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), F.col("n"))


def _shares(table: DataFrame, weight: Column) -> DataFrame:
    """p per feature; uniform when all weights of a feature are 0."""
    totals = table.groupBy("feature").agg(F.sum(weight).alias("_t"), F.count(F.lit(1)).alias("_v"))
    share = F.when(F.col("_t") > 0, weight / F.col("_t")).otherwise(1 / F.col("_v"))
    return table.join(F.broadcast(totals), "feature").withColumn("p", share).drop("_t", "_v")  # one row per feature


def marginals_from_one_hot(df: DataFrame, groups: dict[str, dict[str, str]]) -> DataFrame:
    """P1 from 0/1 columns; ``groups`` maps feature -> value -> column, so no name is taken apart."""
    columns = [(f, v, c) for f, values in groups.items() for v, c in values.items()]
    if not columns:
        raise ValueError("no features to learn")
    sums = df.agg(*[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(f"c{i}") for i, (_, _, c) in enumerate(columns)])
    cells = [
        F.struct(F.lit(f).alias("feature"), F.lit(v).alias("value"), F.col(f"c{i}").alias("_s"))
        for i, (f, v, _) in enumerate(columns)
    ]
    shares = _shares(sums.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*"), F.col("_s"))
    return shares.select("feature", "value", F.round("_s").cast("bigint").alias("n"), "p")  # n: whole counts of soft shares


def draw_weights(marginals: DataFrame, temperature: float = 1.0, uniform: bool = False) -> DataFrame:
    """Integer weight ``w`` per category, so that sums do not depend on their order.

    T = 1 uses the counts, or, where they are not whole, the shares in steps of 2^-40; any other T the
    softmax of share / T in the same steps, ``uniform`` none of them. No category with a share loses it
    to rounding: the least weight is 1.
    """
    if uniform:
        return marginals.select("feature", "value", F.lit(1).cast("bigint").alias("w"))
    if temperature == 1.0:
        off = F.abs(F.col("p") * F.col("_t") - F.col("n")) > 1e-6 * F.greatest(F.col("n"), F.lit(1))
        totals = marginals.groupBy("feature").agg(F.sum("n").alias("_t"))
        soft = marginals.join(F.broadcast(totals), "feature").groupBy("feature").agg(
            F.max("_t").alias("_t"), F.max(off).alias("_soft")
        )
        share = F.when(F.col("p") > 0, F.greatest(F.round(F.col("p") * WEIGHT_UNIT), F.lit(1.0))).otherwise(0)
        counted = F.when(F.col("_soft"), share).when(F.col("_t") > 0, F.col("n")).otherwise(1)
        return marginals.join(F.broadcast(soft), "feature").select(  # one row per feature
            "feature", "value", counted.cast("bigint").alias("w")
        )
    top = marginals.groupBy("feature").agg(F.max("p").alias("_top"))
    soft = F.exp((F.col("p") - F.col("_top")) / F.lit(float(temperature)))
    return marginals.join(F.broadcast(top), "feature").select(
        "feature", "value", F.greatest(F.round(soft * WEIGHT_UNIT), F.lit(1.0)).cast("bigint").alias("w")
    )


def _intervals(weights: DataFrame) -> DataFrame:
    """Half-open integer interval [lo, hi) per category, in hash order.

    Summed per hash bucket first, so categories of one feature are spread over many tasks.
    """
    bucketed = weights.withColumn("_b", F.shiftright("_h", HASH_BITS - BUCKET_BITS))
    sums = bucketed.groupBy("feature", "_b").agg(F.sum("w").alias("_s"))
    running = Window.partitionBy("feature").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.select("feature", "_b", (F.sum("_s").over(running) - F.col("_s")).alias("_off"))
    inside = Window.partitionBy("feature", "_b").orderBy("_h", "value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.withColumn("_cum", F.sum("w").over(inside))
        .join(F.broadcast(offsets), ["feature", "_b"])  # at most 2^bits rows per feature
        .select("feature", "value", (F.col("_off") + F.col("_cum") - F.col("w")).alias("lo"),
                (F.col("_off") + F.col("_cum")).alias("hi"))
    )


@dataclass(frozen=True)
class Sampler:
    """Categories with their intervals; ``sizes``: feature -> (total weight, number of categories)."""

    intervals: DataFrame
    sizes: dict[str, tuple[int, int]]
    hash_fn: str

    def draw(self, ids: DataFrame, key: str, seed: int | str) -> DataFrame:
        """Adds one column per feature to ``ids``, each drawn on its own from (seed, key, feature).

        The range lookup is an equi-join on cells of equal weight: a category is listed in the cells
        it touches, and a draw looks into its own cell. Draws are uniform, so no cell is hot.
        """
        out = ids
        for feature, (total, values) in self.sizes.items():
            cells = min(max(MIN_CELLS, 1 << (values - 1).bit_length()), MAX_CELLS)

            def cell(place: Column) -> Column:
                return F.floor(place / F.lit(float(total)) * cells).cast("int")

            table = (
                self.intervals.filter((F.col("feature") == feature) & (F.col("lo") < F.col("hi")))
                .withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
                .select("_cell", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("value").alias(feature))
            )
            if values + cells <= MAX_BROADCAST_ROWS:
                table = F.broadcast(table)
            place = F.floor(u01(seed, key, F.lit(feature), fn=self.hash_fn) * F.lit(float(total))).cast("bigint")
            drawn = out.withColumn("_place", place).withColumn("_cell", cell(F.col("_place")))
            hit = (F.col("_place") >= F.col("_lo")) & (F.col("_place") < F.col("_hi"))
            out = drawn.join(table, "_cell").filter(hit).drop("_cell", "_place", "_lo", "_hi")
        return out


def sampler(
    marginals: DataFrame, temperature: float = 1.0, uniform: bool = False, hash_fn: str = HASH_FN
) -> Sampler:
    """Prepares draws. The intervals are fixed once, so that the table they were counted from is not
    read again for every feature: few categories as a local table, any number in a written one."""
    spark = marginals.sparkSession
    weights = draw_weights(marginals, temperature, uniform).withColumn("_h", hash48("", "value", fn=hash_fn))
    few = weights.limit(FEW_CATEGORIES + 1).collect()
    if not few:
        raise ValueError("marginals must be fitted before a population is drawn")
    if len(few) <= FEW_CATEGORIES:
        rows, sizes = [], {}
        for r in sorted(few, key=lambda r: (r["feature"], r["_h"], r["value"])):
            total, n = sizes.get(r["feature"], (0, 0))
            rows.append((r["feature"], r["value"], total, total + r["w"]))
            sizes[r["feature"]] = (total + r["w"], n + 1)
        return Sampler(spark.createDataFrame(rows, "feature string, value string, lo bigint, hi bigint"), sizes, hash_fn)
    intervals = checkpointed(_intervals(weights))
    bounds = intervals.groupBy("feature").agg(F.max("hi").alias("total"), F.count(F.lit(1)).alias("n"))
    sizes = {r["feature"]: (r["total"], r["n"]) for r in bounds.orderBy("feature").collect()}  # one row per feature
    return Sampler(intervals, sizes, hash_fn)


def _ids(spark: SparkSession, n: int | DataFrame, key: str) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", key) if isinstance(n, int) else n


def sample_population(
    marginals: DataFrame,
    n: int | DataFrame,
    seed: int = 42,
    temperature: float = 1.0,
    uniform: bool = False,
    key: str = "uid",
    hash_fn: str = HASH_FN,
) -> DataFrame:
    """Synthetic workers, ``n`` of them or one per row of a table of ids.

    Another seed draws the same workers anew.
    """
    return sampler(marginals, temperature, uniform, hash_fn).draw(_ids(marginals.sparkSession, n, key), key, seed)


def assign_persona(
    tasks: DataFrame, attributes: DataFrame, columns: list[str], seed: int = 42, key: str = "qid",
    hash_fn: str = HASH_FN,
) -> DataFrame:
    """A persona per task, each attribute uniform over its distinct non-null values."""
    marginals = fit_marginals(attributes, columns, drop_missing=True)
    drawn = sampler(marginals, uniform=True, hash_fn=hash_fn).draw(tasks, key, seed)
    return drawn.select(*tasks.columns, *columns)


def random_vectors(
    spark: SparkSession, n: int | DataFrame, dim: int = RANDOM_VECTOR_SIZE, seed: int = 42, key: str = "uid",
    hash_fn: str = HASH_FN,
) -> DataFrame:
    """P5: a vector of uniforms per id."""
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: u01(seed, key, j, fn=hash_fn).cast("float"))
    return _ids(spark, n, key).withColumn("comment", vector)


def random_preferences(
    spark: SparkSession, n: int | DataFrame, seed: int = 42, key: str = "uid", hash_fn: str = HASH_FN
) -> DataFrame:
    """Three positive shares of 100, five scores 0-4 and one of four districts per id."""

    def pick(name: str, size: int) -> Column:
        return pick_index(seed, F.lit(size), key, F.lit(name), fn=hash_fn)

    a, b = F.col("_a"), F.col("_b")
    cuts = (
        _ids(spark, n, key)
        .withColumn("_a", 1 + pick("cut1", 98))
        .withColumn("_b", 1 + pick("cut2", 97))
        .withColumn("_b", F.when(b >= a, b + 1).otherwise(b))
        .withColumn("_district", pick("district", len(DISTRICTS)))
    )
    return cuts.withColumns({
        "transport": F.least(a, b),
        "culture": F.greatest(a, b) - F.least(a, b),
        "nature": 100 - F.greatest(a, b),
        **{name: pick(name, 5) for name in PREFERENCE_SCORES},
        **{d: (F.col("_district") == i).cast("bigint") for i, d in enumerate(DISTRICTS)},
    }).drop("_a", "_b", "_district")
