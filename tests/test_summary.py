import math

import pytest
from pyspark.sql import functions as F
from tallyframe.functions.student import t_quantile
from tallyframe.operators import summary


def test_t_quantile():
    known = {1: 12.7062, 2: 4.30265, 5: 2.57058, 10: 2.22814, 30: 2.04227, 120: 1.97993}
    assert all(abs(t_quantile(0.975, n) - t) < 1e-4 for n, t in known.items())
    assert t_quantile(0.5, 3) == 0 and abs(t_quantile(0.025, 5) + 2.57058) < 1e-4
    assert math.isnan(t_quantile(0.9, 0)) and abs(t_quantile(0.975, 1e7) - 1.959964) < 1e-5


def test_error_summary(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 1, 3.0), ("b", 2, 5.0)], "agent string, num_workers int, error double")
    got = {r["agent"]: tuple(r)[2:] for r in summary.error_summary(df).collect()}
    assert got["a"][:2] == (2.0, 1.0) and abs(got["a"][2] - 1.96 / 3 ** 0.5) < 1e-12 and got["b"] == (5.0, None, 0.0)
    t = {r["agent"]: r["ci"] for r in summary.error_summary(df, method="t").collect()}
    assert abs(t["a"] - 2.48414) < 1e-4 and t["b"] == 0.0
    ci = {r["agent"]: (r["n"], r["mean"], r["h"]) for r in summary.mean_ci(df, ["agent"], "error").collect()}
    assert ci["a"][:2] == (3, 2.0) and abs(ci["a"][2] - 2.48414) < 1e-4 and ci["b"] == (1, 5.0, None)
    with pytest.raises(ValueError):
        summary.error_summary(df, method="z")


def test_flatten(spark):
    df = spark.createDataFrame(
        [(1, 0.5, {"a": [1.0, 2.0], "b": [3.0]}), (2, 0.7, {"a": []}), (3, 0.9, {"other": [9.0]})],
        "num_workers int, time double, errors map<string,array<double>>",
    )
    errors, times = summary.flatten_errors(df, ["a", "b"])
    assert sorted(map(tuple, errors.collect())) == [(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0)]
    assert sorted(map(tuple, times.collect())) == [(1, 0.5), (2, 0.7), (3, 0.9)]


def test_compare_times(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "num_workers int, t double")
    b = spark.createDataFrame([(2, 0.5), (3, 0.6)], "num_workers int, other double")
    assert [tuple(r) for r in summary.compare_times(a, b, names=("x", "y")).collect()] == [(2, 0.2, 0.5)]
    assert summary.compare_times(a, b, values=("t", "other")).columns == ["num_workers", "time_a", "time_b"]


def test_bands(spark):
    df = spark.createDataFrame([("big_one", 1, 2.0, 0.0, 0.5), ("b", 1, 3.0, 0.0, 1.0), ("c", 1, 0.0, 0.0, 0.0)],
                               "agent string, num_workers int, mean double, std double, ci double")
    got = [tuple(r) for r in summary.band_table(df, ["b", "big_one"], {"b": "B!"}).orderBy("ord").collect()]
    assert got == [(0, "b", "B!", 1, 3.0, 2.0, 4.0), (1, "big_one", "big one", 1, 2.0, 1.5, 2.5)]
    assert summary.band_table(df, ["big_one"]).first()["label"] == "big one"
    pair = spark.createDataFrame([(1.0, 2.0, 0.5, 3.0, 1.0)], "k double, m1 double, c1 double, m2 double, c2 double")
    got = sorted(map(tuple, summary.band_pair(pair, "k", ("m1", "c1"), ("m2", "c2"), ("one", "two")).collect()), key=str)
    assert got == [(1.0, "one", 2.0, 1.5, 2.5), (1.0, "two", 3.0, 2.0, 4.0)]


def test_fixed_k(spark):
    runs = lambda *r: spark.createDataFrame([(x,) for x in r], "k array<double>")
    axis = lambda df: [r["k"] for r in summary.fixed_k(df, "k").orderBy("pos").collect()]
    assert axis(runs([0.0, 4.0], [1.0, 2.0, 5.0])) == [1.0, 4.0]  # mean length 2.5 rounds to 2
    assert axis(runs([3.0])) == [3.0]
    assert axis(runs([3.0, 4.0, 9.0], [0.0, 0.5, 1.0])) == [3.0, 2.0, 1.0]
    assert axis(runs([1.0, 2.0], [])) == [1.0, 2.0] and summary.empty_runs(runs([], [1.0], None), "k").first()[0] == 2
    long = spark.createDataFrame([(1, 0.0), (1, 4.0), (2, 1.0), (2, 2.0), (2, 5.0)], "run int, k double")
    assert [r["k"] for r in summary.fixed_k_long(long, "run", "k").orderBy("pos").collect()] == [1.0, 4.0]


def test_long_axis_is_made_in_many_tasks(spark):
    runs = spark.createDataFrame([(5_000_000, 1.0, 9.0), (5_000_001, 0.0, 11.0)], "n long, first double, last double")
    axis = summary._common_axis(runs)
    assert axis.rdd.getNumPartitions() > 1
    row = axis.agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.min("k").alias("a"), F.max("k").alias("b"), F.sum("k").alias("s")).first()
    assert (row["n"], row["last"], row["a"], row["b"]) == (5_000_000, 4_999_999, 1.0, 9.0) and abs(row["s"] / 5_000_000 - 5.0) < 1e-9
    sizes = axis.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 5_000_000
    assert summary._common_axis(runs.limit(0)).count() == 0
