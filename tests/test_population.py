import pytest
from pyspark.sql import functions as F

from tallyframe.operators import population as pop


@pytest.fixture(scope="module")
def people(spark):
    rows = [("a", "x")] * 60 + [("b", "x")] * 30 + [("c", None)] * 10
    return spark.createDataFrame(rows, "f string, g string")


def shares(df, feature):
    n = df.count()
    return {r[feature]: r["count"] / n for r in df.groupBy(feature).count().collect()}


def test_marginals(people):
    got = {(r["feature"], r["value"]): (r["n"], r["p"]) for r in pop.fit_marginals(people, ["f", "g"]).collect()}
    assert got == {
        ("f", "a"): (60, 0.6), ("f", "b"): (30, 0.3), ("f", "c"): (10, 0.1), ("g", "x"): (90, 0.9), ("g", "nan"): (10, 0.1),
    }
    assert pop.fit_marginals(people, ["g"], drop_missing=True).first()["p"] == 1.0
    with pytest.raises(ValueError):
        pop.fit_marginals(people, [])


def test_marginals_from_one_hot(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (1.0, 0.0, 0.0)], "how_a double, how_far_b double, z_c double")
    groups = {"how": {"a": "how_a"}, "how_far": {"b": "how_far_b"}, "z": {"c": "z_c", "d": "how_far_b"}}
    got = {(r["feature"], r["value"]): r["p"] for r in pop.marginals_from_one_hot(df, groups).collect()}
    assert got == {("how", "a"): 1.0, ("how_far", "b"): 1.0, ("z", "c"): 0.5, ("z", "d"): 0.5}
    drawn = pop.sample_population(pop.marginals_from_one_hot(df, groups), 4000)
    assert abs(shares(drawn, "z")["c"] - 0.5) < 0.04


@pytest.mark.parametrize("options,expected", [
    ({}, {"a": 0.6, "b": 0.3, "c": 0.1}),
    ({"temperature": 0.5}, {"a": 0.5107, "b": 0.2803, "c": 0.1879}),
    ({"uniform": True}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}),
])
def test_sample(people, options, expected):
    n = 20000
    drawn = pop.sample_population(pop.fit_marginals(people, ["f", "g"]), n, **options)
    assert drawn.count() == n and set(drawn.columns) == {"uid", "f", "g"}
    got = shares(drawn, "f")
    if "temperature" in options:  # softmax of share / T
        import math
        w = {k: math.exp(p / 0.5) for k, p in (("a", 0.6), ("b", 0.3), ("c", 0.1))}
        expected = {k: v / sum(w.values()) for k, v in w.items()}
    assert all(abs(got[k] - p) < 4 * (p * (1 - p) / n) ** 0.5 for k, p in expected.items())


def test_redraw_and_independence(people):
    m = pop.fit_marginals(people, ["f", "g"])
    one, two = pop.sample_population(m, 500, seed=1), pop.sample_population(m, 500, seed=2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, pop.sample_population(m, one.select("uid").repartition(7), seed=1).collect()))
    assert one.select(*two.columns).exceptAll(two).count() > 100
    both = shares(pop.sample_population(m, 20000).withColumn("fg", F.concat("f", "g")), "fg")
    assert abs(both["bx"] - 0.27) < 0.02


def test_written_intervals_draw_the_same(people, monkeypatch):
    m = pop.fit_marginals(people, ["f", "g"])
    local = sorted(map(tuple, pop.sample_population(m, 300).collect()))
    monkeypatch.setattr(pop, "FEW_CATEGORIES", 1)
    assert sorted(map(tuple, pop.sample_population(m, 300).collect())) == local


def test_many_categories_are_joined_by_cell(spark, monkeypatch):
    monkeypatch.setattr(pop, "MAX_BROADCAST_ROWS", 10)
    monkeypatch.setattr(pop, "FEW_CATEGORIES", 10)
    df = spark.range(5000).select(F.col("id").cast("string").alias("f"))
    drawn = pop.sample_population(pop.fit_marginals(df, ["f"]), 3000)
    assert drawn.count() == 3000 and drawn.select("f").distinct().count() > 1500


def test_persona(spark):
    attributes = spark.createDataFrame([("f", None)] + [("m", "x")] * 9, "gender string, race string")
    tasks = spark.range(4000).select(F.col("id").alias("qid"))
    got = pop.assign_persona(tasks, attributes, ["gender", "race"])
    assert got.columns == ["qid", "gender", "race"] and got.filter("race <> 'x'").isEmpty()
    assert abs(shares(got, "gender")["f"] - 0.5) < 0.04  # not weighted by frequency


def test_preferences(spark):
    df = pop.random_preferences(spark, 20000)
    r = df.agg(
        F.min("transport"), F.min("culture"), F.min("nature"), F.min(F.expr("transport + culture + nature")),
        F.max(F.expr("transport + culture + nature")), F.min("f_cost"), F.max("f_cost"),
        F.min(F.expr("District_Nord + District_Ost + District_S + District_West")),
        F.max(F.expr("District_Nord + District_Ost + District_S + District_West")), F.avg("District_S"),
    ).first()
    assert tuple(r)[:9] == (1, 1, 2, 100, 100, 0, 4, 1, 1) and abs(r[9] - 0.25) < 0.02
    assert len(df.columns) == 13


def test_vectors(spark):
    got = pop.random_vectors(spark, 3, dim=5).collect()
    assert all(len(r["comment"]) == 5 and 0 < sum(r["comment"]) < 5 for r in got)
    assert len({tuple(r["comment"]) for r in got}) == 3


def test_soft_shares_keep_their_fractions(spark):
    df = spark.createDataFrame([(0.3, 0.7)] * 3 + [(0.2, 0.8)], "a double, b double")
    rows = pop.marginals_from_one_hot(df, {"f": {"a": "a", "b": "b"}})
    assert {r["value"]: round(r["p"], 6) for r in rows.collect()} == {"a": 0.275, "b": 0.725}
    weights = {r["value"]: r["w"] for r in pop.draw_weights(rows).collect()}
    assert abs(weights["a"] / sum(weights.values()) - 0.275) < 1e-9
    cold = {r["value"]: r["w"] for r in pop.draw_weights(rows, temperature=0.001).collect()}
    assert cold["a"] == 1 and cold["b"] > 1 << 39
