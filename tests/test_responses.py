import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe.config import ResponseConfig
from tallyframe.functions import columns as fc
from tallyframe.operators import coverage, responses as rs
from tallyframe.plans.prepare import prepare
from tallyframe.sources.tables import read_responses, read_sides, write_samples, write_split

NAN = float("nan")
CFG = ResponseConfig(
    qid_col="question_id", uid_col="worker_id", human_score_col="rating", embedding_col="embedding", text_col="text",
    categorical_features=("gender", "how_connected"), reference_score_col="llm_score", baseline_prefix="r",
    num_baseline_ratings=3, test_size=0.5, seed=1,
)
RAW = "question_id long, worker_id long, rating double, embedding string, text string, gender string, how_connected boolean"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (1, 10, 4.0, "[0.1, 0.2]", "a", "f", True), (1, 11, 2.0, "[0.1, 0.2]", "a", None, False),
        (2, 10, 3.0, "[1, 2.5]", "b", "f", True), (3, 12, 5.0, "1,2", "c", "m", None),
    ]
    return spark.createDataFrame(rows, RAW)


def test_canonicalize(raw):
    assert rs.canonicalize(raw, CFG).columns == [
        "qid", "uid", "human_score", "task_embedding", "gender", "how_connected"
    ]
    assert rs.canonicalize(raw.drop("text"), CFG).columns[0] == "qid"


def test_one_hot(raw, spark):
    df, names = rs.one_hot(raw.select("question_id", "gender", "how_connected"), ["gender", "how_connected"])
    assert names == ["gender_f", "gender_m", "gender_nan", "how_connected_False", "how_connected_True", "how_connected_nan"]
    assert df.columns == ["question_id", *names]
    assert all(sum(r[1:4]) == 1 and sum(r[4:]) == 1 for r in df.collect())
    unseen = spark.createDataFrame([("x", None)], "gender string, how_connected boolean")
    row = rs.one_hot_apply(unseen, {"gender": ["f"], "how_connected": ["nan"]}).first()
    assert tuple(row) == (0.0, 1.0)
    with pytest.raises(ValueError):
        rs.one_hot_fit(raw, ["gender"], max_categories=2)
    assert rs.one_hot_fit(raw, []) == {}


def test_one_hot_sparse_has_no_limit(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("v"), F.format_string("%05d", "id")).alias("f"))
    got = rs.one_hot_sparse(df, ["f"]).orderBy("id").collect()
    assert [r["context_idx"] for r in got] == [[i] for i in range(3000)]
    few = rs.vocabulary_table(df.limit(10), ["f"])
    assert rs.one_hot_sparse(df.filter("id = 2999"), ["f"], few).first()["context_idx"] == []


def test_parse_embedding(spark):
    df = spark.createDataFrame([("[1, 2.5, -3e-2]",), ("1,2",), ("[1,None]",), ("[1,null]",), (None,)], "t string")
    got = [r[0] for r in df.select(fc.parse_embedding("t")).collect()]
    assert [round(x, 4) for x in got[0]] == [1.0, 2.5, -0.03] and got[1:] == [None] * 4
    round_ones = spark.createDataFrame([("(1, 2)",), (" ( 3,) ",), ("(1, 2",), ("(a)",)], "t string")  # brackets of both kinds are read
    assert [r[0] for r in round_ones.select(fc.parse_embedding("t")).collect()] == [[1.0, 2.0], [3.0], None, None]


def test_vector_report(spark, raw):
    row = rs.vector_report(rs.canonicalize(raw, CFG), "task_embedding").first()
    assert row["n_unreadable"] == 1 and row["n_without_key"] == 0 and (row["shortest"], row["longest"]) == (2, 2)
    assert prepare(raw, *(spark.createDataFrame([], t) for t in ("question_id long, llm_score double", "question_id long, r1 double")), CFG).report.first() == row


def test_split_rejects_missing_keys(spark):
    from tallyframe.operators.splits import group_split, train_val_split

    rows = spark.createDataFrame([(i if i else None, 1) for i in range(12)], "qid long, uid long")
    with pytest.raises(ValueError, match="qid is missing"):
        group_split(rows, "qid", 0.2)
    with pytest.raises(ValueError, match="qid is missing"):
        train_val_split(rows, 0.2)


def test_vector_casts(spark):
    df = spark.createDataFrame([([1.9, -1.9],)], "v array<double>")
    assert df.select(fc.as_long_array(df, "v")).first()[0] == [1, -1]
    assert [round(x, 5) for x in df.select(fc.as_float_array(df, "v")).first()[0]] == [1.9, -1.9]
    nan = spark.createDataFrame([([NAN, 2.0],)], "v array<double>")
    assert nan.select(fc.as_long_array(nan, "v", strict=False)).first()[0] == [None, 2]
    with pytest.raises(PySparkException):
        nan.select(fc.as_long_array(nan, "v")).collect()
    with pytest.raises(TypeError):
        fc.as_float_array(spark.createDataFrame([("x",)], "v string"), "v")


def test_ratings_and_fills(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, NAN, 3.0)], "qid long, r1 double, r2 double")
    assert [r[0] for r in df.select(fc.ratings_to_array(df, "r", 3)).collect()] == [[2.0, 0.0, 0.0], [0.0, 3.0, 0.0]]


def test_attach(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    refs = spark.createDataFrame([(1, 4.5), (2, NAN), (1, 5.5)], "question_id long, llm_score double")
    got = sorted((r["qid"], r["yref_llm"]) for r in rs.attach_reference(rows, refs, CFG).collect())
    assert got == [(1, 4.5), (1, 5.5), (2, 0.0), (3, 0.0)]
    with pytest.raises(ValueError):
        rs.attach_reference(rows, refs, CFG, on_duplicate="error")
    base = spark.createDataFrame([(1, 1.0, None)], "question_id long, r1 double, r2 double")
    got = {r["qid"]: r["baseline_llm_ratings_dist"] for r in rs.attach_baseline(rows, base, CFG).collect()}
    assert got == {1: [1.0, 0.0, 0.0], 2: [0.0] * 3, 3: [0.0] * 3}


def test_score_range(spark):
    make = lambda v: spark.createDataFrame([(x,) for x in v], "human_score double")
    assert tuple(rs.score_range(make([])).first()) == (1.0, 10.0)
    assert tuple(rs.score_range(make([NAN, None])).first()) == (1.0, 10.0)
    assert tuple(rs.score_range(make([NAN, 2.0, 7.0])).first()) == (2.0, 7.0)


def test_counts(spark):
    df = spark.createDataFrame([(1, None, 1.0), (None, 2, NAN)], "qid long, uid long, human_score double")
    assert {r["column"]: r["n_missing"] for r in rs.null_counts(df).collect()} == {"qid": 1, "uid": 1, "human_score": 1}
    assert tuple(rs.validate_responses(df).first()) == (2, 1, 1, 1, False)
    assert rs.profile_frame(df).count() == 2


def test_modal_length(spark):
    df = spark.createDataFrame([([0.0] * n, n) for n in (3, 3, 2, 2, 1)] + [(None, 0)], "v array<double>, n int")
    assert [r["n"] for r in rs.modal_length_filter(df, "v").collect()] == [2, 2]
    assert tuple(rs.check_dim(df, "v").first()) == (1, 3, 1, False)


def test_clamp_and_grid(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (9.0,), (NAN,), (None,)], "x double")
    got = [r[0] for r in df.select(fc.clamp("x", 1, 5)).collect()]
    assert got[:3] == [1.0, 3.0, 5.0] and got[3] != got[3] and got[4] is None
    df = spark.createDataFrame([(1.0, 2.0, 5), (3.0, 1.0, 1), (0.0, 1.0, 0)], "a double, b double, n int")
    assert [r[0] for r in df.select(fc.linspace("a", "b", "n")).collect()] == [[1.0, 1.25, 1.5, 1.75, 2.0], [3.0], []]
    assert fc.linspace_values(1.0, 0.1, 50)[-1] == 0.1 and fc.linspace_values(2, 3, 1) == [2.0]


def test_prepare(spark, raw):
    refs = spark.createDataFrame([(1, 4.5)], "question_id long, llm_score double")
    base = spark.createDataFrame([(1, 1.0, 2.0)], "question_id long, r1 double, r2 double")
    out = prepare(raw, refs, base, CFG)
    assert out.table.columns == [
        "qid", "uid", "human_score", "task_embedding", "yref_llm", "baseline_llm_ratings_dist",
        "gender_f", "gender_m", "gender_nan", "how_connected_False", "how_connected_True", "how_connected_nan", "split",
    ]
    assert out.train.count() + out.test.count() == 4
    assert tuple(out.score_range.first()) == (2.0, 5.0)
    assert out.train.select("qid").intersect(out.test.select("qid")).isEmpty()
    assert out.table.filter("task_embedding is null").count() == 1
    fitted = prepare(raw, refs, base, CFG, fit_on="train")
    assert set(fitted.features) <= set(out.features)


def test_source_and_sinks(spark, raw, tmp_path):
    raw.write.parquet(f"{tmp_path}/raw")
    df = read_responses(spark, f"{tmp_path}/raw", CFG)
    assert df.columns[0] == "qid"
    plan = df.filter("qid = 1").select("uid")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(question_id), EqualTo(question_id,1)]" in plan
    write_split(df.withColumn("split", F.when(F.col("qid") == 1, "test").otherwise("train")), f"{tmp_path}/split")
    back = spark.read.parquet(f"{tmp_path}/split").filter("split = 'test'")
    assert back.count() == 2 and "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().executedPlan().toString()
    write_samples(df.withColumn("level", F.lit(3)), "level", f"{tmp_path}/levels")
    assert spark.read.parquet(f"{tmp_path}/levels").first()["level"] == 3


def test_profiles_merge(spark):
    rows = spark.range(20_000).select(
        (F.col("id") % 7).alias("day"), F.col("id").alias("n"), F.when(F.col("id") % 4 > 0, (F.col("id") % 1000).cast("double")).otherwise(float("nan")).alias("x"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("w"), (F.col("id") % 300).cast("string"))).alias("t"), F.lit(None).cast("int").alias("nothing"),
    )
    names = ["n", "x", "t", "nothing"]
    parts = rs.profile_sketches(rows, names, ["day"])
    assert parts.count() == 28
    whole = {r["column"]: r for r in rs.read_profile(rs.profile_sketches(rows, names)).collect()}
    merged = {r["column"]: r for r in rs.read_profile(rs.merge_profiles(parts)).collect()}
    for got in (whole, merged):
        assert {c: (r["n_rows"], r["n_missing"]) for c, r in got.items()} == {"n": (20_000, 0), "x": (20_000, 5_000), "t": (20_000, 10_000), "nothing": (20_000, 20_000)}
        assert (got["n"]["smallest"], got["n"]["largest"], got["t"]["smallest_text"], got["t"]["largest_text"]) == (0.0, 19_999.0, "w0", "w98")
        assert all(abs(got[c]["n_distinct"] / n - 1) < 0.06 for c, n in (("n", 20_000), ("x", 750), ("t", 150))) and got["nothing"]["n_distinct"] == 0
        assert all(abs(v / 20_000 - share) < 0.04 for v, share in zip(got["n"]["quantiles"], (0.25, 0.5, 0.75)))
        assert got["t"]["quantiles"] is None and got["nothing"]["smallest"] is None
    counts = coverage.entity_counts(rows.select(F.col("n").alias("qid"), F.col("t").alias("uid")), approx=True).first()
    assert abs(counts["n_qid"] / 20_000 - 1) < 0.08 and abs(counts["n_uid"] / 150 - 1) < 0.08 and counts["n_obs"] == 20_000
    assert rs.read_profile(rs.profile_sketches(rows.limit(0), names)).count() == 4
    with pytest.raises(ValueError):
        rs.profile_sketches(rows.withColumn("a", F.array("n")), ["a"])


def test_sides_are_pruned_while_the_query_runs(spark, tmp_path):
    write_split(spark.range(90).withColumn("split", F.when(F.col("id") % 9 == 0, "test").otherwise("train")), f"{tmp_path}/split")
    sizes = spark.read.parquet(f"{tmp_path}/split").groupBy("split").count()
    back = read_sides(spark, f"{tmp_path}/split", sizes.filter("count < 50"))
    assert "dynamicpruning" in back._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in back.collect()) == list(range(0, 90, 9))
