import pytest
from pyspark.sql import functions as F

from tallyframe.functions import hashing
from tallyframe.operators import keyorder as ko
from tallyframe.operators.joins import fits_broadcast, heavy_keys, join_by_key, keep_keys
from tallyframe.operators.splits import group_split, side, train_val_split


def answers(spark, tasks=40, workers=15, per_task=6):
    return spark.range(tasks * per_task).select(
        (F.col("id") % tasks).alias("qid"), ((F.col("id") * 7) % workers).alias("uid"), F.col("id").alias("row")
    )


def test_exact_number_of_keys_for_any_partitioning(spark):
    df = answers(spark)
    for k in (0, 1, 7, 39, 40, 100):
        sets = []
        for part in (df, df.repartition(1), df.repartition(13)):
            choice = ko.choose_keys(part, "qid", 5, lambda n: [k])
            assert choice.n == 40
            sets.append({r[0] for r in part.filter(choice.chosen()).select("qid").distinct().collect()})
        assert sets[0] == sets[1] == sets[2]
        assert len(sets[0]) == min(k, 40)


@pytest.mark.parametrize("bits", [0, 3, 12, 20])
def test_cuts_agree_with_ranks(spark, bits):
    df = answers(spark)
    ranks = {r["qid"]: r["rk"] for r in ko.rank_keys(df, "qid", 9, bits=bits).collect()}
    assert sorted(ranks.values()) == list(range(1, 41))
    choice = ko.choose_keys(df, "qid", 9, lambda n: [3, 10, 25], bits=bits)
    kept = choice.keep(df, "lvl").select("qid", "lvl").distinct().collect()
    assert {r["qid"]: r["lvl"] for r in kept} == {
        q: 0 if k <= 3 else 1 if k <= 10 else 2 for q, k in ranks.items() if k <= 25
    }


def test_cuts_by_longer_prefixes(spark, monkeypatch):
    df = spark.range(5000).withColumnRenamed("id", "qid")
    ks = [1, 17, 2500, 4999, 5000]
    plain = ko.choose_keys(df, "qid", 3, lambda n: ks).cuts
    monkeypatch.setattr(ko, "FETCH_KEYS", 2)
    for bits in (0, 1, 5, 12):
        assert ko.choose_keys(df, "qid", 3, lambda n: ks, bits=bits).cuts == plain


def test_equal_hashes_are_told_apart_by_key(spark, monkeypatch):
    monkeypatch.setattr(ko, "hash48", lambda seed, *c, fn="": (hashing.as_column(c[-1]) % 3).cast("bigint"))
    df = answers(spark)
    choice = ko.choose_keys(df, "qid", 1, lambda n: [5])
    assert choice.cuts[0].key is not None
    assert df.filter(choice.chosen()).select("qid").distinct().count() == 5


def test_string_keys(spark):
    df = answers(spark).withColumn("qid", F.concat(F.lit("task "), "qid"))
    choice = ko.choose_keys(df, "qid", 1, lambda n: [11])
    assert df.filter(choice.chosen()).select("qid").distinct().count() == 11


def test_choice_is_uniform(spark):
    keys = spark.range(200).withColumnRenamed("id", "qid")
    hits = {}
    for seed in range(30):
        for r in keys.filter(ko.choose_keys(keys, "qid", seed, lambda n: [50]).chosen()).collect():
            hits[r[0]] = hits.get(r[0], 0) + 1
    assert sum(hits.values()) == 1500
    assert max(hits.values()) < 20  # mean 7.5, sd 2.4


def test_split_is_disjoint_and_whole(spark):
    df = answers(spark)
    for by in ("qid", "uid"):
        split = group_split(df, by, 0.25, seed=3)
        sides = {r["split"]: r for r in split.groupBy("split").agg(
            F.count_distinct(by).alias("k"), F.count("*").alias("n")).collect()}
        n = df.select(by).distinct().count()
        assert sides["test"]["k"] == -(-n // 4) and sides["train"]["k"] == n - -(-n // 4)
        assert sides["test"]["n"] + sides["train"]["n"] == df.count()
        train, test = side(split, "train"), side(split, "test")
        assert train.select(by).intersect(test.select(by)).isEmpty()


def test_split_frac_keeps_nine_of_ten(spark):
    df = answers(spark, workers=10)
    split = group_split(df, "qid", 0.2, frac=0.9, seed=1)
    assert side(split, "train").select("uid").distinct().count() == 9
    whole = group_split(df, "qid", 0.2, seed=1)
    assert side(split, "test").exceptAll(side(whole, "test")).isEmpty()


def test_split_errors(spark):
    one = spark.createDataFrame([(1, 1)], "qid long, uid long")
    with pytest.raises(ValueError):
        group_split(one, "qid", 0.25)
    with pytest.raises(ValueError):
        group_split(answers(spark), "row", 0.25)
    with pytest.raises(ValueError):
        ko.split_size(10, 1.5)
    assert ko.split_size(10, 0.25) == 3 and ko.split_size(10, 4) == 4


def test_validation_split_needs_five_tasks(spark):
    four = answers(spark, tasks=4)
    assert [r[0] for r in train_val_split(four, 0.5).select("split").distinct().collect()] == ["train"]
    assert [r[0] for r in train_val_split(answers(spark), 0).select("split").distinct().collect()] == ["train"]
    assert train_val_split(answers(spark).limit(0), 0.5).isEmpty()
    ten = train_val_split(answers(spark, tasks=10), 0.25).filter("split = 'val'")
    assert ten.select("qid").distinct().count() == 3


def test_copies_are_numbered_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(ko, "COPY_CHUNK", 4)
    df = spark.range(23).select(F.when(F.col("id") < 20, 1).otherwise(2).alias("a"))
    got = sorted((r["a"], r["_copy"]) for r in ko.number_copies(df).collect())
    assert got == [(1, i) for i in range(1, 21)] + [(2, i) for i in range(1, 4)]


def test_copies_of_one_row_leave_many_tasks(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = ko.number_copies(df).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in made) == 1_000_000 and len(made) > 1


def test_split_groups_rank_like_whole_groups(spark):
    df = spark.range(600).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7).alias("g"), F.col("id").alias("row"))
    hashed, ties = ko.with_row_hash(df, 4, ["row"])
    sizes = df.groupBy("g").agg(F.count("*").alias("_n"))
    whole = ko.rank_in_group(hashed, ["g"], ["_h", *ties], sizes)
    pieces = ko.rank_in_group(hashed, ["g"], ["_h", *ties], sizes, piece_rows=25)
    a = sorted((r["g"], r["row"], r["_rk"]) for r in whole.collect())
    assert a == sorted((r["g"], r["row"], r["_rk"]) for r in pieces.collect())
    assert sorted(k for g, _, k in a if g == 0) == list(range(1, sum(1 for g, _, _ in a if g == 0) + 1))


def test_pieces_bound_the_window(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("row"))
    hashed, ties = ko.with_row_hash(df, 4, ["row"])
    sizes = df.groupBy("g").agg(F.count("*").alias("_n"))
    pieces = ko.rank_in_group(hashed, ["g"], ["_h", *ties], sizes, piece_rows=500)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "_b" in plan.split("Window [row_number()")[1].split("\n")[0]


def test_rank_rows_and_sorted(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("v"), F.col("id").alias("row"))
    hashed, ties = ko.with_row_hash(df, 4, ["row"])
    assert sorted(r["_rk"] for r in ko.rank_rows(hashed, ["_h", *ties]).collect()) == list(range(1, 501))
    ranked = ko.rank_sorted(df.repartition(7), ["v", "row"]).orderBy("_rk").collect()
    assert [r["_rk"] for r in ranked] == list(range(1, 501))
    assert [(r["v"], r["row"]) for r in ranked] == sorted((i % 3, i) for i in range(500))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_join_equals_plain_join(spark, how):
    rows = spark.range(900).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id") % 50).alias("qid"), (F.col("id") % 4).alias("x"))
    table = spark.range(40).select(F.col("id").alias("qid"), (F.col("id") * 10).alias("v"))
    plain = rows.join(table, "qid", how)
    salted = join_by_key(rows, table, "qid", how, max_rows=5, hot_parts=10)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.select(plain.columns).collect()), key=str)
    assert join_by_key(rows, table, "qid", how).count() == plain.count()


def test_salted_join_survives_equal_rows_and_duplicates(spark):
    rows = spark.range(1000).select(F.lit(1).alias("qid"))
    table = spark.createDataFrame([(1, "a"), (1, "b")] + [(i, "c") for i in range(2, 20)], "qid long, v string")
    assert join_by_key(rows, table, "qid", max_rows=5, hot_parts=10).count() == 2000


def test_keep_keys(spark):
    keys = spark.createDataFrame([(1,), (1,), (3,)], "qid long")
    assert {r["qid"] for r in keep_keys(answers(spark), keys, "qid").collect()} == {1, 3}


def test_draws(spark):
    df = spark.range(20000)
    u = df.select(hashing.u01(1, "id").alias("u"), hashing.n01(1, "id").alias("n"), hashing.n01(1, "id", fn="md5").alias("m"))
    r = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("n"), F.stddev("n"), F.avg("m"), F.stddev("m")).first()
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.01
    assert abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03 and abs(r[5]) < 0.03 and abs(r[6] - 1) < 0.03
    with pytest.raises(ValueError):
        hashing.hash48(1, "id", fn="crc")


def test_salts_follow_the_heat_and_null_keys_are_spread(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 500, 1).when(F.col("id") < 800, F.lit(None)).otherwise(F.col("id")).alias("qid"))
    table = spark.range(900).select(F.col("id").alias("qid"), F.lit("v").alias("v"))
    joined = join_by_key(rows, table, "qid", max_rows=5, hot_parts=20)
    assert joined.count() == 1000 and joined.filter("v is null").count() == 400
    assert not fits_broadcast(spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t")), max_bytes=5000)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("copies", [1, 30])
def test_heavy_keys_join_by_a_sketch(spark, how, copies):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, 1).when(F.col("id") < 1600, 2).when(F.col("id") < 2000, F.lit(None)).otherwise(F.col("id") % 50).alias("qid"), (F.col("id") % 4).alias("x")
    )
    table = spark.range(40 * copies).select((F.col("id") % 40).alias("qid"), (F.col("id") * 10).alias("v"))
    heavy, without = heavy_keys(rows, "qid", 300)
    assert len(heavy) == 2 and sorted(heavy.values()) == [620, 1020] and without == 400
    joined = join_by_key(rows, table, "qid", how, max_rows=10, hot_rows=300)
    plain = rows.join(table, "qid", how)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, joined.select(plain.columns).collect()), key=str)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (copies > 1) and "Union" in plan
    assert joined.columns[0] == "qid"


def test_no_heavy_keys_is_a_plain_join(spark):
    rows, table = spark.range(500).withColumnRenamed("id", "qid"), spark.range(100).withColumnRenamed("id", "qid")
    joined = join_by_key(rows, table, "qid", "inner", max_rows=10)
    assert joined.count() == 100 and "Union" not in joined._jdf.queryExecution().optimizedPlan().toString()
    text = rows.select(F.concat(F.lit("k"), (F.col("qid") % 3).cast("string")).alias("k"))
    keys = spark.range(90).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    assert join_by_key(text, keys, "k", "inner", max_rows=10, hot_rows=50).count() == 500


def test_rank_in_group_takes_more_tasks_for_more_rows(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 100).alias("g"), F.xxhash64("id").bitwiseAND(F.lit((1 << 48) - 1)).alias("_h"), "id")
    sizes = rows.groupBy("g").agg(F.count("*").alias("_n"))
    once = {(r["id"], r["_rk"]) for r in ko.rank_in_group(rows, ["g"], ["_h", "id"], sizes).collect()}
    monkeypatch.setattr(ko, "RANKED_ROWS", 100)
    ranked = ko.rank_in_group(rows, ["g"], ["_h", "id"], sizes)
    assert {(r["id"], r["_rk"]) for r in ranked.collect()} == once
    assert ", 30)" in ranked._jdf.queryExecution().executedPlan().toString()
