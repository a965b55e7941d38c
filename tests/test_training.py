import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyframe.operators.responses import one_hot
from tallyframe.operators.splits import train_val_split
from tallyframe.plans.training import assign_batches, train_val_files, training_rows
from tallyframe.sources.tables import read_batch, write_batches

SCHEMA = ("qid long, uid long, human_score double, yref_llm double, f_a float, f_b float, "
          "task_embedding array<double>, baseline_llm_ratings_dist array<double>, comment array<int>, text string")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (1, 10, 3.0, 2.0, 1.0, 0.0, [0.5, 1.5], [1.0], [1, 2], "[0.5, 1.5]"),
        (2, 10, 4.0, 0.0, 0.0, 1.0, [2.5, 3.5], [2.0], [3, 4], "[2.5, 3.5]"),
        (3, 11, 5.0, 0.0, 0.0, 1.0, [4.5, 5.5], [3.0], [5], "[4.5, 5.5]"),
    ], SCHEMA)


def test_full(rows):
    got = training_rows(rows, ["f_a", "f_b"]).orderBy("qid").first()
    assert got["context"] == [1.0, 0.0] and got["task_embedding"] == [0.5, 1.5] and got["baseline_llm_ratings_dist"] == [1.0]


def test_parsed(rows):
    df = rows.drop("task_embedding").withColumnRenamed("text", "task_embedding")
    got = training_rows(df, ["f_a", "f_b"], "parsed").orderBy("qid").collect()
    assert got[1]["task_embedding"] == [2.5, 3.5] and "baseline_llm_ratings_dist" not in got[0].asDict()


def test_vector_context_keeps_rows_aligned(rows):
    got = training_rows(rows, [], "vector_context").orderBy("qid").collect()
    assert [(r["qid"], r["context"], r["task_embedding"]) for r in got] == [(1, [1.0, 2.0], [0.5, 1.5]), (2, [3.0, 4.0], [2.5, 3.5])]
    with pytest.raises(ValueError):
        training_rows(rows, [], "other")


@pytest.mark.parametrize("options", [
    {"row_key": ["id"]}, {}, {"shuffle": False, "order_by": ["v"]}, {"shuffle": False, "order_by": ["v"], "row_key": ["id"]},
])
def test_batches(spark, options):
    df = spark.range(103).select("id", (F.col("id") % 9).alias("v"))
    got = assign_batches(df, 10, **options).collect()
    places = sorted((r["batch_id"], r["pos"]) for r in got)
    assert places == [(i // 10, i % 10) for i in range(103)] and {r["id"] for r in got} == set(range(103))
    if "order_by" in options:
        ordered = [r["v"] for r in sorted(got, key=lambda r: (r["batch_id"], r["pos"]))]
        assert ordered == sorted(ordered)


def test_equal_rows_get_places_of_their_own(spark):
    df = spark.range(50).select(F.lit(1).alias("a"))
    for shuffle in (True, False):
        got = assign_batches(df, 8, shuffle, order_by=["a"])
        assert sorted((r["batch_id"], r["pos"]) for r in got.collect()) == [(i // 8, i % 8) for i in range(50)]


def test_epochs_differ_and_partitions_do_not_matter(spark):
    df = spark.range(60)
    order = lambda d, e: [r["id"] for r in assign_batches(d, 7, epoch=e, row_key=["id"]).orderBy("batch_id", "pos").collect()]
    assert order(df, 0) == order(df.repartition(9), 0) and order(df, 0) != order(df, 1)
    with pytest.raises(ValueError):
        assign_batches(df, 7, shuffle=False)
    with pytest.raises(ValueError):
        assign_batches(df, 0)


def test_batches_are_written_in_order(spark, tmp_path):
    write_batches(assign_batches(spark.range(60), 7, row_key=["id"]), f"{tmp_path}/b", 3)
    files = spark.read.parquet(f"{tmp_path}/b").select("batch_id", F.input_file_name().alias("f")).distinct()
    assert files.count() == 9


def test_a_batch_is_one_range_of_one_file(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 40).alias("qid"), F.col("id").alias("row"), (F.col("id") * 7 % 1000).alias("ts"))
    index = train_val_files(rows, f"{tmp_path}/t", 16, 0.25, 3, 0, ["row"], ["ts"], per_file=4)
    found = {(r["split"], r["batch_id"]): r for r in index.collect()}
    split = {r["row"]: r["split"] for r in train_val_split(rows, 0.25, 3).collect()}
    assert sum(r["n_rows"] for r in found.values()) == 1000 and {s for s, _ in found} == {"train", "val"}
    for (side, batch), r in found.items():
        if batch % 9 == 0:
            file = pq.read_table(r["path"].removeprefix("file:")).slice(r["first_row"], r["n_rows"])
            assert file["batch_id"].to_pylist() == [batch] * r["n_rows"] and file["pos"].to_pylist() == list(range(r["n_rows"]))
            back = read_batch(spark, f"{tmp_path}/t/{side}", batch, 4)
            assert [x["row"] for x in back.collect()] == file["row"].to_pylist()
            assert back.select(F.input_file_name()).distinct().count() == 1
            assert all(split[x] == side for x in file["row"].to_pylist())
    val = spark.read.parquet(f"{tmp_path}/t/val/rows").orderBy("batch_id", "pos").collect()
    assert [r["ts"] for r in val] == sorted(r["ts"] for r in val)
    assert "PartitionFilters: [isnotnull(file" in read_batch(spark, f"{tmp_path}/t/train", 5, 4)._jdf.queryExecution().executedPlan().toString()


def test_sparse_rows_equal_columns(spark):
    rows = spark.createDataFrame(
        [(1, 1, "[1.0]", 2.0, 1.0, "a", "x"), (2, 1, "[2.0]", 3.0, 0.0, "b", None), (3, 2, None, 4.0, 0.0, "a", "y")],
        "qid long, uid long, task_embedding string, human_score double, yref_llm double, f string, g string",
    )
    sparse = training_rows(rows, ["f", "g"], "parsed", encoding="sparse")
    coded, names = one_hot(rows, ["f", "g"])
    dense = {r["qid"]: r["context"] for r in training_rows(coded, names, "parsed").collect()}
    got = {r["qid"]: r["context_idx"] for r in sparse.collect()}
    assert {k: [float(i in v) for i in range(len(names))] for k, v in got.items()} == dense
    with pytest.raises(ValueError):
        training_rows(rows, ["f"], "vector_context", encoding="sparse")
