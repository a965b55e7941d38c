"""What the plans must and must not contain."""

import re

from pyspark.sql import functions as F

from tallyframe.operators import coverage, reduction, responses as rs, splits
from tallyframe.plans import tables as tb


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_is_a_map_over_the_rows(spark, sf):
    p = plan(splits.group_split(tb.responses(spark, sf).select("qid", "uid"), "qid", 0.2, frac=0.5))
    assert "Exchange" not in p and "Join" not in p
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in p


def test_choice_reads_two_columns_and_no_broadcast(spark, sf):
    p = plan(reduction.scenario(tb.responses(spark, sf), "worker").rows.select("qid", "uid", "lvl"))
    assert "Exchange" not in p and "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in p


def test_group_samples_are_cut_before_the_shuffle(spark, sf):
    df = tb.responses(spark, sf).select("qid", "uid", "l_extendedprice")
    p = plan(reduction.scenario(df, "responses_per_task", row_key=["uid", "l_extendedprice"]).rows)
    above, below = p.split("Exchange hashpartitioning(qid")
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below


def test_coverage_takes_one_pass(spark, sf):
    study = reduction.scenario(tb.responses(spark, sf), "task")
    assert len(re.findall(r"FileScan parquet", plan(study.stats))) == 1


def test_small_tables_are_broadcast(spark, sf):
    p = plan(rs.attach_reference(tb.responses(spark, sf), tb.task_reference(spark, sf)))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_distinct_pairs_give_the_means(spark, sf):
    df = tb.responses(spark, sf)
    direct = df.groupBy("qid").agg(F.count_distinct("uid").alias("n")).agg(F.avg("n")).first()[0]
    assert abs(coverage.coverage_stats(df).first()["avg_workers_per_qid"] - direct) < 1e-9
