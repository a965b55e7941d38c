from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ratings


def rated(spark, *replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "qid long, reply string")
    return [tuple(r)[2:] for r in ratings.validate_ratings(df, "reply").orderBy("qid").collect()]


def test_valid(spark):
    assert rated(spark, "3", "Difficulty: 3", " 2 \n", "-4") == [(3, "VALID"), (3, "VALID"), (2, "VALID"), (4, "VALID")]


def test_no_number(spark):
    got = rated(spark, "", "no", "10", "a3", "3_", "3分", "3é", " 7 ")
    assert got[1] == (None, "INVALID: No valid number found in response: no")
    assert got[7] == (None, "INVALID: No valid number found in response: 7")
    assert all(r is None and s.startswith("INVALID: No valid number") for r, s in got)


def test_several(spark):
    got = rated(spark, "[1-5]", "3.5", "3 or 4")
    assert [s for _, s in got] == [
        "INVALID: Multiple candidates detected: ['1', '5']", "INVALID: Multiple candidates detected: ['3', '5']",
        "INVALID: Multiple candidates detected: ['3', '4']",
    ]
    assert all(r is None for r, _ in got)


def test_missing_reply(spark):
    assert rated(spark, None)[0][0] is None and rated(spark, None)[0][1].startswith("INVALID: ")


def test_prompts(spark):
    df = spark.createDataFrame([(1, "What?", "woman", "x")], "qid long, text string, gender string, race string")
    got = ratings.build_prompts(df, ["gender", "race"]).first()["prompt"]
    assert "Gender: woman | Race: x" in got and "\nWhat?\n" in got and got == got.strip()
    assert "general human" in ratings.build_prompts(df).first()["prompt"]
    assert ratings.build_prompts(df, None, " \n{persona}: {text}\n ").first()["prompt"] == "general human: What?"


def test_rate(spark):
    df = spark.range(100).select(F.col("id").alias("qid"), F.concat(F.lit("task "), "id").alias("prompt"))

    def model(prompts):
        if any(p.endswith("13") for p in prompts):
            raise RuntimeError("no answer")
        return [f"Difficulty: {int(p.split()[1]) % 7}" for p in prompts]

    got = {r["qid"]: r for r in ratings.rate(df, model, 4).collect()}
    assert len(got) == 100
    for qid, r in got.items():
        if qid == 13:
            assert r["llm_rating"] is None and r["validation_status"] == "INVALID: no answer"
        elif 1 <= qid % 7 <= 5:
            assert r["llm_rating"] == qid % 7 and r["validation_status"] == "VALID"
        else:
            assert r["llm_rating"] is None and "No valid number" in r["validation_status"]
    summary = {(r["kind"], r["llm_rating"]): (r["n"], r["share"]) for r in ratings.rating_summary(ratings.rate(df, model, 4)).collect()}
    assert summary[("failed", None)] == (1, 0.01) and sum(n for n, _ in summary.values()) == 100
    with pytest.raises(ValueError):
        ratings.validate_ratings(df, "prompt", 1, 12)


def test_rules_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("3",), ("no",)], "reply string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("reply string").parquet(f"{tmp_path}/in")
    query = (
        ratings.validate_ratings(stream, "reply").writeStream.format("memory").queryName("rated")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert sorted(r["llm_rating"] or 0 for r in spark.table("rated").collect()) == [0, 3]


def test_slots_in_any_order(spark):
    df = spark.createDataFrame([(1, "What?"), (2, None)], "qid long, text string")
    got = {r["qid"]: r["prompt"] for r in ratings.build_prompts(df, None, "Q: {text} P: {persona} Q: {text}").collect()}
    assert got == {1: "Q: What? P: general human Q: What?", 2: None}
    assert ratings.build_prompts(df, ["qid"], "only {text}").first()["prompt"] == "only What?"
    with pytest.raises(ValueError):
        ratings.build_prompts(df, None, "no slot {persona}")


def test_two_actions_ask_once(spark, tmp_path):
    folder = str(tmp_path)

    def model(prompts):
        import os
        import uuid

        for _ in prompts:
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return ["4"] * len(prompts)

    df = spark.createDataFrame([(i, None if i == 3 else f"p{i}") for i in range(10)], "qid long, prompt string")
    rated = ratings.rate(df, model, 2)
    assert rated.count() == 10 and rated.filter("llm_rating = 4").count() == 9
    assert rated.filter("qid = 3").first()["validation_status"].startswith("INVALID")
    assert len(list(tmp_path.iterdir())) == 9


def test_a_broken_run_goes_on_from_its_ledger(spark, tmp_path):
    asked, ledger = tmp_path / "asked", f"file://{tmp_path}/ledger"
    asked.mkdir()

    def model(broken):
        def ask(prompts):
            import os
            import uuid

            if broken and "p7" in prompts:
                os._exit(1)  # the executor is lost, not the call
            for p in prompts:
                open(os.path.join(asked, f"{p}-{uuid.uuid4().hex}"), "w").close()
            return ["no" if p == "p3" else "4" for p in prompts]

        return ask

    def times():
        return Counter(x.name.split("-")[0] for x in asked.iterdir())

    rows = [(i, None if i == 40 else f"p{i % 20}") for i in range(41)]
    df = spark.createDataFrame(rows, "qid long, prompt string").repartition(3)
    with pytest.raises(Exception):
        ratings.rate_resumed(df, model(True), 1, ledger, "one", wave_prompts=1)
    early = times()
    assert 0 < len(early) < 20 and set(early.values()) == {1}
    before = {r["prompt_hash"] for r in ratings.read_ledger(spark, ledger).collect()}
    assert len(before) <= len(early)
    out = ratings.rate_resumed(df, model(False), 2, ledger, "two", wave_prompts=6)
    got = {r["qid"]: r for r in out.collect()}
    again = times()
    assert len(got) == 41 and set(again) == {f"p{i}" for i in range(20)}
    assert sum(again.values()) == 20 + len(early) - len(before)  # all but what a broken wave held were asked once
    assert {r["run"] for r in got.values()} == {"one", "two", None}
    assert got[3]["llm_rating"] is None and got[5]["llm_rating"] == 4 and got[40]["validation_status"].startswith("INVALID")
    assert out.columns == ["qid", "prompt", "reply", "llm_rating", "validation_status", "run"]
    ratings.rate_resumed(df, model(True), 2, ledger, "three").count()  # nobody is asked
    assert times() == again


def test_failed_calls_are_asked_again_on_request(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, prompt string")

    def bad(prompts):
        raise RuntimeError("busy")

    statuses = lambda out: {r["qid"]: r["validation_status"] for r in out.collect()}
    assert all("busy" in x for x in statuses(ratings.rate_resumed(df, bad, 2, ledger, "1")).values())
    good = lambda prompts: ["3"] * len(prompts)
    assert all("busy" in x for x in statuses(ratings.rate_resumed(df, good, 2, ledger, "2")).values())
    assert set(statuses(ratings.rate_resumed(df, good, 2, ledger, "3", retry_failed=True)).values()) == {"VALID"}
    assert ratings.rate_resumed(df.limit(0), bad, 2, f"file://{tmp_path}/none", "1").count() == 0


def test_model_gets_bounded_slices(spark, monkeypatch):
    sizes = []

    def responder(prompts):
        sizes.append((len(prompts), sum(map(len, prompts))))
        return [p[:1] for p in prompts]

    monkeypatch.setattr(ratings, "ASKED_ROWS", 4)
    monkeypatch.setattr(ratings, "ASKED_BYTES", 10)
    texts = ["1", None, "2aaa", "3bbb", "4cccccccccccc", "5", "1", "2", "3", "4", "5", None]
    batch = pa.RecordBatch.from_pydict({"prompt": texts, "n": list(range(12))})
    parts = list(ratings._asked(responder, batch, "prompt"))
    assert [x for _, replies, _ in parts for x in replies.to_pylist()] == [t and t[:1] for t in texts]
    assert [x for part, _, _ in parts for x in part.column("n").to_pylist()] == list(range(12))
    assert all(n == 1 or n <= 4 and size <= 10 for n, size in sizes) and len(sizes) > 3
