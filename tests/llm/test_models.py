"""Language, quality and toxicity: exact parts against plain Python, models by held-out accuracy."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import labelled, language, quality, queries as q, toxicity
from tests.llm import brute
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def medium():
    return "/root/testdata/sf0.01"


def plain_grams(text):
    words = "".join(ch if ch.isalpha() else " " for ch in text.lower()).split()
    out = Counter()
    for w in words:
        padded = f"_{w}_"
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def test_grams_are_those_of_words():
    for text in ["", " ", "a", "Ab c!", "été à l'été 12", "x" * 50, "漢字 kana"]:
        assert sorted(Counter(language.grams(text).tolist()).values()) == sorted(plain_grams(text).values())
    assert len(set(language.grams("a b").tolist())) == 8  # a, b, _a, a_, _b, b_, _a_, _b_


def test_distances():
    profiles = {"one": np.array([5, 7, 9]), "two": np.array([9, 8])}
    away = language.Distances(profiles, 10)(np.array([9, 5, 1]))
    assert away.tolist() == [abs(0 - 2) + abs(1 - 0) + 10, 0 + 10 + 10]


def test_language_edge_cases(spark):
    rows = [(1, "the and of", "en"), (2, "der und die", "de"), (3, None, "de"), (4, "", None), (5, "12 !", "en"), (6, "the the", None), (6, "the the", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    profiles = language.learn(table)
    assert set(profiles) == {"de", "en"}
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.identified(table, profiles).collect())
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    assert language.learn(table.limit(0)) == {}
    assert {r["lang_pred"] for r in language.identified(table, {}).collect()} == {"und"}


def test_language_profiles_count_all_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = language.learn(docs)
    counts = Counter()
    for r in docs.filter("lang = 'en'").collect():
        found, n = np.unique(language.grams(r["text"]), return_counts=True)
        counts.update(dict(zip(found.tolist(), n.tolist())))
    want = sorted(counts, key=lambda g: (-counts[g], g))[: language.PROFILE]
    assert profiles["en"].tolist() == want


def test_language_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in q.op5_language(spark, sf).collect() if r["held_out"]]
    assert rows and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.97


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=4), rng.normal(size=(2, 2)))
    sizes = [3, 0, 1, 5, 2]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    features = rng.normal(size=(bounds[-1], 4))
    good, pairs = quality.marginals(model, features, bounds)
    want, expected = np.zeros(bounds[-1]), np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        weights = {}
        for path in itertools.product((0, 1), repeat=int(b - a)):
            energy = sum(features[a + i] @ model.weights for i, y in enumerate(path) if y) + sum(model.pairs[x, y] for x, y in zip(path, path[1:]))
            weights[path] = math.exp(energy)
        total = sum(weights.values())
        for path, w in weights.items():
            want[a:b] += np.array(path) * w / total
            for x, y in zip(path, path[1:]):
                expected[x, y] += w / total
    assert np.allclose(good, want) and np.allclose(pairs, expected)


def test_line_features():
    own, lengths, bounds = quality.line_features([b"", b"ab ab AB\n\n\n## 12", b"  \n", "été\n".encode()])
    assert bounds.tolist() == [0, 0, 2, 2, 3] and lengths.tolist() == [8, 5, 5]
    assert own[0, 0] == pytest.approx(2 / 6) and own[1, 4] == pytest.approx(2 / 5) and own[1, 1] == pytest.approx(2 / 5)
    assert own[0, 5] == pytest.approx(1 / 3) and own[0, 6] == pytest.approx(1 / 3)
    near = quality.with_neighbours(own, bounds)
    width = own.shape[1]
    assert (near[0, 2 * width : 3 * width] == own[1]).all() and (near[1, width : 2 * width] == own[0]).all() and not near[2, width : 3 * width].any()


def test_quality_edge_cases(spark):
    table = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "a\n" * 5000), (5, "x")], "doc_id long, score string").withColumnRenamed("score", "text")
    for sample in ([], [("a", 1)], [("", 0), ("", 1)]):
        rows = {r["doc_id"]: r["score"] for r in quality.scored(table, quality.fit(sample)).collect()}
        assert rows[1] == rows[2] == rows[3] == 0 and all(0 <= x <= 1 for x in rows.values())
    assert quality.scored(table.limit(0), quality.fit([])).count() == 0


def accuracy(spark, folder, rows, label):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])


def test_quality_accuracy(spark, medium):
    rows = q.op4_quality(spark, medium).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert accuracy(spark, medium, rows, "quality") > 0.95


def test_toxicity_slopes():
    words, grid, _ = toxicity.windows(pa.array(["one two three four five", "six", "", "one one two!" * 20]))
    net = toxicity.Network(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    few, places = toxicity._only(words, grid)
    slope = np.random.default_rng(0).standard_normal(len(places))
    inputs = net.inputs(few)
    found = net.backward(few, inputs, places, net.forward(inputs, places, keep=True)[1], slope)
    for name, value in net.w.items():
        at = np.unravel_index(np.abs(found[name]).argmax(), value.shape)
        sides = []
        for step in (1e-3, -1e-3):
            value[at] += step
            sides.append((net.forward(net.inputs(few), places) * slope).sum())
            value[at] -= step
        assert found[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-3, rel=1e-2, abs=1e-5), name


def test_windows_overlap_and_cover():
    texts = ["", "  ", " ".join(map(str, range(100))), "a b", None, " ".join("x" * 32), "Don't 'STOP' ###"]
    words, grid, owner = toxicity.windows(pa.array(texts))
    assert Counter(owner.tolist()) == {2: 6, 3: 1, 5: 1, 6: 1}
    long = grid[owner == 2]
    assert sorted(set(long[long >= 0].tolist())) == sorted(set(long[long >= 0].tolist())) and len(set(long[long >= 0].tolist())) == 100
    assert (long[0][toxicity.STRIDE :] == long[1][: toxicity.STRIDE]).all() and long[-1].tolist().count(-1) == 12
    assert (grid[owner == 5] >= 0).sum() == 1 or len(grid[owner == 5]) == 1


def test_toxicity_learns_words_and_spares_clean_texts(spark):
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(60)]

    def text(bad):
        words = rng.choice(plain, rng.integers(5, 90)).tolist()
        if bad:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["scum", "LOSER!", "idiot."])))
        return " ".join(words)

    sample = [(text(y), y) for y in (0, 1) for _ in range(150)]
    net = toxicity.fit(sample)
    fresh = [(text(y), y) for y in (0, 1) for _ in range(60)]
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(fresh)] + [(900, None), (901, ""), (902, "w1 " * 4000)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(table, net).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, (_, y) in enumerate(fresh)]) > 0.95
    assert got[900] == got[901] == 0 and got[902] < 0.5
    assert toxicity.scored(table.limit(0), net).count() == 0
    assert toxicity.fit([("a", 1)]).text_scores(pa.array(["a"])).shape == (1,)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(50)] + [(None, "y"), (3, "other"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(45)] + [(3, 1), (46, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    sample = labelled.labelled_sample(docs, labels, "toxic", rows=5)
    assert Counter(y for _, y in sample) == {0: 5, 1: 5}
    small = labelled.labelled_sample(docs, labels, "toxic", rows=50, size=100)
    assert 0 < sum(len(t) + 1 for t, _ in small) <= 100
    assert labelled.labelled_sample(docs.limit(0), labels, "toxic") == []


def test_sample_passes_over_what_does_not_fit(spark):
    rows = [(i, "x" * i) for i in range(1, 41)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 61)], "doc_id long, toxic int")

    def sample(*long, **bounds):
        return labelled.labelled_sample(spark.createDataFrame(rows + list(long), "doc_id long, text string"), labels, "toxic", **bounds)

    whole = sample(rows=60)
    assert Counter(whole) == Counter((t, i % 2) for i, t in rows)
    assert sample(*[(i, "y" * 5_000) for i in range(41, 61)], rows=60, size=2_000) == whole  # whatever their rank
    few = sample(*[(i, "y" * 600) for i in range(41, 61)], rows=60, size=1_000)
    assert {y for _, y in few} == {0, 1} and 900 < sum(len(t) + 1 for t, _ in few) <= 1_000
    odd = spark.createDataFrame([(1, "y" * 600), (2, "x"), (4, "xx")], "doc_id long, text string")
    with pytest.raises(ValueError, match="class"):
        labelled.labelled_sample(odd, labels, "toxic", size=100)
    assert labelled.labelled_sample(odd.filter("doc_id > 1"), labels, "toxic", size=100)


def test_pipeline_equals_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    near = language.Distances(q.language_profiles(docs))
    rows = [r for r in rows if near.nearest(r[1])[0] != "und"]
    model = q.quality_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def good(text):
        own, lengths, bounds = quality.line_features([text.encode()])
        if not len(own):
            return False
        chance = quality.marginals(model, quality.with_neighbours(own, bounds), bounds)[0]
        mean = float((chance * lengths).sum() / lengths.sum())
        return 1 / (1 + math.exp(-(model.curve[0] * (mean - 0.5) + model.curve[1]))) >= 0.5

    rows = [r for r in rows if good(r[1])]
    assert all(labels.get(k, 1) == 1 for k, _ in rows)
    keep = {k for k, best, _, _ in brute.exact(rows) if k == best}
    rows = [r for r in rows if r[0] in keep]
    names, _ = brute.components(rows, 5, 80, 100)
    rows = [r for r in rows if names[r[0]] == r[0]]
    tokenizer = Tokenizer.from_file(q.WORD_TOKENIZER)
    want = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in rows}
    got = corpus_pipeline.run(spark, sf)
    found = {r["doc_id"]: r["doc_tokens"] for r in got.select("doc_id", "doc_tokens").distinct().collect()}
    assert found == want and [name for name, _ in corpus_pipeline.STAGES][:2] == ["language", "quality"]


def test_stages_take_odd_rows(spark, sf):
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (None, "the of and to\n", "en", "s", 3, "c"), (3, "the of and to\n", "en", "s", 3, "d"), (3, "the of and to\n", "en", "s", 3, "d")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Score string")
    for docs in (table, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count() or name == "packing"
            assert name == "packing" or out.columns == docs.columns


def test_toxicity_query(spark, medium, tmp_path):
    docs, labels = (spark.read.parquet(f"{medium}/{x}.parquet") for x in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in q.op1_toxicity(spark, medium).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    assert accuracy(spark, medium, list(rows.values()), "toxic") > 0.85
    # what the held-out fold is labelled with, and any other column, has no part in a score
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned.write.parquet(f"{tmp_path}/labels.parquet")
    docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "n_chars": F.lit(0), "score": F.rand(3)}).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    again = {r["doc_id"]: r["score"] for r in q.op1_toxicity(spark, str(tmp_path)).collect()}
    assert again.keys() == rows.keys() and all(abs(again[k] - r["score"]) < 1e-6 for k, r in rows.items())


def test_one_class_gives_a_constant():
    texts = pa.array(["a b", "", "c"])
    assert toxicity.fit([("a", 1)]).text_scores(texts).round(6).tolist() == [1, 0, 1]
    assert toxicity.fit([("a", 0), ("b", 0)]).text_scores(texts).round(6).tolist() == [0, 0, 0] == toxicity.fit([]).text_scores(texts).round(6).tolist()


def test_quality_is_fitted_on_a_bounded_number_of_lines(monkeypatch):
    monkeypatch.setattr(quality, "LINES", 10)
    sample = [("a\n" * 50, 1), ("good words here\n" * 4, 1), ("##\n" * 3, 0), ("x\n" * 20, 0)]
    assert quality._fitting(sample) == [sample[1], sample[2]]
    assert (quality.fit(sample).weights == quality.fit([sample[1], sample[2]]).weights).all()
    with pytest.raises(ValueError, match="class"):
        quality.fit([("a\n" * 50, 1), ("b", 0)])


def test_sample_plan_sorts_no_class_in_one_task(spark, medium):
    import inspect

    assert "Window" not in inspect.getsource(labelled)
    docs, labels = (spark.read.parquet(f"{medium}/{x}.parquet") for x in ("documents", "labels"))
    sample = labelled.labelled_sample(docs, labels, "toxic", rows=20)
    assert Counter(y for _, y in sample) == {0: 20, 1: 20}
    assert sample == labelled.labelled_sample(docs.repartition(7), labels.repartition(3), "toxic", rows=20)
