"""Periodic runs, spelling variants and identifiers against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import identifiers as ids, queries as q, runs, spelling

LOWER = {i: i + 32 for i in range(65, 91)}


# -- runs ---------------------------------------------------------------------------------------------


def brute_runs(words, least=24, periods=3):
    found = {}
    for period in range(1, len(words) // periods + 1):
        at = 0
        while at + period < len(words):
            start = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            if at + period - start >= max(least, periods * period):
                found.setdefault((start, at + period - start), period)
            at += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def echo(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if key is None else str(key)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def wanted_runs(key, text):
    words = echo(key, text)
    found = brute_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *four, sha(lines), sha(kept))


@pytest.fixture(scope="module")
def periodic():
    rnd = random.Random(6)
    rows = []
    for key in range(120):
        words = [rnd.choice(["a", "b", "été", "c,", "漢", "x" * 9][: rnd.choice([1, 2, 3, 6])]) for _ in range(rnd.randint(0, 160))]
        for _ in range(rnd.randint(0, 3)):
            if words:
                a, e = sorted(rnd.choices(range(len(words) + 1), k=2))
                p = rnd.randint(1, 20)
                words[a:e] = [words[a + (i - a) % p] if a + (i - a) % p < len(words) else "z" for i in range(a, e)]
        rows.append((key, "".join(rnd.choice([" ", "\n", "  \t", "\x0b"]) + w for w in words)))
    return [*rows, (900, None), (None, "no key " * 40), (901, ""), (902, " \r\n"), (903, "w " * 3_000), (904, "a b " * 6), (904, "a b " * 6), (None, None)]


@pytest.mark.parametrize("least", [3, 7, 24])
def test_runs_of_random_words(least, monkeypatch):
    monkeypatch.setattr(runs, "ASKED", least)
    rnd = random.Random(least)
    for _ in range(120):
        docs = []
        for _ in range(rnd.randint(1, 6)):
            words = [rnd.randrange(rnd.choice([1, 2, 3, 30])) for _ in range(rnd.randint(0, 150))]
            for _ in range(rnd.randint(0, 3)):
                if len(words) > 3:
                    a, p = rnd.randrange(len(words)), rnd.randint(1, 12)
                    for i in range(a + p, rnd.randint(a, len(words))):
                        words[i] = words[i - p]
            docs.append(words)
        got = runs.runs_of(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs]), least)
        assert list(map(tuple, got.tolist())) == [(k, *r) for k, d in enumerate(docs) for r in brute_runs(d, least)]


def test_grammar_answers_like_a_comparison():
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = np.concatenate([[-1], np.tile(rng.integers(0, 3, rng.integers(1, 9)), 40), rng.integers(0, 2, 50), [-2]])
        levels = runs.grammar(text)
        for up, level in zip(levels[1:], levels):
            assert len(up.symbols) == len(level.first) - 1 < len(level.symbols)
        x, y = rng.integers(1, len(text) - 1, (2, 200))
        x, y = x[x != y], y[x != y]
        ends = np.append(text, [-3, -4])
        want = [next(k for k in range(len(text)) if ends[a + k] != ends[b + k] or min(ends[a + k], ends[b + k]) < 0) for a, b in zip(x, y)]
        assert runs.agreement(levels, x, y).tolist() == want


def test_runs_query(spark, tmp_path, periodic):
    table = spark.createDataFrame(periodic, "doc_id long, text string").withColumn("Runs", F.lit(1)).withColumn("g", F.lit("g")).repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = q.op11_runs(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(wanted_runs(k, t) for k, t in periodic)
    kinds = dict(got.dtypes)
    assert all(kinds[x] == "bigint" for x in ("n_runs", "start", "length", "period", "exponent_milli"))
    assert runs.echoed(table).columns == table.columns and runs.collapsed(table.limit(0), out=("r", "c")).count() == 0
    kept = runs.collapsed(table, out=("r", "c"))
    assert kept.columns == [*table.columns, "r", "c"] and kept.count() == len(periodic)


def test_runs_query_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {tuple(r) for r in q.op11_runs(spark, sf).collect()} == {wanted_runs(r["doc_id"], r["text"]) for r in docs}


# -- spelling -----------------------------------------------------------------------------------------


def brute_words(rows, rare):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if rare and h % rare == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return found


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(found):
    words = {w: n for w, n in found.items() if n >= 5}
    rows = {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and one_apart(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        rows[w] = (best if best is not None and words[best] >= 5 * n else None, len(near))
    out = set()
    for w, (form, near) in rows.items():
        root = w
        while rows[root][0] is not None:
            root = rows[root][0]
        out.add((w, form, root, words[w], near, words.get(form)))
    return out


@pytest.fixture(scope="module")
def spelled():
    rnd = random.Random(8)
    rows = []
    stems = ["".join(rnd.choice("aeiorstÉé×n") for _ in range(rnd.randint(6, 11))) for _ in range(40)]
    for key in range(300):
        words = []
        for _ in range(rnd.randint(0, 60)):
            w = list(stems[min(int(rnd.expovariate(0.12)), 39)])
            for _ in range(rnd.choice([0] * 12 + [1, 1, 2])):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "é", "s"])
            words.append("".join(w).upper() if rnd.random() < 0.2 else "".join(w))
        rows.append((key, rnd.choice([" ", "-", "1", "漢", "ā"]).join(words)))
    return [*rows, (900, None), (901, ""), (None, "nokeys " * 30), (902, "y" * 300 + " " + "longest" * 200), (903, ("y" * 300 + " ") * 6), (903, ("z" + "y" * 300 + " ") * 90)]


@pytest.mark.parametrize("rare", [0, 3, 199])
def test_words_of_texts(spelled, rare):
    words, n = spelling.words_of([(t or "").encode() for _, t in spelled], ["" if k is None else str(k) for k, _ in spelled], rare)
    assert dict(zip(words, n.tolist())) == brute_words(spelled, rare)
    assert spelling.words_of([], [], rare)[0] == [] == spelling.words_of([b"", b" "], ["1", "2"], rare)[0]


def test_crc_goes_on():
    rnd = random.Random(1)
    data = np.frombuffer(rnd.randbytes(500), np.uint8)
    begin, size = np.array([0, 5, 99, 300]), np.array([7, 0, 64, 200])
    before = np.array([zlib.crc32(b"a"), 0, zlib.crc32(b"xyz:"), 5], np.uint32)
    want = [zlib.crc32(data[b : b + s].tobytes(), int(x)) for x, b, s in zip(before, begin, size)]
    assert spelling.crc32_after(before, data, begin, size).tolist() == want


def test_bit_sliced_index_finds_all_near_words():
    rnd = random.Random(2)
    for size in [1, 2, 3, 63, 64, 65, 200]:
        for letters in ("ab", "abcdéÿ"):
            words = list({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))).encode("latin-1") for _ in range(size)})
            one, two = spelling.near_in(words)
            want = sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and one_apart(a.decode("latin-1"), b.decode("latin-1")))
            assert sorted(zip(one.tolist(), two.tolist())) == want


@pytest.mark.parametrize("block", [2, 16, 4096])
def test_near_words_whatever_the_block(spark, spelled, block):
    words = {w: n for w, n in brute_words(spelled, 0).items() if n >= 5}
    table = spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3)
    got = spelling.near_words(table, block).collect()
    assert sorted((r["word"], r["near"]) for r in got) == sorted((a, b) for a in words for b in words if a != b and one_apart(a, b))
    assert all(r["n"] == words[r["word"]] and r["near_n"] == words[r["near"]] for r in got)


def test_spelling_query(spark, tmp_path, spelled):
    spark.createDataFrame(spelled, "doc_id long, text string").withColumn("Word", F.lit(1)).withColumn("n", F.lit(2)).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = q.op12_spelling(spark, str(tmp_path))
    want = brute_variants(brute_words(spelled, 199))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert any(r[1] for r in want) and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    chain = spark.createDataFrame([("abcdefghij"[:k] + "x" * 0, 5 ** (12 - k)) for k in range(6, 11)], "word string, n long")
    assert {r["root"] for r in spelling.variants(chain).collect()} == {"abcdef"}
    assert spelling.variants(chain.limit(0)).count() == 0


def test_spelling_query_on_the_tables(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in q.op12_spelling(spark, sf).collect()} == brute_variants(brute_words(rows, 199))


# -- identifiers --------------------------------------------------------------------------------------


def brute_identifiers(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        total, digits = 0, [int(x) for x in m[0] if x not in " -"]
        for i, x in enumerate(reversed(digits)):
            total += x if i % 2 == 0 else sum(divmod(2 * x, 10))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(x.isdigit() for x in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


HARD = ["", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "999.1.1.1 1.1.1.255", "0000000255.1.1.1", "4111 1111 1111 1111", "4111-1111 11111111 ", "+1 (017) 555-7713.", "+1+12345678901 é +49 170 1234567", "4111  1111 1111 1111", "@a.b x@", "1" * 5000]


def test_plain_identifiers():
    rnd = random.Random(5)
    for text in HARD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 70))) for signs in ("a@.b-+ 0123(é", "01234 .+-", "4 -10") for _ in range(4000)]:
        assert ids.found(text) == brute_identifiers(text), text


DISGUISED = [
    ("write to john [at] example [dot] com now", "john [at] example [dot] com", "john@example.com"),
    ("Jo.Smith (AT) mail.example.org, or", "Jo.Smith (AT) mail.example.org", "Jo.Smith@mail.example.org"),
    ("mail john at example dot com today", "john at example dot com", "john@example.com"),
    ("j dot doe at example dot co dot uk!", "j dot doe at example dot co dot uk", "j.doe@example.co.uk"),
    ("juan arroba ejemplo punto es", "juan arroba ejemplo punto es", "juan@ejemplo.es"),
    ("x@example dot com", "x@example dot com", "x@example.com"),
    ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "john@example.com"),
    ("é jоhn@exаmple.com", "jоhn@exаmple.com", "john@example.com"),
    ("jo​hn@example.com", "jo​hn@example.com", "john@example.com"),
    ("plus one five five five one two three four five six seven ok", "plus one five five five one two three four five six seven", "+15551234567"),
    ("+1 five five five, one two three four five six seven", "+1 five five five, one two three four five six seven", "+15551234567"),
    ("+1‑555‑123‑4567 x", "+1‑555‑123‑4567", "+1-555-123-4567"),
    ("host 192[.]168[.]1[.]10 up", "192[.]168[.]1[.]10", "192.168.1.10"),
    ("one nine two dot one six eight dot zero dot one", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
    ("４１１１ 1111 1111 ١١١١", "４１１１ 1111 1111 ١١١١", "4111 1111 1111 1111"),
    ("vier " + "eins " * 15, ("vier " + "eins " * 15).strip(), "4" + "1" * 15),
]


@pytest.mark.parametrize("text,span,plain", DISGUISED)
def test_disguised_identifiers(text, span, plain):
    own = [r for r in ids.spans("😀 " + text) if r[3]]
    assert [(("😀 " + text)[a:b], p) for a, _, b, _, p in own] == [(span, plain)]
    assert [r[:3] for r in ids.spans(text) if not r[3]] == brute_identifiers(text)


@pytest.mark.parametrize("text", ["at the dot com boom we looked at a dot", "look at example.com", "one two three four", "un point de vue", "meet (at) noon [dot]", "¡Нет! 12.5 – 14", "10² ½", "we are at it dot and", "zero one two three four five six seven eight nine ten", "4111 1111 1111 1112"])
def test_clean_texts_are_left_alone(text):
    assert ids.spans(text) == []


def test_hostile_texts_take_linear_time():
    for evil in ["1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "at " * 60_000, "+1(" * 60_000, "((" * 90_000, " dot" * 50_000, "a at " * 50_000, "<" * 200_000, "one " * 20_000, "com dot at " * 9_000, "​" * 90_000]:
        ids.spans(evil)


def test_identifiers_query(spark, tmp_path, sf):
    rows = [(k, t) for k, t in enumerate([*HARD, *(t for t, *_ in DISGUISED)])] + [(900, None), (None, "a@b.c"), (901, "x"), (901, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Identifiers", F.lit(1)).withColumn("kind", F.lit(1))
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, wide in ((str(tmp_path), True), (sf, False)):
        docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        want = Counter()
        for key, text in docs:
            base = brute_identifiers(text or "")
            digest = hashlib.sha256(",".join(f"{ids.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
            want[(key, *(sum(k == kind for _, k, _ in base) for kind in range(4)), digest)] += 1
        got = q.op13_identifiers(spark, folder).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        texts = dict(docs)
        for r in got:
            every = [(a, k, b) for a, k, b, *_ in ids.spans(texts[r["doc_id"]] or "")]
            assert r["spans"] == ",".join(f"{ids.KINDS[k]}:{a}:{b}" for a, k, b in every)
        assert any(r["n_disguised"] for r in got) == wide
    out = ids.identified(table, out="found")
    assert out.columns == [*table.columns, "found"] and ids.identified(table.limit(0), out="found").count() == 0
