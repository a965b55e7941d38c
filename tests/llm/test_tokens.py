"""Byte BPE, packing and id files against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyframe.llm import byte_bpe, common as c, id_files, packing, pieces, queries as q

DOCS = [
    "", "a\r\n\r\nb  c\x1cd  \t e\n", "aaaa" * 700, " " * 900, "!" * 400, "é" * 333, "日本語テキスト 😀😀  x", "\x85 \x85a <|endoftext|>",
    "it's we'LL they're 12345 ½ ² x", " a", "é a. é, É!", "\n", "Don't stop. 'twas the day; (yes) a_b c-d", "word " * 3000,
]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    return DOCS + ["".join(rnd.choice("ab \n\t\r'sé1.! 　\x1c漢\xa0\x85́Ö") for _ in range(200)) for _ in range(150)]


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, None), (None, "no key", "y"), (901, "twice", "z"), (901, "twice", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, `N_Ids` string").repartition(3)


def wanted(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(texts, name):
    flat, ends = pieces.tokenizer_pieces(public_tokenizers.path(name))([t.encode() for t in texts])
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == wanted(name, texts)


def test_memo_that_overflows(texts, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 5)
    held = pieces.tokenizer_pieces(q.BYTE_TOKENIZER)
    for _ in range(2):
        flat, ends = held([t.encode() for t in texts])
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == wanted("byte_bpe_50k.json", texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
@pytest.mark.parametrize("white_space", [True, False])
def test_byte_bpe_is_exact(texts, name, white_space):
    path = public_tokenizers.path(name)
    ranks = byte_bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    byte_bpe._LOADED.clear()
    bpe, held = byte_bpe._loaded(path, public_tokenizers.PATTERN, white_space)
    byte_bpe._LOADED.clear()
    flat, ends = held([t.encode() for t in texts])
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode_ordinary(t) for t in texts]
    joint, _ = bpe.decode(flat)
    assert joint == "".join(texts).encode()
    with pytest.raises(ValueError):
        bpe.decode(np.array([10**6]))


def test_backtracking_equals_merging():
    bpe = byte_bpe.ByteBPE(byte_bpe.load_ranks(q.BYTE_RANKS))
    rnd = random.Random(2)
    for _ in range(2000):
        word = "".join(rnd.choice("thenigorsau eé") for _ in range(rnd.randint(1, 18))).encode()
        assert bpe.encode(word) == bpe.merged(word)
    assert all(bpe.merged(token) == [rank] for token, rank in list(bpe.ranks.items())[::97])


def test_byte_bpe_table(spark, table):
    out = byte_bpe.encode(table, q.BYTE_RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "N_Ids", "ids"]
    back = out.withColumn("back", byte_bpe.decoded("ids", q.BYTE_RANKS, public_tokenizers.PATTERN)).collect()
    assert len(back) == table.count()
    assert all(bytes(r["back"]) == (r["text"] or "").encode() for r in back)
    assert byte_bpe.encode(table.limit(0), q.BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_piece_lengths():
    for n in [*range(1, 300), 2047, 2048, 2049, 70_001]:
        cut = packing.piece_lengths(n, 2048)
        assert sum(cut) == n and cut == sorted(cut, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in cut)


def test_packing(spark, table, texts):
    rows = packing.packed(table, q.WORD_TOKENIZER, end_id=1, longest=64).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    ids = dict(enumerate(x + [1] for x in wanted("word_bpe_49k.json", texts))) | {900: [1]}
    for key, want in ids.items():
        own = sorted((r for r in rows if r["doc_id"] == key), key=lambda r: r["start"])
        assert [x for r in own for x in np.frombuffer(r["ids"], "<u4").tolist()] == want
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] == len(r["ids"]) // 4 and r["doc_tokens"] == len(want) for r in own)
    assert sum(r["start"] == 0 for r in rows if r["doc_id"] == 901) == 2
    assert packing.packed(table.limit(0), q.WORD_TOKENIZER, end_id=1).count() == 0
    with pytest.raises(ValueError):
        packing.cut(table, q.WORD_TOKENIZER, 1, longest=100)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = id_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (id_files.unpack(data, bits, 1001) == ids).all()
    assert id_files.width(1) == 1 and id_files.width(50_257) == 16 and id_files.width(65_537) == 17


def test_id_files(spark, table, texts, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/ids"
    splits = c.range_splits(table, "doc_id", 5)
    ids = id_files.encoded(table, q.BYTE_TOKENIZER, end_id=0)
    manifest = id_files.write(ids, folder, q.BYTE_VOCABULARY, splits)
    rows = sorted(id_files.read(spark, folder).collect(), key=lambda r: r["start"])
    want = [(None, "no key"), *enumerate(texts), (900, ""), (901, "twice"), (901, "twice")]
    tokens = [x + [0] for x in wanted("byte_bpe_50k.json", [t for _, t in want])]
    assert [r["key"] for r in rows] == [k for k, _ in want]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == tokens
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([len(x) for x in tokens])])[:-1].tolist()
    monkeypatch.setattr(id_files, "BLOCK", 7)
    for file in manifest.collect():
        with id_files.Reader(f"{folder}/{file['file']}") as held:
            at = len(held.keys) - 1
            assert held.document(at).tolist()[-1] == 0 and held.read(3, 3).size == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        id_files.write(ids, f"file://{tmp_path}/few", 128, splits)
    empty = f"file://{tmp_path}/empty"
    id_files.write(id_files.encoded(table.limit(0), q.BYTE_TOKENIZER, end_id=0), empty, q.BYTE_VOCABULARY, [])
    assert id_files.read(spark, empty).count() == 0


def test_queries_against_the_libraries(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(q.BYTE_RANKS), special_tokens={})
    for r in q.op6_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    keys = sorted(docs)
    at, rows = 0, {r["doc_id"]: r for r in q.op8_id_files(spark, sf).collect()}
    for key, ids in zip(keys, wanted("byte_bpe_50k.json", [docs[k] for k in keys])):
        data = np.array([*ids, 0], "<u4").tobytes()
        assert tuple(rows[key]) == (key, at, len(ids) + 1, zlib.crc32(data))
        at += len(ids) + 1
    assert len(rows) == len(docs)
    tokens = dict(zip(keys, wanted("word_bpe_49k.json", [docs[k] for k in keys])))
    parts = q.op7_packing(spark, sf).collect()
    assert sum(r["length"] for r in parts) == sum(len(x) + 1 for x in tokens.values())
    for r in parts:
        ids = np.array([*tokens[r["doc_id"]], 1], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


ADDED = [
    "hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "a<|startoftext|>b", "<|endoftext", "|><|endoftext|>'s <|ENDOFTEXT|>",
    " <|endoftext|>  x", "<|", "endoftext|>", "", "é<|endoftext|>é",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_give_their_ids(texts, name):
    rnd = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", " ", "\n", "a", "'s", "é", "<", "1", "\x85"]
    rows = ADDED + texts + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]
    held = pieces.tokenizer_pieces(public_tokenizers.path(name), added=True)
    for _ in range(2):
        flat, ends = held([t.encode() for t in rows])
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    flat, ends = held([b"<|endof", b"text|>"])  # not across texts
    assert flat.tolist() == [i for t in ("<|endof", "text|>") for i in library.encode(t, add_special_tokens=False).ids]


def test_queries_keep_added_tokens(spark, tmp_path):
    rows = list(enumerate(ADDED))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    byte, word = (Tokenizer.from_file(p) for p in (q.BYTE_TOKENIZER, q.WORD_TOKENIZER))
    at, got = 0, {r["doc_id"]: r for r in q.op8_id_files(spark, str(tmp_path)).collect()}
    for key, text in rows:
        ids = np.array([*byte.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[key]) == (key, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for parts in (q.op7_packing(spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, docs, str(tmp_path))):
        found = parts.collect()
        for key, text in rows:
            ids = np.array([*word.encode(text, add_special_tokens=False).ids, 1], "<u4")
            own = [r for r in found if r["doc_id"] == key]
            assert sum(r["length"] for r in own) == len(ids)
            assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


def test_memo_stays_within_its_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_BYTES", 20_000)
    rnd = random.Random(9)
    held = pieces.tokenizer_pieces(q.BYTE_TOKENIZER, added=True)
    library = Tokenizer.from_file(q.BYTE_TOKENIZER)
    for size in (50, 5, 4_000, 0, 300, 20_000, 7):  # whatever a chunk brings
        text = " ".join("".join(rnd.choice("abcdé<|x") for _ in range(rnd.randint(1, 40))) for _ in range(size)) + " the of <|endoftext|> the"
        flat, ends = held([text.encode()])
        assert flat.tolist() == library.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(flat)]
        assert held.memo.nbytes <= 20_000 and len(held.memo.keys) > 0
    frequent = held.memo.places(pa.array([b" the"], pa.large_binary()))
    assert frequent[0] >= 0  # what batches ask for most often stays


def test_cuts_of_many_documents():
    tokens = np.array([1, 2, 3, 63, 64, 65, 200, 1, 4096, 4095])
    parents, starts, lengths = packing.cuts(tokens, 64)
    for k, n in enumerate(tokens.tolist()):
        own = lengths[parents == k].tolist()
        assert own == packing.piece_lengths(n, 64)
        assert starts[parents == k].tolist() == np.concatenate([[0], np.cumsum(own)])[:-1].tolist()
    assert all(len(x) == 0 for x in packing.cuts(np.empty(0, np.int64), 64))


def test_words_are_folded_before_they_are_looked_up(texts):
    words = [
        "The the THE\nthe.The, thE's IT'S Élan élan ÉLAN ÀÞß×÷ÿ ÿ Ÿ İi H̱ é́ É́ ÉA ÉÉÉ naïve NAÏVE\nCiÓN ción cIóN í Í ıI ΣΑΣ ſK K å Å",
        " Word\nword \n\nWord\tword x<|endoftext|>X <|ENDOFTEXT|> <|startoftext|> Le<|startoftext|>LE", "É", " É", "\nÉ", "́ É ́", "",
    ]
    rnd = random.Random(8)
    words += ["".join(rnd.choice("abAB'sS. \n×÷ÀÉéßÿŸ́í19漢") for _ in range(300)) for _ in range(300)]
    data = [t.encode() for t in texts + words] + [b"\xc3 A\xc3", b"\x80B \xc3A \xc3\xc3\x89 \xc3\x97"]  # not UTF-8
    for added in (False, True):
        tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        tokenizer.encode_special_tokens = not added
        want = [x.ids for x in tokenizer.encode_batch([x.decode("utf-8", "replace") for x in data], add_special_tokens=False)]
        held = pieces.tokenizer_pieces(q.WORD_TOKENIZER, added)
        for _ in range(2):
            flat, ends = held(data)
            assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    known = set(held.memo.keys.to_pylist())
    assert b"the" in known and b"\xc3\xa9lan" in known and not known & {b" the", b" The", b"\xc3\x89lan", b" \xc3\x89lan"}
    assert not pieces.tokenizer_pieces(q.BYTE_TOKENIZER, True)._folding


def test_words_of_a_byte_level_vocabulary_go_to_its_model(texts, monkeypatch):
    words = [
        "The the THE\nthe.The, thE's IT'S we're'LL Élan élan  É ÀÞß×÷ÿ ÿ Ÿ İi H̱ é́ É́ naïve\nCiÓN ción Σ ſK K å Å ªº µ", "", " ", " É", "\nÉ", "a­a",
        " x<|endoftext|>X Le<|endoftext|>LE", " ".join(chr(i) + "a" + chr(i) for i in range(0x20, 0x180)), "\xa0é é\xa0 \x85é",
    ]
    rnd = random.Random(9)
    words += ["".join(rnd.choice("abAB'sS. \n×÷ÀÉéßÿŸ́í19漢") for _ in range(300)) for _ in range(300)]
    data = [t.encode() for t in texts + words] + [b"\xc3 A\xc3", b"\x80B \xc3A \xc3\xc3\x89 \xc3\x97"]  # not UTF-8
    for added in (False, True):
        tokenizer = Tokenizer.from_file(q.BYTE_TOKENIZER)
        tokenizer.encode_special_tokens = not added
        want = [x.ids for x in tokenizer.encode_batch([x.decode("utf-8", "replace") for x in data], add_special_tokens=False)]
        held = pieces.tokenizer_pieces(q.BYTE_TOKENIZER, added)
        for _ in range(2):
            flat, ends = held(data)
            assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_plain_words_pass_the_pattern_by(tmp_path):
    """Only pieces that are not a word are encoded as text; none is where an added token may stand in a word."""
    from tokenizers import AddedToken

    def by_text(path):
        held, seen = pieces.tokenizer_pieces(path), []
        inner = dict(zip(held._encode.__code__.co_freevars, (x.cell_contents for x in held._encode.__closure__)))["by_text"]
        cell = next(x for n, x in zip(held._encode.__code__.co_freevars, held._encode.__closure__) if n == "by_text")
        cell.cell_contents = lambda some: seen.extend(some) or inner(some)
        flat, _ = held([b"plain words and \xc3\xa9lan, 12 more"])
        want = Tokenizer.from_file(path)
        assert flat.tolist() == want.encode("plain words and élan, 12 more", add_special_tokens=False).ids
        return set(seen)

    assert by_text(q.BYTE_TOKENIZER) == {b",", b" 12"}
    other = Tokenizer.from_file(q.BYTE_TOKENIZER)
    other.add_tokens([AddedToken("ord", normalized=False)])
    other.save(str(tmp_path / "other.json"))
    assert b" words" in by_text(str(tmp_path / "other.json"))
