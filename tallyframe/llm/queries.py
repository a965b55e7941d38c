"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common as c, exact_dedup, fingerprints, id_files, identifiers, jaccard_join, labelled, language, packing, quality, runs, slots, spelling, toxicity

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = 50_257
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = c.fold("doc_id", 5) == 0
    sample = labelled.labelled_sample(docs.filter(~held), table(spark, sf_dir, "labels").filter(~held), "toxic")
    return _judged(toxicity.scored(docs, toxicity.fit(sample)), held)


def _judged(rows: DataFrame, held) -> DataFrame:
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"), asked=F.col("key") % 20 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = c.fold("doc_id", 3) == 1
    return _judged(quality.scored(docs, quality_model(docs, table(spark, sf_dir, "labels"))), held)


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fitted on documents of the learning folds only."""
    learns = c.fold("doc_id", 3) != 1
    return quality.fit(labelled.labelled_sample(docs.filter(learns), labels.filter(learns), "quality"))


def language_profiles(docs: DataFrame) -> dict:
    """Learned from documents of the learning folds only."""
    return language.learn(docs.filter(c.fold("doc_id", 4) != 2))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = language.identified(docs.select("doc_id", "text"), language_profiles(docs))
    return rows.select("doc_id", (c.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.col("n_ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1, added=True)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket_rank"]
    return pieces.select(*columns).withColumn("length", F.col("length").cast("long"))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = c.shared_folder(spark)
    splits = c.range_splits(docs, "doc_id", c.partitions(spark))
    id_bytes = (id_files.width(BYTE_VOCABULARY) + 7) // 8
    ids = id_files.encoded(docs, BYTE_TOKENIZER, end_id=0, id_bytes=id_bytes, added=True)
    id_files.write(ids, folder, BYTE_VOCABULARY, splits, id_bytes)
    return id_files.read(spark, folder).select(
        F.col("key").alias("doc_id"),
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op9_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.sharded(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "spread"
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.echoed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.collapsed(docs).withColumn("best", runs.foremost("runs"))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: One of so many runs of letters loses a letter.
RARE = 199


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(table(spark, sf_dir, "documents"), rare=RARE))


def op13_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.identified(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("identifiers", lambda x: ~x["disguised"])

    def count(kind: str):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, identifiers.KINDS),
        F.sha2(identifiers.listed(base), 256).alias("base_sha256"),
        identifiers.listed(F.col("identifiers")).alias("spans"),
        F.size(F.filter("identifiers", lambda x: x["disguised"])).cast("long").alias("n_disguised"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_packing": op7_packing,
    "op8_id_files": op8_id_files,
    "op9_slots": op9_slots,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_runs": op11_runs,
    "op12_spelling": op12_spelling,
    "op13_identifiers": op13_identifiers,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op10_exact_dedup": f"""
        WITH rows AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM rows WINDOW same AS (PARTITION BY text_sha256)
    """,
}
