"""Exact duplicates by a heavy-hitter split.

Misra-Gries summaries of the partitions name every digest that may be frequent. Those candidates, of
which there are at most ``capacity``, are counted exactly; the winner of each verified one is
broadcast, and its copies are settled where they lie. All other digests are shuffled as usual; each of
them has at most 2 / (capacity + 1) of the rows, so no task gets a large group.

Defined cases: a null text counts as empty; of equal texts the row with the largest key stays, a null
key is the smallest, and of rows with the same key one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Digests that the broadcast may hold: 4,096 rows of under 200 bytes.
CAPACITY = 4_096

_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def _digests(texts: pa.Array) -> pa.Array:
    """SHA-256 of the text's UTF-8 with A-Z lower-cased; the other bytes of UTF-8 are never A-Z."""
    return pa.array([hashlib.sha256(x.translate(_FOLD)).hexdigest() for x in c.as_bytes(texts)], pa.string())


def text_digest(text: str):
    @F.arrow_udf("string")
    def digest(texts: pa.Array) -> pa.Array:
        return _digests(texts)

    return digest(F.col(text))


def summary(counts: Counter, capacity: int) -> Counter:
    """Misra-Gries reduction: subtract the (capacity + 1)-th largest count, drop what is not above it."""
    if len(counts) <= capacity:
        return counts
    cut = sorted(counts.values(), reverse=True)[capacity]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def frequent(digests: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Candidates (digest): at most ``capacity``, with every digest of over 2 / (capacity + 1) of the rows.

    A partition's summary understates a count by at most its rows / (capacity + 1), so the sums do
    by at most N / (capacity + 1); fewer than ``capacity + 1`` sums can be above that bound.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(batch.column(0).to_pylist())
            if len(seen) > 8 * capacity:
                seen = summary(seen, capacity)
        seen = summary(seen, capacity)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["digest", "n"])

    total = digests.count()
    merged = digests.select("digest").mapInArrow(summarise, "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return merged.filter(F.col("n") > total / (capacity + 1)).select("digest")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    rows = c.written(
        docs.select(F.col(key).alias("key"), text_digest(text).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    )
    candidates = F.broadcast(frequent(rows, capacity))
    best = F.max(F.struct("key", "row")).alias("best")
    hot = c.written(rows.join(candidates, "digest").groupBy("digest").agg(best, F.count("*").alias("n")).filter("n > 1"))
    settled = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    same = Window.partitionBy("digest")
    rest = rest.select("digest", "key", "row", F.max(F.struct("key", "row")).over(same).alias("best"), F.count("*").over(same).alias("n"))
    columns = [
        F.col("key").alias(key),
        F.col("best.key").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    ]
    return settled.select(*columns).unionByName(rest.select(*columns))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with all their columns.

    Losing copies of a frequent text go before the shuffle; the shuffle then carries one text per row
    of the other digests, and each task keeps the first of every digest.
    """
    digest, winner = c.fresh(docs, "digest"), c.fresh(docs, "winner")
    rows = c.written(docs.select(F.col(key).alias("key"), text_digest(text).alias("digest")))
    candidates = F.broadcast(frequent(rows, capacity))
    hot = c.written(rows.join(candidates, "digest").groupBy("digest").agg(F.max("key").alias("best"), F.count("*").alias("n")).filter("n > 1"))
    hot = hot.select(F.col("digest").alias(digest), F.struct(F.col("best").alias("key")).alias(winner))
    tagged = docs.withColumn(digest, text_digest(text)).join(F.broadcast(hot), digest, "left")
    left = tagged.filter(F.col(winner).isNull() | F.col(key).eqNullSafe(F.col(winner)["key"]))
    rank = c.fresh(docs, "rank")
    order = Window.partitionBy(digest).orderBy(F.col(key).desc_nulls_last())
    return left.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*docs.columns)
