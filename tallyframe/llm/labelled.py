"""A bounded sample of labelled texts, for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Rows of each class, and bytes of text in all, that a classifier is fitted on.
ROWS, BYTES = 1_500, 24 << 20
#: Documents of each class that the choice looks at, in multiples of those it takes.
SPARE = 4


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", rows: int = ROWS, size: int = BYTES) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` documents of each class, at most ``size`` bytes together.

    Keys are drawn by a hash; those without a document, and labels other than 0 and 1, do not count.
    The choice looks at sizes alone: a document that does not fit is passed over for the next one. Only
    the chosen keys meet the texts. A class of which no document fits raises.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("key is not null and label in (0, 1)")
    found = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("key is not null")
    found = found.select("key", (F.octet_length("text") + 1).alias("bytes"), F.xxhash64("text").alias("hash"), "text")
    one = found.groupBy("key").agg(F.min(F.struct("bytes", "hash")).alias("one")).select("key", "one.bytes", "one.hash")
    marked = marked.groupBy("key").agg(F.max("label").alias("label")).join(one, "key")
    marked = c.written(marked)
    order = [F.col("bytes") > size, F.xxhash64(F.lit(41), "key"), F.col("key")]
    # each task keeps its own first rows of a class, so no task gets a class
    lists = [marked.filter(F.col("label") == y).orderBy(*order).limit(SPARE * rows).collect() for y in (0, 1)]
    drawn = [(k, r["label"], r) for own in lists for k, r in enumerate(own)]
    chosen, left, room = [], size, {}
    for _, _, r in sorted(drawn, key=lambda x: x[:2]):  # numbers only, at most 2 x SPARE x rows
        if room.setdefault(r["label"], rows) and r["bytes"] <= left:
            chosen.append((r["key"], r["bytes"], r["hash"], r["label"], len(chosen)))
            left -= r["bytes"]
            room[r["label"]] -= 1
    if lost := [k for k, free in room.items() if free == rows > 0]:
        raise ValueError(f"no document of class {lost} fits into {size} bytes beside those drawn before")
    if not chosen:
        return []
    types = marked.select("key", "bytes", "hash", "label", F.lit(0).alias("rank")).schema
    keys = F.broadcast(spark.createDataFrame(chosen, types))
    texts = found.join(keys, ["key", "bytes", "hash"]).groupBy("rank", "label").agg(F.min("text").alias("text"))
    return [(r["text"], r["label"]) for r in sorted(texts.collect(), key=lambda r: r["rank"])]
