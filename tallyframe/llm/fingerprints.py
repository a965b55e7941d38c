"""SimHash fingerprints of 128 bits: DataFrame functions only.

The terms of a text are its runs of three words. Every occurrence votes with the bits of the term's
hash, so a term weighs as much as it is frequent; a bit of the fingerprint is set when more than half
of the votes set it. Two votes are counted in one 64-bit sum, 32 bits each.

``near`` finds all pairs of fingerprints within a Hamming radius r: they are cut into b > r blocks, of
which at least b - r agree, and a table for every choice of b - r blocks meets the pair by equality. A
block key that very many fingerprints share is told apart by one block more: the bits of the table's
other blocks are cut into r + 1, of which one must agree.

A word of more than LONG characters (a text without blanks, a long address) has its runs of RUN
characters as terms, so that such texts are alike by what they share too.

Defined cases: a null text counts as empty, and an empty text has one empty term; equal texts have
equal fingerprints; rows of equal keys are ordered by their texts; a null key comes last in descending
order; the only row of a table is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

WORDS = 3  # words in a term
LONG, RUN = 32, 4  # characters of a word that is cut, and of a run of its characters
RADIUS, BLOCKS = 3, 5
HOT = 4_096  # fingerprints of a block key that are met without a further block


def terms(text: Column) -> Column:
    """Hashes of all runs of WORDS words (shorter at the end of the text), and of the runs of characters of long words."""
    def runs(words: Column) -> Column:
        own = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WORDS))))
        return F.when(F.exists(words, lambda w: F.char_length(w) > LONG), F.concat(own, pieces(words))).otherwise(own)

    def pieces(words: Column) -> Column:
        long = F.filter(words, lambda w: F.char_length(w) > LONG)
        return F.flatten(F.transform(long, lambda w: F.transform(F.array(F.split(w, "")), characters)[0]))

    def characters(signs: Column) -> Column:
        inner = F.slice(signs, 1, F.size(signs) - (RUN - 1))
        return F.transform(inner, lambda s, i: F.xxhash64(F.lit(37), s, *(F.get(signs, i + k) for k in range(1, RUN))))

    # the outer transform binds the words, which would be split again for every element otherwise
    return F.element_at(F.transform(F.array(F.split(text, "[ \\n\\t\\r]+")), runs), 1)


def votes(term: str) -> list[Column]:
    """Sums of the bits of two hashes of the term: sum k has bit k low and bit k + 32 high."""
    hashes = [F.col(term), F.xxhash64(F.lit(31), F.col(term))]
    pair = F.lit(1 << 32 | 1)
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(pair)).alias(f"v{32 * j + k}") for j, h in enumerate(hashes) for k in range(32)]


def signed(total: str) -> list[Column]:
    """The two halves of the fingerprint from the sums of ``votes``."""

    def half(j: int) -> Column:
        word = F.lit(0).cast("long")
        for k in range(32):
            both = F.col(f"v{32 * j + k}")
            for count, bit in ((both.bitwiseAND(F.lit((1 << 32) - 1)), k), (F.shiftrightunsigned(both, 32), k + 32)):
                value = (1 << bit) - (1 << 64 if bit == 63 else 0)
                word = word.bitwiseOR(F.when(count * 2 > F.col(total), F.lit(value)).otherwise(F.lit(0).cast("long")))
        return word

    return [half(0).alias("high"), half(1).alias("low")]


def fingerprints(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row of keys, high, low for every distinct value of the keys; its texts vote together."""
    hashes = texts.select(*keys, F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    counted = hashes.groupBy(*keys).agg(F.count("*").alias("total"), *votes("term"))
    return counted.select(*keys, *signed("total"))


def as_text(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return 1 - distance(a, b) / 128


def _bits(spans: list[tuple[int, int]]) -> Column:
    """Hash of some stretches of the fingerprint, bit 0 the highest of ``high``."""
    parts = []
    for start, end in spans:
        for at, column in ((0, "high"), (64, "low")):
            a, b = max(start, at) - at, min(end, at + 64) - at
            if a < b:
                parts.append(F.shiftrightunsigned(F.col(column), 64 - b).bitwiseAND(F.lit((1 << b - a) - 1 if b - a < 64 else -1)))
    return F.xxhash64(F.lit(0), *parts)


def _choices(radius: int, blocks: int) -> list[tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]]:
    """For each table: the stretches it fixes, and radius + 1 parts of those it leaves open."""
    edges = [128 * k // blocks for k in range(blocks + 1)]
    spans = list(zip(edges, edges[1:]))
    found = []
    for some in combinations(range(blocks), blocks - radius):
        open_bits = [b for i in range(blocks) if i not in some for b in range(*spans[i])]
        cut = [len(open_bits) * k // (radius + 1) for k in range(radius + 2)]
        found.append(([spans[i] for i in some], [[(b, b + 1) for b in open_bits[a:e]] for a, e in zip(cut, cut[1:])]))
    return found


def tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """A row for every choice of blocks - radius blocks: (table, block_key) before the columns of prints."""
    keys = [F.struct(F.lit(k).alias("table"), _bits(fixed).alias("block_key")) for k, (fixed, _) in enumerate(_choices(radius, blocks))]
    return prints.select(F.inline(F.array(*keys)), *prints.columns)


def _told_apart(rows: DataFrame, hot: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Rows of ``tables`` with ``more``: 0, or for hot block keys a row for each further block, with its hash."""
    further = F.lit(None).cast("array<bigint>")
    for k, (_, parts) in enumerate(_choices(radius, blocks)):
        further = F.when(F.col("table") == k, F.array(*[F.xxhash64(F.lit(i), _bits(p)) for i, p in enumerate(parts)])).otherwise(further)
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["table", "block_key"], "left")
    more = F.when(F.col("hot"), further).otherwise(F.array(F.lit(0).cast("long")))
    return marked.withColumn("more", F.explode(more)).drop("hot")


def near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """All pairs (high, low, near_high, near_low, distance) of different fingerprints within the radius.

    Both sides are folded to distinct fingerprints first: copies meet once. Who has a fingerprint is
    told by the tables themselves, so copies need not be expanded into pairs. Block keys of more than
    ``hot`` fingerprints are few (at most one in so many rows) and are told apart by a further block.
    """
    if not 0 <= radius < blocks:
        raise ValueError("there must be more blocks than the radius")
    left = tables(queries.select("high", "low").distinct(), radius, blocks)
    right = tables(prints.select("high", "low").distinct(), radius, blocks)
    keys = c.written(right.groupBy("table", "block_key").count().filter(F.col("count") > hot).select("table", "block_key"))
    left, right = (_told_apart(x, keys, radius, blocks) for x in (left, right))
    right = right.withColumnsRenamed({"high": "near_high", "low": "near_low"})
    away = distance((F.col("high"), F.col("low")), (F.col("near_high"), F.col("near_low")))
    met = left.join(right, ["table", "block_key", "more"]).withColumn("distance", away)
    return met.filter(F.col("distance").between(1, radius)).drop("table", "block_key", "more").distinct()


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, next_uid, key, text, next_text): every row with the next one in descending order of keys.

    Rows are dealt into ranges of keys, each ordered by itself. The first row of a range is also sent,
    as a guest, to the range before it, whose last row it follows. The texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bucket = c.range_bucket(F.col("key"), c.range_splits(rows, "key", 4 * c.partitions(spark)))
    heads = rows.groupBy(bucket.alias("bucket")).agg(F.max("key").alias("head")).orderBy(F.desc("bucket")).collect()  # one per range
    ring = [(x.bucket, x.head, heads[k - 1].bucket, heads[(k + 1) % len(heads)].bucket) for k, x in enumerate(heads)]
    ring = F.broadcast(spark.createDataFrame(ring, "bucket int, head long, before int, after int"))
    own, guest = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("at"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("bucket", bucket).join(ring, "bucket")
    ends = F.when(F.col("key").eqNullSafe(F.col("head")), F.array(own, guest)).otherwise(F.array(own))
    dealt = dealt.select("key", "text", "after", F.inline(ends))
    order = Window.partitionBy("at").orderBy("guest", F.col("key").desc_nulls_last(), "text")
    ranked = dealt.select(
        "key", "text", "guest", "at", "after",
        F.row_number().over(order).cast("long").alias("rank"),
        F.lead("text").over(order).alias("next_text"),
        F.lead("guest").over(order).alias("last"),
    ).filter(~F.col("guest"))
    uid = lambda at, rank: at.cast("long") * (1 << 40) + rank
    following = F.when(F.col("last"), uid(F.col("after"), F.lit(1))).otherwise(uid(F.col("at"), F.col("rank") + 1))
    return ranked.select(uid(F.col("at"), F.col("rank")).alias("uid"), following.alias("next_uid"), "key", "text", "next_text")


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text", asked: Column | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and their likeness.

    The edited text has its last third replaced by as much of the beginning of the next document. ``n_near``
    is, for rows whose key (the column ``key``) meets the condition ``asked``, how many other fingerprints
    of the table lie within RADIUS of the row's own; else null.
    """
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = with_next(docs, key, text).select(
        "uid", "next_uid", "key", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)).alias("edited"),
    )
    rows = rows.withColumn("sha", F.unhex(F.sha2("edited", 256)))
    both = rows.select("uid", "next_uid", "key", "n_chars", "sha", F.posexplode(F.array("text", "edited")).alias("which", "text"))
    prints = c.written(fingerprints(both, "text", ["uid", "next_uid", "key", "n_chars", "sha", "which"]))
    own = prints.filter("which = 0")
    edited = prints.filter("which = 1").select("uid", F.struct("high", "low").alias("e"))
    after = own.select(F.col("uid").alias("next_uid"), F.struct("high", "low").alias("x"))
    joined = own.join(edited, "uid").join(after, "next_uid")
    if asked is None:
        joined = joined.withColumn("n_near", F.lit(None).cast("long"))
    else:
        pairs = near(own.filter(asked), own).groupBy("high", "low").agg(F.count("*").alias("found"))
        joined = joined.join(pairs, ["high", "low"], "left").withColumn("n_near", F.when(asked, F.coalesce("found", F.lit(0))))
    mine, e, x = (F.col("high"), F.col("low")), (F.col("e.high"), F.col("e.low")), (F.col("x.high"), F.col("x.low"))
    return joined.select(
        F.col("key").alias(key), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        as_text(*mine).alias("fingerprint"), as_text(*e).alias("edited_fingerprint"),
        likeness(mine, e).alias("near_edited"), likeness(mine, x).alias("near_next"), "n_near",
    )
