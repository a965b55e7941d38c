"""Random order of keys and rows without a global sort (K2, K3, K5).

"Choose k of n keys without replacement" takes the first k keys in the order ``(hash, key)``.
The hash is uniform over distinct keys, so its top bits split the keys into even buckets: bucket
counts give the place of any rank, and only the few buckets that hold a wanted rank are looked into.
The result is a *cut* ``(hash, key)`` per k. Membership of a row then is a comparison of its own
hash with that cut: no join, no shuffle and no broadcast of keys, however many rows a key has.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.hashing import HASH_BITS, HASH_FN, HASH_RANGE, hash48
from tallyframe.session import checkpointed

BUCKET_BITS = 12
MAX_BUCKET_BITS = 20
# A window task of a per-group rank gets pieces of about so many rows, however large the table is.
SPLIT_ROWS = 1_000_000
# Rows that a task of a per-group rank gets on average at most.
RANKED_ROWS = 2_000_000
COPY_CHUNK = 65_536
FETCH_KEYS = 20_000
MAX_LISTED = 50_000  # groups or pieces of groups in a broadcast


def split_size(n: int, size: float | int) -> int:
    """K5: number of keys on the held-out side; an error if nothing is left on the other side."""
    if isinstance(size, bool) or size < 0:
        raise ValueError("size must be a count or a share in (0, 1)")
    if isinstance(size, float) and not 0.0 < size < 1.0:
        raise ValueError("a share must lie in (0, 1)")
    held = size if isinstance(size, int) else math.ceil(size * n)
    if n - held < 1:
        raise ValueError(f"no key would be left: {held} of {n} held out")
    return held


def floor_size(n: int, ratio: float) -> int:
    """K5: number of keys kept by a reduction."""
    return int(n * ratio)


@dataclass(frozen=True)
class Cut:
    """Last key, in hash order, of the first k. ``h`` is -1 when nothing is chosen; ``key`` is set
    only if another key shares the hash, since the hash alone decides otherwise."""

    h: int
    key: object = None

    def includes(self, h: Column, key: Column) -> Column:
        if self.key is None:
            return h <= F.lit(self.h)
        return (h < self.h) | ((h == self.h) & (key <= F.lit(self.key)))


@dataclass(frozen=True)
class KeyChoice:
    """The first k of the n distinct keys of one column, for one or several k (ascending)."""

    key: str
    seed: str
    hash_fn: str
    n: int
    ks: list[int]
    cuts: list[Cut]

    @property
    def h(self) -> Column:
        return hash48(self.seed, self.key, fn=self.hash_fn)

    def chosen(self, position: int = -1) -> Column:
        """Row predicate: the key is among the first ``ks[position]``."""
        return self.cuts[position].includes(self.h, F.col(self.key))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Rows of the largest choice, with the position of the smallest choice that holds them."""
        missed = [F.when(c.includes(F.col("_h"), F.col(self.key)), 0).otherwise(1) for c in self.cuts[:-1]]
        return (
            df.filter(self.chosen())
            .withColumn("_h", self.h)
            .withColumn(name, reduce(lambda a, b: a + b, missed, F.lit(0)))
            .drop("_h")
        )


def choose_keys(
    df: DataFrame,
    key: str,
    seed: int | str,
    sizes: Callable[[int], list[int]],
    hash_fn: str = HASH_FN,
    bits: int = BUCKET_BITS,
    reject_null: bool = False,
) -> KeyChoice:
    """Cuts for ``sizes(n)`` keys, given the number n of distinct keys.

    One distinct over one column; the driver sees bucket counts and at most FETCH_KEYS keys. A missing
    key is no key: it is left out, or with ``reject_null`` an error.
    """
    if reject_null and not df.filter(F.col(key).isNull()).select(key).isEmpty():
        raise ValueError(f"{key} is missing in some rows")
    keys = (
        df.select(key).filter(F.col(key).isNotNull()).distinct()
        .withColumn("_h", hash48(seed, key, fn=hash_fn))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        counts = {
            r["_b"]: r["count"]
            for r in keys.groupBy(_bucket("_h", bits).alias("_b")).count().collect()
        }
        n = sum(counts.values())
        ks = sizes(n)
        if list(ks) != sorted(ks):
            raise ValueError("sizes must ascend")
        cuts = _cuts(keys, key, counts, [min(k, n) for k in ks], bits)
    finally:
        keys.unpersist()
    return KeyChoice(key, str(seed), hash_fn, n, list(ks), cuts)


def choose_many(
    df: DataFrame,
    key: str,
    seed: int | str,
    sizes: Callable[[int], list[int]],
    hash_fn: str = HASH_FN,
    bits: int = BUCKET_BITS,
) -> list[KeyChoice]:
    """One choice per size, each in an order of its own: level i has the seed "<seed>/<i>".

    The distinct keys are found once. Bucket counts of all levels come from one aggregate over them;
    at most 2^bits counts per level reach the driver.
    """
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = keys.count()
        ks = sizes(n)
        hashes = [hash48(f"{seed}/{i}", key, fn=hash_fn) for i in range(len(ks))]
        places = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftright(h, HASH_BITS - bits).alias("b")) for i, h in enumerate(hashes)])
        counts: list[dict[int, int]] = [{} for _ in ks]
        for r in keys.select(F.inline(places)).groupBy("i", "b").count().collect():
            counts[r["i"]][r["b"]] = r["count"]
        cuts = _cuts_of_levels(keys, key, hashes, counts, [min(k, n) for k in ks], bits)
        return [KeyChoice(key, f"{seed}/{i}", hash_fn, n, [k], [cut]) for i, (k, cut) in enumerate(zip(ks, cuts))]
    finally:
        keys.unpersist()


def _cuts(keys: DataFrame, key: str, counts: dict[int, int], ks: list[int], bits: int) -> list[Cut]:
    """Selects the wanted ranks by hash prefix: buckets that hold one are counted again by longer
    prefixes until they are few keys together, and only those are fetched."""
    inside = _locate(counts, [(k, None, k) for k in set(ks) if k > 0])
    while sum(counts[b] for b in {b for b, _ in inside.values()}) > FETCH_KEYS and bits < HASH_BITS:
        longer = min(bits + BUCKET_BITS, HASH_BITS)
        buckets = sorted({b for b, _ in inside.values()})
        finer = (
            keys.filter(_bucket("_h", bits).isin(buckets))
            .groupBy(_bucket("_h", longer).alias("_b")).count().collect()  # at most 2^12 counts per rank
        )
        counts = {r["_b"]: r["count"] for r in finer}
        inside = _locate(counts, [(k, (b, longer - bits), rank) for k, (b, rank) in inside.items()])
        bits = longer
    found = {0: Cut(-1)}
    if inside:
        buckets = sorted({b for b, _ in inside.values()})
        rows = sorted(
            (b, h, value)
            for b, h, value in keys.filter(_bucket("_h", bits).isin(buckets)).select(_bucket("_h", bits), "_h", key).collect()
        )
        start = {b: bisect_left(rows, b, key=lambda r: r[0]) for b in buckets}
        for k, (b, rank) in inside.items():
            at = start[b] + rank - 1
            shared = any(0 <= o < len(rows) and rows[o][1] == rows[at][1] for o in (at - 1, at + 1))
            found[k] = Cut(rows[at][1], rows[at][2] if shared else None)
    return [found[k] for k in ks]


def _cuts_of_levels(
    keys: DataFrame, key: str, hashes: list[Column], counts: list[dict[int, int]], ks: list[int], bits: int
) -> list[Cut]:
    """The cut of one rank per level, each by a hash of its own: the buckets that hold them are fetched
    together while they are few keys, and looked into level by level beyond that."""
    inside = {i: _locate(counts[i], [(k, None, k)])[k] for i, k in enumerate(ks) if k > 0}
    if sum(counts[i][b] for i, (b, _) in inside.items()) > FETCH_KEYS:
        return [_cuts(keys.withColumn("_h", hashes[i]), key, counts[i], [k], bits)[0] for i, k in enumerate(ks)]
    cuts = [Cut(-1)] * len(ks)
    if inside:
        held = [
            F.when(F.shiftright(hashes[i], HASH_BITS - bits) == b, F.struct(F.lit(i).alias("i"), hashes[i].alias("h")))
            for i, (b, _) in inside.items()
        ]
        found: dict[int, list] = {i: [] for i in inside}
        for r in keys.select(key, F.inline(F.array_compact(F.array(*held)))).collect():
            found[r["i"]].append((r["h"], r[key]))
        for i, (_, rank) in inside.items():
            rows = sorted(found[i])
            h, value = rows[rank - 1]
            shared = any(0 <= o < len(rows) and rows[o][0] == h for o in (rank - 2, rank))
            cuts[i] = Cut(h, value if shared else None)
    return cuts


def _locate(
    counts: dict[int, int], wanted: list[tuple[int, tuple[int, int] | None, int]]
) -> dict[int, tuple[int, int]]:
    """k -> (bucket, rank inside it), for ranks among all buckets or below one shorter prefix."""
    out = {}
    buckets = sorted(counts)
    for k, prefix, rank in wanted:
        for bucket in buckets:
            if prefix is not None and bucket >> prefix[1] != prefix[0]:
                continue
            if rank <= counts[bucket]:
                out[k] = (bucket, rank)
                break
            rank -= counts[bucket]
    return out


def _bucket(h: str, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits)


def rank_keys(
    df: DataFrame, key: str, seed: int | str, hash_fn: str = HASH_FN, bits: int | None = None
) -> DataFrame:
    """K2: every distinct key with its 1-based rank in the random order.

    Sorted per bucket of about a million keys, for which the rows are estimated once if ``bits`` is not
    given; the running offsets are the only single-task step and hold 2^bits rows.
    """
    distinct = df.select(key).filter(F.col(key).isNotNull()).distinct()
    if bits is None:
        bits = bucket_bits(df.agg(F.approx_count_distinct(key)).first()[0])
    keys = (
        distinct
        .withColumn("_h", hash48(seed, key, fn=hash_fn))
        .withColumn("_b", _bucket("_h", bits))
    )
    place = Window.partitionBy("_b").orderBy("_h", key)
    return keys.join(F.broadcast(_offsets(keys, [])), "_b").select(
        key, (F.col("_off") + F.row_number().over(place)).alias("rk")
    )


def _offsets(df: DataFrame, within: list[str]) -> DataFrame:
    """Rows before each bucket, from one row per bucket."""
    running = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = df.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(*within, "_b", (F.sum("_n").over(running) - F.col("_n")).alias("_off"))


def number_copies(df: DataFrame) -> DataFrame:
    """Adds ``_copy`` = 1..c to the c copies of a row that is equal in every column.

    Copies are folded before the shuffle. Their numbers are unfolded in two steps with an exchange
    between them, by row and chunk of COPY_CHUNK numbers, so the copies of one row leave many tasks.
    """
    chunk = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c"), F.lit(COPY_CHUNK).cast("bigint")))
    content = [c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
    return (
        df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_from", chunk)
        .repartition(*content, "_from")
        .withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_c"), F.col("_from") + COPY_CHUNK - 1))))
        .drop("_c", "_from")
    )


def with_row_hash(
    df: DataFrame,
    seed: int | str,
    row_key: list[str] | None = None,
    hash_fn: str = HASH_FN,
    salt: list[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Adds ``_h``, a hash that tells rows apart, and returns the columns that order equal hashes.

    ``row_key`` names columns that are unique per row. Without it all columns and a copy number
    are used, so equal rows are told apart too, and each of them can be drawn.
    """
    if row_key is None:
        row_key = [*df.columns, "_copy"]
        df = number_copies(df)
    cols = [*(salt or []), *[c for c in row_key if c not in (salt or [])]]
    return df.withColumn("_h", hash48(seed, *cols, fn=hash_fn)), list(row_key)


def top_in_group(df: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """First ``limit`` rows per group with ``_rk``.

    The limit is a literal, so Spark cuts every map partition to ``limit`` rows per group before the
    shuffle; a group that holds a third of all rows ends as a few rows per map task.
    """
    place = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(place)).filter(F.col("_rk") <= limit)


def rank_in_group(
    df: DataFrame,
    groups: list[str],
    order: list[str],
    sizes: DataFrame,
    piece_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Full rank ``_rk`` of the rows of each group in the order ``_h, …``.

    ``sizes`` has one row per group: its number of rows ``_n`` and any columns to attach. Groups of more
    than ``piece_rows`` rows are split by hash range into pieces of about that size. The lists of such
    groups and of their pieces are broadcast if they are short, and joined by a shuffle if not. Rows are
    shuffled by group and piece for the rank and for the attached columns, to more tasks than the session's
    shuffles have where those would get more than RANKED_ROWS rows each.
    """
    bound = piece_rows
    pieces = sizes.withColumn("_pieces", F.ceil(F.col("_n") / bound).cast("int")).drop("_n")
    hot = pieces.filter(F.col("_pieces") > 1).select(*groups, "_pieces")
    keys = [*groups, "_b"]
    if hot.isEmpty():
        marked, offsets = df.withColumn("_b", F.lit(0)), None
    else:
        piece = F.floor(F.col("_h") / F.lit(HASH_RANGE) * F.col("_pieces")).cast("int")
        marked = (
            df.join(_listed(hot), groups, "left")
            .withColumn("_b", F.coalesce(piece, F.lit(0)))
            .withColumn("_hot", F.col("_pieces").isNotNull())
            .drop("_pieces")
        )
        offsets = _offsets(marked.filter("_hot"), groups)
        marked = marked.drop("_hot")
    attached = pieces.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    place = Window.partitionBy(*keys).orderBy(*order)
    parts = math.ceil((sizes.agg(F.sum("_n")).first()[0] or 0) / RANKED_ROWS)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        marked = marked.repartition(parts, *keys)
    ranked = marked.join(attached, keys).withColumn("_rk", F.row_number().over(place))
    if offsets is not None:
        ranked = ranked.join(_listed(offsets), keys, "left").withColumn(
            "_rk", F.col("_rk") + F.coalesce("_off", F.lit(0))
        ).drop("_off")
    return ranked.drop("_b")


def _listed(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(MAX_LISTED + 1).count() <= MAX_LISTED else table


def bucket_bits(rows: int) -> int:
    """Bits for buckets of about a million rows; at most 2^20 offsets."""
    return min(max(BUCKET_BITS, math.ceil(math.log2(max(rows, 1) / SPLIT_ROWS))), MAX_BUCKET_BITS)


def rank_rows(df: DataFrame, order: list[str], bits: int = BUCKET_BITS) -> DataFrame:
    """Rank ``_rk`` of all rows in the random order ``_h, …``; sorted per hash bucket, never as a whole."""
    bucketed = df.withColumn("_b", _bucket("_h", bits))
    place = Window.partitionBy("_b").orderBy(*order)
    return (
        bucketed.withColumn("_rk", F.row_number().over(place))
        .join(F.broadcast(_offsets(bucketed, [])), "_b")
        .withColumn("_rk", F.col("_off") + F.col("_rk"))
        .drop("_b", "_off")
    )


def rank_sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """Rank ``_rk`` of all rows in a given order.

    Range-partitioned and sorted once, then fixed by a reliable checkpoint so that the row counts of
    the partitions and the rows themselves are the same data; the place within a partition needs no
    further sort or shuffle.
    """
    ordered = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn("_b", F.shiftright("_id", 33))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(_offsets(placed, [])), "_b")
        .withColumn("_rk", F.col("_off") + within + 1)
        .drop("_id", "_b", "_off")
    )
