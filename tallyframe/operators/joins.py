"""Equi-joins of the responses with a table per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
# Rows of one key that a task of a shuffled join may get.
HOT_ROWS = 2_000_000
# Keys that the summary of a table's heavy keys names, and keys that it follows.
HEAVY_KEYS, FOLLOWED_KEYS = 5_000, 100_000


def fits_broadcast(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Looks at no more than ``max_rows + 1`` rows: their number, and the bytes of numbers, texts and lists."""
    sizes = [F.lit(16)]
    for name, kind in table.dtypes:
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(name), F.lit(0)))
        elif kind.startswith(("array", "map", "struct")):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    size = sum(sizes[1:], sizes[0]).cast("bigint")
    row = table.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return row[0] <= max_rows and row[1] <= max_bytes


def heavy_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> tuple[dict[int, int], int]:
    """Hashes of the keys with more than about ``hot_rows`` rows and how many each has, and the rows without a key.

    A summary of bounded size per task, merged: no count per key. It surely names every key of more than
    some 1/20,000 of the rows; below that a key may go unnoticed, and Spark's own skew handling is left.
    """
    item = F.when(F.col(key).isNotNull(), F.xxhash64(key))
    top = F.call_function("approx_top_k", item, F.lit(HEAVY_KEYS), F.lit(FOLLOWED_KEYS))
    row = rows.agg(top.alias("top"), F.count_if(F.col(key).isNull()).alias("without")).first()
    return {x["item"]: x["count"] for x in row["top"] or [] if x["item"] is not None and x["count"] > hot_rows}, row["without"]


def join_by_key(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
    hot_parts: int | None = None,
    hot_rows: int = HOT_ROWS,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Join of many rows with a table per key; ``how`` is inner, left or left_semi.

    A table of checked size is broadcast. Beyond that the heavy keys of the rows are looked up in a bounded
    summary (of ``measured``, if the rows' keys can be read there for less). Rows of heavy keys, and rows
    without a key if they are many, stay where they are: the few table rows of those keys are broadcast, or,
    if they do not fit either, sent to as many tasks as the key has ``hot_rows`` rows. All other rows are
    shuffled. With ``hot_parts`` keys are counted instead and salted by their share of the rows.
    """
    if fits_broadcast(table, max_rows):
        return rows.join(F.broadcast(table), key, how)
    if hot_parts is not None:
        return _by_share(rows, table, key, how, hot_parts)
    heavy, without = heavy_keys(rows if measured is None else measured, key, hot_rows)
    if not heavy and without <= hot_rows:
        return rows.join(table, key, how)
    hot = F.xxhash64(key).isin(list(heavy)) if heavy else F.lit(False)
    stays = F.col(key).isNull() | (F.col(key).isNotNull() & hot)
    some, others = table.filter(F.col(key).isNotNull() & hot), table.filter(F.col(key).isNotNull() & ~hot)
    far = rows.filter(~stays).join(others, key, how)
    if fits_broadcast(some, max_rows):
        return rows.filter(stays).join(F.broadcast(some), key, how).unionByName(far)
    salts = {h: -(-n // hot_rows) for h, n in heavy.items()}
    listed = rows.sparkSession.createDataFrame(sorted(salts.items()), "_hash long, _salts int")
    near = _salted(
        rows.filter(stays).withColumn("_hash", F.xxhash64(key)), some.withColumn("_hash", F.xxhash64(key)), key, how, listed, "_hash", max(salts.values())
    )
    return near.drop("_hash").unionByName(far)


def _by_share(rows: DataFrame, table: DataFrame, key: str, how: str, hot_parts: int) -> DataFrame:
    """A key that holds more than 1/hot_parts of the rows (there are fewer than ``hot_parts`` of them) is
    salted: its rows go to as many tasks as it has such parts, and its table rows are repeated that often.
    Rows without a key match nothing and are spread over all salts."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(key).isNotNull())
    total = rows.count()
    hot = counts.filter(F.col("_n") * hot_parts > total).select(
        key, F.ceil(F.col("_n") * hot_parts / F.lit(max(total, 1))).cast("int").alias("_salts")
    )
    return _salted(rows, table, key, how, hot, key, hot_parts)


def _salted(rows: DataFrame, table: DataFrame, key: str, how: str, hot: DataFrame, by: str, most: int) -> DataFrame:
    # Row content and map partition: spreads equal rows too, and a retried task repeats its salts.
    content = [c for c in rows.columns if "map<" not in rows.schema[c].dataType.simpleString()]
    spread = F.xxhash64(*content, F.spark_partition_id(), F.monotonically_increasing_id())
    salts = F.when(F.col(key).isNull(), F.lit(most)).otherwise(F.coalesce("_salts", F.lit(1)))
    left = rows.join(F.broadcast(hot), by, "left").withColumn("_salt", F.pmod(spread, salts).cast("int")).drop("_salts")
    right = table.join(F.broadcast(hot), by, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return left.join(right if by == key else right.drop(by), [key, "_salt"], how).drop("_salt")


def keep_keys(rows: DataFrame, keys: DataFrame, key: str, **options) -> DataFrame:
    """Rows whose key is in a given list of keys."""
    return join_by_key(rows, keys.select(key).distinct(), key, "left_semi", **options)
