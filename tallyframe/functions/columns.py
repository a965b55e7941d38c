"""Scalar and array column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe.functions.hashing import as_column


def missing_as_null(c: str | Column) -> Column:
    """NaN counts as missing, as it does in data-frame tools outside Spark."""
    return F.nanvl(as_column(c).cast("double"), F.lit(None).cast("double"))


def round_double(c: str | Column, digits: int) -> Column:
    """``round`` of a double, by its decimal text only near a tie and for large numbers: that costs more than a draw."""
    x = as_column(c)
    scaled = x * F.lit(10.0**digits)
    below = F.floor(scaled)
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled - below - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5) / F.lit(10.0**digits)).otherwise(F.round(x, digits))


def fill_zero(c: str | Column) -> Column:
    """I8: null or NaN becomes 0, as float."""
    return F.coalesce(missing_as_null(c), F.lit(0.0)).cast("float")


def category_text(df: DataFrame, name: str) -> Column:
    """Category as string; a missing value is the category 'nan', booleans print capitalised."""
    kind = df.schema[name].dataType
    text = F.col(name).cast("string")
    if isinstance(kind, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit("nan"))


def parse_embedding(c: str | Column) -> Column:
    """Text list, in square or round brackets, to float vector. Any other text, or one with a null, gives NULL."""
    text = F.regexp_replace(as_column(c), r"^\s*\(([^()]*?),?\s*\)\s*$", "[$1]")
    parsed = F.array(F.from_json(text, "array<float>"))  # a list of one, so that text is parsed once
    return F.get(F.filter(parsed, lambda v: ~F.exists(v, lambda x: x.isNull())), F.lit(0))


def as_float_array(df: DataFrame, name: str) -> Column:
    """Vector cell as array<float>; any other cell type is an error."""
    _require_array(df, name)
    return F.col(name).cast("array<float>")


def as_long_array(df: DataFrame, name: str, strict: bool = True) -> Column:
    """Vector cell as array<bigint>, truncating toward zero. ``strict=False`` gives NULL
    instead of an error for NaN."""
    _require_array(df, name)
    if strict:
        return F.col(name).cast("array<bigint>")
    return F.transform(F.col(name), lambda x: x.try_cast("bigint"))


def _require_array(df: DataFrame, name: str) -> None:
    kind = df.schema[name].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise TypeError(f"unsupported cell type of column {name}: {kind.simpleString()}")


def ratings_to_array(df: DataFrame, prefix: str, n: int) -> Column:
    """Columns <prefix>1..<prefix>n as one list; absent columns and missing cells are 0."""
    present = set(df.columns)
    cells = [
        fill_zero(f"{prefix}{i}") if f"{prefix}{i}" in present else F.lit(0.0).cast("float")
        for i in range(1, n + 1)
    ]
    return F.array(*cells) if cells else F.array().cast("array<float>")


def zeros(n: int) -> Column:
    """List of n zeros."""
    return F.array_repeat(F.lit(0.0).cast("float"), n)


def clamp(c: str | Column, lo: float | Column, hi: float | Column) -> Column:
    """Limit to [lo, hi]; NaN stays NaN, NULL stays NULL."""
    value = as_column(c)
    low = lo if isinstance(lo, Column) else F.lit(float(lo))
    high = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(value.isNull() | F.isnan(value), value).otherwise(F.least(F.greatest(value, low), high))


def linspace_values(start: float, stop: float, n: int) -> list[float]:
    """I17 for constant bounds: n evenly spaced values, the last one exactly ``stop``."""
    if n <= 0:
        return []
    if n == 1:
        return [float(start)]
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [float(stop)]


def linspace(start: str | Column, stop: str | Column, n: str | Column) -> Column:
    """I17 with bounds from columns: array of n evenly spaced values."""
    a, b, size = as_column(start).cast("double"), as_column(stop).cast("double"), as_column(n).cast("int")
    grid = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.when(i == size - 1, b).otherwise(a + i * ((b - a) / (size - 1))),
    )
    return (
        F.when(size <= 0, F.array().cast("array<double>"))
        .when(size == 1, F.array(a))
        .otherwise(grid)
    )


def dot(a: Column, b: Column) -> Column:
    """Dot product of two double arrays of equal length, kept inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
