"""Small column expressions shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def positive(col: Column) -> Column:
    return F.greatest(col.cast("double"), F.lit(0.0))


def log_pos(col: Column) -> Column:
    """log1p of the value, negatives taken as 0."""
    return F.log1p(positive(col))


def add_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def hash_uniform(*keys: str, seed: int = 0) -> str:
    """SQL text of a number in (0, 1) that depends on the keys only, so any partitioning gives it again."""
    text = f"concat_ws(':', {seed}, {', '.join(keys)})"
    return f"((cast(conv(substring(md5({text}), 1, 8), 16, 10) as bigint) + 0.5D) / {float(2**32)!r}D)"


def rounded(df: DataFrame, keys: list[str], digits: int = 6, special: dict[str, int] | None = None) -> DataFrame:
    """Fix the result form: keys as they are, every other number a double of ``digits`` decimals.

    The small shift moves exact halves (sums divided by 2, 4, 8 ...) off the rounding edge, so that
    the last bit of a sum, which depends on the order of addition, cannot change the result.
    """
    special = special or {}
    out = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if f.name in keys:
            out.append(f"cast({name} as bigint) AS {name}" if isinstance(f.dataType, T.IntegralType) else name)
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            d = special.get(f.name, digits)
            out.append(f"round(cast({name} as double) + {0.037 * 10.0**-d!r}D, {d}) AS {name}")
        else:
            out.append(name)
    return df.selectExpr(*out)
