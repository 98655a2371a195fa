"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(f: Callable[..., Column], array: Column, *columns: Column) -> Column:
    """f(x, *columns) for each x of the array.

    The columns come as a second argument of the lambda, not out of its surroundings: so they may hold Arrow functions, which
    Spark doesn't allow inside lambdas.  Repeating them costs a reference an element.
    """
    given = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return F.zip_with(array, F.array_repeat(given, F.size(array)), lambda x, s: f(x, *[s[f"c{i}"] for i in range(len(columns))]))


def gather(array: Column, places: Column) -> Column:
    """The array's elements at 1-based places; null where a place is 0 or beyond the array."""
    return each(lambda p, a: F.get(a, p - 1), places, array)


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a barrier that keeps what comes before and after it in projections of their own.

    Spark can't plan an Arrow function over nested lambdas over other Arrow functions in one projection, so decoders that follow
    encoders in one plan need this between them.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
