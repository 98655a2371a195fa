"""Texts and bytes as sequences of symbols, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.functions.columns import each


def of_bytes(data: Column) -> Column:
    """Binary to an array of one-byte binaries; empty for empty data, null for null."""
    size = F.length(data)
    return F.when(size == 0, F.array().cast("array<binary>")).otherwise(each(lambda i, b: F.substring(b, i, F.lit(1)), F.sequence(F.lit(1), size), data))


def of_text(text: Column) -> Column:
    """The bytes of the text's UTF-8 form, as symbols: positions count bytes."""
    return of_bytes(F.encode(text, "UTF-8"))


def of_chars(text: Column) -> Column:
    """The text's code points, as strings."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def as_text(symbols: Column) -> Column:
    """Byte symbols as strings, each on its own: symbols that aren't UTF-8 (bytes from 0x80 on) are an error, nulls stay."""
    return F.transform(symbols, lambda x: F.when(x.isNotNull(), F.validate_utf8(x.cast("string"))))


def as_bytes(symbols: Column) -> Column:
    """String symbols as their UTF-8 bytes, nulls stay."""
    return F.transform(symbols, lambda x: F.encode(x, "UTF-8"))


def join_bytes(symbols: Column) -> Column:
    """All symbols one after the other, as one binary."""
    return F.unhex(F.array_join(F.transform(symbols, F.hex), ""))


def join_text(symbols: Column) -> Column:
    """Byte symbols as one text; bytes that aren't UTF-8 as a whole are an error."""
    return F.decode(join_bytes(symbols), "UTF-8")


def sequence_of(df: DataFrame, keys: list[str], order_by: list[str], value: str, out: str = "seq") -> DataFrame:
    """One row a key with the array of its values in order (order_by should be total); one shuffle, a key's rows meet in one task."""
    pairs = F.array_sort(F.collect_list(F.struct(*order_by, F.col(value).alias("__value"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["__value"]).alias(out))


def to_long(df: DataFrame, seq: str, *keys: str, position: str = "k", symbol: str = "sym") -> DataFrame:
    """One row a position (1-based) and symbol."""
    return df.select(*keys, F.posexplode(seq).alias("__p", symbol)).select(*keys, (F.col("__p") + 1).alias(position), symbol)


def to_nested(df: DataFrame, *keys: str, position: str = "k", symbol: str = "sym", out: str = "seq") -> DataFrame:
    """The inverse of ``to_long``; empty sequences have no rows there and aren't restored."""
    return sequence_of(df, list(keys), [position], symbol, out)
