"""Run-length encoding of array columns, nested and long."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.functions import sequences as sq
from loomseq.functions.columns import each
from loomseq.functions import shapes as S


def _runs(compat: bool):
    @F.arrow_udf(S.RUNS)
    @sq.in_slices
    def runs(column: pa.Array) -> pa.Array:
        values, first = sq.flat(column)
        length, place, begin = sq.runs(sq.codes_of(values), first, compat)
        made = pa.StructArray.from_arrays([pa.array(length, pa.int32()), pa.array(place, pa.int32())], names=["n", "at"])
        return sq.nested(made, begin, column)

    return runs


RUNS = {compat: _runs(compat) for compat in (False, True)}


@lru_cache(64)
def _typed(element: T.DataType, compat: bool):
    """Encoding and decoding in one Arrow function each, for elements of a known type."""
    run = T.StructType().add("n", T.IntegerType()).add("value", element)

    @F.arrow_udf(T.ArrayType(run))
    @sq.in_slices
    def coded(column: pa.Array) -> pa.Array:
        values, first = sq.flat(column)
        length, place, begin = sq.runs(sq.codes_of(values), first, compat)
        own = np.repeat(first[:-1], np.diff(begin))
        made = pa.StructArray.from_arrays([pa.array(length, pa.int32()), values.take(pa.array(own + place - 1))], names=["n", "value"])
        return sq.nested(made, begin, column)

    @F.arrow_udf(T.ArrayType(element))
    @sq.in_slices
    def restored(column: pa.Array) -> pa.Array:
        runs, first = sq.flat(column)
        values = runs.field("value")
        many = np.where(np.asarray(values.is_null()), 1, np.maximum(np.asarray(runs.field("n").fill_null(0)), 0))
        begin = np.concatenate(([0], np.cumsum(many)))[first]
        return sq.nested(values.take(pa.array(np.repeat(np.arange(len(many)), many))), begin, column)

    return coded, restored


def encode(seq: Column, compat: bool = False, element: T.DataType | None = None) -> Column:
    """Array of (n, value): runs of equal neighbours; every null is a run of its own.  An empty array stays empty.

    ``compat`` repeats or loses nulls at the ends of a sequence (functions.sequences.runs), which can't be undone.  Where the
    elements' type is told, values come straight from the Arrow function, else built-in expressions fetch them.
    """
    if element is not None:
        return _typed(element, compat)[0](seq)
    return each(lambda r, s: F.struct(r["n"].alias("n"), F.get(s, r["at"] - 1).alias("value")), RUNS[compat](seq), seq)


def decode(runs: Column, element: T.DataType | None = None) -> Column:
    """The sequence of such runs; a null value counts once whatever its n, and runs of 0 or fewer not at all."""
    if element is not None:
        return _typed(element, False)[1](runs)
    many = lambda r: F.array_repeat(r["value"], F.when(r["value"].isNull(), 1).otherwise(F.greatest(r["n"], F.lit(0))))
    return F.flatten(F.transform(runs, many))


@lru_cache(64)
def _flat(element: T.DataType):
    """Runs of strings or binaries to flat arrays and back, in one Arrow function each."""
    own = pa.binary() if isinstance(element, T.BinaryType) else pa.string()

    @F.arrow_udf(T.ArrayType(element))
    @sq.in_slices
    def laid(column: pa.Array) -> pa.Array:
        runs, first = sq.flat(column)
        values = pa.concat_arrays([runs.field("n").cast(pa.string()).cast(own), runs.field("value").cast(own)])
        turns = np.arange(2 * len(runs)).reshape(2, -1).T.ravel()
        return sq.nested(values.take(pa.array(turns)), 2 * first, column)

    @F.arrow_udf(T.ArrayType(T.StructType().add("n", T.IntegerType()).add("value", element)))
    @sq.in_slices
    def taken(column: pa.Array) -> pa.Array:
        values, first = sq.flat(column)
        size = np.diff(first) // 2
        begin = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(first[:-1] - 2 * begin[:-1], size) + 2 * np.arange(begin[-1])
        counts = values.take(pa.array(at)).cast(pa.string())
        if counts.null_count:
            raise ValueError("a run without a count")
        made = pa.StructArray.from_arrays([counts.cast(pa.int32()), values.take(pa.array(at + 1)).cast(own)], names=["n", "value"])
        return sq.nested(made, begin, column)

    return laid, taken


def to_flat(runs: Column, binary: bool = False, element: T.DataType | None = None) -> Column:
    """Counts as text and values by turns, as one array of strings or (``binary``) binaries; told an element type, strings or binaries by an Arrow function."""
    if element is not None:
        return _flat(element)[0](runs)
    count = lambda r: r["n"].cast("string").cast("binary") if binary else r["n"].cast("string")
    return F.flatten(F.transform(runs, lambda r: F.array(count(r), r["value"])))


def from_flat(flat: Column, element: T.DataType | None = None) -> Column:
    """The runs of such an array: a count that isn't a number, or is null, is an error; an odd last element is left out."""
    if element is not None:
        return _flat(element)[1](flat)

    def run(i: Column, f: Column) -> Column:
        count, value = F.get(f, 2 * i), F.get(f, 2 * i + 1)
        n = F.when(count.isNull(), F.raise_error(F.lit("a run without a count")).cast("int")).otherwise(count.cast("string").cast("int"))
        return F.struct(n.alias("n"), value.alias("value"))

    size = F.floor(F.size(flat) / 2).cast("int")
    at = F.slice(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), 1, F.greatest(size, F.lit(0)))
    return F.when(flat.isNotNull(), each(run, at, flat))


def encode_long(df: DataFrame, *keys: str, position: str = "k", symbol: str = "sym") -> DataFrame:
    """(keys, run, n, value) from rows (keys, position, symbol), by windows: gaps and islands."""
    order = Window.partitionBy(*keys).orderBy(position)
    changed = (~F.col(symbol).eqNullSafe(F.lag(symbol).over(order))) | F.col(symbol).isNull() | (F.row_number().over(order) == 1)
    marked = df.select(*keys, position, symbol, changed.cast("int").alias("__new"))
    islands = marked.select(*keys, symbol, F.sum("__new").over(order).cast("int").alias("run"))
    return islands.groupBy(*keys, "run").agg(F.count(F.lit(1)).cast("int").alias("n"), F.first(symbol).alias("value"))


def decode_long(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, k, sym): the rows that ``encode_long`` was made of."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.where("n > 0").withColumn("__before", before)
    return placed.select(*keys, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("__i"), "__before", F.col("value").alias("sym")).select(*keys, (F.col("__before") + F.col("__i")).cast("int").alias("k"), "sym")
