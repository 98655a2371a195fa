"""Move-to-front of array columns, nested and long."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.functions import sequences as sq
from loomseq.functions.columns import each, gather
from loomseq.functions import shapes as S


def alphabet(seq: Column) -> Column:
    """The distinct symbols in order, null first."""
    return F.sort_array(F.array_distinct(seq))


def _moved(values: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, places, begin): the code, and where in its sequence (1-based) each symbol of the list in the end first stands."""
    codes = sq.codes_of(values)
    indices, lists = sq.move_to_front(codes, first)
    places, size = [np.empty(0, np.int64)], [0]
    for a, b, symbols in zip(first[:-1], first[1:], lists, strict=True):
        known, at = np.unique(codes[a:b], return_index=True)
        places.append(at[np.searchsorted(known, symbols)] + 1)
        size.append(size[-1] + len(symbols))
    return indices, np.concatenate(places), np.array(size)


@F.arrow_udf(S.MOVED)
@sq.in_slices
def _encode(column: pa.Array) -> pa.Array:
    values, first = sq.flat(column)
    indices, places, begin = _moved(values, first)
    parts = [sq.nested(pa.array(indices, pa.int32()), first), sq.nested(pa.array(places, pa.int32()), begin)]
    return pa.StructArray.from_arrays(parts, names=["indices", "places"], mask=column.is_null())


@F.arrow_udf(S.INTS)
def _decode(indices: pa.Array, sizes: pa.Array) -> pa.Array:
    values, first = sq.flat(indices)
    if values.null_count:
        raise ValueError("a null among move-to-front indices")
    size = np.asarray(sizes.fill_null(0))
    # without symbols there is nothing, whatever the indices
    count = np.where(size > 0, np.diff(first), 0)
    keep = np.repeat(size > 0, np.diff(first))
    begin = np.concatenate(([0], np.cumsum(count)))
    ranks = sq.inverse_move_to_front(np.asarray(values)[keep], begin, size)
    return sq.nested(pa.array(ranks, pa.int32()), begin, indices)


@lru_cache(64)
def _typed(element: T.DataType):
    """Encoding and decoding in one Arrow function each, for elements of a known type."""

    @F.arrow_udf(T.StructType().add("indices", S.INTS).add("symbols", T.ArrayType(element)))
    @sq.in_slices
    def coded(column: pa.Array) -> pa.Array:
        values, first = sq.flat(column)
        indices, places, begin = _moved(values, first)
        own = np.repeat(first[:-1], np.diff(begin))
        parts = [sq.nested(pa.array(indices, pa.int32()), first), sq.nested(values.take(pa.array(own + places - 1)), begin)]
        return pa.StructArray.from_arrays(parts, names=["indices", "symbols"], mask=column.is_null())

    @F.arrow_udf(T.ArrayType(element))
    @sq.in_slices
    def restored(pair: pa.Array) -> pa.Array:
        indices, at = sq.flat(pair.field("indices"))
        if indices.null_count:
            raise ValueError("a null among move-to-front indices")
        values, first = sq.flat(pair.field("symbols"))
        codes = sq.codes_of(values)
        # each list as its distinct symbols in order
        order = np.lexsort((codes, sq.owners(first)))
        own = sq.owners(first)[order]
        new = np.ones(len(order), bool)
        new[1:] = (codes[order][1:] != codes[order][:-1]) | (own[1:] != own[:-1])
        order, own = order[new], own[new]
        size = np.bincount(own, minlength=len(pair)).astype(np.int64) if len(own) else np.zeros(len(pair), np.int64)
        count = np.where(size > 0, np.diff(at), 0)
        keep = np.repeat(size > 0, np.diff(at))
        begin = np.concatenate(([0], np.cumsum(count)))
        ranks = sq.inverse_move_to_front(np.asarray(indices)[keep], begin, size)
        base = np.concatenate(([0], np.cumsum(size)))[:-1]
        made = sq.nested(values.take(pa.array(order[np.repeat(base, count) + ranks])), begin)
        return pc.if_else(pc.or_(pair.is_null(), pc.or_(pair.field("indices").is_null(), pair.field("symbols").is_null())), pa.scalar(None, made.type), made) if pair.null_count or pair.field("indices").null_count or pair.field("symbols").null_count else made

    return coded, restored


def encode(seq: Column, element: T.DataType | None = None) -> Column:
    """(indices, symbols): each symbol's 0-based place in a list that begins as ``alphabet`` and gets it moved to the front; the list as it is in the end.

    Where the elements' type is told, symbols come straight from the Arrow function, else built-in expressions fetch them.
    """
    if element is not None:
        return _typed(element)[0](seq)
    made = _encode(seq)
    return F.when(seq.isNotNull(), F.struct(made["indices"].alias("indices"), gather(seq, made["places"]).alias("symbols")))


def decode(pair: Column, element: T.DataType | None = None) -> Column:
    """The sequence; any order of the symbols gives the same.  An index outside the list is an error; no indices or symbols give nothing."""
    if element is not None:
        return _typed(element)[1](pair)
    symbols = alphabet(pair["symbols"])
    return each(lambda r, s: F.element_at(s, r + 1), _decode(pair["indices"], F.size(symbols)), symbols)


def encode_long(df: DataFrame, *keys: str, position: str = "k", symbol: str = "sym") -> DataFrame:
    """(keys, k, idx) from rows (keys, position, symbol), without sequential state.

    A symbol's index is the number of others that were seen since it was last, where symbols not yet seen count as seen before
    the start in the order of the alphabet.  So it is the number of symbols whose last place is after its own last place.
    Makes a row for each position and symbol of the alphabet.
    """
    symbols = df.select(*keys, symbol).distinct()
    ranked = symbols.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first(symbol))) - 1)
    rows = df.select(*keys, F.col(position).alias("__k"), F.col(symbol).alias("__x"))
    grid = rows.join(ranked.hint("merge"), list(keys))
    seen = F.max(F.when(F.col("__x").eqNullSafe(F.col(symbol)), F.col("__k"))).over(Window.partitionBy(*keys, "__r").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1))
    last = grid.select(*keys, "__k", "__r", F.col("__x").eqNullSafe(F.col(symbol)).alias("__own"), F.coalesce(seen, -F.col("__r")).alias("__last"))
    mine = F.max(F.when(F.col("__own"), F.col("__last"))).over(Window.partitionBy(*keys, "__k"))
    counted = last.withColumn("__mine", mine).groupBy(*keys, "__k").agg(F.sum((F.col("__last") > F.col("__mine")).cast("int")).cast("int").alias("idx"))
    return counted.withColumnRenamed("__k", "k")


def final_list_long(df: DataFrame, *keys: str, position: str = "k", symbol: str = "sym") -> DataFrame:
    """(keys, i, sym): the list in the end, by last places, i from 0."""
    last = df.groupBy(*keys, symbol).agg(F.max(position).alias("__last"))
    return last.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__last"))) - 1).alias("i"), F.col(symbol).alias("sym"))
