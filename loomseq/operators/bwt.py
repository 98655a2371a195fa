"""Suffix arrays and the Burrows-Wheeler transform of array, binary and text columns.

Elements are of any type that Arrow sorts (numbers, strings, binaries, dates, timestamps, booleans); others, such as structs,
become ranks first.  The end sentinel is null and sorts first, so sequences must not have nulls of their own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.functions import sequences as sq
from loomseq.functions import shapes as S
from loomseq.functions.columns import each, gather
from loomseq.operators import symbols as sy
from loomseq.sources.shared import written


@F.arrow_udf(S.INTS)
@sq.in_slices
def _suffix_array(column: pa.Array) -> pa.Array:
    values, first = sq.flat(column)
    sa, begin = sq.suffix_arrays(sq.codes_of(values), first)
    return sq.nested(pa.array(sa, pa.int32()), begin, column)


@F.arrow_udf(S.INTS)
@sq.in_slices
def _suffix_array_bytes(column: pa.Array) -> pa.Array:
    codes, first = sq.bytes_flat(column)
    sa, begin = sq.suffix_arrays(codes, first)
    return sq.nested(pa.array(sa, pa.int32()), begin, column)


@F.arrow_udf(S.BYTES)
@sq.in_slices
def _bwt_bytes(column: pa.Array) -> pa.Array:
    out, begin = sq.bwt(*sq.bytes_flat(column))
    return sq.nested(sq.byte_values(out), begin, column)


@F.arrow_udf(S.BYTES)
@sq.in_slices
def _bwt_text(column: pa.Array) -> pa.Array:
    column = column.cast(pa.binary())
    out, begin = sq.bwt(*sq.bytes_flat(column))
    return sq.nested(sq.byte_values(out), begin, column)


def _order(strict: bool):
    @F.arrow_udf(S.INTS)
    @sq.in_slices
    def places(column: pa.Array) -> pa.Array:
        # the transform of the places themselves: where each symbol of the result stands
        values, first = sq.flat(column)
        codes = sq.codes_of(values)
        out, size = [], [0]
        for a, b in zip(first[:-1], first[1:], strict=True):
            at = sq.inverse_places(codes[a:b], strict)
            out.append(at + 1)
            size.append(size[-1] + len(at))
        values = sq.np.concatenate(out) if out else sq.np.empty(0, sq.np.int64)
        return sq.nested(pa.array(values, pa.int32()), sq.np.array(size), column)

    return places


def _inverse_bytes(column: pa.Array) -> tuple[list[bytes | None], pa.Array]:
    values, first = sq.flat(column)
    codes = sq.codes_of(values)
    out, begin = sq.inverse_bwt(codes, first)
    raw = (out - 1).astype(sq.np.uint8).tobytes()
    return [None if null else raw[a:b] for a, b, null in zip(begin[:-1], begin[1:], sq.np.asarray(column.is_null()), strict=True)], column


@F.arrow_udf(S.BINARY)
@sq.in_slices
def _restore_bytes(column: pa.Array) -> pa.Array:
    return pa.array(_inverse_bytes(column)[0], pa.binary())


def ranks(seq: Column) -> Column:
    """The elements as their ranks in the sequence's own order (1-based), for element types that only Spark sorts; nulls stay."""
    return each(lambda x, alphabet: F.when(x.isNotNull(), F.array_position(alphabet, x).cast("int")), seq, F.sort_array(F.array_distinct(seq)))


def suffix_array(seq: Column, strategy: str = "arrow") -> Column:
    """1-based starts of all suffixes in order, the empty one first; ``strategy``: arrow (prefix doubling), hof (sorts slices: for short rows)."""
    if strategy == "hof":
        starts = F.sequence(F.lit(1), F.size(seq) + 1)
        made = each(lambda i, s: F.struct(F.slice(s, i, F.size(s) + 1).alias("s"), i.alias("i")), starts, seq)
        return F.when(seq.isNotNull(), F.transform(F.array_sort(made), lambda x: x["i"]))
    return _suffix_array(seq)


def suffix_array_bytes(data: Column, strategy: str = "arrow") -> Column:
    """The same of binary data, by bytes."""
    if strategy == "hof":
        starts = F.sequence(F.lit(1), F.length(data) + 1)
        made = each(lambda i, b: F.struct(F.substring(b, i, F.length(b)).alias("s"), i.alias("i")), starts, data)
        return F.when(data.isNotNull(), F.transform(F.array_sort(made), lambda x: x["i"]))
    return _suffix_array_bytes(data)


def suffixes(seq: Column, strategy: str = "arrow") -> Column:
    """Structs (suffixindex, suffixstartpos, suffix) in order; suffix is null for the empty one.  Quadratic in size."""
    sa = suffix_array(seq, strategy)
    row = lambda k, a, s: F.struct(k.alias("suffixindex"), F.get(a, k - 1).alias("suffixstartpos"), F.when(F.get(a, k - 1) <= F.size(s), F.slice(s, F.get(a, k - 1), F.size(s) + 1)).alias("suffix"))
    return each(row, F.sequence(F.lit(1), F.size(sa)), sa, seq)


def bwt_of_suffix_array(sa: Column, seq: Column) -> Column:
    """The symbols before the suffixes, null for the whole one; an empty sequence has an empty transform."""
    return F.when(F.size(seq) > 0, gather(seq, F.transform(sa, lambda i: i - 1))).when(seq.isNotNull(), F.slice(seq, 1, 0))


def bwt(seq: Column, strategy: str = "arrow") -> Column:
    return bwt_of_suffix_array(suffix_array(seq, strategy), seq)


def bwt_bytes(data: Column) -> Column:
    """The transform of binary data as an array of one-byte binaries."""
    return _bwt_bytes(data)


def bwt_text(text: Column) -> Column:
    """The transform of the text's UTF-8 bytes."""
    return _bwt_text(text)


def inverse(seq: Column, strict: bool = False) -> Column:
    """The sequence whose transform this is (see functions.sequences.inverse_bwt for what isn't one)."""
    return gather(seq, _order(strict)(seq))


def inverse_bytes(seq: Column) -> Column:
    """Of one-byte symbols, as binary."""
    return _restore_bytes(seq)


def inverse_chunks(seq: Column) -> Column:
    """Of symbols that are binaries of any length, joined."""
    return sy.join_bytes(inverse(seq))


def inverse_text(seq: Column) -> Column:
    """Of one-byte symbols, as text; bytes that aren't UTF-8 are an error."""
    return F.decode(_restore_bytes(seq), "UTF-8")


def matrix(seq: Column, strategy: str = "arrow") -> Column:
    """All rotations of the sequence with its sentinel, in the order of its suffixes.  Quadratic in size."""
    n, end = F.size(seq), F.transform(F.slice(seq, 1, 1), lambda x: F.nullif(x, x))
    made = each(lambda i, s, e: F.concat(F.slice(s, i, F.size(s) + 1), e, F.slice(s, 1, i - 1)), suffix_array(seq, strategy), seq, end)
    return F.when(n > 0, made).when(seq.isNotNull(), F.slice(made, 1, 0))


def suffix_array_long(df: DataFrame, key: str, position: str = "k", symbol: str = "sym") -> DataFrame:
    """(key, suffixindex, suffixstartpos) from rows (key, position, symbol), by prefix doubling with joins and windows only.

    Each round is written to the shared folder, so no round repeats the ones before it.  A key's rows are ranked in one task by a
    sort that spills.  Rounds end when all ranks differ.  Sequences without rows have none here.
    """
    ends = df.groupBy(key).agg((F.max(position) + 1).alias("p"))
    rows = df.select(key, F.col(position).alias("p"), F.col(symbol).alias("s")).unionByName(ends, allowMissingColumns=True)
    ranked = written(rows.select(key, "p", F.dense_rank().over(Window.partitionBy(key).orderBy(F.asc_nulls_first("s"))).alias("r")), "suffix-ranks")
    k = 1
    while ranked.groupBy(key).agg((F.max("r") < F.count("*")).alias("ties")).where("ties").limit(1).count():
        ahead = F.coalesce(F.lead("r", k).over(Window.partitionBy(key).orderBy("p")), F.lit(0))
        ranked = written(ranked.withColumn("a", ahead).select(key, "p", F.dense_rank().over(Window.partitionBy(key).orderBy("r", "a")).alias("r")), "suffix-ranks")
        k *= 2
    return ranked.select(key, F.col("r").alias("suffixindex"), F.col("p").alias("suffixstartpos"))


def bwt_long(df: DataFrame, key: str, position: str = "k", symbol: str = "sym") -> DataFrame:
    """(key, k, sym) of the transform, from rows (key, position, symbol): the symbol before each suffix, null for the whole one.

    Joins of long forms never broadcast: Spark sees the size of the files below, of which few bytes make many rows.
    """
    sa = suffix_array_long(df, key, position, symbol)
    before = df.select(F.col(key), (F.col(position) + 1).alias("suffixstartpos"), F.col(symbol).alias("sym"))
    return sa.join(before.hint("merge"), [key, "suffixstartpos"], "left").select(key, F.col("suffixindex").alias("k"), "sym")


def inverse_long(df: DataFrame, key: str, position: str = "k", symbol: str = "sym") -> DataFrame:
    """(key, k, sym) of the sequence, from rows (key, position, symbol) of its transform, by pointer doubling with joins.

    Each place's pointer leads to the place of the symbol before its own; doubled pointers tell how far each is from the end in as
    many rounds as the length has binary digits.  Rounds are written to the shared folder; rows that have come to the end are only
    copied.  Rows that aren't a transform, so that a walk never ends, raise a ValueError.
    """
    order = Window.partitionBy(key).orderBy(F.asc_nulls_first("s"), "p")
    rows = df.select(F.col(key), F.col(position).alias("p"), F.col(symbol).alias("s"))
    # the sentinel's place is where the walk begins and ends: it leads nowhere, with no step
    ranked = rows.select(key, "p", "s", F.row_number().over(order).cast("long").alias("to"))
    state = written(ranked.select(key, "p", "s", F.when(F.col("s").isNotNull(), F.col("to")).alias("to"), F.when(F.col("s").isNull(), 0).otherwise(1).cast("long").alias("steps")), "walk")
    before = None
    while on := state.where("to is not null").count():
        # of walks that end, some do in each round
        if on == before:
            raise ValueError("not a transform: a walk that comes to no sentinel")
        before = on
        ahead = state.select(F.col(key), F.col("p").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        moved = state.where("to is not null").join(ahead.hint("merge"), [key, "to"]).select(key, "p", "s", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps"))
        state = written(state.where("to is null").unionByName(moved), "walk")
    return state.where("s is not null").select(key, F.col("steps").cast("int").alias("k"), F.col("s").alias("sym"))
