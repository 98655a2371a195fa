"""FM-index: C and Occ tables, the index of a text, and counting and locating patterns by backward search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.functions import sequences as sq
from loomseq.functions import shapes as S
from loomseq.functions.columns import each
from loomseq.operators import bwt as bw
from loomseq.operators.mtf import alphabet

#: Pattern bytes that are held by each task at once; more patterns are searched in blocks.
PATTERN_BYTES = 16 << 20


def cc(bwt: Column) -> Column:
    """Array of (c, sym) by symbol: how many symbols of the transform sort before it; null first, with 0."""
    row = lambda s, ordered: F.struct(F.when(s.isNull(), 0).otherwise(F.array_position(ordered, s).cast("int") - 1).alias("c"), s.alias("sym"))
    return each(row, alphabet(bwt), F.sort_array(bwt))


#: Cells of Occ, as bytes' alphabets at most make them, that a task gives back at a time.
OCC_CELLS = 1 << 23


def _occ_rows(column: pa.Array) -> pa.Array:
    values, first = sq.flat(column)
    codes = sq.codes_of(values)
    rows, inner, outer = [], [0], [0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        symbols = np.unique(codes[a:b])
        for s in symbols:
            rows.append(np.cumsum(codes[a:b] == s, dtype=np.int32))
            inner.append(inner[-1] + b - a)
        outer.append(outer[-1] + len(symbols))
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return sq.nested(sq.nested(pa.array(flat, pa.int32()), np.array(inner)), np.array(outer), column)


_occ = F.arrow_udf(sq.in_slices(_occ_rows, lambda n: n * np.minimum(n, 257), OCC_CELLS), S.INT_ROWS)


def occ(bwt: Column) -> Column:
    """Array of (sym, row of (k, occ, bwt)) by symbol: how often it is among the first k symbols, for every k.  As large as text times alphabet."""
    cells = lambda row, b: F.transform(F.zip_with(row, b, lambda o, x: F.struct(o.alias("o"), x.alias("x"))), lambda z, i: F.struct((i + 1).alias("k"), z["o"].alias("occ"), z["x"].alias("bwt")))
    return F.zip_with(alphabet(bwt), each(cells, _occ(bwt), bwt), lambda s, row: F.struct(s.alias("sym"), row.alias("row")))


def build(seq: Column) -> Column:
    """The whole index of a sequence: (cc, occ, sa).  Three empty arrays for an empty sequence."""
    sa = F.when(F.size(seq) > 0, bw.suffix_array(seq)).otherwise(F.slice(bw.suffix_array(seq), 1, 0))
    transformed = bw.bwt_of_suffix_array(sa, seq)
    return F.struct(cc(transformed).alias("cc"), occ(transformed).alias("occ"), sa.alias("sa"))


def to_bwt(index: Column) -> Column:
    """The transform, read from the first Occ row; empty if the index is."""
    rows = index["occ"]
    return F.transform(F.flatten(F.slice(F.transform(rows, lambda r: r["row"]), 1, 1)), lambda x: x["bwt"])


def cc_long(df: DataFrame, *keys: str, symbol: str = "sym") -> DataFrame:
    """(keys, sym, c) from the transform's rows."""
    counted = df.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(symbol)).rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*keys, F.col(symbol).alias("sym"), F.coalesce(F.sum("__n").over(order), F.lit(0)).cast("int").alias("c"))


def occ_long(df: DataFrame, *keys: str, position: str = "k", symbol: str = "sym") -> DataFrame:
    """(keys, sym, k, occ) from the transform's rows: a row for each symbol of the alphabet and position.

    The join never broadcasts: Spark sees the size of the files below, of which few bytes make many rows.
    """
    symbols = df.select(*keys, F.col(symbol).alias("__s")).distinct()
    grid = df.select(*keys, F.col(position).alias("k"), F.col(symbol).alias("__x")).join(symbols.hint("merge"), list(keys))
    order = Window.partitionBy(*keys, "__s").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.select(*keys, F.col("__s").alias("sym"), "k", F.sum(F.col("__x").eqNullSafe(F.col("__s")).cast("int")).over(order).cast("int").alias("occ"))


#: The columns of a compact index beside its key.
INDEX = ("bwt", "sa", "end", "c", "occ")


def index_bytes(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, bwt, sa, end, c, occ): the compact index that searches use, of a binary or string column; rows with empty or null data have none.

    ``end`` is the sentinel's place in the transform, ``c`` how many symbols sort before each byte, ``occ`` how often each byte
    that occurs is before every SAMPLE-th place.  Build it once, write it as Parquet, and search it as often as needed.
    """
    raw = F.col(data).cast("binary")
    rows = df.select(key, raw.alias("__raw")).where(F.length("__raw") > 0)
    return rows.select(key, _index(F.col("__raw")).alias("__i")).select(key, *[f"__i.{c}" for c in INDEX])


@F.arrow_udf(S.INDEX)
def _index(column: pa.Array) -> pa.Array:
    codes, first = sq.bytes_flat(column)
    sa, begin = sq.suffix_arrays(codes, first)
    own = sq.owners(begin)
    out = np.zeros(len(sa), np.uint8)
    real = sa > 1
    out[real] = codes[(first[:-1][own] + sa - 2)[real]] - 1  # the sentinel's place is where sa is 1
    ends = np.flatnonzero(sa == 1) - begin[:-1] if len(codes) else np.zeros(len(column), np.int64)
    bwts, cs, occs = [], [], []
    for a, b, end in zip(begin[:-1], begin[1:], ends.tolist(), strict=True):
        c, occ = sq.occ_tables(out[a:b], end)
        bwts.append(out[a:b].tobytes())
        cs.append(c)
        occs.append(occ.astype("<i4").tobytes())
    flat_c = np.concatenate(cs) if cs else np.empty(0, np.int32)
    parts = [pa.array(bwts, pa.binary()), sq.nested(pa.array(sa, pa.int32()), begin), pa.array(ends, pa.int32()), sq.nested(pa.array(flat_c), np.arange(len(cs) + 1) * 257), pa.array(occs, pa.binary())]
    return pa.StructArray.from_arrays(parts, names=list(INDEX))


@F.arrow_udf(S.BINARY)
def _restored(bwt: pa.Array, end: pa.Array) -> pa.Array:
    out = []
    for raw, place in zip(bwt.to_pylist(), end.to_pylist(), strict=True):
        if raw is None:
            out.append(None)
            continue
        codes = np.frombuffer(raw, np.uint8).astype(np.int32) + 1
        codes[place] = 0
        out.append((codes[sq.inverse_places(codes)] - 1).astype(np.uint8).tobytes())
    return pa.array(out, pa.binary())


def restore(index: Column) -> Column:
    """The binary whose compact index (a struct of INDEX) this is; null for null."""
    return _restored(index["bwt"], index["end"])


def _searched(bwt: pa.Array, end: pa.Array, c: pa.Array, occ: pa.Array, patterns: list[bytes], compat: bool) -> list[list[tuple[int, int]] | None]:
    """For each stored index the interval of each pattern; None where there is no index."""
    tables, first = sq.flat(c)
    tables = np.asarray(tables)
    out = []
    for i, (raw, place, rows) in enumerate(zip(bwt.to_pylist(), end.to_pylist(), occ.to_pylist(), strict=True)):
        if raw is None:
            out.append(None)
            continue
        stored = sq.Stored(raw, place, tables[first[i] : first[i + 1]], np.frombuffer(rows, "<i4"))
        out.append([sq.interval(stored, p, compat) for p in patterns])
    return out


def counter(patterns: list[bytes], compat: bool = False):
    """An Arrow function of an index's bwt, end, c and occ: array of (pattern, n), n null where the pattern is nowhere."""

    @F.arrow_udf(S.COUNTS)
    def counted(bwt: pa.Array, end: pa.Array, c: pa.Array, occ: pa.Array) -> pa.Array:
        found = _searched(bwt, end, c, occ, patterns, compat)
        n = [high - low or None for x in found if x is not None for low, high in x]
        names = pa.array(patterns, pa.binary()).take(pa.array(np.tile(np.arange(len(patterns)), sum(x is not None for x in found))))
        made = pa.StructArray.from_arrays([names, pa.array(n, pa.int32())], names=["pattern", "n"])
        return sq.nested(made, np.concatenate(([0], np.cumsum([len(patterns) * (x is not None) for x in found]))).astype(np.int64), bwt)

    return counted


def locator(patterns: list[bytes], compat: bool = False):
    """An Arrow function of an index's bwt, end, c, occ and sa: array of (pattern, positions), in the order of the suffixes."""

    @F.arrow_udf(S.PLACES)
    def located(bwt: pa.Array, end: pa.Array, c: pa.Array, occ: pa.Array, sa: pa.Array) -> pa.Array:
        found = _searched(bwt, end, c, occ, patterns, compat)
        starts, first = sq.flat(sa)
        starts = np.asarray(starts)
        parts = [starts[first[i] + low : first[i] + high] for i, x in enumerate(found) if x is not None for low, high in x]
        names = pa.array(patterns, pa.binary()).take(pa.array(np.tile(np.arange(len(patterns)), sum(x is not None for x in found))))
        positions = sq.nested(pa.array(np.concatenate([starts[:0], *parts]), pa.int32()), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64))
        made = pa.StructArray.from_arrays([names, positions], names=["pattern", "positions"])
        return sq.nested(made, np.concatenate(([0], np.cumsum([len(patterns) * (x is not None) for x in found]))).astype(np.int64), bwt)

    return located


def _blocks(patterns: list[bytes | str]) -> list[tuple[int, list[bytes]]]:
    """The patterns as bytes, in blocks of PATTERN_BYTES, each with the number of its first."""
    out, size = [], 0
    for i, p in enumerate(patterns):
        raw = p.encode() if isinstance(p, str) else bytes(p)
        if not out or size + len(raw) > PATTERN_BYTES:
            out.append((i, []))
            size = 0
        out[-1][1].append(raw)
        size += len(raw)
    return out


def locate(index: DataFrame, key: str, patterns: list[bytes | str], compat: bool = False) -> DataFrame:
    """(key, pattern_idx, pattern, positions): 1-based byte positions in the order of the suffixes; none: an empty array.

    One row for each indexed row and pattern, in the patterns' order with repeats; an empty pattern is nowhere.  By default a
    pattern is found where it is; ``compat`` cuts a pattern behind its last byte that the text lacks (unless that is its last).
    Patterns are the caller's own list: every task holds them, PATTERN_BYTES at a time.
    """
    out = None
    for at, block in _blocks(patterns):
        found = index.select(key, F.posexplode(locator(block, compat)("bwt", "end", "c", "occ", "sa")).alias("__p", "__r"))
        rows = found.select(key, (F.col("__p") + at).alias("pattern_idx"), "__r.pattern", "__r.positions")
        out = rows if out is None else out.union(rows)
    return index.select(key, F.lit(0).alias("pattern_idx"), F.lit(b"").alias("pattern"), F.col("sa").alias("positions")).limit(0) if out is None else out


def count(index: DataFrame, key: str, patterns: list[bytes | str], compat: bool = False) -> DataFrame:
    """(key, pattern_idx, pattern, n): as ``locate``, the number of places, null for none; the suffix array isn't read."""
    out = None
    for at, block in _blocks(patterns):
        found = index.select(key, F.posexplode(counter(block, compat)("bwt", "end", "c", "occ")).alias("__p", "__r"))
        rows = found.select(key, (F.col("__p") + at).alias("pattern_idx"), "__r.pattern", "__r.n")
        out = rows if out is None else out.union(rows)
    return index.select(key, F.lit(0).alias("pattern_idx"), F.lit(b"").alias("pattern"), F.lit(0).alias("n")).limit(0) if out is None else out


def effective(data: Column, pattern: bytes) -> Column:
    """What ``compat`` looks for: the longest end of the pattern whose bytes the data all has; null if there is none."""
    out = F.lit(None).cast("binary")
    for i in range(len(pattern) - 1, -1, -1):
        has = F.lit(True)
        for b in set(pattern[i:]):
            has = has & (F.position(F.lit(bytes([b])).cast("binary"), data) > 0)
        out = F.when(has, F.lit(pattern[i:])).otherwise(out)
    return out


def text_positions(data: Column, pattern: bytes) -> Column:
    """Without an index: ascending 1-based byte positions, for few patterns; built-in expressions only."""
    m = len(pattern)
    n = F.length(data)
    if not m:
        return F.slice(F.sequence(F.lit(1), F.lit(1)), 1, 0)
    at = F.slice(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), 1, F.greatest(n - m + 1, F.lit(0)))
    return F.filter(at, lambda i: F.substring(data, i, F.lit(m)) == F.lit(pattern))


def text_count(data: Column, pattern: bytes) -> Column:
    """The number of those places, null for none."""
    return F.nullif(F.size(text_positions(data, pattern)), F.lit(0))
