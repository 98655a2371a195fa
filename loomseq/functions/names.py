"""Every transform by a name that says what goes in and what comes out.

``bytestring``/``text``: binary or string columns, or arrays of them; ``bwt``: the transform as an array with a null sentinel;
``rle``, ``mtf``, ``fm_index`` with ``_b`` or ``_t``: codes whose symbols are binaries or strings.  Names are made by rule from
these parts and looked up in ``FUNCTIONS`` or as attributes of this module.  String symbols are made of single bytes, so a text
beyond ASCII is an error in the ``_t`` forms that start from bytes, as in any encoding by bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.functions import sequences as sq
from loomseq.functions import shapes as S
from loomseq.functions.columns import each
from loomseq.operators import bwt as bw
from loomseq.operators import fm, mtf, rle
from loomseq.operators import symbols as sy

FUNCTIONS: dict[str, Callable] = {}


def _chain(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def run(column: Column) -> Column:
        for step in steps:
            column = step(column)
        return column

    return run


def _same(column: Column) -> Column:
    return column


def index_of_bwt(transformed: Column, matrix: Column | None = None) -> Column:
    """The index (cc, occ, sa) of a transform; the suffix array comes from its matrix of rotations, or else from the sequence that it restores."""
    if matrix is not None:
        # a rotation is a suffix, the sentinel and what is before the suffix
        sa = F.transform(matrix, lambda row: (F.size(row) + 1 - F.array_position(F.transform(row, lambda x: x.isNull()), True)).cast("int"))
    else:
        original = bw.inverse(transformed)
        sa = F.when(F.size(transformed) > 0, bw.suffix_array(original)).otherwise(F.slice(bw.suffix_array(original), 1, 0))
    return F.struct(fm.cc(transformed).alias("cc"), fm.occ(transformed).alias("occ"), sa.alias("sa"))


def _index_of_bwt(symbols: Callable[[Column], Column]) -> Callable[..., Column]:
    return lambda transformed, matrix=None: index_of_bwt(symbols(transformed), matrix)


TRANSFORM = {"bytestring": bw.bwt_bytes, "text": bw.bwt_text}
SYMBOLS = {"b": _same, "t": sy.as_text}
ENCODE = {"rle": rle.encode, "mtf": mtf.encode, "fm_index": index_of_bwt}
DECODE = {"rle": rle.decode, "mtf": mtf.decode, "fm_index": fm.to_bwt}
JOIN = {"bytestring": bw.inverse_chunks, "text": _chain(bw.inverse_chunks, lambda c: F.decode(c, "UTF-8"))}
#: element types from one to the other
CONVERT = {("bytestring", "b"): _same, ("bytestring", "t"): sy.as_text, ("text", "b"): sy.as_bytes, ("text", "t"): _same}
BACK = {("bytestring", "b"): _same, ("bytestring", "t"): sy.as_bytes, ("text", "b"): sy.as_text, ("text", "t"): _same}


def _typed(code: str, s: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Encoder and decoder of a code whose symbols are binaries (b) or strings (t)."""
    element = T.BinaryType() if s == "b" else T.StringType()
    if code == "rle":
        return lambda c: rle.encode(c, element=element), lambda c: rle.decode(c, element)
    if code == "mtf":
        return lambda c: mtf.encode(c, element), lambda c: mtf.decode(c, element)
    return ENCODE[code], DECODE[code]


for code in ENCODE:
    for kind in ("bytestring", "text"):
        for s in ("b", "t"):
            encode, decode = _typed(code, s)
            FUNCTIONS[f"{kind}_to_bwt_to_{code}_{s}"] = _chain(TRANSFORM[kind], SYMBOLS[s], encode)
            FUNCTIONS[f"{kind}_bwt_to_{code}_{s}"] = _chain(SYMBOLS[s], encode) if code != "fm_index" else _index_of_bwt(SYMBOLS[s])
            if code != "fm_index":
                FUNCTIONS[f"{kind}_to_{code}_{s}"] = _chain(CONVERT[kind, s], encode)
            FUNCTIONS[f"{kind}_from_bwt_from_{code}_{s}"] = _chain(decode, BACK["bytestring", s], JOIN[kind])
            FUNCTIONS[f"{kind}_bwt_from_{code}_{s}"] = _chain(decode, BACK[kind, s])
            FUNCTIONS[f"{kind}_from_{code}_{s}"] = _chain(decode, BACK[kind, s])


def _search(made: Callable, columns: tuple[str, ...], patterns: list[bytes | str], data: Column, compat: bool) -> Column:
    raw = [p.encode() if isinstance(p, str) else bytes(p) for p in patterns]
    index = fm._index(F.when(F.length(data) > 0, data))
    return made(raw, compat)(*[index[c] for c in columns])


def counts(patterns: list[bytes | str], data: Column, compat: bool = False) -> Column:
    """Array of (pattern, n) of one binary: n is null where the pattern is nowhere; no elements for empty or null data or no patterns."""
    found = _search(fm.counter, ("bwt", "end", "c", "occ"), patterns, data.cast("binary"), compat)
    return F.when(F.length(data) > 0, found).otherwise(F.slice(found, 1, 0))


def places(patterns: list[bytes | str], data: Column, compat: bool = False) -> Column:
    """Array of (pattern, positions): 1-based byte positions in the order of the suffixes."""
    found = _search(fm.locator, ("bwt", "end", "c", "occ", "sa"), patterns, data.cast("binary"), compat)
    return F.when(F.length(data) > 0, found).otherwise(F.slice(found, 1, 0))


def _in_text(search: Callable[..., Column], field: str) -> Callable[..., Column]:
    """The same of a text, whose patterns come back as texts; a text beyond ASCII is an error, as byte symbols as strings are."""

    def run(patterns: list[bytes | str], data: Column, compat: bool = False) -> Column:
        ascii_only = F.when(F.length(data) == F.octet_length(data), data).when(data.isNotNull(), F.raise_error(F.lit("a text beyond ASCII")).cast("string"))
        return F.transform(search(patterns, ascii_only, compat), lambda r: F.struct(F.decode(r["pattern"], "UTF-8").alias("pattern"), r[field].alias(field)))

    return run


def _interval(compat: bool):
    @F.arrow_udf(S.INTERVAL)
    def search(codes: pa.Array, pattern: pa.Array) -> pa.Array:
        values, first = sq.flat(codes)
        asked, at = sq.flat(pattern)
        values, asked = sq.np.asarray(values), sq.np.asarray(asked)
        made = [sq.interval(sq.Searcher(values[a:b]), asked[c:d].tolist(), compat) for a, b, c, d in zip(first[:-1], first[1:], at[:-1], at[1:], strict=True)]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in made], pa.int32()), pa.array([x for _, x in made], pa.int32())], names=["low", "high"])

    return search


def interval(pattern: Column, index: Column, compat: bool = False) -> Column:
    """(low, high): the rows of the index's suffix array, low + 1 to high, whose suffixes begin with the pattern (an array of symbols)."""
    transformed = fm.to_bwt(index)
    symbols = F.filter(mtf.alphabet(transformed), lambda s: s.isNotNull())
    rank = lambda x, known: F.coalesce(F.array_position(known, x), F.lit(0)).cast("int")
    asked = each(lambda x, known: F.when(rank(x, known) > 0, rank(x, known)).otherwise(-1), pattern, symbols)
    return _interval(compat)(each(rank, transformed, symbols), asked)


def count_fm_index(pattern: Column, index: Column, compat: bool = False) -> Column:
    r = interval(pattern, index, compat)
    return F.nullif(r["high"] - r["low"], F.lit(0))


def locate_fm_index(pattern: Column, index: Column, compat: bool = False) -> Column:
    """Rows of the suffix array (1-based), not positions."""
    r = interval(pattern, index, compat)
    return F.when(r["high"] > r["low"], F.sequence(r["low"] + 1, r["high"])).otherwise(F.slice(F.sequence(F.lit(1), F.lit(1)), 1, 0))


def sort_tb(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by first and then second field, nulls first."""
    return F.when(a.eqNullSafe(b), 0).when(F.sort_array(F.array(a, b))[0].eqNullSafe(a), -1).otherwise(1)


@F.arrow_udf(S.INTS)
def _walk(ends: pa.Array, indices: pa.Array) -> pa.Array:
    """Places (1-based) of the pairs that a walk passes: from the first end over each pair's index back to it."""
    marks, first = sq.flat(ends)
    to, _ = sq.flat(indices)
    marks, to = sq.np.asarray(marks), sq.np.asarray(to).astype(sq.np.int64)
    out, size = [], [0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        mark, step, places = marks[a:b], to[a:b], []
        if mark.any():
            end = int(sq.np.argmax(mark))
            at = int(step[end])
            while at != end:
                if mark[at] or len(places) >= b - a:
                    raise ValueError("a walk that doesn't come back to its sentinel")
                places.append(at + 1)
                at = int(step[at])
        out += places
        size.append(size[-1] + len(places))
    return sq.nested(pa.array(out, pa.int32()), sq.np.array(size), ends)


def magic_inverse_bwt(pairs: Column) -> Column:
    """The symbols on the walk over (sym, idx) pairs (idx 0-based) in the order given: from the first null to where its idx leads, and so on back to it.

    Without a null there is nothing; another null on the way, or a way that doesn't lead back, is an error.
    """
    places = _walk(F.transform(pairs, lambda p: p["sym"].isNull()), F.transform(pairs, lambda p: p["idx"].cast("int")))
    return each(lambda i, p: F.get(p, i - 1)["sym"], places, pairs)


for kind in ("bytestring", "text"):
    for s in ("s", "p"):  # serially or in parallel: how Spark runs it is a matter of partitions, values are the same
        FUNCTIONS[f"{kind}_fm_index_count_{s}"] = counts if kind == "bytestring" else _in_text(counts, "n")
        FUNCTIONS[f"{kind}_fm_index_locate_{s}"] = places if kind == "bytestring" else _in_text(places, "positions")

FUNCTIONS |= {
    "to_bwt": bw.bwt, "bytestring_to_bwt": bw.bwt_bytes, "text_to_bwt": bw.bwt_text, "from_bwt": bw.inverse,
    "bytestring_from_word8_bwt": bw.inverse_bytes, "bytestring_from_bytestring_bwt": bw.inverse_chunks, "text_from_bwt": bw.inverse_text,
    "sa_to_bwt": bw.bwt_of_suffix_array, "create_suffix_array": bw.suffixes, "sort_tb": sort_tb, "magic_inverse_bwt": magic_inverse_bwt, "create_bwt_matrix": bw.matrix,
    "seq_to_rle": rle.encode, "seq_from_rle": rle.decode, "nub_seq": mtf.alphabet, "seq_to_mtf": mtf.encode, "seq_from_mtf": mtf.decode,
    "seq_to_occ_ck": fm.occ, "seq_to_cc": fm.cc, "seq_from_fm_index": fm.to_bwt, "count_fm_index": count_fm_index, "locate_fm_index": locate_fm_index,
}


def __getattr__(name: str) -> Callable:
    try:
        return FUNCTIONS[name]
    except KeyError:
        raise AttributeError(name) from None
