"""Chains of transforms: ``encode(df, "text", ["bwt", "mtf"])`` and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.functions.columns import settled
from loomseq.operators import bwt, fm, mtf, rle
from loomseq.operators import symbols as sy

STEPS = ("bwt", "rle", "mtf", "fm")


def encode(df: DataFrame, column: str, steps: list[str], out: str = "code", symbols: str = "bytes") -> DataFrame:
    """df with the column's code: of a string or binary column by bytes (``symbols="text"``: byte symbols as strings, ASCII only; ``"chars"``: by code points, of a string), of an array by elements.

    steps: first bwt (or not), then at most one of rle, mtf and fm (which needs bwt).  The index of a string or binary by bytes is
    the compact one that ``fm.count`` and ``fm.locate`` search (``fm.INDEX``); others have whole tables, as large as text times alphabet.
    """
    return df.withColumn(out, encoded(F.col(column), dict(df.dtypes)[column], steps, symbols))


def decode(df: DataFrame, column: str, steps: list[str], out: str = "text", kind: str = "string", symbols: str = "bytes") -> DataFrame:
    """The inverse; ``kind`` is what the code was made of: string, binary or array."""
    return settled(df).withColumn(out, decoded(F.col(column), kind, steps, symbols))


def _checked(steps: list[str]) -> tuple[bool, str | None]:
    first, rest = steps[:1] == ["bwt"], steps[1:] if steps[:1] == ["bwt"] else steps
    if not steps or len(rest) > 1 or set(steps) - set(STEPS) or steps == ["fm"]:
        raise ValueError(f"no such chain: {steps}")
    return first, rest[0] if rest else None


def _element(kind: str, symbols: str) -> T.DataType | None:
    """The type of the symbols, where it follows from the column's."""
    return None if kind not in ("string", "binary") else T.BinaryType() if symbols == "bytes" else T.StringType()


def _compact(kind: str, symbols: str) -> bool:
    return kind in ("string", "binary") and symbols == "bytes"


def encoded(c: Column, kind: str, steps: list[str], symbols: str = "bytes") -> Column:
    transform, code = _checked(steps)
    if code == "fm" and _compact(kind, symbols):
        return F.when(c.isNotNull(), fm._index(c.cast("binary")))
    if kind == "string" and symbols == "chars":
        seq = bwt.bwt(sy.of_chars(c)) if transform else sy.of_chars(c)
    elif kind == "string":
        seq = bwt.bwt_text(c) if transform else sy.of_text(c)
    elif kind == "binary":
        seq = bwt.bwt_bytes(c) if transform else sy.of_bytes(c)
    else:
        seq = bwt.bwt(c) if transform else c
    if symbols == "text" and kind in ("string", "binary"):
        seq = sy.as_text(seq)
    if code == "fm":
        from loomseq.functions.names import index_of_bwt

        return index_of_bwt(seq)
    element = _element(kind, symbols)
    return {None: lambda x: x, "rle": lambda x: rle.encode(x, element=element), "mtf": lambda x: mtf.encode(x, element)}[code](seq)


def decoded(c: Column, kind: str, steps: list[str], symbols: str = "bytes") -> Column:
    transform, code = _checked(steps)
    if code == "fm" and _compact(kind, symbols):
        data = fm.restore(c)
        return F.decode(data, "UTF-8") if kind == "string" else data
    element = _element(kind, symbols)
    seq = {None: lambda x: x, "rle": lambda x: rle.decode(x, element), "mtf": lambda x: mtf.decode(x, element), "fm": fm.to_bwt}[code](c)
    if kind not in ("string", "binary"):
        return bwt.inverse(seq) if transform else seq
    if symbols == "chars":
        return F.array_join(bwt.inverse(seq) if transform else seq, "")
    if symbols == "text":
        seq = sy.as_bytes(seq)
    data = bwt.inverse_bytes(seq) if transform else sy.join_bytes(seq)
    return F.decode(data, "UTF-8") if kind == "string" else data
