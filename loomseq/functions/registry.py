"""The transforms as SQL functions of a session."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomseq.functions import sequences as sq
from loomseq.functions import shapes as S
from loomseq.operators import bwt, fm, mtf, rle


def _search(bwts: pa.Array, ends: pa.Array, cs: pa.Array, occs: pa.Array, patterns: pa.Array) -> list[tuple[int, int]]:
    """Each row's interval of its own pattern; (0, 0) without an index or a pattern."""
    tables, first = sq.flat(cs)
    tables, out = np.asarray(tables), []
    for i, (raw, end, occ, p) in enumerate(zip(*(x.to_pylist() for x in (bwts, ends, occs, patterns)), strict=True)):
        found = (0, 0) if raw is None or p is None else sq.interval(sq.Stored(raw, end, tables[first[i] : first[i + 1]], np.frombuffer(occ, "<i4")), p)
        out.append(found)
    return out


@F.arrow_udf(S.INT)
def _count(index: pa.Array, pattern: pa.Array) -> pa.Array:
    found = _search(*(index.field(c) for c in ("bwt", "end", "c", "occ")), pattern)
    return pa.array([high - low or None for low, high in found], pa.int32())


@F.arrow_udf(S.INTS)
def _locate(index: pa.Array, pattern: pa.Array) -> pa.Array:
    found = _search(*(index.field(c) for c in ("bwt", "end", "c", "occ")), pattern)
    starts, first = sq.flat(index.field("sa"))
    return pa.array([starts[first[i] + low : first[i] + high].to_pylist() for i, (low, high) in enumerate(found)], pa.list_(pa.int32()))


class Search:
    """The table function ``fm_search(bwt, end, c, occ, sa, patterns)``: a row for each pattern of an index."""

    def eval(self, bwt: bytes, end: int, c: list[int], occ: bytes, sa: list[int], patterns: list[bytes]):
        if bwt is None:
            return
        stored = sq.Stored(bytes(bwt), end, np.array(c), np.frombuffer(bytes(occ), "<i4"))
        for i, p in enumerate(patterns or []):
            low, high = (0, 0) if p is None else sq.interval(stored, bytes(p))
            yield i, p, high - low or None, sa[low:high]


#: name -> Arrow function; the index functions take what ``fm_index_bytes`` gives and a binary pattern.
UDFS = {
    "suffix_array": bwt._suffix_array, "suffix_array_bytes": bwt._suffix_array_bytes, "bwt_bytes": bwt._bwt_bytes, "bwt_text": bwt._bwt_text,
    "bwt_restore_bytes": bwt._restore_bytes, "rle_runs": rle.RUNS[False], "rle_runs_compat": rle.RUNS[True], "mtf_places": mtf._encode, "mtf_ranks": mtf._decode,
    "fm_occ_counts": fm._occ, "fm_index_bytes": fm._index, "fm_count": _count, "fm_locate": _locate,
}
#: name -> SQL function of built-in expressions: parameters, type of the result, body.
SQL = {
    "rle_restore": ("runs ARRAY<STRUCT<n INT, value BINARY>>", "ARRAY<BINARY>", "flatten(transform(runs, r -> array_repeat(r.value, CASE WHEN r.value IS NULL THEN 1 ELSE greatest(r.n, 0) END)))"),
    "alphabet": ("symbols ARRAY<BINARY>", "ARRAY<BINARY>", "sort_array(array_distinct(symbols))"),
    "text_count": ("t STRING, p STRING", "INT", "nullif(size(filter(sequence(1, greatest(octet_length(t), 1)), i -> octet_length(p) > 0 AND substring(CAST(t AS BINARY), i, octet_length(p)) = CAST(p AS BINARY))), 0)"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for SQL in this session; returns their names."""
    for name, udf in UDFS.items():
        spark.udf.register(name, udf)
    spark.udtf.register("fm_search", F.udtf(Search, returnType="pattern_idx int, pattern binary, n int, positions array<int>"))
    for name, (given, kind, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
    return sorted([*UDFS, *SQL, "fm_search"])
