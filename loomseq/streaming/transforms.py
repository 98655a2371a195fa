"""Transforms of streams: the nested forms work on a row at a time, so they run unchanged on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.plans import pipelines


def encode_stream(stream: DataFrame, column: str, steps: list[str], out: str = "code") -> DataFrame:
    """``pipelines.encode`` of each row as it comes; needs no state and no watermark."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return pipelines.encode(stream, column, steps, out)


def decode_stream(stream: DataFrame, column: str, steps: list[str], out: str = "text") -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return pipelines.decode(stream, column, steps, out)


def runs_by_window(stream: DataFrame, time: str, value: str, width: str, delay: str, *keys: str) -> DataFrame:
    """(keys, window, runs): run-length codes of each key's values in time windows; late rows count up to ``delay``."""
    from loomseq.operators import rle

    pairs = F.array_sort(F.collect_list(F.struct(F.col(time), F.col(value).alias("v"))))
    grouped = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, width)).agg(F.transform(pairs, lambda x: x["v"]).alias("seq"))
    return grouped.select(*keys, "window", rle.encode(F.col("seq")).alias("runs"))
