"""Exchanges of packed rows, and what else the operators need of a cluster."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.sources.shared import scratch, shared_dir, written  # noqa: F401 - the operators take them from here


def partitions(spark: SparkSession) -> int:
    """Partitions of an exchange; spark.sql.shuffle.partitions is set by who knows the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def packed(arrays: dict[str, np.ndarray], bucket: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows dealt into buckets, one output row a bucket, with each column's values as bytes."""
    bucket = bucket.astype(np.uint16 if n <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    ids, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at[1:], len(bucket))
    cols = {"bucket": pa.array(ids.astype(np.int32))}
    for k, v in arrays.items():
        v = np.ascontiguousarray(v[order])
        w = v.itemsize
        raw = pa.py_buffer(v.tobytes())
        off = pa.py_buffer(np.append(at, ends[-1:] if len(at) else [0]).astype(np.int32) * np.int32(w) if len(at) else np.zeros(1, np.int32))
        cols[k] = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, off, raw])
    return pa.RecordBatch.from_pydict(cols)


def unpack(batch: pa.RecordBatch, column: str, dtype) -> np.ndarray:
    c = batch.column(column)
    if not len(c):
        return np.empty(0, dtype)
    off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]].view(dtype) if c.buffers()[2] and off[-1] > off[0] else np.empty(0, dtype)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then gives the memory that the task has freed back to the system, as the worker lives on for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def exchange(df: DataFrame, n: int, reduce: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], dtypes: dict[str, str], schema: str) -> DataFrame:
    """Sends packed rows to their bucket's task; ``reduce`` gets all of a bucket as arrays.

    A bucket has about 1/n of the items: what sends them collapses repeats of a key beforehand, so no key is large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[np.ndarray]] = {k: [] for k in dtypes}
        for b in batches:
            for k, t in dtypes.items():
                parts[k].append(unpack(b, k, t).copy())
        if any(map(len, parts["k"] if "k" in parts else next(iter(parts.values())))):
            arrays = {}
            for k in list(parts):
                arrays[k] = np.concatenate(parts.pop(k))
            yield from reduce(arrays)

    return df.repartitionById(n, F.col("bucket")).mapInArrow(lambda batches: trimmed(run(batches)), schema)
