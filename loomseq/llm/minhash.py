"""MinHash fingerprints: several universal hash permutations over word shingles, vectorised; bands joined in Spark, Jaccard verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import simhash
from loomseq.llm import textvec as tv
from loomseq.llm.cluster import exchange, packed, partitions, trimmed, written
from loomseq.llm.components import components

#: Values of a text without words.
EMPTY = 0xFFFF
#: Shingles that one permutation works on at a time, so that they stay in a core's cache.
BLOCK = 1 << 14


def permutations(size: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of multiply-shift hashing, a universal family: (a * x + b) mod 2**64, of which the top counts."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, size, dtype=np.uint64)


def signatures(docs: tv.Docs, shingle: int, size: int, seed: int = 7) -> np.ndarray:
    """(documents, size) uint16: of the least value of each permutation over a document's shingles of words, the low 16 bits.

    A document with fewer words has its whole sequence as one shingle, one without words the value EMPTY everywhere.
    """
    h, count = word_shingles(docs, shingle)
    a, b = permutations(size, seed)
    out = np.full((len(docs), size), EMPTY, np.uint16)
    has = np.flatnonzero(count)
    if not len(has):
        return out
    at = np.concatenate(([0], np.cumsum(count[has])))
    i = 0
    while i < len(has):  # whole documents, about a block at a time; a longer one is a block
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        x, cut = h[at[i] : at[j]], at[i:j] - at[i]
        for p in range(size):
            out[has[i:j], p] = (np.minimum.reduceat(x * a[p] + b[p], cut) >> np.uint64(32)).astype(np.uint16)
        i = j
    return out


def packed_rows(sig: np.ndarray) -> pa.Array:
    """Signatures as binary values, big-endian, so that their hexadecimal digits are those of the values."""
    raw = sig.astype(">u2")
    off = np.arange(len(sig) + 1, dtype=np.int32) * np.int32(2 * sig.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(off), pa.py_buffer(raw.tobytes())])


def fingerprints(docs: DataFrame, shingle: int = 5, size: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, signature): 2 bytes a permutation.  Null and empty texts have the signature of all ones; equal texts equal signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [signatures(d, shingle, size) for d in tv.chunks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), packed_rows(np.concatenate(out) if out else np.empty((0, size), np.uint16))], names=["id", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, signature binary")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal values, which estimates the Jaccard similarity of the shingle sets."""
    return (a == b).mean(axis=1) if len(a) else np.empty(0)


def word_shingles(docs: tv.Docs, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that signatures are made of, and their number in each document."""
    starts, ends, first = docs.words()
    return tv.shingles(tv.WORDS.bytes(docs.buf, starts, ends), first, size)


def digest(text: bytes) -> bytes:
    return xxhash.xxh128_digest(text)


def banded(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(a, b): of each band's bucket, edges from every text in it to the least, as ids of their classes.  docs: id, text.

    A band's values are a key, of which the partition and 32 more bits are told apart: texts that meet by chance are only compared in
    vain.  Equal texts of a batch are sent once, and a bucket takes those of a class, from all batches, for one.
    """
    n = partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            keys, digests, who = [], [], []
            seen: dict[bytes, int] = {}
            for d in tv.chunks(b.column(1)):
                own = [digest(d.text(i)) for i in range(len(d))]
                fresh = []
                for i, x in enumerate(own):
                    k = seen.setdefault(x, len(who))
                    if k == len(who):
                        who.append(int(ids[d.first + i]))
                        fresh.append(i)
                    else:
                        who[k] = min(who[k], int(ids[d.first + i]))
                if fresh:
                    value = signatures(d, shingle, bands * rows)[fresh].reshape(len(fresh), bands, rows)
                    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(fresh), bands))
                    for r in range(rows):
                        key = tv.mix(key ^ (value[:, :, r].astype(np.uint64) + np.uint64((r + 1) << 32)))
                    keys.append(key)
                    digests += [own[i][:8] for i in fresh]
            if keys:
                key = np.concatenate(keys)
                mine = np.repeat(np.frombuffer(b"".join(digests), "<u8"), bands)
                yield packed({"k": (key.ravel() >> np.uint64(32)).astype("<u4"), "d": mine, "id": np.repeat(np.array(who, np.int64), bands)}, (key.ravel() % np.uint64(n)).astype(np.int64), n)

    def link(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((x["id"], x["d"], x["k"]))
        k, d, who = x["k"][order], x["d"][order], x["id"][order]
        # the first of a text in a bucket has the least id of its class
        first = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]
        k, who = k[first], who[first]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        least = np.repeat(np.minimum.reduceat(who, at), np.diff(np.append(at, len(k))))
        edges = np.unique(np.stack([who, least], axis=1)[who != least], axis=0)
        yield pa.RecordBatch.from_pydict({"a": edges[:, 0], "b": edges[:, 1]})

    sent = docs.where("id is not null").select("id", "text").mapInArrow(lambda batches: trimmed(run(batches)), "bucket int, k binary, d binary, id binary")
    return exchange(sent, n, link, {"k": "<u4", "d": "<u8", "id": "<i8"}, "a long, b long")


def classified(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = 25, rows: int = 5) -> DataFrame:
    """(id, digest, class_id, component) of every different id and text of docs (id, text) but null ids; see ``near_duplicates``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, n = [], [np.empty(0, np.int64)]
            for d in tv.chunks(b.column(1)):
                digests += [digest(d.text(i)) for i in range(len(d))]
                n.append(np.diff(d.words()[2]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(np.concatenate(n))], names=["id", "digest", "n"])

    texts = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).where("id is not null")
    prints = written(texts.mapInArrow(lambda batches: trimmed(run(batches)), "id long, digest binary, n long").distinct(), "minhash-prints")
    classes = written(prints.groupBy("digest").agg(F.min("id").alias("class_id"), F.min("n").alias("n")), "minhash-classes")
    met = components(banded(texts, shingle, bands, rows))
    groups = met.select(F.col("node").alias("id"), F.col("component").alias("group")).distinct()
    members = written(groups.join(classes.groupBy(F.col("class_id").alias("id")).agg(F.max("n").alias("n")), "id"), "minhash-members")
    found = components(simhash.verified(texts, members, shingle, threshold, word_shingles, merge=False))
    merged = written(classes.join(found, classes.class_id == found.node, "left").select("digest", "class_id", F.coalesce("component", "class_id").alias("component")), "minhash-components")
    return written(prints.join(merged, "digest").select("id", "digest", "class_id", "component"), "minhash-classified")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = 25, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, component): near-duplicates by banded signatures, verified by the Jaccard similarity of the whole shingle sets.

    One row for each different id and text, and each row with a null id, which has no class.  Equal texts are one class, named
    by its least id; the component is the least id that links of ``threshold`` or more reach.  Two texts meet in one of the bands
    of their ``bands * rows`` values with probability 1 - (1 - s**rows)**bands, 0.9999 at 0.8.  Bands are joined by linking each
    text to its bucket's least, so no bucket is expanded into all pairs; all texts that are so connected are a group, and within
    groups every similarity counts (simhash.verified).  Null texts count as empty; texts without words are alike.
    """
    rows_of = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    nulls = rows_of.where("id is null").select("id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component"))
    return classified(rows_of, shingle, threshold, bands, rows).select("id", "class_id", "component").union(nulls)


def with_next(docs: DataFrame, classes: DataFrame, sampled: int = 60) -> DataFrame:
    """docs (id, text) dealt into runs of descending id, in order, for a task to stream: (run, ghost, id, text, digest, class_id, component).

    Before the rows of an id come those of ``classes`` (id, digest, class_id, component) with that id, whose text is null.

    The rows of the id that follows a run come again as its last rows, as ghosts: so each row's successor is in its run.  After
    the least id comes the greatest.  Runs are cut at ids of a sample (``sampled`` a run), which decides their lengths only.
    """
    spark = docs.sparkSession
    n = 8 * partitions(spark)
    ids = docs.select("id")
    total, top = ids.agg(F.count("*"), F.max("id")).first()
    got = ids.sample(min(1.0, sampled * n / max(1, total)), seed=3).toArrow().column("id").to_numpy() if total else np.empty(0, np.int64)
    # run i: ids above edges[i - 1] up to edges[i]; each edge also ends the run above it, the topmost one the lowest run
    edges = np.unique(np.append(np.sort(got)[len(got) // n :: max(1, len(got) // n)], top or 0))

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        run = np.searchsorted(edges, x.to_numpy())
        return pd.Series(2 * run + (edges[np.minimum(run, len(edges) - 1)] == x.to_numpy()))

    run, edge = F.floor(F.col("place") / 2).cast("int"), F.col("place") % 2 == 1
    to = lambda run, ghost: F.struct(run.alias("run"), F.lit(ghost).alias("ghost"))
    twice = F.when(edge, F.array(to(run, 0), to((run + 1) % len(edges), 1))).otherwise(F.array(to(run, 0)))
    dealt = docs.withColumn("place", place("id")).select("id", "text", F.explode(twice).alias("to")).select("to.run", "to.ghost", "id", "text")
    known = classes.withColumn("place", place("id")).select(run.alias("run"), F.lit(0).alias("ghost"), "id", "digest", "class_id", "component")
    dealt = dealt.unionByName(known, allowMissingColumns=True)
    parts = partitions(spark)
    return dealt.repartitionById(parts, F.col("run") % parts).sortWithinPartitions("run", "ghost", F.desc("id"), "text")


def edited(text: str, following: str) -> str:
    """The text whose last third (rounded down, in code points) is replaced by the first as many of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def edits(docs: DataFrame, shingle: int = 5, size: int = 256, classes: DataFrame | None = None) -> DataFrame:
    """Each row's text and edited text with their fingerprints: (id, n_chars, edited, signature, edited_signature, near_edited, near_next, class_id, component).

    Next is the row that follows by descending id (rows of one id by text; null ids last, as one id), after the last the first.
    The last two columns are of the row's id and text in ``classes`` (see ``classified``), null without any.
    """
    spark, lowest = docs.sparkSession, np.iinfo(np.int64).min
    names = ["id", "n_chars", "edited", "signature", "edited_signature", "near_edited", "near_next", "class_id", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for its successor: run, id, text, signature, classes
        known: dict[bytes, tuple[int, int]] = {}
        of = None
        for b in batches:
            texts = b.column(3)
            own = np.asarray(texts.is_valid())
            sig = np.empty((len(b), size), np.uint16)
            if own.any():
                sig[own] = np.concatenate([signatures(d, shingle, size) for d in tv.chunks(texts.filter(pa.array(own)))])
            rows = []
            for i, (r, ghost, doc, text, mark, cls, component) in enumerate(zip(*(b.column(j).to_pylist() for j in range(7)), strict=True)):
                if of != (r, doc):
                    of, known = (r, doc), {}
                if text is None:
                    known[mark] = (cls, component)
                    continue
                if held is not None and held[0] == r:
                    rows.append((held, edited(held[2], text), sig[i]))
                # of several ghosts the first is the successor
                held = None if ghost else (r, doc, text, sig[i], known.get(digest(text.encode()), (None, None)) if known else (None, None))
            for at in range(0, len(rows), 1000):
                part = rows[at : at + 1000]
                texts = pa.array([x[1] for x in part], pa.string())
                mine, after = np.stack([x[0][3] for x in part]), np.stack([x[2] for x in part])
                changed = np.concatenate([signatures(d, shingle, size) for d in tv.chunks(texts)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if x[0][1] == lowest else x[0][1] for x in part], pa.int64()), pa.array([len(x[0][2]) for x in part], pa.int64()), texts, packed_rows(mine), packed_rows(changed), pa.array(likeness(mine, changed)), pa.array(likeness(mine, after)), *[pa.array([x[0][4][i] for x in part], pa.int64()) for i in range(2)]],
                    names=names,
                )

    rows = docs.select(F.coalesce(F.col("id"), F.lit(int(lowest))).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    if classes is None:
        classes = spark.createDataFrame([], "id long, digest binary, class_id long, component long")
    streamed = with_next(rows, classes).select("run", "ghost", "id", "text", "digest", "class_id", "component")
    return streamed.mapInArrow(run, "id long, n_chars long, edited string, signature binary, edited_signature binary, near_edited double, near_next double, class_id long, component long")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of all documents, of their edited texts, and their likeness; further columns are the least id with
    the same text (class_id) and the least id of its near-duplicates, by bands and verified similarity (component_id).

    Null and empty texts count as empty; rows with a null id follow all others and have neither class nor component; rows that
    repeat an id follow each other by text.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    hexed = lambda c: F.lower(F.hex(c))
    found = edits(docs, classes=classified(docs))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hexed("signature").alias("fingerprint"), hexed("edited_signature").alias("edited_fingerprint"), "near_edited", "near_next", "class_id", F.col("component").alias("component_id"),
    )
