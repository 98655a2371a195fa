"""Exact removal of repeated word windows, found by difference-cover anchors.

A set D of residues modulo v is a difference cover if every difference modulo v is one of two of its elements.  Then for any
two starts i and j of equal windows there is a shift d below v with both i + d and j + d at residues in D.  So runs of
``window - v + 1`` words are hashed only at those residues (4 of 13): equal windows share the anchor at that shift.

1. Anchors go, packed, to the bucket of their hash; those that occur again anywhere come back to their documents.
2. A window is extended from each repeated anchor in it: only such windows are hashed whole (96 bits of two hashes) and go to the
   bucket of their hash, which returns every start but the first by (document, start).
3. The words that the returned windows cover are removed.

Whole copies of a text need none of this: all their windows start earlier in the copy with the smallest id, which alone goes
through it.

What sends a hash collapses its repeats within a batch beforehand: known repeats go back to their document at once, so a passage
in a third of all documents costs its bucket one entry a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import textvec as tv
from loomseq.llm.cluster import exchange, packed, partitions, trimmed, written

#: Perfect difference sets: each difference occurs once (fixed values).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Anchors are no shorter than this where the window allows it.
LEAST_ANCHOR = 8
ENTRY = "k binary, h2 binary, d binary, p binary, known binary"
DTYPES = {"k": "<u8", "h2": "<u4", "d": "<i8", "p": "<i4", "known": "u1"}
#: Instead of positions: every window of the document starts earlier.
WHOLE = b"\xff\xff\xff\xff"
NO_ID = np.iinfo(np.int64).max


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period whose anchors have LEAST_ANCHOR words at least; (1, (0,)) for windows too short for any."""
    fits = [v for v in COVERS if window - v + 1 >= min(LEAST_ANCHOR, window)]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


def _dealt(k: np.ndarray, h2: np.ndarray, d: np.ndarray, p: np.ndarray, n: int, first_stays: bool) -> pa.RecordBatch:
    """Entries of a batch, to the bucket of their hash.  A hash that occurs in it again goes once; its other entries (and the
    first, unless it stays in question) are known repeats and go to their document's bucket."""
    order = np.lexsort((p, d, h2, k))
    k, h2, d, p = k[order], h2[order], d[order], p[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (h2[1:] != h2[:-1])] if len(k) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    twice = np.bincount(group)[group] > 1 if len(k) else np.empty(0, bool)
    known = np.zeros(len(k), np.uint8)
    if first_stays:
        head = np.flatnonzero(new)
        # entries that are the first itself, seen twice, are no repeats of it
        known[~new & ((d != d[head][group]) | (p != p[head][group]))] = 1
        sent = new | (known == 1)
    else:
        known[twice] = 2  # repeats, and the first of them still tells others
        known[twice & ~new] = 1
        sent = np.ones(len(k), bool)
    back = np.argsort(order[sent])  # in the order of documents, which compresses better
    k, h2, d, p, known = (x[sent][back] for x in (k, h2, d, p, known))
    by = np.where(known == 1, tv.mix(d.astype(np.uint64)), k)
    return packed({"k": k, "h2": h2, "d": d, "p": p, "known": known}, (by % np.uint64(n)).astype(np.int64), n)


def _to_documents(d: np.ndarray, p: np.ndarray, n: int) -> pa.RecordBatch:
    return packed({"k": d.astype("<i8"), "p": p.astype("<i4")}, (tv.mix(d.astype(np.uint64)) % np.uint64(n)).astype(np.int64), n)


def _by_document(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(id, at): each document's positions, in order, as 4 bytes each."""
    order = np.lexsort((x["p"], x["k"]))
    d, p = x["k"][order], x["p"][order]
    new = np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])]
    d, p = d[new], p[new]
    at = np.flatnonzero(np.r_[True, d[1:] != d[:-1], True])
    for i in range(0, len(at) - 1, 10_000):
        cut = at[i : i + 10_001]
        off = pa.py_buffer(((cut - cut[0]) * 4).astype(np.int32))
        yield pa.RecordBatch.from_pydict({"id": d[cut[:-1]], "at": pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, off, pa.py_buffer(p[cut[0] : cut[-1]].astype("<i4").tobytes())])})


def later_copies(docs: DataFrame) -> DataFrame:
    """(id): documents whose whole text a document with a smaller id has.  Aggregates before its shuffle."""
    prints = docs.where("text is not null").select("id", F.unhex(F.md5("text")).alias("hash"))
    several = written(prints.groupBy("hash").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("hash", "least"), "substring-copies")
    return written(prints.join(several, "hash").where("id > least").select("id").distinct(), "substring-copies")


def repeated_windows(docs: DataFrame, copies: DataFrame, window: int) -> DataFrame:
    """(id, at): of every document with any, the starts of windows whose words also start earlier.

    docs: id, text, row (what else the caller joins to the result, so that all joins read the same exchange of the texts).
    copies: ids of documents to leave out, whose windows all start earlier in others.
    """
    n = partitions(docs.sparkSession)
    v, residues = cover(window)
    length = window - v + 1
    in_cover = np.isin(np.arange(v), residues)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            ks, ds, ps = [], [], []
            for docs in tv.chunks(b.column(1)):
                starts, ends, first = docs.words()
                words = tv.WORDS.bytes(docs.buf, starts, ends)
                count = np.diff(first)
                usable = np.where(count >= window, count - length + 1, 0)
                doc = tv.segments(usable)
                p = np.arange(len(doc)) - np.repeat(np.cumsum(usable) - usable, usable)
                keep = in_cover[p % v]
                doc, p = doc[keep], p[keep]
                at = first[doc] + p
                ks.append(tv.RUNS.of(words, at, length))
                ds.append(ids[docs.first + doc])
                ps.append(p.astype(np.int32))
            if ks:
                k = np.concatenate(ks)
                yield _dealt(k, np.zeros(len(k), np.uint32), np.concatenate(ds), np.concatenate(ps), n, first_stays=False).drop_columns(["h2"])

    def again(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sure = x["known"] == 1
        asked = np.flatnonzero(~sure)
        order = asked[np.argsort(x["k"][asked], kind="stable")]
        k = x["k"][order]
        new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        twice = (np.bincount(group)[group] > 1) | (x["known"][order] == 2) if len(k) else np.empty(0, bool)
        rows = np.concatenate([np.flatnonzero(sure), order[twice]])
        yield _to_documents(x["d"][rows], x["p"][rows], n)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            marks = b.column(2)
            ks, hs, ds, ps = [], [], [], []
            for docs in tv.chunks(b.column(1)):
                starts, ends, first = docs.words()
                words, words2 = tv.WORDS.bytes(docs.buf, starts, ends), tv.WORDS2.bytes(docs.buf, starts, ends)
                doc, p = [], []
                for i in range(len(docs)):
                    a = np.frombuffer(marks[docs.first + i].as_py(), "<i4").astype(np.int64)
                    last = int(first[i + 1] - first[i]) - window
                    # starts from which a window holds an anchor: a mark of each such range's ends, summed up
                    change = np.zeros(max(0, last) + window + 2, np.int32)
                    a = a[a <= last + v - 1]
                    np.add.at(change, np.maximum(a - (v - 1), 0), 1)
                    np.add.at(change, a + 1, -1)
                    at = np.flatnonzero(np.cumsum(change)[: last + 1] > 0) if last >= 0 else np.empty(0, np.int64)
                    doc.append(np.full(len(at), i))
                    p.append(at)
                doc, p = np.concatenate(doc), np.concatenate(p)
                at = first[doc] + p
                ks.append(tv.RUNS.of(words, at, window))
                hs.append(tv.RUNS2.of(words2, at, window).astype(np.uint32))
                ds.append(ids[docs.first + doc])
                ps.append(p.astype(np.int32))
            if ks:
                yield _dealt(*map(np.concatenate, (ks, hs, ds, ps)), n, first_stays=True)

    def later(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sure = x["known"] == 1
        asked = np.flatnonzero(~sure)
        order = asked[np.lexsort((x["p"][asked], x["d"][asked], x["h2"][asked], x["k"][asked]))]
        k, h2, d, p = (x[c][order] for c in ("k", "h2", "d", "p"))
        new = np.r_[True, (k[1:] != k[:-1]) | (h2[1:] != h2[:-1])] if len(k) else np.empty(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else np.empty(0, np.int64)
        rows = np.concatenate([np.flatnonzero(sure), order[(d != d[head]) | (p != p[head])]])
        yield _to_documents(x["d"][rows], x["p"][rows], n)

    per_document = {"k": "<i8", "p": "<i4"}
    asked = docs.join(copies, "id", "left_anti").select("id", "text").mapInArrow(lambda batches: trimmed(anchors(batches)), "bucket int, k binary, d binary, p binary, known binary")
    told = exchange(asked, n, again, {c: t for c, t in DTYPES.items() if c != "h2"}, "bucket int, k binary, p binary")
    marked = exchange(told, n, _by_document, per_document, "id long, at binary")
    extended = docs.join(marked, "id").select("id", "text", "at", "row").mapInArrow(lambda batches: trimmed(windows(batches)), f"bucket int, {ENTRY}")
    told = exchange(extended, n, later, DTYPES, "bucket int, k binary, p binary")
    return exchange(told, n, _by_document, per_document, "id long, at binary")


def dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", out: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """All rows with n_words, n_removed and kept (the kept words joined by one space) beside the input's columns.

    Words are runs outside ``\\x20 \\x09-\\x0D``, compared unchanged.  A word goes if a window of ``window`` words of its document
    covers it whose words also start earlier: in a document with a smaller id or earlier in the same one, judged on the input.
    Null texts have no words; texts shorter than a window keep all.  Rows that repeat an id are one document: a window at the
    same id and start isn't earlier, and what is removed of one (all, for a copy) is removed of all at these starts.  A null id comes after all
    others.  ``out`` names the three; columns named like them are replaced, all others stay.
    """
    made = ("n_words", "n_removed", "kept")
    names = [c for c in docs.columns if c.lower() not in {m.lower() for m in out}]
    frame = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("row"))
    copies = later_copies(frame)
    found = repeated_windows(frame, copies, window).union(copies.select("id", F.lit(WHOLE).alias("at"))).groupBy("id").agg(F.max("at").alias("at"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column(2)
            words_out, removed_out, kept_out = [], [], []
            for docs in tv.chunks(b.column(1)):
                starts, ends, first = docs.words()
                for i in range(len(docs)):
                    n = int(first[i + 1] - first[i])
                    words_out.append(n)
                    at = marks[docs.first + i].as_py()
                    keep = None
                    if at == WHOLE:
                        keep = np.full(n, n < window)
                    elif at:
                        a = np.frombuffer(at, "<i4").astype(np.int64)
                        change = np.zeros(n + window + 1, np.int32)
                        a = a[a <= n - window]
                        np.add.at(change, a, 1)
                        np.add.at(change, a + window, -1)
                        keep = np.cumsum(change)[:n] == 0
                    removed_out.append(n - int(keep.sum()) if keep is not None else 0)
                    parts = docs.text(i).split()
                    kept_out.append(b" ".join(parts if keep is None else [w for w, k in zip(parts, keep.tolist(), strict=True) if k]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words_out, pa.int64()), pa.array(removed_out, pa.int64()), pa.array(kept_out, pa.binary()).cast(pa.string()), b.column(1)], names=["row", *made, "text"])

    joined = frame.join(found, "id", "left").select("row", "text", "at")
    schema = joined.drop("at").select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept"), "text").schema
    found = joined.mapInArrow(lambda batches: trimmed(remove(batches)), schema)
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names], *[F.col(m).alias(o) for m, o in zip(made, out, strict=True)])


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: windows of 20 words over all documents.

    Null and empty texts have no words; a null id comes after all others; rows that repeat an id are one document (see ``dedup``).
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, window=20).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
