"""SimHash near-duplicates by tiled exact comparison of fingerprints.

A fingerprint has 64 bits a word.  Two of them differ in at least as many bits as their population counts do, and so in at
least the sum of that over their halves: fingerprints are dealt into tiles by the counts of their two halves, a tile meets
only those tiles whose counts are within the radius, and larger tiles are split by the counts of their quarters the same way.
Tiles that meet are compared bit by bit, all against all (numpy exclusive-or and bit counts), so no link is lost.  The work is
quadratic in the number of different fingerprints, with a constant that the tiles lower.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.llm import textvec as tv
from loomseq.llm.cluster import exchange, packed, partitions, trimmed, unused, written
from loomseq.llm.components import components

#: For each byte, its bits in the eight bytes of a word: sums of up to 255 such words count bits side by side.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
#: Up to this radius the counts of halves and quarters are compared, beyond it those of whole fingerprints.
NARROW = 8
#: A tile has about so many fingerprints at most; those of more than SPLIT are split by finer population counts.
TILE, SPLIT = 1 << 18, 1 << 14
#: Texts, and shingles of them, that a tile of a group holds where similarities are verified; texts that all of a larger group meet first.
VERIFY_ROWS, VERIFY_SHINGLES, REPRESENTATIVES = 1024, 700_000, 8
#: Sets of so few shingles, where one more changes many bits, link within this radius of 128 bits.
FEW, WIDE = 5, 38
#: Comparisons that one step holds in memory.
BLOCK = 1 << 17


def hashes(docs: tv.Docs, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle, as space-joined lower-case words, and the number of them in each document."""
    buf = tv.LOWER[docs.buf]
    starts, ends, first = tv.Docs(buf, docs.off, 0).words()
    # words joined by one space: copied to a new buffer
    size = ends - starts
    to = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(int(to[-1]), 0x20, np.uint8)
    at = np.repeat(starts - to[:-1], size) + (np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size))
    joined[np.repeat(np.arange(len(size)), size) + np.arange(int(size.sum()))] = buf[at]
    n = np.diff(first)
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(n.dtype))
    s = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    e = s + np.repeat(np.minimum(n, shingle), count)
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b], 42) for a, b in zip(to[s].tolist(), (to[e] - 1).tolist(), strict=True)), np.uint64, len(s)), count


def vote(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit word for each document: the bits set in over half of its hashes."""
    # groups of at most 255 hashes of one document
    groups = -(-count // 255)
    size = np.full(int(groups.sum()), 255)
    last = np.cumsum(groups)[groups > 0] - 1
    size[last] = (count - (groups - 1) * 255)[groups > 0]
    at = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    bits = np.zeros((len(size), 64), np.uint32)
    if len(size):
        columns = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
        for i in range(8):
            bits[:, 8 * i : 8 * i + 8] = np.add.reduceat(SPREAD[columns[:, i]], at).view(np.uint8).reshape(-1, 8)
    total = tv.per_segment(np.add, bits, groups, 0)
    return np.packbits(2 * total > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def distinct(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes without repeats, ascending, and their numbers."""
    found = [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])] if len(count) else []
    return np.concatenate([h[:0], *found]), np.array([len(x) for x in found], np.int64)


def fingerprints(docs: DataFrame, shingle: int = 5, words: int = 1, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """(id, fp, digest, n): the fingerprint of every row's whole text as 8 big-endian bytes a word, the first word first, the text's XXH128 and the number of votes.

    A shingle votes as often as it occurs, with ``sets`` once.  Null and empty texts have the fingerprint zero; texts with fewer words than a shingle have their whole sequence as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, digests, votes = [], [], [np.empty(0, np.int64)]
            for d in tv.chunks(b.column(1)):
                digests += [xxhash.xxh128_digest(d.text(i)) for i in range(len(d))]
                h, count = hashes(d, shingle)
                if sets:
                    h, count = distinct(h, count)
                votes.append(count)
                fp = np.stack([vote(h if not w else tv.mix(h + np.uint64(w * 0x9E3779B97F4A7C15 % 2**64)), count) for w in range(words)], axis=1)
                out.append(fp)
            raw = np.concatenate(out).astype(">u8") if out else np.empty((0, words), ">u8")
            off = (np.arange(len(raw) + 1) * 8 * words).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "fp": pa.BinaryArray.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(off), pa.py_buffer(raw.tobytes())]), "digest": pa.array(digests, pa.binary()), "n": np.concatenate(votes).astype(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: trimmed(run(batches)), "id long, fp binary, digest binary, n long")


def counts(fp: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of that many equal parts of each fingerprint (rows of words)."""
    c = np.bitwise_count(fp.view(np.uint8)).reshape(len(fp), parts, -1)
    return c.sum(axis=2, dtype=np.int16)


def near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of a and b that differ in at most ``radius`` bits."""
    found_a, found_b = [], []
    words = a.shape[1]
    step = max(1, BLOCK // max(1, len(b)))
    columns = [np.ascontiguousarray(b[:, w]) for w in range(words)]
    for i in range(0, len(a), step):
        differ = np.bitwise_count(a[i : i + step, :1] ^ columns[0])
        for w in range(1, words):  # up to 4 words: sums of bit counts stay below 256
            differ += np.bitwise_count(a[i : i + step, w : w + 1] ^ columns[w])
        x, y = np.divmod(np.flatnonzero(differ <= radius), len(b))
        found_a.append(x + i)
        found_b.append(y)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def roots(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The forest after joining x and y pairwise: everyone's parent becomes the least of its tree."""
    while True:
        px, py = parent[x], parent[y]
        differ = px != py
        if not differ.any():
            return parent
        x, y, px, py = x[differ], y[differ], px[differ], py[differ]
        low, high = np.minimum(px, py), np.maximum(px, py)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


@dataclass
class Sets:
    """What sets whose fingerprints are compared must reach: a Jaccard similarity, with a wider radius for those of at most ``few`` shingles."""

    threshold: float
    few: int = FEW
    wide: int = WIDE

    def possible(self, a: np.ndarray, b: np.ndarray, bits: np.ndarray, radius: int) -> np.ndarray:
        """Whether sets of a and b shingles whose fingerprints differ in so many bits are candidates: their sizes allow the
        similarity, and sets that only equal ones of their size reach have equal fingerprints."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        common = np.ceil(self.threshold / (1 + self.threshold) * (a + b) - 1e-9)
        limit = np.where(high <= self.few, max(self.wide, radius), radius)
        return (common <= low) & (bits <= np.where((a == b) & (common == a), 0, limit))


def meet(fp: np.ndarray, own: np.ndarray, radius: int, parent: np.ndarray, sets: Sets | None = None, size: np.ndarray | None = None) -> np.ndarray:
    """Joins in ``parent`` all near pairs of a row in own (a mask) and any row; a large tile is split by the counts of its quarters.

    With ``sets`` a pair is near as far as the sizes of its sets allow.
    """
    reach = radius if sets is None else max(radius, sets.wide)

    def compare(mine: np.ndarray, others: np.ndarray, parent: np.ndarray) -> np.ndarray:
        count = counts(fp, 1)[:, 0]
        mine, others = mine[np.argsort(count[mine], kind="stable")], others[np.argsort(count[others], kind="stable")]
        for i in range(0, len(mine), 128):
            low, high = count[mine[i]] - reach, count[mine[min(i + 128, len(mine)) - 1]] + reach
            for j in range(0, len(others), 1 << 14):
                if count[others[j]] > high or count[others[min(j + (1 << 14), len(others)) - 1]] < low:
                    continue  # no pair of these blocks is within the radius
                x, y = near(fp[mine[i : i + 128]], fp[others[j : j + (1 << 14)]], reach)
                x, y = mine[i : i + 128][x], others[j : j + (1 << 14)][y]
                if sets is not None and len(x):
                    stay = sets.possible(size[x].astype(np.int64), size[y].astype(np.int64), np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64), radius)
                    x, y = x[stay], y[stay]
                if len(x):
                    parent = roots(parent, x, y)
        return parent

    a = np.flatnonzero(own)
    if reach > NARROW or len(fp) <= SPLIT:
        return compare(a, np.arange(len(fp)), parent)
    keys, inverse = np.unique(counts(fp, 4), axis=0, return_inverse=True)
    order = np.argsort(inverse.ravel(), kind="stable")
    at = np.searchsorted(inverse.ravel()[order], np.arange(len(keys) + 1))
    for k in np.unique(inverse.ravel()[a]):
        mine = order[at[k] : at[k + 1]]
        close = np.flatnonzero(np.abs(keys - keys[k]).sum(axis=1) <= reach)
        parent = compare(mine[own[mine]], np.concatenate([order[at[j] : at[j + 1]] for j in close]), parent)
    return parent


def links(classes: DataFrame, radius: int, words: int = 1, sets: Sets | None = None) -> DataFrame:
    """(a, b): edges between ids of ``classes`` (id, fp; one row a fingerprint) that join exactly what chains of fingerprints
    within the radius join; from each task at most one edge a fingerprint, never all pairs of a group.  ``sets`` needs the
    classes' n, the number of shingles.

    A narrow radius deals fingerprints by the counts of both halves, each tile getting those tiles within reach.  Under a wide one
    counts set few apart: then fingerprints are dealt at random and blocks of them are skipped by their ranges of counts.
    ``salts`` cuts tiles so that none outgrows a task and all tasks have some.
    """
    n, total = partitions(classes.sparkSession), classes.count()
    narrow = radius <= NARROW and (sets is None or sets.wide <= NARROW)
    reach = radius if sets is None else max(radius, sets.wide)
    if narrow:
        around = [(i, j) for i in range(reach + 1) for j in range(-reach, reach + 1) if (i > 0 or j >= 0) and i + abs(j) <= reach]
        salts = max(1, -(-total // (25 * TILE)))
    else:
        around, salts = [(0, 0)], max(-(-total // TILE), math.isqrt(2 * n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            if not len(ids):
                continue
            fp = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").astype("<u8").reshape(len(ids), words)
            cell = counts(fp, 2).astype(np.int64) if narrow else np.zeros((len(ids), 2), np.int64)
            salt = (tv.mix(fp[:, 0] + np.uint64(7)) % np.uint64(salts)).astype(np.int64)
            keys, own, rows = [], [], []

            def send(i: int, j: int, mine: np.ndarray, theirs: np.ndarray, is_own: bool, who: np.ndarray) -> None:
                keys.append((((cell[who, 0] + i) * 4096 + cell[who, 1] + j + 64) * salts + mine) * salts + theirs)
                own.append(np.full(len(who), is_own, np.uint8))
                rows.append(who)

            every = np.arange(len(ids))
            for other in range(salts):
                who = every if narrow else every[salt <= other]
                send(0, 0, salt[who], np.full(len(who), other), True, who)
                for i, j in around:
                    who = every[salt > other] if (i, j) == (0, 0) else every  # tiles of one cell meet once
                    send(i, j, np.full(len(who), other), salt[who], False, who)
            keys, own, rows = map(np.concatenate, (keys, own, rows))
            size = {} if sets is None else {"n": np.asarray(b.column(2)).astype(np.int32)[rows]}
            yield packed({"k": keys, "own": own, "id": ids[rows]} | size | {f"w{w}": fp[rows, w] for w in range(words)}, (tv.mix(keys.astype(np.uint64)) % np.uint64(n)).astype(np.int64), n)

    def compare(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(x["k"], kind="stable")
        k = x["k"][order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        ids, index = np.unique(x["id"], return_inverse=True)
        parent = np.arange(len(ids))
        fp = np.stack([x[f"w{w}"] for w in range(words)], axis=1)
        own = x["own"].astype(bool)
        for i, j in zip(at[:-1], at[1:], strict=True):
            rows = order[i:j]
            if not own[rows].any():
                continue
            local = meet(np.ascontiguousarray(fp[rows]), own[rows], radius, np.arange(len(rows)), sets, None if sets is None else x["n"][rows])
            moved = np.flatnonzero(local != np.arange(len(rows)))
            if len(moved):
                parent = roots(parent, index[rows[moved]], index[rows[local[moved]]])
        moved = np.flatnonzero(parent != np.arange(len(ids)))
        yield pa.RecordBatch.from_pydict({"a": ids[moved], "b": ids[parent[moved]]})

    blobs = "k binary, own binary, id binary" + ("" if sets is None else ", n binary") + "".join(f", w{w} binary" for w in range(words))
    dealt = classes.select("id", "fp", *([] if sets is None else ["n"])).mapInArrow(deal, f"bucket int, {blobs}")
    return exchange(dealt, n, compare, {"k": "<i8", "own": "u1", "id": "<i8"} | ({} if sets is None else {"n": "<i4"}) | {f"w{w}": "<u8" for w in range(words)}, "a long, b long")


def verified(texts: DataFrame, members: DataFrame, shingle: int, threshold: float, shingles: Callable[[tv.Docs, int], tuple[np.ndarray, np.ndarray]] = hashes, merge: bool = True) -> DataFrame:
    """(a, b): edges that join exactly what chains of texts with a Jaccard similarity of ``threshold`` or more join, within groups.

    texts: id, text; members: id, group, n (its number of shingles), one row an id.  The sets are of what ``shingles`` makes of a
    text.  A group of one tile is compared all with all.  Of a larger one all texts are first compared with REPRESENTATIVES of
    it; what they join into its largest cluster needs no more comparisons among itself, and only the texts outside of it are
    compared with all.  So what is sent and compared grows with the group's size times the number of its outsiders.  Tiles bound
    what a task holds, and each comparison gives at most one edge a text.  Of rows that repeat an id the least text counts.
    Texts meet what is asked of them in a merge join, or (``merge`` false) in the join that Spark chooses by the members' size.
    """
    size = members.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    tiles = F.greatest(F.ceil(F.greatest(F.col("rows") / VERIFY_ROWS, F.col("shingles") / VERIFY_SHINGLES)), F.lit(1)).cast("int")
    placed = written(members.join(size.select("group", tiles.alias("tiles")), "group").select("id", "group", "tiles", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("own")), "verify-members")
    tiles_col = F.col("tiles")
    to = lambda low, high, side: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(side).alias("side"))
    range_of = lambda n: F.sequence(F.lit(0), n - 1)
    zero = F.lit(0)
    small = placed.where(tiles_col == 1).select("id", "group", F.array(to(zero, zero, 0)).alias("to"))
    large = placed.where(tiles_col > 1)
    by_hash = Window.partitionBy("group").orderBy(F.xxhash64("id", F.lit("representative")), "id")
    chosen = large.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= REPRESENTATIVES)
    asked = large.select("id", "group", F.array(to(F.col("own"), zero, 1)).alias("to")).union(chosen.select("id", "group", F.transform(range_of(tiles_col), lambda t: to(t, zero, 0)).alias("to")))
    first = written(compared(texts, small.union(asked), shingle, threshold, shingles, merge), "verify-first")
    if large.isEmpty():
        return first
    met = components(first.join(large.select(F.col("id").alias("a")), "a", "left_semi"))
    clustered = written(large.join(met, large.id == met.node, "left").select("id", "group", "tiles", "own", F.coalesce("component", "id").alias("cluster")), "verify-clusters")
    count = clustered.groupBy("group", "cluster").agg(F.count(F.lit(1)).alias("rows"))
    main = count.groupBy("group").agg(F.max_by("cluster", F.struct("rows", -F.col("cluster"))).alias("main"))
    outside = clustered.join(main, "group").where("cluster <> main")
    blocks = written(outside.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / VERIFY_ROWS).cast("int").alias("blocks")), "verify-blocks")
    rest = written(outside.join(blocks, "group").select("id", "group", "tiles", F.pmod(F.xxhash64("id", F.lit("outside")), F.col("blocks")).alias("block")), "verify-outside")
    all_of = clustered.join(blocks, "group")
    asked = rest.select("id", "group", F.transform(range_of(tiles_col), lambda t: to(F.col("block"), t, 0)).alias("to")).union(all_of.select("id", "group", F.transform(range_of(F.col("blocks")), lambda k: to(k, F.col("own"), 1)).alias("to")))
    return first.union(compared(texts, asked, shingle, threshold, shingles, merge))


def compared(texts: DataFrame, asked: DataFrame, shingle: int, threshold: float, shingles: Callable[[tv.Docs, int], tuple[np.ndarray, np.ndarray]], merge: bool) -> DataFrame:
    """(a, b): edges between the texts that meet in a tile (group, low, high): those of side 0 with those of side 1, or, where
    there is no side 1, among themselves.  asked: id, group, to (array of low, high, side)."""
    n = partitions(texts.sparkSession)
    asked = written(asked, "verify-asked")  # so that a join that Spark chooses goes by its size
    sent = texts.join(asked.hint("merge") if merge else asked, "id").select("id", "group", F.explode("to").alias("to"), "text").select("group", "to.low", "to.high", "to.side", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held = None, [], []

        def close() -> pa.RecordBatch:
            sets = []
            for d in tv.chunks(pa.array(held, pa.string())):
                h, count = shingles(d, shingle)
                sets += [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])]
            return alike([(side, who, x) for (side, who), x in zip(rows, sets, strict=True)], threshold)

        for b in batches:
            for group, low, high, side, who, text in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (group, low, high) != now:
                    if held:
                        yield close()
                    now, rows, held = (group, low, high), [], []
                if not rows or rows[-1] != (side, who):  # rows that repeat an id follow each other, the least text first
                    rows.append((side, who))
                    held.append(text)
        if held:
            yield close()

    dealt = sent.repartitionById(n, F.pmod(F.xxhash64("group", "low", "high"), F.lit(n)).cast("int")).sortWithinPartitions("group", "low", "high", "side", "id", "text")
    return dealt.mapInArrow(lambda batches: trimmed(run(batches)), "a long, b long")


def alike(rows: list[tuple[int, int, np.ndarray]], threshold: float) -> pa.RecordBatch:
    """Edges between the sets (side, id, set) of one tile, or of two that meet (sides 0 and 1)."""
    side, ids = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
    size = np.array([len(r[2]) for r in rows])
    values, at = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    owner = tv.segments(size)
    shared = np.bincount(at) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    owner, at = owner[keep], column[at[keep]]
    mine = np.arange(len(rows)) if not side.any() else np.flatnonzero(side == 0)
    others = np.arange(len(rows)) if not side.any() else np.flatnonzero(side == 1)
    place = np.zeros(len(rows), np.int64)
    place[others] = np.arange(len(others))
    common = np.zeros((len(mine), len(others)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for i in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(at, [i, i + 2048])
        incident = np.zeros((len(rows), 2048), np.float32)
        incident[owner[a:b], at[a:b] - i] = 1
        common += incident[mine] @ incident[others].T
    parent = np.arange(len(rows))
    for i in range(0, len(mine), 64):
        part = common[i : i + 64].astype(np.float64)
        union = size[mine[i : i + 64]][:, None] + size[others][None, :] - part
        x, y = np.nonzero(part >= threshold * union)
        parent = roots(parent, mine[i + x], others[y])
    moved = np.flatnonzero(parent != np.arange(len(rows)))
    return pa.RecordBatch.from_pydict({"a": ids[moved], "b": ids[parent[moved]]})


def near_duplicates(docs: DataFrame, shingle: int = 5, words: int = 2, radius: int = 34, threshold: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) of every row: component is the least id that links reach.

    Fingerprints within the radius link; with a ``threshold`` only as far as the exact Jaccard similarity of the shingle sets
    reaches it, and fingerprints are of the sets: each shingle votes once, however often a text repeats it.  The default radius of
    34 of 128 bits, and WIDE for sets of at most FEW shingles, finds at least 0.999 of the pairs of similarity 0.8 whatever their
    sizes (see README), more of those above.  Null and empty texts share
    the fingerprint zero and are linked like others; repeated ids give repeated rows; a null id is returned with a null component
    and links nothing.
    """
    sets = None if threshold is None else Sets(threshold)
    prints = written(fingerprints(docs, shingle, words, id_col, text_col, sets is not None), "simhash")
    # copies of a text are one class, or, where fingerprints alone decide, texts of one fingerprint
    kind = ["fp"] if threshold is None else ["fp", "digest"]
    classes = written(prints.where("id is not null").groupBy(*kind).agg(F.min("id").alias("id"), F.min("n").alias("n")), "simhash-classes")
    found = components(links(classes, radius, words, sets))
    if threshold is not None:
        groups = found.select(F.col("node").alias("id"), F.col("component").alias("group")).distinct()
        members = written(groups.join(classes.groupBy("id").agg(F.max("n").alias("n")), "id"), "simhash-members")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        found = components(verified(texts, members, shingle, threshold))
    merged = written(classes.join(found, classes.id == found.node, "left").select(*kind, F.coalesce("component", "id").alias("component")), "simhash-components")
    return prints.join(merged, kind, "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents with the least id of their group (see ``near_duplicates``), one row each, all columns as they were; all rows
    with a null id stay.

    Of rows that repeat an id that with the least text stays (null first), of those the first by all columns as JSON.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
    stay = found.where("id = component").groupBy("id").agg(F.count("*").alias("rows"))
    stay = written(stay, "simhash-kept")
    kept_id = unused(docs, "kept")
    kept = docs.join(stay.select(F.col("id").alias(kept_id)).hint("merge"), F.col(id_col) == F.col(kept_id), "left_semi")
    if not stay.where("rows > 1").isEmpty():  # rows that repeat an id: collapsed before the shuffle
        every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        first = kept.select(F.col(f"`{id_col}`").alias("id"), every.alias("row"), F.struct(F.col(f"`{text_col}`").alias("text"), F.to_json(every).alias("all")).alias("key")).groupBy("id").agg(F.min_by("row", "key").alias("row"))
        kept = first.select(*[F.col(f"row.`{c}`") for c in docs.columns])
    return kept.union(docs.where(F.col(id_col).isNull()))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 4-word shingles, 64 bits, radius 4 over all documents.

    Null and empty texts have the fingerprint zero and link like others; repeated ids give repeated rows; a null id has a
    fingerprint, links nothing and has a null component_id.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, shingle=4, words=1, radius=4, threshold=None)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
