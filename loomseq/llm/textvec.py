"""Vectorised text primitives: every document of a batch is one slice of a byte buffer.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  A word's hash chains a 64-bit mixer over its 8-byte pieces, its length
first; a run of words is hashed by pairs of hashes of its halves, quarters and so on, mixed again at each level.  Neither is a
polynomial, so no word or run repeats another's hash by its structure; as with any fixed hash, two that were sought for could.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SPACES = (0x20, *range(0x09, 0x0E))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one vectorised step works on, so that its arrays stay small; a longer document is one step.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Longer byte strings are hashed one by one.
LONG_BYTES = 256
#: The bytes of a piece of up to 8 that count.
PIECE = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


class Strings:
    """Hashes of byte strings: equal for equal strings, whatever is around them."""

    def __init__(self, seed: int):
        self.seed = int(np.random.default_rng(seed).integers(0, 2**63))

    def bytes(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(self.seed))
        at_all = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)
        long = np.flatnonzero(size > LONG_BYTES)
        who = None
        if len(long):
            who = np.flatnonzero(size <= LONG_BYTES)
        at, left = (starts, size) if who is None else (starts[who], size[who])
        while len(at):
            piece = at_all[at].view("<u8").ravel() & PIECE[np.minimum(left, 8)]
            if who is None:
                h = mix(h ^ piece)
            else:
                h[who] = mix(h[who] ^ piece)
            on = np.flatnonzero(left > 8)
            who = on if who is None else who[on]
            at, left = at[on] + 8, left[on] - 8
        for i in long.tolist():
            h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), self.seed)
        return h


class Runs:
    """Hashes of runs of words, of the words' hashes."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.odd, self.add = (rng.integers(0, 2**63, dtype=U64) * U64(2) + U64(1) for _ in range(2))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a ^ (b * self.odd + self.add))

    def of(self, words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """The hashes of words[i : i + length] for each i in at: of power-of-two runs, which double, the binary digits of length."""
        if not len(at):
            return np.empty(0, U64)
        out, done, level, size = None, 0, words, 1
        while True:
            if length & size:
                part = level[at + done]
                out = part if out is None else self.pair(out, part)
                done += size
            if 2 * size > length:
                return out
            level = self.pair(level[: len(level) - size], level[size:])
            size *= 2


WORDS, WORDS2, RUNS, RUNS2 = Strings(101), Strings(102), Runs(103), Runs(104)


class Docs:
    """Some consecutive documents of a batch: ``buf`` holds their bytes, document i is buf[off[i]:off[i + 1]]."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, first: int):
        self.buf, self.off, self.first = buf, off, first

    def __len__(self) -> int:
        return len(self.off) - 1

    def words(self, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and where each document's words begin (one entry more than documents)."""
        n = len(self.buf)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(self.off), np.int64)
        inside = ~separator[self.buf]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = self.off[:-1][self.off[:-1] < n]
        before[edge] = False
        after[edge[edge > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, self.off)

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Docs]:
    """The texts of a column (null: empty), some at a time: about ``limit`` bytes, at least one document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] else np.empty(0, np.uint8)
    if column.null_count:  # a null may still cover bytes
        size = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
        if int(size.sum()) != int(off[-1] - off[0]):
            column = pa.array([x or b"" for x in column.to_pylist()], pa.large_binary())
            yield from chunks(column, limit)
            return
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield Docs(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def segments(counts: np.ndarray) -> np.ndarray:
    """The owner of each item, for owners that have ``counts`` items in turn."""
    return np.repeat(np.arange(len(counts)), counts)


def shingles(words: np.ndarray, first: np.ndarray, size: int, runs: Runs = RUNS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their number in each document; a document with fewer words has its whole sequence as one."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    starts = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    length = np.repeat(np.minimum(n, size), count)
    out = np.empty(len(starts), U64)
    for k in np.flatnonzero(np.bincount(length, minlength=1)).tolist():
        rows = slice(None) if k == size and (length == size).all() else np.flatnonzero(length == k)
        out[rows] = runs.of(words, starts[rows], k)
    return out, count


def per_segment(ufunc: np.ufunc, values: np.ndarray, counts: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each owner's items; ``empty`` for owners that have none."""
    out = np.full((len(counts), *values.shape[1:]), empty, values.dtype)
    has = counts > 0
    if has.any():
        at = np.concatenate(([0], np.cumsum(counts)[:-1]))[has]
        out[has] = ufunc.reduceat(values, at, axis=0)
    return out
