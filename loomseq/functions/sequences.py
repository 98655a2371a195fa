"""Sequence transforms in numpy, over all sequences of a batch at once.

A batch of sequences is a flat array of codes and where each sequence begins in it (one entry more than sequences).  Codes are
integers in the order of the symbols; 0 is the end sentinel, which sorts before all.  Positions are 1-based, as in results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Symbols that the first sort of suffixes looks at, 9 bits each beside the sequence's number.
FIRST_SORT, CODE_BITS = 5, 9


def owners(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


#: Symbols that are sorted at a time; a longer sequence is sorted on its own.
SORTED = 1 << 21


def suffix_arrays(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all suffixes in order, the empty one first, and where each sequence's begin.

    Whole sequences of about SORTED symbols at a time, whatever the batch, so that a task's memory is bounded by its longest one.
    """
    if len(codes) <= SORTED or len(first) <= 2:
        return sorted_together(codes, first)
    out, i = [], 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + SORTED, "right")) - 1)
        out.append(sorted_together(codes[first[i] : first[j]], first[i : j + 1] - first[i])[0].astype(np.int32))
        i = j
    return np.concatenate(out), np.concatenate(([0], np.cumsum(np.diff(first) + 1)))


def sorted_together(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of all sequences together, by prefix doubling: ranks by the first k symbols, then by pairs of ranks k apart, of
    suffixes that still share theirs only."""
    n = np.diff(first) + 1
    begin = np.concatenate(([0], np.cumsum(n)))
    total = int(begin[-1])
    own = np.repeat(np.arange(len(n)), n)
    # each sequence with its sentinel behind it
    text = np.zeros(total, np.int64)
    keep = np.ones(total, bool)
    keep[begin[1:] - 1] = False
    text[keep] = codes
    left = begin[1:][own] - np.arange(total)  # symbols from here to the end, the sentinel included
    if len(n) < 1 << 18 and int(codes.max(initial=0)) < 1 << CODE_BITS:
        key, k = own.astype(np.uint64), FIRST_SORT
        padded = np.concatenate([text, np.zeros(k, np.int64)])
        for i in range(k):
            key = (key << np.uint64(CODE_BITS)) | np.where(left > i, padded[i : i + total], 0).astype(np.uint64)
    else:
        top = np.uint64(int(codes.max(initial=0)) + 1)
        key, k = own.astype(np.uint64) * top + text.astype(np.uint64), 1
    order = np.argsort(key)
    at = np.arange(total)
    # a suffix's rank is the place of its group's first member, so that groups can be refined on their own
    start = _group_starts(key[order], at)
    rank = np.empty(total, np.int64)
    rank[order] = start
    left_over = order[_shared(start)]
    while len(left_over):
        ahead = np.zeros(len(left_over), np.int64)
        inside = left[left_over] > k
        ahead[inside] = rank[left_over[inside] + k] + 1
        key = rank[left_over] * (total + 1) + ahead
        by = np.argsort(key)
        members, at = left_over[by], np.arange(len(by))
        group = rank[members]
        start = group + _group_starts(key[by], at) - _group_starts(group, at)
        rank[members] = start
        left_over = members[_shared(start)]
        k *= 2
    order = np.empty(total, np.int64)
    order[rank] = np.arange(total)
    return order - begin[own[order]] + 1, begin


def _group_starts(ordered: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of some ordered values the place of the first that equals it."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at


def _shared(start: np.ndarray) -> np.ndarray:
    """Mask of those whose group has others."""
    out = np.zeros(len(start), bool)
    same = start[1:] == start[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def bwt(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform, with its sentinel; an empty sequence stays empty."""
    sa, begin = suffix_arrays(codes, first)
    own = owners(begin)
    out = np.zeros(len(sa), codes.dtype)
    real = sa > 1
    out[real] = codes[(first[:-1][own] + sa - 2)[real]]
    keep = (np.diff(first) > 0)[own]
    size = np.where(np.diff(first) > 0, np.diff(first) + 1, 0)
    return out[keep], np.concatenate(([0], np.cumsum(size)))


def inverse_bwt(codes: np.ndarray, first: np.ndarray, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The sequence whose transform this is.

    Without a sentinel nothing; of several cycles that of the first sentinel; a second sentinel on it is an error.  ``strict``
    makes whatever isn't a transform an error.  The walk is done by pointer doubling: steps 1, 2, 4, ... of all at once.
    """
    out = [codes[a:b][inverse_places(codes[a:b], strict)] for a, b in zip(first[:-1], first[1:], strict=True)]
    size = np.array([len(x) for x in out], np.int64)
    return np.concatenate(out) if out else codes[:0], np.concatenate(([0], np.cumsum(size)))


def inverse_places(c: np.ndarray, strict: bool = False) -> np.ndarray:
    """Where in the transform c (0-based) each symbol of the original stands."""
    order = np.argsort(c, kind="stable")
    if not len(c) or c[order[0]] != 0:
        walk = np.empty(0, np.int64)
    else:
        walk, jump = order[:1], order
        while len(walk) < len(c) and not (walk == 0).any():
            walk = np.concatenate([walk, jump[walk]])
            jump = jump[jump]
        walk = walk[: int(np.argmax(walk == 0))]
    found = order[walk]
    if (c[found] == 0).any():
        raise ValueError("a second sentinel on the cycle of the first")
    if strict and len(found) != max(0, len(c) - 1):
        raise ValueError(f"not a transform: {len(found)} of {len(c) - 1} symbols")
    return found


def runs(codes: np.ndarray, first: np.ndarray, compat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, places, first): the runs of equal symbols, each sentinel one of its own; place: of a run's first symbol in its sequence.

    ``compat`` has quirks around sentinels that some encoders have: a leading sentinel is lost where data follows it, and one that
    ends the sequence is told twice, the second time with the last run's length.
    """
    n = len(codes)
    own = owners(first)
    new = np.ones(n, bool)
    new[1:] = (codes[1:] != codes[:-1]) | (own[1:] != own[:-1]) | (codes[1:] == 0)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    place = at - first[:-1][own[at]] + 1
    begin = np.searchsorted(at, first)
    if not compat:
        return length, place, begin
    # by blocks of sentinels: such a block tells each of its sentinels after the first twice, once with the length of the run
    # before the block (1 if there is none), and once more so where the sequence ends; the first of a leading block isn't told
    lengths, places, size = [], [], []
    for a, b, start in zip(begin[:-1], begin[1:], first[:-1], strict=True):
        told = len(lengths)
        stale = 1
        for i in range(a, b):
            here = int(place[i])
            if codes[start + here - 1]:
                lengths.append(int(length[i]))
                places.append(here)
                stale = int(length[i])
                continue
            leads = i == a
            follows = not leads and codes[start + int(place[i - 1]) - 1] == 0
            if follows:
                lengths.append(stale)
                places.append(here)
            if not leads:
                lengths.append(1)
                places.append(here)
            if i == b - 1:
                lengths.append(stale)
                places.append(here)
        size.append(len(lengths) - told)
    return np.array(lengths, np.int64), np.array(places, np.int64), np.concatenate(([0], np.cumsum(np.array(size, np.int64))))


def move_to_front(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each symbol's 0-based place in a list that begins as the sorted alphabet and gets each symbol moved to its front; the list afterwards, as codes.

    Within a run of equal symbols all but the first are at the front, so only the first of each run is looked up.
    """
    out = np.zeros(len(codes), np.int32)
    head = np.ones(len(codes), bool)
    head[1:] = codes[1:] != codes[:-1]
    head[first[:-1][first[:-1] < len(codes)]] = True
    heads = np.flatnonzero(head)
    cut = np.searchsorted(heads, first)
    lists = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        alphabet, ranks = np.unique(codes[heads[a:b]], return_inverse=True)
        order = front(len(alphabet))
        find, drop, put = order.index, order.pop, order.insert
        moved = []
        for r in ranks.tolist():
            i = find(r)
            if i:
                drop(i)
                put(0, r)
            moved.append(i)
        out[heads[a:b]] = moved
        lists.append(alphabet[np.array(list(order), np.int64)])
    return out, lists


def front(size: int) -> bytearray | list[int]:
    """The places 0 to size - 1, as bytes where they fit."""
    return bytearray(range(size)) if size <= 256 else list(range(size))


def inverse_move_to_front(indices: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranks (0-based) of the symbols in the sorted alphabet, of so many symbols; an index outside the list is an error.

    An index of 0 repeats the symbol before it, so only others are looked up.
    """
    n, own = len(indices), owners(first)
    bad = (indices < 0) | (indices >= sizes[own])
    if bad.any():
        at = int(np.argmax(bad))
        raise ValueError(f"move-to-front index {indices[at]} outside a list of {sizes[own[at]]}")
    moves = indices != 0
    moves[first[:-1][first[:-1] < n]] = True
    places = np.flatnonzero(moves)
    cut = np.searchsorted(places, first)
    made: list[int] = []
    for a, b, size in zip(cut[:-1], cut[1:], sizes.tolist(), strict=True):
        order = front(size)
        take, put, add = order.pop, order.insert, made.append
        for i in indices[places[a:b]].tolist():
            r = take(i)
            put(0, r)
            add(r)
    out = np.zeros(n, np.int32)
    out[places] = made
    return out[places[np.cumsum(moves) - 1]] if n else out


class Searcher:
    """Backward search over one transformed sequence of any codes: how many symbols sort before each, and each symbol's places in the transform."""

    def __init__(self, bwt: np.ndarray):
        self.n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        self.symbols, at, count = np.unique(bwt[order], return_index=True, return_counts=True)
        self.places = {int(s): order[i : i + c] for s, i, c in zip(self.symbols, at, count, strict=True)}
        self.base = dict(zip(self.symbols.tolist(), at.tolist(), strict=True))

    def before(self, symbol: int) -> int:
        """How many symbols sort before it; -1 if the sequence lacks it."""
        return self.base.get(symbol, -1) if symbol > 0 else -1

    def rank(self, symbol: int, at: int) -> int:
        """How often the symbol is among the first so many of the transform."""
        return int(np.searchsorted(self.places[symbol], at))


#: Places of the transform between two stored rows of Occ.
SAMPLE = 512


class Stored:
    """The same over a stored index of bytes: its transform, the sentinel's place, C, and Occ at every SAMPLE-th place."""

    def __init__(self, bwt: bytes, end: int, c: np.ndarray, occ: np.ndarray):
        self.n, self.bwt, self.end, self.c = len(bwt), bwt, end, c
        present = np.flatnonzero(np.diff(c))
        self.occ, self.column = occ.reshape(len(bwt) // SAMPLE + 1, len(present)), dict(zip(present.tolist(), range(len(present)), strict=True))

    def before(self, symbol: int) -> int:
        return int(self.c[symbol]) if symbol in self.column else -1

    def rank(self, symbol: int, at: int) -> int:
        row = at // SAMPLE
        found = int(self.occ[row, self.column[symbol]]) + self.bwt.count(symbol, row * SAMPLE, at)
        # the sentinel's place holds a zero byte
        return found - (symbol == 0 and row * SAMPLE <= self.end < at)


def occ_tables(raw: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(C, Occ) of a transform's bytes with the sentinel at place end: how many symbols sort before each byte (and after all), and
    for each byte that occurs how often it is before every SAMPLE-th place."""
    real = np.arange(len(raw)) != end
    count = np.bincount(raw[real], minlength=256)
    c = np.concatenate(([1], 1 + np.cumsum(count))).astype(np.int32)
    present = np.flatnonzero(count)
    column = np.zeros(256, np.int64)
    column[present] = np.arange(len(present))
    blocks = len(raw) // SAMPLE + 1
    inside = np.bincount((np.arange(len(raw)) // SAMPLE * len(present) + column[raw])[real], minlength=blocks * len(present)).reshape(blocks, -1)
    return c, (np.cumsum(inside, axis=0) - inside).astype(np.int32)


def interval(index: Searcher | Stored, pattern: list[int] | bytes, compat: bool = False) -> tuple[int, int]:
    """Rows [low, high) of the suffixes that begin with the pattern; (0, 0) if none.

    ``compat``: a symbol that the text lacks ends the search with what has matched behind it, unless it is the last.
    """
    low, high, matched = 0, index.n, False
    for s in reversed(pattern):
        base = index.before(s)
        if base < 0:
            return (low, high) if compat and matched else (0, 0)
        low, high, matched = base + index.rank(s, low), base + index.rank(s, high), True
        if low >= high:
            return 0, 0
    return (low, high) if matched else (0, 0)


# Arrow


def sizes(column: pa.Array) -> np.ndarray:
    """Symbols of each row of lists, binaries or texts, or of structs by their first field."""
    while pa.types.is_struct(column.type):
        column = column.field(0)
    count = pc.binary_length if pa.types.is_binary(column.type) or pa.types.is_string(column.type) else pc.list_value_length
    return np.asarray(pc.fill_null(count(column), 0), np.int64)


def in_slices(f: Callable[[pa.Array], pa.Array], cells: Callable[[np.ndarray], np.ndarray] | None = None, most: int = SORTED) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """f over each batch of a column, by slices of whole rows that have some ``most`` symbols (or ``cells`` of their sizes), given
    back one by one: a task holds the results of one slice, not of a batch; a longer row is on its own."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            size = sizes(column)
            first = np.concatenate(([0], np.cumsum(cells(size) if cells else size)))
            i = 0
            while i < len(column):
                j = max(i + 1, int(np.searchsorted(first, first[i] + most, "right")) - 1)
                yield f(column.slice(i, j - i))
                i = j

    run.__name__ = f.__name__
    return run


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column, and where each row's begin; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return column.flatten(), np.concatenate(([0], np.cumsum(size)))


def bytes_flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes (byte + 1) of a binary column, and where each row's begin; null rows are empty."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    raw = b"".join(x for x in column.to_pylist() if x)
    return np.frombuffer(raw, np.uint8).astype(np.int32) + 1, np.concatenate(([0], np.cumsum(size)))


def codes_of(values: pa.Array) -> np.ndarray:
    """Codes of the values in their order, null as 0."""
    if pa.types.is_binary(values.type) and len(values):
        off = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
        valid = np.asarray(values.is_valid()) if values.null_count else np.ones(len(values), bool)
        if (np.diff(off)[valid] == 1).all():
            out = np.zeros(len(values), np.int32)
            if valid.any():
                out[valid] = np.frombuffer(values.buffers()[2], np.uint8)[off[:-1][valid]].astype(np.int32) + 1
            return out
    encoded = values.dictionary_encode()
    words = encoded.dictionary
    rank = np.empty(len(words) + 1, np.int32)
    rank[np.asarray(pc.sort_indices(words))] = np.arange(1, len(words) + 1)
    rank[-1] = 0
    return rank[np.asarray(pc.fill_null(encoded.indices, len(words)))]


def nested(values: pa.Array, first: np.ndarray, like: pa.Array | None = None) -> pa.Array:
    """A list column; null where ``like`` is."""
    off = pa.array(first.astype(np.int32), pa.int32())
    if like is not None and like.null_count:
        off = pa.array(first.astype(np.int32), pa.int32(), mask=np.append(np.asarray(like.is_null()), False))
    return pa.ListArray.from_arrays(off, values)


def byte_values(codes: np.ndarray) -> pa.Array:
    """One-byte binaries, null for the sentinel."""
    real = codes > 0
    off = np.concatenate(([0], np.cumsum(real))).astype(np.int32)
    valid = pa.py_buffer(np.packbits(real, bitorder="little").tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(codes), [valid, pa.py_buffer(off), pa.py_buffer((codes[real] - 1).astype(np.uint8).tobytes())], int((~real).sum()))
