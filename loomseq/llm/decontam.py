"""Benchmark decontamination: passages of documents within an edit distance, in words, of benchmark items.

The CGK embedding of a sequence is a random walk along it: step j emits the symbol at the pointer and moves on by a bit that a
random function of (j, symbol) gives.  Sequences few edits apart have walks that soon fall into step again after an edit, so
their embeddings agree in many places: edit distance becomes Hamming distance.  Bit-sampling LSH takes a few coordinates of the
embedding as a key.  Here the symbols are words, and windows have the size of an item: a walk takes two steps a word, and a
repetition's coordinates lie anywhere along it, near each other, as walks in step at one are mostly in step at the next.  The
distance between walks grows with the square of the edits, so items of more than WINDOW words go by windows of equal parts, one
of which has no larger share of edits than the whole.

Windows start at every place of a document where one could match at all: a passage within the allowed edits keeps a number of the
item's runs of two and three words, which are counted first; that loses nothing.  Walks that meet at a place and step go on as one.
How many repetitions a window size needs to find the target share of edited passages is measured, for edits at random and evenly
spread ones; a target that MOST_REPETITIONS don't reach is an error.  Candidates are verified by the exact edit distance between
the item and the best passage around the place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import textvec as tv
from loomseq.llm.cluster import trimmed, unused

#: What separates words in ASCII texts: all but letters and digits.
SEPARATOR = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])
#: Code points of scripts written without spaces, each letter of which is a word: Thai and Lao, Myanmar, Khmer, kana, Han (fixed values).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x323AF))
#: Words of the longest window, whose walk has as many steps as there are random bits.
WINDOW = 32
#: Coordinates of a key, and the steps between them.
COORDINATES, GAPS = 4, (1, 2)
MOST_REPETITIONS = 512
#: Text of benchmark items of one block of the index; blocks that a worker holds at once.
BLOCK_BYTES, HELD_BLOCKS = 1 << 19, 4
#: Text that is searched at a time.
SEARCH_BYTES = 1 << 23
#: Edited windows of each size and kind of edits on which recall is measured.
TRIALS = 1000
#: Edits at random, evenly spread ones, and evenly spread ones that all replace a word.
KINDS = ("random", "spread", "replaced")


@lru_cache(1)
def folded() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case (0 if it is no letter, mark or digit), and whether it is a word of its own."""
    low, single = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in chain(range(0xD800), range(0xE000, 0x110000)):
        x = chr(c)
        if x.isalnum() or unicodedata.category(x)[0] == "M":
            lower = x.lower()
            low[c] = ord(lower) if len(lower) == 1 else c
    for first, last in UNSPACED:
        single[first : last + 1] = low[first : last + 1] > 0
    return low, single


def words_of(docs: tv.Docs) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document, and where each document's begin.

    Words are runs of letters, marks and digits by Unicode, in lower case where that is one character; in scripts without spaces
    each character is one.
    """
    size = np.diff(docs.off)
    beyond = np.concatenate(([0], np.cumsum(docs.buf >= 128)))
    other = beyond[docs.off[1:]] > beyond[docs.off[:-1]]
    if not other.any():
        return _ascii_words(docs)
    inside = np.repeat(other, size)
    parts = []
    for mine, where, words in ((~other, ~inside, _ascii_words), (other, inside, _other_words)):
        parts.append(words(tv.Docs(docs.buf[where], np.concatenate(([0], np.cumsum(size[mine]))), 0)))
    (plain, at), (wide, where) = parts
    count = np.zeros(len(docs), np.int64)
    count[~other], count[other] = np.diff(at), np.diff(where)
    out, own = np.empty(len(plain) + len(wide), np.uint64), np.repeat(other, count)
    out[~own], out[own] = plain, wide
    return out, np.concatenate(([0], np.cumsum(count)))


def _ascii_words(docs: tv.Docs) -> tuple[np.ndarray, np.ndarray]:
    low = tv.Docs(tv.LOWER[docs.buf], docs.off, 0)
    starts, ends, first = low.words(SEPARATOR)
    return tv.WORDS.bytes(low.buf, starts, ends), first


def _other_words(docs: tv.Docs) -> tuple[np.ndarray, np.ndarray]:
    """Code point by code point."""
    low, single = folded()
    points = np.frombuffer(docs.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # where each document begins, in code points
    off = np.concatenate(([0], np.cumsum((docs.buf & 0xC0) != 0x80)))[docs.off]
    alone, points = single[points], low[points]
    inside = points > 0
    new = np.ones(len(points) + 1, bool)
    new[1:-1] = ~inside[:-1] | alone[:-1] | alone[1:]
    new[off] = True
    starts, ends = np.flatnonzero(inside & new[:-1]), np.flatnonzero(inside & (new[1:] | ~np.append(inside[1:], False))) + 1
    # hashed as UTF-8, as ASCII texts are
    points[~inside] = 0x20
    place = np.concatenate(([0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))))
    buf = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
    return tv.WORDS.bytes(buf, place[starts], place[ends]), np.searchsorted(starts, off)


class Filter:
    """A bitmap of 64-bit keys: tells which keys may be among them."""

    def __init__(self, keys: np.ndarray):
        self.map = np.zeros(1 << max(12, (8 * len(keys)).bit_length()), bool)
        self.map[keys & np.uint64(len(self.map) - 1)] = True

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.map[keys & np.uint64(len(self.map) - 1)]


@dataclass
class Walk:
    """One repetition: the random bits' seed, where along the walk its coordinates begin, and the steps from there to each."""

    seed: np.uint64
    along: float
    steps: list[int]

    def begin(self, n: int) -> int:
        """The step of the first coordinate for windows of n words."""
        return int(self.along * max(1, 2 * n - self.steps[-1]))

    def bits(self, words: np.ndarray) -> np.ndarray:
        return tv.mix(words ^ self.seed)

    def key(self, key: np.ndarray, words: np.ndarray) -> np.ndarray:
        return tv.mix(key ^ words)


@lru_cache(1)
def walks(seed: int = 11) -> list[Walk]:
    rng = np.random.default_rng(seed)
    return [Walk(rng.integers(0, 2**63, dtype=np.uint64), float(rng.random()), [0, *np.cumsum(rng.choice(GAPS, COORDINATES - 1)).tolist()]) for _ in range(MOST_REPETITIONS)]


def step(at: np.ndarray, bits: np.ndarray, j: int) -> np.ndarray:
    """The pointers after step j."""
    return at + ((bits >> np.uint64(j)) & np.uint64(1)).astype(np.int64)


def allowed(n: int, share: float) -> int:
    """Edits that n words may have."""
    return int(share * n + 1e-9)


def edited(rng: np.random.Generator, words: np.ndarray, edits: int, kind: str) -> list[np.uint64]:
    """The words with so many edits: replaced (all, or a third of them), dropped or new ones."""
    w, n = list(words), len(words)
    for e in reversed(range(edits)):
        edit, at = 0 if kind == "replaced" else int(rng.integers(3)), (2 * e + 1) * n // (2 * edits) if kind != "random" else int(rng.integers(len(w)))
        new = rng.integers(0, 2**63, dtype=np.uint64)
        w[at : at + 1] = [new] if edit == 0 else [] if edit == 1 else [new, w[at]]
    return w


@lru_cache(1024)
def repetitions(n: int, edits: int, recall: float) -> tuple[int, dict[str, float]]:
    """How many walks find windows of n words with so many edits as often as asked for, and how often they do by kind of edits.

    A passage is found where its walk, from its start or the word after it, gives the key of the item's walk.
    """
    rng = np.random.default_rng([5, n, edits])
    width, total = n + edits + 2 * WINDOW + 2, TRIALS * len(KINDS)
    item, text = (rng.integers(0, 2**63, (total, width), dtype=np.uint64) for _ in range(2))
    for t in range(total):
        w = edited(rng, item[t, :n], edits, KINDS[t % len(KINDS)])
        text[t, : len(w)] = w
    left = np.arange(total)
    for r, walk in enumerate(walks(), 1):
        c, who = walk.begin(n), np.arange(len(left))
        want = walk.begin(n) + np.array(walk.steps)

        def emitted(x: np.ndarray, start: int, c: int = c, walk: Walk = walk, want: np.ndarray = want, who: np.ndarray = who) -> np.ndarray:
            bits, at, out = walk.bits(x), np.full(len(x), start), []
            for j in range(int(want[-1]) + 1):
                if j in want:
                    out.append(x[who, at])
                at = step(at, bits[who, at], j)
            return np.stack(out, axis=1)

        own = emitted(item[left], 0)
        found = np.zeros(len(left), bool)
        for start in (0, 1):
            found |= (emitted(text[left], start) == own).all(axis=1)
        left = left[~found]
        share = {kind: 1 - int((left % len(KINDS) == i).sum()) / TRIALS for i, kind in enumerate(KINDS)}
        if min(share.values()) >= recall:
            return r, share
    raise ValueError(f"{MOST_REPETITIONS} walks find {min(share.values()):.3f} of windows of {n} words with {edits} edits, not {recall}")


class Index:
    """The keys of all items' windows, for each repetition."""

    def __init__(self, ids: list[int], words: list[np.ndarray], share: float = 0.2, recall: float = 0.999):
        self.ids, self.words, self.share = ids, words, share
        self.size = np.array([len(w) for w in words], np.int64)
        self.edits = np.array([allowed(n, share) for n in self.size.tolist()], np.int64)
        #: windows by size: (item, offset) of each
        parts: dict[int, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.size.tolist()):
            cut = np.linspace(0, n, -(-n // WINDOW) + 1).astype(int).tolist() if n else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                parts.setdefault(b - a, []).append((i, a))
        #: (window size, kind of edits) -> share of edited windows that the walks find
        self.recall: dict[tuple[int, str], float] = {}
        # (repetition, step) -> the keys so far after each coordinate, items, and how far behind an item's start the first one is
        tables: dict[tuple[int, int], list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]] = {}
        for n, members in sorted(parts.items()):
            count, found = repetitions(n, allowed(n, share), recall)
            self.recall |= {(n, kind): x for kind, x in found.items()}
            item, offset = np.array(members, np.int64).T
            text = np.empty((len(members), n + 2 * WINDOW + 2), np.uint64)
            for row, (i, a) in zip(text, members, strict=True):
                row[:n] = words[i][a : a + n]
            # what a walk meets behind a window is no word
            text[:, n:] = tv.mix(np.arange(text[:, n:].size, dtype=np.uint64).reshape(len(members), -1) + np.uint64(n << 40))
            who = np.arange(len(members))
            for r, walk in enumerate(walks()[:count]):
                bits, at, keys, key = walk.bits(text), np.zeros(len(members), np.int64), [], np.zeros(len(members), np.uint64)
                begin = walk.begin(n)
                for j in range(begin + walk.steps[-1] + 1):
                    if j == begin:
                        behind = offset + at
                    if j - begin in walk.steps:
                        key = walk.key(key, text[who, at])
                        keys.append(key)
                    at = step(at, bits[who, at], j)
                tables.setdefault((r, begin), []).append((keys, item, behind))
        #: for each repetition, by step: filters of the keys so far, whole keys in order, their items, and how far behind
        self.tables: list[list[tuple[int, list[Filter], np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(1 + max((r for r, _ in tables), default=-1))]
        for (r, begin), made in sorted(tables.items()):
            keys = [np.concatenate([m[0][k] for m in made]) for k in range(COORDINATES)]
            order = np.argsort(keys[-1], kind="stable")
            self.tables[r].append((begin, [Filter(k) for k in keys], keys[-1][order], np.concatenate([m[1] for m in made])[order], np.concatenate([m[2] for m in made])[order]))
        self.expected = min(self.recall.values(), default=1.0)
        # what a passage keeps: so many of the items' runs of 3, 2 and 1 words in so many words, by classes of like sizes
        flat = np.concatenate([np.empty(0, np.uint64), *words])
        pairs = [tv.RUNS.pair(w[:-1], w[1:]) for w in words]
        triples = [tv.RUNS.pair(p[:-1], w[2:]) for p, w in zip(pairs, words, strict=True)]
        self.runs = [Filter(np.concatenate([flat[:0], *x])) for x in ([flat], pairs, triples)]
        self.kept: dict[int, tuple[int, list[int]]] = {}
        for n in parts:
            k = allowed(n, share)
            reach, need = self.kept.get(int(2 * np.log2(n)), (0, [n, n, n]))
            # an edit takes a run of q words with any of its q places
            self.kept[int(2 * np.log2(n))] = (max(reach, n + k), [min(x, n - q + 1 - q * k) for q, x in enumerate(need, 1)])

    def places(self, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The places of all windows that could match."""
        n = len(words)
        inside = np.zeros(n + 1, np.int32)
        hits = [self.runs[0].has(words) if any(need[1] <= 0 for _, need in self.kept.values()) else np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)]
        hits[1][: n - 1] = self.runs[1].has(pairs)
        two = np.flatnonzero(hits[1][: n - 2] & hits[1][1 : n - 1]) if n > 2 else np.empty(0, np.int64)
        hits[2][two] = self.runs[2].has(tv.RUNS.pair(pairs[two], words[two + 2]))
        sums = [np.concatenate(([0], np.cumsum(hit, dtype=np.int32))) for hit in hits]
        for reach, need in self.kept.values():
            start = None
            for q in (3, 2, 1):
                if need[q - 1] <= 0 or q == 1 and start is not None:
                    continue
                end = np.minimum(np.arange(n) + (reach - q + 1), n) if start is None else np.minimum(start + (reach - q + 1), n)
                total = sums[q - 1]
                enough = total[end] - (total[:-1] if start is None else total[start]) >= need[q - 1]
                start = np.flatnonzero(enough) if start is None else start[enough]
            np.add.at(inside, start, 1)
            np.add.at(inside, np.minimum(start + reach, n), -1)
        return np.flatnonzero(np.cumsum(inside[:-1]) > 0)

    def candidates(self, words: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(item, place): items that may be in the words, with the place where the item would begin."""
        items, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        place = self.places(words, tv.RUNS.pair(words[:-1], words[1:]) if pairs is None else pairs) if len(words) else np.empty(0, np.int64)
        if len(place):
            text, last = words[place], len(place) - 1
            for walk, tables in zip(walks(), self.tables, strict=False):
                bits, at, j = walk.bits(text), np.arange(len(text)), 0
                for begin, filters, keys, item, behind in tables:
                    while j < begin:
                        at = np.minimum(step(at, bits[at], j), last)
                        # walks that have met are one from here on
                        at = at[np.append(True, at[1:] != at[:-1])]
                        j += 1
                    who, now, key = at, at, np.zeros(len(at), np.uint64)
                    for k, filter in zip(range(walk.steps[-1] + 1), self._due(walk, filters), strict=True):
                        if filter is not None:
                            key = walk.key(key, text[now])
                            keep = filter.has(key)
                            who, now, key = who[keep], now[keep], key[keep]
                            if not len(who):
                                break
                        now = np.minimum(step(now, bits[now], begin + k), last)
                    if len(who):
                        low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                        n = high - low
                        hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                        items.append(item[hit])
                        places.append(np.repeat(place[who], n) - behind[hit])
        return np.concatenate(items), np.concatenate(places)

    @staticmethod
    def _due(walk: Walk, filters: list[Filter]) -> list[Filter | None]:
        """For each step from the first coordinate on, the filter of the coordinate that is due."""
        due: list[Filter | None] = [None] * (walk.steps[-1] + 1)
        for at, filter in zip(walk.steps, filters, strict=True):
            due[at] = filter
        return due

    def matches(self, words: np.ndarray, first: np.ndarray, pairs: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, end) of the best passage of each item in each document: the nearest, then the first."""
        item, place = self.candidates(words, pairs)
        if not len(item):
            return []
        reach = self.edits[item]
        # the document that the item's middle would be in
        doc = np.searchsorted(first, np.clip(place + self.size[item] // 2, 0, len(words) - 1), "right") - 1
        rows = np.unique(np.stack([item, doc, np.clip(place, first[doc] - reach, first[doc + 1])], axis=1), axis=0)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = int(rows[a, 0])
            for x in range(a, b, 4096):
                for d, found in self._verify(i, rows[x : min(b, x + 4096), 1:], words, first):
                    out[d, i] = min(out.get((d, i), found), found)
        return [(d, i, *found) for (d, i), found in sorted(out.items())]

    def _verify(self, i: int, rows: np.ndarray, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, tuple[int, int, int]]]:
        w, n, k = self.words[i], int(self.size[i]), int(self.edits[i])
        doc, place = rows[:, 0], rows[:, 1]
        at = place[:, None] - k + np.arange(n + 2 * k)[None, :]
        inside = (at >= first[doc][:, None]) & (at < first[doc + 1][:, None])
        text = words[np.clip(at, 0, len(words) - 1)]
        # no passage within k edits has fewer of the item's words, or of its pairs of neighbours
        enough = (np.isin(text, w) & inside).sum(axis=1) >= n - k
        if n - 1 - 2 * k > 0 and enough.any():
            near = np.isin(tv.RUNS.pair(text[enough, :-1], text[enough, 1:]), tv.RUNS.pair(w[:-1], w[1:]))
            enough[enough] = (near & inside[enough, :-1] & inside[enough, 1:]).sum(axis=1) >= n - 1 - 2 * k
        doc, at, inside, text = doc[enough], at[enough], inside[enough], text[enough]
        if not len(doc):
            return
        far = n + k + 1
        end, distance = last_row(w, text, inside, far)
        for r in np.flatnonzero(distance <= k).tolist():
            e = int(end[r])
            # the same from the end backwards, to the nearest start
            back, d = last_row(w[::-1], text[r : r + 1, :e][:, ::-1], inside[r : r + 1, :e][:, ::-1], far, anchored=True)
            s = e - int(back[0])
            yield int(doc[r]), (int(distance[r]), int(at[r, s] - first[doc[r]]) if s < at.shape[1] else 0, int(at[r, e - 1] - first[doc[r]]) + 1)


def last_row(item: np.ndarray, text: np.ndarray, inside: np.ndarray, far: int, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each row of text the end (a number of words) of the passage nearest to the item, the first of those, and its edit distance.

    The passage may start anywhere, or at the row's start if anchored.  Words that aren't inside can't be part of a passage.
    """
    c, m = text.shape
    j = np.arange(m + 1)
    # a passage can't go over words outside: they come first or last in a row, so such columns are far from everything
    lead = np.concatenate([np.ones((c, 1), bool), inside], axis=1)
    start_ok = np.concatenate([inside, np.ones((c, 1), bool)], axis=1)
    row = np.where(lead | start_ok, 0, far) if not anchored else np.where(lead, j[None, :], far)
    for symbol in item:
        step = row + 1
        step[:, 1:] = np.minimum(step[:, 1:], np.where(inside, row[:, :-1] + (text != symbol), far))
        row = np.minimum.accumulate(step - j, axis=1) + j
    row = np.where(lead, row, far)
    end = row.argmin(axis=1)
    return end, row[np.arange(c), end]


def find(docs: DataFrame, items: DataFrame, share: float = 0.2, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word, item_words): the best passage of every item in every document that has one.

    A passage matches if its word edit distance to the item is at most ``share`` of the item's words.  Words are runs of letters,
    marks and digits by Unicode, in lower case, so case, punctuation and spacing don't count; in scripts without spaces each
    letter is one.  Null and empty texts and items match nothing; repeated rows match each on its own, with null ids as others.
    Documents are read once, whatever the number of items, and not shuffled; workers hold HELD_BLOCKS blocks of the index.  A
    ``share`` of edits at which walks don't reach ``recall`` raises a ValueError.
    """
    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks = _blocks(items, share, recall, item_col, item_text)
    names = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("item_words", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for first, index, found in _found(b.column(1), blocks):
                rows += [(ids[first + doc], index.ids[i], distance, start, end, int(index.size[i])) for doc, i, distance, start, end in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])

    return frame.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, item_id long, distance int, start_word long, end_word long, item_words int")


def clean(docs: DataFrame, items: DataFrame, share: float = 0.2, recall: float = 0.999, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, unchanged, in which no item matches (see ``find``); one pass, no shuffle."""
    names = docs.columns
    blocks = _blocks(items, share, recall, item_col, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(len(b), bool)
            for first, _, found in _found(b.column(len(names)), blocks):
                for match in found:
                    keep[first + match[0]] = False
            yield b.select(range(len(names))).filter(pa.array(keep))

    frame = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias(unused(docs, "text")))
    return frame.mapInArrow(lambda batches: trimmed(run(batches)), docs.schema)


def _found(texts: pa.Array, blocks: list) -> Iterator[tuple[int, Index, list[tuple[int, int, int, int, int]]]]:
    """(number of the first text, index, matches) of some texts at a time and each block of the index."""
    for d in tv.chunks(texts, SEARCH_BYTES):
        words, first = words_of(d)
        if len(words):
            pairs = tv.RUNS.pair(words[:-1], words[1:])
            for shared in blocks:
                yield d.first, shared.value, shared.value.matches(words, first, pairs)
                if len(blocks) > HELD_BLOCKS:
                    vars(shared).pop("_value", None)  # loaded again from the worker's disk for the next texts


def _blocks(items: DataFrame, share: float, recall: float, item_col: str, item_text: str) -> list:
    """Broadcast indexes of the items, of BLOCK_BYTES of text each (or one item)."""
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, made = -(-total // BLOCK_BYTES) or 1, []
    # read once, in order, a partition at a time, of which the driver holds one block
    rows = asked.select(F.pmod(F.xxhash64("text", "item_id"), F.lit(count)).alias("block"), "item_id", "text").orderBy("block", "item_id", "text").toLocalIterator()
    for _, block in groupby(rows, key=lambda r: r[0]):
        ids, texts = [], []
        for r in block:
            ids.append(r[1])
            texts.append(r[2])
        words = []
        for d in tv.chunks(pa.array(texts, pa.string())):
            w, first = words_of(d)
            words += np.split(w, first[1:-1])
        made.append(items.sparkSession.sparkContext.broadcast(Index(ids, words, share, recall)))
    return made


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: a row for each item that a document holds (see ``find``).

    Null and empty texts and items match nothing; null ids and repeated rows match as others.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
