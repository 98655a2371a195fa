"""Byte-pair encoding by a deterministic tokenization automaton.

The automaton's arcs are labelled by tokens; it accepts exactly the token sequences that the merges, applied in order, leave.
It starts as one state with a loop for every byte.  Each merge (a, b -> c) is one gadget: the arcs of a are redirected to a
copy of their target that lacks the arc of b, and wherever there is an arc of a there is now one of c, to the state that b led
to.  All arcs of a token lead to one state, so a gadget adds one state at most: 50,000 merges give some 50,000 states.  Which
arcs leave a state follows from the gadgets that made it (``arc``); the transition table keeps each answer once asked for, as
lazily built automata do: all of it would be 2.5 billion entries.

Every beginning of a word has one accepted path, so every place of a word has one state.  A word is read from left to right: from
each place's state the table's transitions by the tokens that stand there give the states of the places behind them.  Nothing is
ever taken back.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.llm.cluster import trimmed, unused

#: The split before the merges, of the byte-level pre-tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and numbers that Unicode assigned after version 16, whose tables the split follows: to it they are other signs (fixed values).
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
SPLIT = regex.compile(PATTERN)
HAS_LATER = regex.compile(f"[{LATER}]")
SPLIT_LATER = regex.compile(
    PATTERN.replace(r"[^\s\p{L}\p{N}]", "OTHER").replace(r"\p{L}", rf"[\p{{L}}--[{LATER}]]").replace(r"\p{N}", rf"[\p{{N}}--[{LATER}]]").replace("OTHER", rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]"), regex.V1
)


def split(text: str) -> list[str]:
    """The words that merges stay within."""
    return (SPLIT_LATER if not _latin(text) and HAS_LATER.search(text) else SPLIT).findall(text)


def _latin(text: str) -> bool:
    """Whether all code points are below 256, which says so fastest."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: In the table of transitions: asked for, and there is none.
NO_ARC = -2
#: Longer words are encoded one by one.
LONG_WORD = 40
#: Words whose tokens a worker remembers; it starts anew when they are more.
REMEMBERED = 150_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by its rule: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """A hash table of distinct integers that many lookups go through at once; what isn't in it gives -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.count = len(keys)
        self.top = np.int64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.keys, self.values = np.full(int(self.top) + 1, -1, np.int64), np.full(int(self.top) + 1, -1, np.int64)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            place, first = np.unique(at[left], return_index=True)
            free = self.keys[place] < 0
            won = left[first[free]]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.top

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.keys >= 0
        return self.keys[used], self.values[used]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B97F4A7C1)) >> np.int64(20)) & self.top

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = self.values[at]
        left = np.flatnonzero((found != keys) & (found >= 0))
        out[found != keys] = -1
        while len(left):
            at[left] = (at[left] + 1) & self.top
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Automaton:
    """labels: the bytes of each token id; merges: (left id, right id, result id), first to last."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        size = max(labels, default=0) + 1
        self.labels = labels
        self.left, self.right, self.made = [-1] * size, [-1] * size, [0] * size
        self.step: dict[tuple[int, int], int] = {}
        #: (a, k): the target of a's arcs once k gadgets are in; the start is state 0
        self.states: list[tuple[int, int]] = [(-1, 0)]
        self.state = [0] * size
        self.live = [True] * size
        for k, (a, b, c) in enumerate(merges, 1):
            if self.made[c] or c in (a, b):
                raise ValueError(f"two merges make token {c}")
            before = self.state[b]
            self.live[c] = self.live[a] and self.live[b] and self._leaves(a, k - 1, b)
            self.left[c], self.right[c], self.made[c] = a, b, k
            self.step[a, b] = k
            self.state[c] = before
            if self.live[c]:
                self.states.append((a, k))
                self.state[a] = len(self.states) - 1
        self.size, self.nodes, self.tokens = size, None, []
        # the labels as a trie: (node << 8 | byte) -> node; the token of each node
        trie: dict[int, int] = {}
        token = [-1]
        self.length = np.zeros(size, np.int64)
        for t, label in labels.items():
            node = 0
            for x in label:
                to = trie.get(node << 8 | x)
                if to is None:
                    to = trie[node << 8 | x] = len(token)
                    token.append(-1)
                node = to
            token[node], self.length[t] = t, len(label)
        self.token = np.array(token)
        self.trie = Table(np.fromiter(trie, np.int64, len(trie)), np.fromiter(trie.values(), np.int64, len(trie)))
        # the transitions asked for so far, (state * size + token) -> state or -1; the latest are in recent
        self.table, self.recent = Table(np.empty(0, np.int64), np.empty(0, np.int64)), {}

    def _leaves(self, a: int, k: int, t: int) -> bool:
        """Whether an arc of t leaves the state that a's arcs led to after k gadgets."""
        left, right, made, step = self.left, self.right, self.made, self.step
        while True:
            if step.get((a, t), 1 << 60) <= k:
                return False  # that gadget's copy lacks it
            if made[t] and made[t] >= made[a]:
                k, t = min(k, made[t]), left[t]  # t's gadget put it where its left part had an arc
            elif made[a]:
                k, a = made[a] - (left[a] == right[a]), right[a]  # a's gadget led to where its right part then led
            else:
                return True

    def arc(self, state: int, token: int) -> int:
        """The state after the token, NO_ARC if no arc of it leaves the state."""
        key = state * self.size + token
        found = self.recent.get(key)
        if found is None:
            ok = self.live[token] and (not state or self._leaves(*self.states[state], token))
            found = self.recent[key] = self.state[token] if ok else NO_ARC
        return found

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The transitions of many states and tokens, by the table."""
        key = state * self.size + token
        to = self.table.get(key)
        missing = np.flatnonzero(to == -1)
        if len(missing):
            new, at = np.unique(key[missing], return_inverse=True)
            to[missing] = np.fromiter((self.arc(*divmod(k, self.size)) for k in new.tolist()), np.int64, len(new))[at]
            if len(self.recent) > 4096 + self.table.count // 8:
                keys, values = self.table.items()
                keys, at = np.unique(np.concatenate([keys, np.fromiter(self.recent, np.int64)]), return_index=True)
                self.table, self.recent = Table(keys, np.concatenate([values, np.fromiter(self.recent.values(), np.int64)])[at]), {}
        return to

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of pre-split words, one after the other, and where each word's end.

        All words of up to LONG_WORD bytes are read together, place by place.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        count = np.zeros(len(words), np.int64)
        order = np.argsort(-size, kind="stable")
        long = order[: int(np.searchsorted(-size[order], -LONG_WORD, "left"))]
        ids: dict[int, list[int]] = {i: self._long(words[i]) for i in long.tolist()}
        short = order[len(long) :]
        size = size[short]
        n, most = len(short), int(size.max(initial=0))
        buf = np.frombuffer(b"".join(words[i] for i in short.tolist()) + b"\0", np.uint8).astype(np.int64)
        base = np.cumsum(size) - size
        # of each place its state, and the token that led there
        state, last = np.full((n, most + 1), -1, np.int32), np.zeros((n, most + 1), np.int32)
        state[:, 0] = 0
        for j in range(most):
            # longer words come first
            on = np.arange(int(np.searchsorted(-size, -j, "left")))
            at, node, k = state[on, j].astype(np.int64), np.zeros(len(on), np.int64), j
            if len(on) and at.min() < 0:
                raise ValueError(f"no path for {words[int(short[int(at.argmin())])]!r}")
            while len(on):
                to = self.trie.get(node << 8 | buf[base[on] + k])
                k += 1
                stay = to >= 0
                on, at, node = on[stay], at[stay], to[stay]
                t = self.token[node]
                hit = np.flatnonzero(t >= 0)
                reached = self.arcs(at[hit], t[hit])
                ok = reached >= 0
                hit = hit[ok]
                state[on[hit], k], last[on[hit], k] = reached[ok], t[hit]
                stay = size[on] > k
                on, at, node = on[stay], at[stay], node[stay]
        # the path to each word's end, from there back
        end, path, depth = size.copy(), [], np.zeros(n, np.int64)
        who = np.flatnonzero(end > 0)
        if (state[np.arange(n), size] < 0).any():
            raise ValueError(f"no path for {words[int(short[int(state[np.arange(n), size].argmin())])]!r}")
        while len(who):
            t = last[who, end[who]]
            path.append((who, t))
            depth[who] += 1
            end[who] -= self.length[t]
            who = who[end[who] > 0]
        count[short] = depth
        for i, x in ids.items():
            count[i] = len(x)
        ends = np.cumsum(count)
        out = np.empty(int(count.sum()), np.int32)
        place = ends[short] - 1
        for who, t in path:
            out[place[who]] = t
            place[who] -= 1
        for i, x in ids.items():
            out[ends[i] - len(x) : ends[i]] = x
        return out, ends

    def _long(self, word: bytes) -> list[int]:
        """The accepted path of one word, found in the same way."""
        if self.nodes is None:
            self.nodes = dict(zip(*(x.tolist() for x in self.trie.items()), strict=True))
            self.tokens = self.token.tolist()
        nodes, tokens, arc, n = self.nodes, self.tokens, self.arc, len(word)
        state, last = [-1] * (n + 1), [-1] * (n + 1)
        state[0] = 0
        for j in range(n):
            node, k = 0, j
            if state[j] < 0:
                raise ValueError(f"no path for {word[:80]!r}")
            while k < n and (node := nodes.get(node << 8 | word[k], -1)) >= 0:
                k += 1
                t = tokens[node]
                if t >= 0 and state[k] < 0 and (to := arc(state[j], t)) >= 0:
                    state[k], last[k] = to, t
        if state[n] < 0:
            raise ValueError(f"no path for {word[:80]!r}")
        out = []
        while n:
            out.append(last[n])
            n -= int(self.length[last[n]])
        return out[::-1]


class Tokenizer:
    """A byte-level BPE file (JSON) as an automaton; special tokens in a text are cut out first."""

    def __init__(self, path: str, encodes: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        chars, vocab = byte_chars(), model["vocab"]
        as_bytes = lambda s: bytes(chars[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        labels = {i: as_bytes(s) for s, i in vocab.items()}
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]) if encodes else None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path} has added tokens that take what is beside them")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*labels, *self.special.values()]) + 1
        self.label = np.array([b""] * size, object)
        for i, b in labels.items():
            self.label[i] = b
        for s, i in self.special.items():
            self.label[i] = s.encode()
        #: remembered words (specials as 1-tuples) by number; where each one's tokens begin in flat, and how many there are
        self.known: dict[str | tuple[str], int] = {}
        self.begin, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of some texts, whose new words go through the automaton together."""
        words, count = [], []
        for t in texts:
            before = len(words)
            for k, p in enumerate(self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t]):
                words += [(p,)] if k % 2 else split(p)
            count.append(len(words) - before)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            self.begin, self.size, self.flat = self.begin[:0], self.size[:0], self.flat[:0]
        new = [w for w in set(words).difference(known) if isinstance(w, str)]
        special = [w for w in set(words).difference(known) if isinstance(w, tuple)]
        ids, end = self.automaton.encode([w.encode() for w in new])
        ids = np.concatenate([ids, np.array([self.special[w[0]] for w in special], np.int32)])
        end = np.concatenate(([0], end, len(ids) - len(special) + 1 + np.arange(len(special)))).astype(np.int64)
        known.update(zip([*new, *special], range(len(known), len(known) + len(end) - 1), strict=True))
        self.begin, self.size, self.flat = np.concatenate([self.begin, end[:-1] + len(self.flat)]), np.concatenate([self.size, np.diff(end)]), np.concatenate([self.flat, ids])
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        size = self.size[at]
        stop = np.cumsum(size)
        out = self.flat[np.repeat(self.begin[at] - (stop - size), size) + np.arange(int(size.sum()))]
        cut = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(count)))]
        return [out[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The arcs' labels in turn; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(self.label[ids]).decode("utf-8", "replace")


_loaded: dict[tuple[str, bool], Tokenizer] = {}


def tokenizer(path: str, encodes: bool = True) -> Tokenizer:
    """The compiled automaton, or the labels alone, once in each worker."""
    if (path, encodes) not in _loaded:
        _loaded[path, encodes] = Tokenizer(path, encodes)
    return _loaded[path, encodes]


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of a column; at least a row each."""
    off = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    i = 0
    while i < len(off):
        j = max(i + 1, int(np.searchsorted(off, (off[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def _encoded(batches: Iterator[pa.RecordBatch], path: str, out: str) -> Iterator[pa.RecordBatch]:
    """The last column, of texts, as token ids."""
    t = tokenizer(path)
    for b in batches:
        kept = b.num_columns - 1
        for part in slices(b, kept):
            ids = t.encode_all([x or "" for x in part.column(kept).to_pylist()])
            off = np.concatenate(([0], np.cumsum(list(map(len, ids)))))
            column = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*part.columns[:kept], column], names=[*b.schema.names[:kept], out])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, out: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """The last column, of token ids, as texts (beside it if it is kept)."""
    t = tokenizer(path, encodes=(path, True) in _loaded)
    for b in batches:
        kept = b.num_columns - (not keep_ids)
        column = b.column(b.num_columns - 1)
        if column.values.null_count:
            raise ValueError("a null among token ids")
        values, off, valid = np.asarray(column.values), np.asarray(column.offsets), np.asarray(column.is_valid())
        if len(values) and int(values[off[0] : off[-1]].min(initial=0)) < 0:
            raise IndexError("a negative token id")
        texts = [t.decode(values[i:j]) if ok else None for i, j, ok in zip(off[:-1], off[1:], valid, strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(texts, pa.string())], names=[*b.schema.names[:kept], out])


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All rows with ``out`` (array of int): the token ids of the whole text; null and empty texts give an empty array.

    ``path`` is a tokenizer file that every worker can read.  Other columns stay as they are; an existing column named ``out``
    is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(unused(docs, "text")))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out, T.ArrayType(T.IntegerType()))
    return frame.mapInArrow(lambda batches: trimmed(_encoded(batches, path, out)), schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows with ``out`` (string): the text that the ids spell; null ids give null, none give an empty text.

    Ids that the vocabulary lacks raise an IndexError, null ids inside an array a ValueError.
    """
    kept = [c for c in tokens.columns if c.lower() != out.lower()]
    frame = tokens.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias(unused(tokens, "ids")))
    schema = tokens.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out, "string")
    return frame.mapInArrow(lambda batches: _decoded(batches, path, out, keep_ids=False), schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", out: str = "decoded", ids_col: str = "ids") -> DataFrame:
    """All rows with ``ids_col`` and ``out``: ``decode`` of what ``encode`` gives, both in one worker.  The text itself isn't kept.

    Columns named like the new ones are replaced, all others stay.
    """
    kept = [c for c in docs.columns if c.lower() not in (ids_col.lower(), out.lower(), text_col.lower())]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(unused(docs, "text")))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids_col, T.ArrayType(T.IntegerType())).add(out, "string")
    return frame.mapInArrow(lambda batches: trimmed(_decoded(_encoded(batches, path, ids_col), path, out, keep_ids=True)), schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Contract query: every whole text of documents to token ids and back.

    Null and empty texts have no tokens and decode to an empty text; null ids and repeated rows are as others.
    """
    path = path or default_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
