"""Language-model scores of whole documents: word counts of all training text, and a recurrent model trained on all of it.

Words are known by 59 bits of a hash, whose low 5 bits are the word's class; all counts are kept in buckets of the hash and never
meet in one place.  What is frequent comes to the driver and the workers: words of at least ``HELD_SHARE`` of all tokens with
their counts, and of these the words of at least ``MODEL_SHARE`` as the model's own symbols, so both are bounded whatever the
corpus.  Other words go by their class in the model and get their count from their bucket.

The recurrent model trains on every training document once, in rounds over disjoint parts: in each, copies of the model train on
the documents that a hash deals them, in the order of another, and the copies' mean, weighted by tokens, is the model.  How many
copies there are follows from the number of tokens alone (``TOKENS_A_COPY``), so the model doesn't depend on partitions or tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import rnn
from loomseq.llm import textvec as tv
from loomseq.llm.cluster import exchange, packed, partitions, trimmed, unpack, written

HELD_SHARE, MODEL_SHARE = 1e-6, 1e-4
CLASS_BITS = 5
OTHERS = 1 << CLASS_BITS
#: The end of a document as a word (no hash of a word has class bits alone).
END = np.uint64(0)
#: Training tokens of one copy over all rounds; copies at most, beyond which each gets more tokens.
TOKENS_A_COPY, MOST_COPIES = 1 << 20, 4096
#: Each round's share of the documents: short ones first, so that copies part from a common start.
ROUNDS = (0.04, 0.16, 0.3, 0.5)
#: Tokens that a copy takes at a time, and cuts into streams.
BLOCK_TOKENS = 150_000
LN10 = np.log(10)


def tokens(docs: tv.Docs) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of each document in lower case (A-Z), its end last, and where each document's begin."""
    buf = tv.LOWER[docs.buf]
    starts, ends, first = tv.Docs(buf, docs.off, 0).words()
    key = np.empty(0, np.uint64)
    if len(starts):
        h = tv.WORDS.bytes(buf, starts, ends)
        # the class: by the last byte, and whether the first is of another script than ASCII
        cls = (buf[ends - 1] & 15).astype(np.uint64) | ((buf[starts] >> 7).astype(np.uint64) << np.uint64(4))
        key = np.maximum(h & ~np.uint64(OTHERS - 1), np.uint64(OTHERS)) | cls
    out = np.full(len(key) + len(docs), END, np.uint64)
    word = np.ones(len(out), bool)
    begin = first + np.arange(len(first))
    word[begin[1:] - 1] = False
    out[word] = key
    return out, begin


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return (tv.mix(key) % np.uint64(n)).astype(np.int64)


def count(docs: DataFrame) -> DataFrame:
    """The counts of all tokens of docs (text), as packed buckets: (bucket, k, c), written."""
    n = partitions(docs.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [tokens(d)[0] for d in tv.chunks(b.column(0))]
            if keys:
                key, c = np.unique(np.concatenate(keys), return_counts=True)
                yield packed({"k": key, "c": c.astype(np.int64)}, bucket_of(key, n), n)

    def total(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, at = np.unique(x["k"], return_inverse=True)
        c = np.bincount(at, x["c"]).astype(np.int64)
        yield packed({"k": key, "c": c}, bucket_of(key, n), n)

    rows = docs.mapInArrow(local, "bucket int, k binary, c binary")
    return written(exchange(rows, n, total, {"k": "<u8", "c": "<i8"}, "bucket int, k binary, c binary"), "lm-counts")


@dataclass
class Corpus:
    """Counts of frequent tokens, and totals over all: tokens, types, and for each class of other words the sum of count + 1 and an unseen word."""

    keys: np.ndarray
    counts: np.ndarray
    total: int
    types: int
    others: np.ndarray
    shape: rnn.Shape
    symbol_keys: np.ndarray  # sorted
    symbol_ids: np.ndarray

    def of(self, key: np.ndarray) -> np.ndarray:
        """Counts of held tokens, -1 for others."""
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == key, self.counts[at], -1) if len(self.keys) else np.full(len(key), -1)

    def symbols(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.symbol_keys, key), len(self.symbol_keys) - 1)
        other = self.shape.words + (key & np.uint64(OTHERS - 1)).astype(np.int64)
        return np.where(self.symbol_keys[at] == key, self.symbol_ids[at], other).astype(np.int32)


def corpus(counts: DataFrame) -> tuple[Corpus, np.ndarray]:
    """What the driver holds of the counts, and the frequency of the model's symbols."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = unpack(b, "c", "<i8")
            yield pa.RecordBatch.from_pydict({"total": [int(c.sum())], "types": [len(c)]})

    total, types = counts.mapInArrow(sums, "total long, types long").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    held, own = max(1, int(np.ceil(HELD_SHARE * total))), max(1, int(np.ceil(MODEL_SHARE * total)))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, c = unpack(b, "k", "<u8"), unpack(b, "c", "<i8")
            cls = (k & np.uint64(OTHERS - 1)).astype(np.int64)
            rare = (c < own) & (k != END)
            mass = np.bincount(cls[rare], c[rare] + 1, minlength=OTHERS)
            tokens = np.bincount(cls[rare], c[rare], minlength=OTHERS)
            keep = (c >= held) | (k == END)
            yield pa.RecordBatch.from_pydict({"k": pa.array([k[keep].tobytes()], pa.binary()), "c": pa.array([c[keep].tobytes()], pa.binary()), "mass": pa.array([mass.astype("<f8").tobytes()], pa.binary()), "tokens": pa.array([tokens.astype("<f8").tobytes()], pa.binary())})

    got = counts.mapInArrow(frequent, "k binary, c binary, mass binary, tokens binary").toArrow()
    key = np.frombuffer(b"".join(got.column("k").to_pylist()), "<u8")
    c = np.frombuffer(b"".join(got.column("c").to_pylist()), "<i8")
    sum_of = lambda name: np.frombuffer(b"".join(got.column(name).to_pylist()), "<f8").reshape(-1, OTHERS).sum(axis=0)
    order = np.argsort(key)
    key, c = key[order], c[order]
    model = np.flatnonzero((c >= own) | (key == END))
    ranked = model[np.lexsort((key[model], -c[model]))]
    words, count = key[ranked], c[ranked].astype(np.float64)
    if not len(words):
        words, count = np.array([END]), np.zeros(1)
    # classes of about equal frequency, some fewer than the root of their number of words, as each costs a product of its own
    share = np.cumsum(count + 0.5) / (count + 0.5).sum()
    classes = max(1, int(0.6 * np.sqrt(len(words))))
    first = np.unique(np.concatenate(([0], np.searchsorted(share, np.arange(1, classes) / classes), [len(words)])))
    shape = rnn.Shape(len(words), OTHERS, int(np.flatnonzero(words == END)[0]), first)
    by_key = np.argsort(words)
    return Corpus(key, c, int(total), int(types), sum_of("mass") + 1, shape, words[by_key], by_key), np.concatenate([count, sum_of("tokens")])


def copies_of(total: int) -> int:
    """The number of copies that train side by side on so many tokens."""
    return int(min(MOST_COPIES, max(1, round(total / TOKENS_A_COPY))))


def train(docs: DataFrame, corp: Corpus, frequency: np.ndarray, size: int = 16) -> dict[str, np.ndarray]:
    """The model's parameters from all of docs (id, text); the same however docs are partitioned.

    Rows that repeat an id go to the same copy.
    """
    spark = docs.sparkSession
    params = rnn.start(corp.shape, frequency, size)
    names, shapes = list(params), {k: v.shape for k, v in params.items()}
    pieces, n, copies = 1 << 12, partitions(spark), copies_of(corp.total)
    shared_corpus = spark.sparkContext.broadcast(corp)
    place = F.pmod(F.xxhash64(F.lit("round"), "id", F.length("text")), F.lit(100))
    edges = np.round(np.cumsum((0, *ROUNDS)) * 100).astype(int).tolist()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corp = shared_corpus.value
        for b in batches:
            order = b.column(0).to_numpy()
            for d in tv.chunks(b.column(1)):
                key, first = tokens(d)
                raw = pa.py_buffer(corp.symbols(key).astype("<u2").tobytes())
                own = order[d.first : d.first + len(d)]
                symbols = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(d), [None, pa.py_buffer((first * 2).astype(np.int64)), raw]).cast(pa.binary())
                yield pa.RecordBatch.from_pydict({"bucket": pa.array((own % copies).astype(np.int32)), "order": own // copies, "symbols": symbols})

    for low, high in zip(edges[:-1], edges[1:], strict=True):
        shared = spark.sparkContext.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            corp = shared_corpus.value
            now, trainer, held, count = None, None, [], 0

            def learn() -> None:
                nonlocal held, count
                if held:
                    trainer.learn(np.concatenate(held).astype(np.int32))
                held, count = [], 0

            def done() -> pa.RecordBatch:
                # in pieces, each with its weight in front, so that no task adds up all of the model
                flat = np.concatenate([trainer.p[k].ravel() for k in names]).astype("<f4")
                cut = [flat[i : i + pieces] for i in range(0, len(flat), pieces)]
                ids = np.arange(len(cut))
                return pa.RecordBatch.from_pydict({"bucket": pa.array((ids % n).astype(np.int32)), "piece": pa.array(ids.astype(np.int32)), "seen": pa.array([trainer.seen] * len(cut), pa.int64()), "v": pa.array([x.tobytes() for x in cut], pa.binary())})

            for b in batches:
                for copy, raw in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                    if copy != now:
                        if trainer is not None:
                            learn()
                            yield done()
                        now, trainer = copy, rnn.Trainer(shared.value, corp.shape)
                    held.append(np.frombuffer(raw.as_buffer(), "<u2"))
                    count += len(held[-1])
                    if count >= BLOCK_TOKENS:
                        learn()
            if trainer is not None:
                learn()
                yield done()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for piece, seen, v in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    x = np.frombuffer(v, "<f4").astype(np.float64) * seen
                    if piece in sums:
                        sums[piece][0] += seen
                        sums[piece][1] += x
                    else:
                        sums[piece] = [seen, x]
            for piece, (seen, x) in sums.items():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "v": pa.array([(x / seen).tobytes()], pa.binary())})

        part = docs.where((place >= low) & (place < high)).select(F.pmod(F.xxhash64(F.lit("order"), F.coalesce("id", F.xxhash64("text"))), F.lit(1 << 62)).alias("order"), "text")
        dealt = part.mapInArrow(deal, "bucket int, order long, symbols binary").repartitionById(copies, F.col("bucket")).sortWithinPartitions("bucket", "order", "symbols")
        trained = dealt.mapInArrow(lambda batches, run=run: trimmed(run(batches)), "bucket int, piece int, seen long, v binary")
        got = trained.repartitionById(n, F.col("bucket")).mapInArrow(add, "piece int, v binary").orderBy("piece").toArrow()
        if got.num_rows:
            flat, at = np.frombuffer(b"".join(got.column("v").to_pylist()), "<f8"), 0
            params = {}
            for k in names:
                size_k = int(np.prod(shapes[k]))
                params[k] = flat[at : at + size_k].reshape(shapes[k]).astype(np.float32)
                at += size_k
    return params


def score(docs: DataFrame, counts: DataFrame, corp: Corpus, params: dict[str, np.ndarray]) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (id, text), in log10.

    Null and empty texts are an end alone.  Repeated rows and null ids are scored each on its own.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    shared = spark.sparkContext.broadcast((corp, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corp, params = shared.value
        row = TaskContext.get().partitionId() << 36
        log_others = np.log10(corp.others)
        for b in batches:
            parts = []
            for d in tv.chunks(b.column(1)):
                key, first = tokens(d)
                unique, at = np.unique(key, return_inverse=True)
                c, symbol = corp.of(unique)[at], corp.symbols(unique)[at]
                parts.append((key, first, c, symbol))
            if not parts:
                continue
            key, c, symbol = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
            size = np.concatenate([np.diff(p[1]) for p in parts])
            first = np.concatenate(([0], np.cumsum(size)))
            doc = tv.segments(size)
            other = symbol >= corp.shape.words
            held = c >= 0
            log_c = np.log10(np.maximum(c, 0) + 1.0)
            add = lambda x, keep: np.bincount(doc[keep], x[keep], minlength=len(size))
            base = add(log_c, held) - size * np.log10(corp.total + corp.types + 1)
            model = rnn.score(params, corp.shape, symbol, first) / LN10 + add(log_c, held & other)
            model -= np.bincount(doc[other], log_others[symbol[other] - corp.shape.words], minlength=len(size))
            known = np.bincount(doc[c > 0], minlength=len(size))
            lost = np.flatnonzero(~held)
            cut = np.searchsorted(lost, first)
            asked = key[lost].astype("<u8")
            off = pa.py_buffer((cut * 8).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(size))), b.column(0), pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model), pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, off, pa.py_buffer(asked.tobytes())])],
                names=["row", "id", "n_tokens", "known", "base", "model", "asked"],
            )
            row += len(size)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = unpack(b, "asked", "<u8")
            size = np.array([len(x) // 8 for x in b.column(1).to_pylist()], np.int64)
            row = np.repeat(np.arange(len(b)), size)
            # a word that a row repeats is asked for once
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.empty(0, np.int64)
            times = np.diff(np.append(at, len(key)))
            key, row = key[at], np.asarray(b.column(0))[row[at]]
            batch = packed({"k": key, "v": row, "m": times.astype(np.int64)}, bucket_of(key, n), n)
            yield batch.append_column("kind", pa.array(np.zeros(len(batch), np.int32)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rows, times, keys, counts = [], [], [], [], []
        for b in batches:
            kind = np.asarray(b.column(4))
            for part, lists in ((b.filter(pa.array(kind == 0)), {"k": asked, "v": rows, "m": times}), (b.filter(pa.array(kind == 1)), {"k": keys, "v": counts})):
                for name, found in lists.items():
                    found.append(unpack(part, name, "<u8" if name == "k" else "<i8").copy())
        asked, rows, times, keys, counts = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (asked, rows, times, keys, counts))
        if not len(asked):
            return
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        c = np.zeros(len(asked), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            c = np.where(keys[at] == asked, counts[at], 0)
        row, at = np.unique(rows, return_inverse=True)
        known, log_c = np.bincount(at, times * (c > 0)), np.bincount(at, times * np.log10(c + 1.0))
        to = (tv.mix(row.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
        yield packed({"k": row.astype("<i8"), "known": known.astype("<i8"), "log": log_c.astype("<f8")}, to, n)

    def by_row(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        row, at = np.unique(x["k"], return_inverse=True)
        yield pa.RecordBatch.from_pydict({"row": row, "more_known": np.bincount(at, x["known"]).astype(np.int64), "more": np.bincount(at, x["log"])})

    scored = written(docs.select("id", "text").mapInArrow(run, "row long, id long, n_tokens long, known long, base double, model double, asked binary"), "lm-scored")
    queries = scored.select("row", "asked").mapInArrow(ask, "bucket int, k binary, v binary, m binary, kind int")
    tables = counts.select("bucket", "k", F.col("c").alias("v"), F.lit(b"").alias("m"), F.lit(1).alias("kind"))
    answers = queries.union(tables).repartitionById(n, F.col("bucket")).mapInArrow(answer, "bucket int, k binary, known binary, log binary")
    more = exchange(answers, n, by_row, {"k": "<i8", "known": "<i8", "log": "<f8"}, "row long, more_known long, more double")
    both = scored.drop("asked").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return both.select("id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(corp.total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the remainder is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from six sevenths of documents, scores all.

    Null texts count as empty: one token, the end.  Rows with a null id train and aren't held out.  Repeated rows train and are
    scored each on its own.  Without training rows every count is 0 and the model is as it starts.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    training = docs.where(~held_out("id"))
    counts = count(training.select("text"))
    corp, frequency = corpus(counts)
    params = train(training, corp, frequency)
    return score(docs, counts, corp, params).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
