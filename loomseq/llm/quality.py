"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and the lines beside it; forward-backward marginals, weighted by the
lines' lengths, make the document's score.  Only documents have labels, so each line of a training document takes its document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import textvec as tv
from loomseq.llm.cluster import trimmed, unused

NEWLINE = np.arange(256) == 0x0A
#: Byte classes whose share of a line is a feature.
CLASSES = {
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)], "upper": [*range(65, 91)], "digit": [*range(48, 58)], "space": [0x20, 0x09],
    "stop": [*b".,;:?"], "shout": [*b"!"], "bar": [*b"|"], "symbol": [*b"#$%&*@^~_+=<>/\\[]{}`"], "quote": [*b"\"'()-"],
}
LUT = {k: np.isin(np.arange(256), v) for k, v in CLASSES.items()}
ODD = LUT["symbol"] | LUT["bar"] | LUT["shout"]
THRESHOLD = 0.7


def line_features(docs: tv.Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (float32) and lengths in bytes of all lines that aren't empty, and where each document's lines begin."""
    starts, ends, first = docs.words(NEWLINE)
    size = ends - starts
    if not len(starts):
        return np.zeros((0, len(CLASSES) * 2 + 9), np.float32), size, first
    shares = []
    for lut in LUT.values():
        total = np.concatenate(([0], np.cumsum(lut[docs.buf], dtype=np.int32)))
        shares.append((total[ends] - total[starts]) / size)
    ws, we, _ = docs.words()
    line = np.searchsorted(starts, ws, "right") - 1
    n = len(starts)
    words = np.bincount(line, minlength=n)
    h = tv.WORDS.bytes(docs.buf, ws, we)
    some = np.maximum(words, 1)
    same = np.zeros(len(ws), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    keys = np.sort((line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    odd_end = np.bincount(line, ODD[docs.buf[np.maximum(we, 1) - 1]], minlength=n)
    letters = np.bincount(line, we - ws, minlength=n)
    whole = tv.WORDS.bytes(docs.buf, starts, ends)
    repeat = np.zeros(n)
    repeat[1:] = whole[1:] == whole[:-1]
    repeat[first[:-1][first[:-1] < n]] = 0
    base = np.stack([*shares, np.log1p(size) / 8, np.log1p(words) / 6, letters / some / 10, np.bincount(line, same, minlength=n) / some, distinct / some, odd_end / some, LUT["upper"][docs.buf[starts]], LUT["stop"][docs.buf[ends - 1]], repeat], axis=1)
    return np.concatenate([base, np.sqrt(base[:, : len(CLASSES)])], axis=1).astype(np.float32), size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it (zero where there is none), and flags of such ends."""
    n, k = x.shape
    out = np.zeros((n, 3 * k + 3), np.float64)
    out[:, :k] = x
    starts, ends = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    if n:
        out[1:, k : 2 * k] = x[:-1]
        out[:-1, 2 * k : 3 * k] = x[1:]
        out[starts, k : 2 * k] = 0
        out[ends, 2 * k : 3 * k] = 0
        out[starts, 3 * k] = 1
        out[ends, 3 * k + 1] = 1
    out[:, 3 * k + 2] = 1
    return out


def marginals(logit: np.ndarray, first: np.ndarray, transition: np.ndarray, pairs: bool = False, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probability of "good" of each line (forward-backward) and, if asked for, the expected transitions, weighted by document."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    active = [int(np.searchsorted(-n[order], -t, "left")) for t in range(int(n.max(initial=0)) + 1)]  # documents with more than t lines
    start = first[:-1][order]
    m = np.exp(transition - transition.max())
    good = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    psi = np.stack([1 - good, good], axis=1) + 1e-300
    alpha, beta = psi.copy(), np.ones_like(psi)
    for t in range(len(active) - 1):
        at = start[: active[t]] + t
        if t:
            alpha[at] *= alpha[at - 1] @ m
        alpha[at] /= alpha[at].sum(axis=1, keepdims=True)
    for t in range(len(active) - 3, -1, -1):
        at = start[: active[t + 1]] + t
        beta[at] = (psi[at + 1] * beta[at + 1]) @ m.T
        beta[at] /= beta[at].sum(axis=1, keepdims=True)
    both = alpha * beta
    p = both[:, 1] / both.sum(axis=1)
    expected = np.zeros((2, 2))
    if pairs:
        inner = np.ones(len(logit), bool)
        inner[first[1:][n > 0] - 1] = False
        at = np.flatnonzero(inner)
        joint = alpha[at][:, :, None] * m * (psi[at + 1] * beta[at + 1])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        expected = (joint * weight[at][:, None, None]).sum(axis=0)
    return p, expected


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    #: the log-odds of a document's mean marginal that become THRESHOLD
    cut: float = 0.0
    #: what every document scores where labels of both kinds weren't given
    constant: float | None = None

    def document(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each document; a document without lines is as one empty line."""
        n = np.diff(first)
        p, _ = marginals(self.logits(x, first), first, self.transition)
        total = tv.per_segment(np.add, size.astype(np.float64), n, 0)
        good = tv.per_segment(np.add, p * size, n, 0)
        mean = good / np.maximum(total, 1)
        if (n == 0).any():
            empty, _ = marginals(self.logits(np.zeros((1, x.shape[1])), np.array([0, 1])), np.array([0, 1]), self.transition)
            mean[n == 0] = empty[0]
        mean = np.clip(mean, 1e-9, 1 - 1e-9)
        return np.log(mean / (1 - mean))

    def logits(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, first) @ self.weights

    def score(self, odds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(odds), self.constant)
        return 1 / (1 + np.exp(-(odds - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)))))


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 120, rate: float = 0.2, l2: float = 1e-3) -> Model:
    """Maximum conditional likelihood (each document with the same weight) by Adam, then the cut of greatest accuracy."""
    n = np.diff(first)
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 1.0
        return Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(3 * x.shape[1] + 3), np.zeros((2, 2)), 0.0, share)
    mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-3
    f = with_neighbours((x - mean) / scale, first)
    doc = tv.segments(n)
    y, weight = label[doc].astype(np.float64), 1 / np.maximum(n, 1)[doc] / len(n)
    inner = np.ones(len(y), bool)
    inner[first[1:][n > 0] - 1] = False
    seen = np.zeros((2, 2))
    for v in (0, 1):
        seen[v, v] = weight[inner & (y == v)].sum()
    w, t = np.zeros(f.shape[1]), np.zeros((2, 2))
    theta = np.zeros(len(w) + 4)
    first_moment, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        p, expected = marginals(f @ w, first, t, True, weight)
        grad = np.concatenate([f.T @ (weight * (y - p)), (seen - expected).ravel()]) - l2 * theta
        first_moment, second = 0.9 * first_moment + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta += rate * (1 - k / rounds) * (first_moment / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
        w, t = theta[: len(w)], theta[len(w) :].reshape(2, 2)
    model = Model(mean, scale, w, t)
    odds = model.document(x, size, first)
    order = np.argsort(odds, kind="stable")
    ordered, good = odds[order], label[order]
    # right[i]: documents that are right if those before i are rejected
    right = np.concatenate(([0], np.cumsum(good == 0))) + np.concatenate((np.cumsum((good == 1)[::-1])[::-1], [0]))
    best = np.flatnonzero(right == right.max())
    edges = np.concatenate(([ordered[0] - 2], ordered, [ordered[-1] + 2]))
    widths = edges[best + 1] - edges[best]
    at = best[int(widths.argmax())]
    model.cut = float((edges[at] + edges[at + 1]) / 2)
    return model


def stretches(n: int, most: int, piece: int = 32) -> list[tuple[int, int]]:
    """At most so many of n lines: all of them, or evenly spread stretches of ``piece`` lines."""
    if n <= most:
        return [(0, n)]
    count = max(1, most // piece)
    return [(i, i + min(piece, most)) for i in np.linspace(0, n - min(piece, most), count).astype(int).tolist()]


def _features(docs: DataFrame, extra: str, most: int) -> DataFrame:
    """(extra, lines, x, size): the features of every document's lines, packed, of ``most`` lines of each at most.  docs: text, extra."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, sizes, lines = [], [], []
            for d in tv.chunks(b.column(0)):
                x, size, first = line_features(d)
                for i, j in zip(first[:-1], first[1:], strict=True):
                    rows = np.concatenate([np.arange(a, b) for a, b in stretches(int(j - i), most)]) + i
                    xs.append(x[rows].tobytes())
                    sizes.append(size[rows].astype("<i4").tobytes())
                    lines.append(len(rows))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(lines, pa.int64()), pa.array(xs, pa.binary()), pa.array(sizes, pa.binary())], names=[extra, "lines", "x", "size"])

    return docs.select("text", extra).mapInArrow(run, f"{extra} int, lines long, x binary, size binary")


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4000, lines: int = 128, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from ``sample`` labelled documents at most, taken by a hash of their id, and ``lines`` lines of each at most.

    The two bound what the driver gets and works on: some 110 bytes a line.  Of longer documents evenly spread stretches of
    lines are learned from; scores are of whole texts.  ``labels`` has one 0 or 1 a document; null ids and labels are ignored,
    of repeated ids the largest label counts, and of rows that repeat a document's id the least text is learned from.  Without
    labels of both kinds every score is the share of label 1, or 1 without any.
    """
    taken = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    taken = taken.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken), "id")
    # one row an id before anything goes to the driver; repeats collapse before the shuffle
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")
    got = _features(rows, "label", lines).toArrow()
    n = got.column("lines").to_numpy()
    label = got.column("label").to_numpy()
    width = line_features(tv.Docs(np.empty(0, np.uint8), np.zeros(1, np.int64), 0))[0].shape[1]
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, width)
    size = np.frombuffer(b"".join(got.column("size").to_pylist()), "<i4")
    return fit(x, size, np.concatenate(([0], np.cumsum(n))).astype(np.int64), label)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All rows with score (0 to 1) and predicted (1 from THRESHOLD on); null and empty texts score as one empty line.

    ``out`` names the two; columns named like them are replaced, all others stay.
    """
    made = tuple(out)
    kept = [c for c in docs.columns if c.lower() not in {m.lower() for m in made}]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(unused(docs, "text")))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns({made[0]: F.lit(0.0), made[1]: F.lit(0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [np.empty(0)]
            for d in tv.chunks(b.column(len(kept))):
                out.append(m.score(m.document(*line_features(d))))
            s = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*kept, *made])

    return frame.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the remainder is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from labels of three quarters of the ids, scores all documents.

    Null and empty texts score as one empty line; a null id has no label and isn't held out; repeated rows are scored each.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return score(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
