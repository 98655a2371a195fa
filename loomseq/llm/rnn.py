"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried along a document.

Symbols are the frequent words (with the document's end), by falling frequency, then one symbol for each class of other words.
The output is factored: a class given the state, then a word given class and state; a class of other words has a fixed
distribution over its words, which the caller adds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32
#: Steps of backpropagation; streams that train side by side; documents that are scored side by side.
WINDOW, STREAMS, TOGETHER = 24, 256, 2048


@dataclass
class Shape:
    words: int  # frequent words, the end among them
    others: int  # classes of other words
    end: int  # the end's symbol
    first: np.ndarray  # where each class of frequent words begins, and their number

    @property
    def symbols(self) -> int:
        return self.words + self.others

    @property
    def classes(self) -> int:
        return len(self.first) - 1 + self.others

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol < self.words, np.searchsorted(self.first, symbol, "right") - 1, symbol - self.words + len(self.first) - 1)


def start(shape: Shape, count: np.ndarray, size: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters whose output, before any training, is the symbols' frequency; count: of each symbol."""
    rng = np.random.default_rng(seed)
    log = np.log(count + 0.5)
    within, total = np.zeros(shape.words), np.zeros(shape.classes)
    for g, (a, b) in enumerate(zip(shape.first[:-1], shape.first[1:], strict=True)):
        total[g] = (count[a:b] + 0.5).sum()
        within[a:b] = log[a:b] - np.log(total[g])
    total[len(shape.first) - 1 :] = count[shape.words :] + 0.5
    small = lambda *s: rng.normal(0, 0.3 / np.sqrt(size), s).astype(F32)
    return {
        "e": rng.normal(0, 0.3, (shape.symbols, size)).astype(F32), "x": small(size, 3 * size), "b": np.zeros(3 * size, F32), "u": small(size, 3 * size),
        "c": np.zeros((size, shape.classes), F32), "cb": (np.log(total) - np.log(total.sum())).astype(F32),
        "w": np.zeros((shape.words, size), F32), "wb": within.astype(F32),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def cell(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: the new state, and what its gradient needs.  x: the input's share of the gates."""
    n = h.shape[1]
    a = h @ u
    gates = sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
    z, r = gates[:, :n], gates[:, n:]
    m = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
    return m + z * (h - m), z, r, m, a[:, 2 * n :]


def output(p: dict[str, np.ndarray], shape: Shape, h: np.ndarray, target: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probabilities (natural) of the targets' symbols given states; with ``grad`` also adds gradients of the mean loss and gives the states'."""
    n = len(target)
    cls = shape.class_of(target)
    # a column a state, so that maxima and sums run along rows
    logit = p["c"].T @ h.T
    logit += p["cb"][:, None]
    logit -= logit.max(axis=0)
    columns = np.arange(n)
    hit = logit[cls, columns]
    np.exp(logit, out=logit)
    total = logit.sum(axis=0)
    out = (hit - np.log(total)).astype(np.float64)
    dh = None
    if grad is not None:
        logit /= total * F32(n)
        logit[cls, columns] -= F32(1 / n)
        grad["c"] += (logit @ h).T
        grad["cb"] += logit.sum(axis=1)
        dh = (p["c"] @ logit).T
    order = np.argsort(cls.astype(np.uint16) if shape.classes < 1 << 16 else cls, kind="stable")
    at = np.searchsorted(cls[order], np.arange(len(shape.first)))
    for g in np.flatnonzero((np.diff(at) > 0) & (np.diff(shape.first) > 1)):
        rows, a, b = order[at[g] : at[g + 1]], shape.first[g], shape.first[g + 1]
        own, w = h[rows], p["w"][a:b]
        logit = w @ own.T
        logit += p["wb"][a:b, None]
        logit -= logit.max(axis=0)
        place, columns = target[rows] - a, np.arange(len(rows))
        hit = logit[place, columns]
        np.exp(logit, out=logit)
        total = logit.sum(axis=0)
        out[rows] += hit - np.log(total)
        if grad is not None:
            logit /= total * F32(n)
            logit[place, columns] -= F32(1 / n)
            grad["w"][a:b] += logit @ own
            grad["wb"][a:b] += logit.sum(axis=1)
            dh[rows] += logit.T @ w
    return out, dh


class Trainer:
    """Adagrad over windows of parallel streams; the state is carried from window to window and starts anew with a document."""

    def __init__(self, params: dict[str, np.ndarray], shape: Shape, rate: float = 0.15):
        self.p = {k: v.copy() for k, v in params.items()}
        self.shape, self.rate = shape, rate
        self.square = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        self.seen = 0

    def learn(self, symbols: np.ndarray) -> None:
        """Trains on documents that follow each other, each closed by the end's symbol."""
        n = len(symbols)
        streams = int(min(STREAMS, max(1, n // WINDOW)))
        length = -(-n // streams)
        # the last stream is filled up with ends, which count as empty documents
        filled = np.full(streams * length, self.shape.end, symbols.dtype)
        filled[:n] = symbols
        target = filled.reshape(streams, length)
        before = np.concatenate([np.full((streams, 1), self.shape.end, symbols.dtype), target[:, :-1]], axis=1)
        h = np.zeros((streams, self.p["u"].shape[0]), F32)
        for t in range(0, length, WINDOW):
            h = self.window(before[:, t : t + WINDOW], target[:, t : t + WINDOW], h)
        self.seen += n

    def window(self, before: np.ndarray, target: np.ndarray, h: np.ndarray) -> np.ndarray:
        p, shape, size = self.p, self.shape, h.shape[1]
        streams, steps = target.shape
        gates = p["e"] @ p["x"] + p["b"]
        x = gates[before.T]  # steps, streams, gates
        go_on = (before != shape.end).T[:, :, None].astype(F32)
        states, lasts = np.empty((steps, streams, size), F32), np.empty((steps, streams, size), F32)
        z, r, m, a = (np.empty((steps, streams, size), F32) for _ in range(4))
        for t in range(steps):
            lasts[t] = h * go_on[t]
            h, z[t], r[t], m[t], a[t] = cell(x[t], lasts[t], p["u"])
            states[t] = h
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        _, dh = output(p, shape, states.reshape(-1, size), target.T.ravel(), grad)
        dh = dh.reshape(steps, streams, size)
        # what a state's gradient is multiplied by for each gate
        by_m, by_z = (1 - z) * (1 - m * m), (lasts - m) * z * (1 - z)
        by_r, z = a * r * (1 - r), z * go_on
        dx, da, back = np.empty((steps, streams, 3 * size), F32), np.empty((steps, streams, 3 * size), F32), np.zeros((streams, size), F32)
        turned = np.ascontiguousarray(p["u"].T)
        for t in range(steps - 1, -1, -1):
            d = dh[t] + back
            step = da[t]
            dm = d * by_m[t]
            np.multiply(d, by_z[t], out=step[:, :size])
            np.multiply(dm, by_r[t], out=step[:, size : 2 * size])
            np.multiply(dm, r[t], out=step[:, 2 * size :])
            dx[t, :, 2 * size :] = dm
            back = step @ turned
            back *= go_on[t]
            back += d * z[t]
        dx[:, :, : 2 * size] = da[:, :, : 2 * size]
        grad["u"] = lasts.reshape(-1, size).T @ da.reshape(-1, 3 * size)
        flat, symbol = dx.reshape(-1, 3 * size), before.T.ravel()
        grad["b"] = flat.sum(axis=0)
        grad["x"] = p["e"][symbol].T @ flat
        of_input = (flat @ p["x"].T).T
        grad["e"] = np.stack([np.bincount(symbol, row, shape.symbols) for row in of_input], axis=1).astype(p["e"].dtype)
        for k, g in grad.items():
            np.clip(g, -0.1, 0.1, out=g)
            self.square[k] += g * g
            p[k] -= self.rate * g / np.sqrt(self.square[k])
        return h


def score(params: dict[str, np.ndarray], shape: Shape, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each document's sum of log-probabilities (natural) of its symbols, the state carried from its start to its end.

    Document i is symbols[first[i]:first[i + 1]].  Documents of like length are scored side by side, window by window.
    """
    n = np.diff(first)
    out = np.zeros(len(n))
    order = np.argsort(-n, kind="stable")
    gates = params["e"] @ params["x"] + params["b"]
    size = params["u"].shape[0]
    for i in range(0, len(order), TOGETHER):
        docs = order[i : i + TOGETHER]
        docs = docs[n[docs] > 0]
        if not len(docs):
            continue
        length = n[docs]
        h = np.zeros((len(docs), size), F32)
        before = np.full(len(docs), shape.end, symbols.dtype)
        for t in range(0, int(length[0]), WINDOW):
            states, targets, owners = [], [], []
            for s in range(t, min(t + WINDOW, int(length[0]))):
                active = int(np.searchsorted(-length, -s, "left"))  # longer than s: the first ones, by falling length
                if active < len(h):
                    h, before = h[:active], before[:active]
                h = cell(gates[before], h, params["u"])[0]
                before = symbols[first[docs[:active]] + s]
                states.append(h)
                targets.append(before)
                owners.append(docs[:active])
            got, _ = output(params, shape, np.concatenate(states), np.concatenate(targets))
            out += np.bincount(np.concatenate(owners), got, minlength=len(n))
    return out
