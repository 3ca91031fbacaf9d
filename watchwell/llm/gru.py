"""A gated recurrent language model with a class-factored output, in numpy.

Symbols are the ``n_words`` most frequent tokens, then one symbol per band of
rarer tokens. A step reads a symbol and gives log P(class of the next token) and,
for words, log P(word | class); a band is a class without words of its own.
Training is backpropagation truncated at the end of each window, with the state
carried into the next window.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(x: np.ndarray, at: np.ndarray, shares: bool = True) -> np.ndarray:
    """The log share of row at[i] in column i; x becomes the shares of each column, if they are wanted."""
    x -= x.max(axis=0)
    picked = x[at, np.arange(x.shape[1])]
    np.exp(x, out=x)
    sums = x.sum(axis=0)
    if shares:
        x /= sums
    return picked - np.log(sums)


@dataclass
class Shape:
    """Sizes, and the class of every symbol.

    class_of: by symbol; words come first and in class order, so that class k
    holds the words first[k] .. first[k + 1] - 1.
    """

    n_words: int
    class_of: np.ndarray
    first: np.ndarray
    hidden: int = 16

    @property
    def symbols(self) -> int:
        return len(self.class_of)

    @property
    def word_classes(self) -> int:
        return len(self.first) - 1

    @property
    def classes(self) -> int:
        return self.word_classes + self.symbols - self.n_words

    @classmethod
    def of(cls, weights: np.ndarray, n_words: int, word_classes: int, hidden: int = 16) -> Shape:
        """Words, by falling weight, in classes of about equal weight; then one class per band."""
        share = np.cumsum(weights[:n_words]) - weights[:n_words] / 2
        raw = np.minimum((share / max(weights[:n_words].sum(), 1e-9) * word_classes).astype(int), word_classes - 1)
        _, dense = np.unique(raw, return_inverse=True)
        first = np.searchsorted(dense, np.arange(int(dense.max(initial=-1)) + 2))
        bands = np.arange(len(weights) - n_words) + len(first) - 1
        return cls(n_words, np.concatenate([dense, bands]).astype(np.int64), first.astype(np.int64), hidden)


class Model:
    """Parameters by name; all float32 unless told otherwise."""

    NAMES = ("inputs", "recur", "out", "out_bias", "word", "word_bias")

    def __init__(self, shape: Shape, weights: np.ndarray, seed: int = 7, kind: type = np.float32):
        """weights: of every symbol; the biases begin at their shares."""
        rng, h = np.random.default_rng(seed), shape.hidden
        self.shape = shape
        self.inputs = rng.normal(0, 0.3, (shape.symbols, 3 * h)).astype(kind)
        self.recur = (rng.normal(0, 1, (h, 3 * h)) / np.sqrt(h)).astype(kind)
        self.out = np.zeros((h, shape.classes), dtype=kind)
        shares = np.bincount(shape.class_of, weights=weights, minlength=shape.classes) + 1e-3
        self.out_bias = np.log(shares / shares.sum()).astype(kind)
        self.word = np.zeros((h, shape.n_words), dtype=kind)
        self.word_bias = np.log(weights[: shape.n_words] + 1e-3).astype(kind)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(old.dtype))
            at += old.size
        return self

    def gates(self) -> list[np.ndarray]:
        """Input and recurrent weights of the update, the reset and the candidate, each an array of its own."""
        h = self.shape.hidden
        return [np.ascontiguousarray(x[:, k * h : (k + 1) * h]) for x in (self.inputs, self.recur) for k in range(3)]

    def step(self, symbols: np.ndarray, state: np.ndarray, gates: list[np.ndarray] | None = None) -> tuple[np.ndarray, tuple]:
        in_z, in_r, in_c, z_of, r_of, c_of = gates or self.gates()
        z, r, u = state @ z_of, state @ r_of, state @ c_of
        z += in_z.take(symbols, axis=0)
        r += in_r.take(symbols, axis=0)
        _sigmoid(z)
        c = u * _sigmoid(r)
        c += in_c.take(symbols, axis=0)
        np.tanh(c, out=c)
        new = state - c
        new *= z
        new += c
        return new, (symbols, state, z, r, c, u)

    def scores(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target symbol after its state."""
        kinds = self.shape.class_of[targets]
        logp = _softmax(self.out.T @ states.T + self.out_bias[:, None], kinds, shares=False)
        for k, rows in self._by_class(kinds):
            a, b = self.shape.first[k], self.shape.first[k + 1]
            if b - a > 1:
                logp[rows] += _softmax(self.word[:, a:b].T @ states[rows].T + self.word_bias[a:b, None], targets[rows] - a, shares=False)
        return logp

    def _by_class(self, kinds: np.ndarray):
        order = np.argsort(kinds.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(kinds[order], np.arange(self.shape.word_classes + 1))
        for k in range(self.shape.word_classes):
            if cuts[k] < cuts[k + 1]:
                yield k, order[cuts[k] : cuts[k + 1]]

    def _outputs(self, flat: np.ndarray, goal: np.ndarray, grads: dict[str, np.ndarray]) -> tuple[float, np.ndarray]:
        """Loss of all tokens and its gradient by the states; gradients of the output layers go to grads."""
        n = max(len(goal), 1)
        kinds, at = self.shape.class_of[goal], np.arange(len(goal))
        d = self.out.T @ flat.T + self.out_bias[:, None]
        logp = _softmax(d, kinds)
        loss = -float(logp.sum())
        d[kinds, at] -= 1
        d /= n
        grads["out"], grads["out_bias"] = (d @ flat).T, d.sum(axis=1)
        d_flat = d.T @ self.out.T
        for k, some in self._by_class(kinds):
            a, b = self.shape.first[k], self.shape.first[k + 1]
            if b - a > 1:
                states, own = flat[some], goal[some] - a
                d = self.word[:, a:b].T @ states.T + self.word_bias[a:b, None]
                logp = _softmax(d, own)
                loss -= float(logp.sum())
                d[own, np.arange(len(some))] -= 1
                d /= n
                grads["word"][:, a:b] = (d @ states).T
                grads["word_bias"][a:b] = d.sum(axis=1)
                d_flat[some] += d.T @ self.word[:, a:b].T
        return loss, d_flat

    def window(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, state: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss per token, gradients and last state of one window (steps x rows).

        mask: of each row, true up to its end. Rows are taken by falling length, so
        that those which go on are always the first ones.
        """
        h, rows = self.shape.hidden, inputs.shape[1]
        order = np.argsort(-mask.sum(axis=0), kind="stable")
        live = [n for n in mask.sum(axis=1).tolist() if n]
        inputs, targets, last = inputs[:, order], targets[:, order], state[order]
        ends, before, kept, gates = last.copy(), last, [], self.gates()
        for t, n in enumerate(live):
            new, memory = self.step(inputs[t, :n], before[:n], gates)
            ends[:n] = new
            kept.append((memory, new))
            before = new
        after = np.empty((rows, h), dtype=state.dtype)
        after[order] = ends
        grads = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        if not live:
            return 0.0, grads, after
        goal = np.concatenate([targets[t, :n] for t, n in enumerate(live)])
        loss, d_flat = self._outputs(np.concatenate([new for _, new in kept]), goal, grads)
        d_z, d_r, d_c, d_u = (np.empty((len(goal), h), dtype=d_flat.dtype) for _ in range(4))
        carry, stop = np.zeros((0, h), dtype=d_flat.dtype), len(goal)
        z_back, r_back, c_back = (np.ascontiguousarray(x.T) for x in gates[3:])
        for (_, before, z, r, c, u), _ in reversed(kept):
            at = slice(stop - len(z), stop)
            stop = at.start
            d_new, own = d_flat[at], d_c[at]
            d_new[: len(carry)] += carry
            carry = d_new * z
            np.subtract(d_new, carry, out=own)
            own *= 1 - c * c
            np.multiply(own, r, out=d_u[at])
            np.multiply(d_u[at] * u, 1 - r, out=d_r[at])
            np.multiply(carry * (1 - z), before - c, out=d_z[at])
            carry += d_z[at] @ z_back
            carry += d_r[at] @ r_back
            carry += d_u[at] @ c_back
        befores = np.concatenate([memory[1] for memory, _ in kept]).T
        grads["recur"] = np.concatenate([befores @ d_z, befores @ d_r, befores @ d_u], axis=1)
        d_inputs = np.concatenate([d_z, d_r, d_c], axis=1)
        read = np.concatenate([memory[0] for memory, _ in kept])
        by_symbol = np.argsort(read.astype(np.uint16), kind="stable")
        symbols, first = np.unique(read[by_symbol], return_index=True)
        grads["inputs"][symbols] = np.add.reduceat(d_inputs[by_symbol], first, axis=0)
        return loss / len(goal), grads, after


class Adam:
    def __init__(self, model: Model, rate: float = 0.01):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {n: np.zeros_like(getattr(model, n)) for n in Model.NAMES}
        self.v = {n: np.zeros_like(getattr(model, n)) for n in Model.NAMES}

    def apply(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        for n, g in grads.items():
            g = g * clip
            self.m[n] += 0.1 * (g - self.m[n])
            self.v[n] += 0.01 * (g * g - self.v[n])
            move = (self.m[n] / (1 - 0.9**self.t)) / (np.sqrt(self.v[n] / (1 - 0.99**self.t)) + 1e-7)
            setattr(self.model, n, getattr(self.model, n) - (self.rate * move).astype(g.dtype))


def padded(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and mask (steps x rows) of symbol sequences; the input before the first is the end symbol."""
    steps = max((len(x) for x in texts), default=0)
    targets = np.full((steps, len(texts)), end, dtype=np.int64)
    mask = np.zeros((steps, len(texts)), dtype=bool)
    for i, x in enumerate(texts):
        targets[: len(x), i] = x
        mask[: len(x), i] = True
    inputs = np.vstack([np.full((1, len(texts)), end, dtype=np.int64), targets[:-1]]) if steps else targets
    return inputs, targets, mask


def train(model: Model, texts: Iterable[np.ndarray], end: int, rows: int = 256, window: int = 32, rate: float = 0.01, batch: int = 2048) -> int:
    """One pass over all symbols of the sequences, by truncated backpropagation; the number of symbols.

    Up to ``rows`` sequences run side by side. Each carries its state from window to
    window up to its end; then the next sequence takes its place. Windows are gathered
    to ``batch`` symbols or more before the parameters move, so that the last sequences,
    which run with few beside them, weigh no more than others.
    """
    adam, coming, total = Adam(model, rate), iter(texts), 0
    zero = np.zeros(model.shape.hidden, dtype=model.recur.dtype)
    open_: list[tuple[np.ndarray, int]] = []  # sequences and where each goes on
    state = np.zeros((0, model.shape.hidden), dtype=model.recur.dtype)
    held, size = {}, 0  # gradients that wait, summed, and the symbols behind them
    while True:
        new = [(x, 0) for x in islice((x for x in coming if len(x)), rows - len(open_))]
        open_ += new
        if not open_:
            if size:
                adam.rate *= min(1.0, size / batch)
                adam.apply({n: g / size for n, g in held.items()})
            return total
        state = np.concatenate([state, np.tile(zero, (len(new), 1))])
        inputs, targets, mask = padded([x[t : t + window] for x, t in open_], end)
        inputs[0] = [x[t - 1] if t else end for x, t in open_]
        _, grads, state = model.window(inputs, targets, mask, state)
        n = int(mask.sum())
        total += n
        if size or n < batch:
            size, held = size + n, {k: g * n + held[k] if size else g * n for k, g in grads.items()}
            if size >= batch:
                adam.apply({k: g / size for k, g in held.items()})
                held, size = {}, 0
        else:
            adam.apply(grads)
        going = [i for i, (x, t) in enumerate(open_) if t + window < len(x)]
        open_ = [(open_[i][0], open_[i][1] + window) for i in going]
        state = state[going]


def log_likelihood(model: Model, texts: list[np.ndarray], end: int, rows: int = 1024, window: int = 32) -> np.ndarray:
    """Natural log probability of each whole sequence; the state runs through all its windows."""
    total = np.zeros(len(texts))
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), rows):
        group = order[at : at + rows]
        size = sizes[group]
        state = np.zeros((len(group), model.shape.hidden), dtype=model.recur.dtype)
        last, gates = np.full(len(group), end, dtype=np.int64), model.gates()
        for t in range(0, int(size[0]) if len(size) else 0, window):
            live = int(np.searchsorted(-size, -t, side="left"))  # longer than t
            goal = np.full((window, live), end, dtype=np.int64)
            for i in range(live):
                part = texts[group[i]][t : t + window]
                goal[: len(part), i] = part
            states, targets, owner = [], [], []
            state, last = state[:live], last[:live]
            for s in range(window):
                n = int(np.searchsorted(-size, -(t + s), side="left"))
                if not n:
                    break
                new, _ = model.step(last[:n], state[:n], gates)
                state = new if n == live else np.concatenate([new, state[n:]])
                states.append(new)
                targets.append(goal[s, :n])
                owner.append(np.arange(n))
                last = goal[s]
            logp = model.scores(np.concatenate(states), np.concatenate(targets))
            total[group] += np.bincount(np.concatenate(owner), weights=logp, minlength=len(group))
    return total
