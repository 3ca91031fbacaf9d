"""A quality classifier from trusted good texts and unlabelled ones.

Bad texts are never labelled for it. The risk of a score is written with positives P,
unlabelled text U and the share p of positives among all text: p E_P[l(z)] for the
positives, and E_U[l(-z)] - p E_P[l(-z)] for the negatives, which are what is in U
beyond p times P. That second part can't be below zero; where a step makes it so, the
next step goes back up on it alone (non-negative risk). The share p is estimated
too: positives that the first classifier has not seen are compared with U by a score
of P against U, and p is the smallest ratio of their shares above a score.

A text becomes the rates of pairs of neighbouring kinds of bytes, and a few numbers
on its words and lines. U is all text: each step is one pass over its stored features,
with sums made in tasks and added up by Spark. The model is linear, and steps are
those of the logistic curvature's upper bound, so that each is a small linear system.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchwell.llm.common import appended, bucket_of, stored, table


def _kinds() -> np.ndarray:
    """The kind of each byte: letters, digits, blanks, line ends, marks, signs, other scripts, control."""
    kind = np.full(256, 12, dtype=np.uint8)
    for k, signs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\v\f", b".", b",", b"!?", b"'\"()-:;", b"|", b"#$%&*+/<=>@[\\]^_`{}~")):
        kind[list(signs)] = k
    kind[128:] = 11
    return kind


_KIND = _kinds()
_N = 13
#: Features of a text: pairs of kinds, then words and lines.
WIDTH = _N * _N + 8
_SCALE = 65535.0
#: Bins of a score.
_BINS = 1000


def text_features(text: str | None) -> np.ndarray:
    """WIDTH numbers from 0 to 1 of a whole text (null: empty)."""
    raw = (text or "").encode()
    out = np.zeros(WIDTH)
    if not raw:
        out[-1] = 1.0
        return out
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    pairs = np.bincount(kind[:-1] * np.uint8(_N) + kind[1:], minlength=_N * _N)
    out[: _N * _N] = np.sqrt(pairs / len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    counts = Counter(words)
    most = max(counts.values(), default=0)
    out[_N * _N : -1] = [
        min(1.0, math.log1p(n) / 20), len(counts) / n, math.log1p(len(counts)) / math.log1p(n), sum(map(eq, words, words[1:])) / n,
        min(1.0, len(raw) / n / 30), len(set(lines)) / len(lines), most / n,
    ]
    return out


def features(docs: DataFrame) -> DataFrame:
    """docs (with text) with x: the features, as 16-bit numbers."""
    return appended(docs, "text", "x binary", lambda texts: [[np.rint(text_features(t) * _SCALE).astype("<u2").tobytes() for t in texts]])


def _matrix(column: list[bytes]) -> np.ndarray:
    """Rows of a constant 1 and the features."""
    x = np.frombuffer(b"".join(column), "<u2").reshape(len(column), WIDTH) / _SCALE
    return np.hstack([np.ones((len(column), 1)), x])


def _totals(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``of`` (from a matrix to a vector) over all rows (x); tasks give their own sums."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(width)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                total += of(_matrix(batch.column(0).slice(a, 1024).to_pylist()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["k", "v"])

    out = np.zeros(width)
    for r in rows.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _losses(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over the rows of x: one, l(-z), and the gradient of l(-z)."""
    z = x @ w
    return np.concatenate([[len(x), np.logaddexp(0, z).sum()], _sigmoid(z) @ x])


@dataclass(frozen=True)
class _Space:
    """Features at mean 0 and spread 1, and the mean products of U and of P in them."""

    shift: np.ndarray
    scale: np.ndarray
    products: np.ndarray

    def raw(self, t: np.ndarray) -> np.ndarray:
        """Weights for plain features."""
        w = t * self.scale
        w[0] -= w[1:] @ self.shift[1:]
        return w

    def lift(self, g: np.ndarray) -> np.ndarray:
        """A mean of (value times plain features) for scaled ones."""
        return (g - g[0] * np.where(np.arange(len(g)) > 0, self.shift, 0)) * self.scale


def _space(products: np.ndarray) -> _Space:
    """From the mean products of U's plain features (row 0: the constant)."""
    shift = products[0].copy()
    spread = np.sqrt(np.maximum(np.diag(products) - shift**2, 0))
    scale = np.where(spread > 1e-4, 1 / np.maximum(spread, 1e-4), 0.0)
    shift[0], scale[0] = 0.0, 1.0
    centred = (products - np.outer(shift, shift)) * np.outer(scale, scale)
    centred[0, 1:] = centred[1:, 0] = 0.0
    return _Space(shift, scale, centred)


@dataclass(frozen=True)
class Classifier:
    """Weights of (1, features) and the share of positives they were fitted for."""

    weights: tuple[float, ...]
    prior: float


def _step(space: _Space, ridge: float) -> np.ndarray:
    """The inverse of the curvature's upper bound."""
    return np.linalg.inv(space.products / 4 + ridge * np.eye(WIDTH + 1))


def _ratio(ours: np.ndarray, all_: np.ndarray, least: float) -> float:
    """The smallest ratio of U's share to P's above a score; P's share at least ``least``. Counts by bins of the score."""
    p, u = (np.cumsum(c[::-1]) / max(1.0, c.sum()) for c in (ours, all_))
    return float(np.min(u[p >= least] / p[p >= least]))


def fit(text: DataFrame, positives: list[bytes], steps: int = 24, first_steps: int = 6, ridge: float = 1e-3, least: float = 0.3) -> Classifier:
    """A classifier from unlabelled rows (x) and the features of positives.

    Without positives or without text it is undecided: every score is 0.5.
    """
    d = WIDTH + 1
    upper = np.triu_indices(d)
    sums = _totals(text, lambda x: (x.T @ x)[upper], len(upper[0]))
    if not positives or not sums[0]:
        return Classifier((0.0,) * d, 0.5)
    products = np.zeros((d, d))
    products[upper] = sums / sums[0]
    space = _space(np.triu(products) + np.triu(products, 1).T)
    ours, move = _matrix(positives), _step(space, ridge)

    def unlabelled(t: np.ndarray) -> tuple[float, np.ndarray]:
        w = space.raw(t)
        out = _totals(text, lambda x: _losses(x, w), d + 2)
        return out[1] / out[0], space.lift(out[2:] / out[0])

    def positive(rows: np.ndarray, t: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Means of l(z) and l(-z), and their gradients."""
        w = space.raw(t)
        out, z = _losses(rows, w), rows @ w
        pull = -_sigmoid(-z) @ rows
        return np.logaddexp(0, -z).mean(), out[1] / len(rows), space.lift(pull / len(rows)), space.lift(out[2:] / len(rows))

    # P against U, from half of the positives; the other half tells the share.
    seen, other = (ours[::2], ours[1::2]) if len(ours) > 1 else (ours, ours)
    t = np.zeros(d)
    for _ in range(first_steps):
        t = t - move @ (unlabelled(t)[1] + positive(seen, t)[2] + ridge * t) / 2
    w = space.raw(t)
    bins = lambda x: np.bincount((_sigmoid(x @ w) * (_BINS - 1)).astype(int), minlength=_BINS).astype(float)
    prior = min(0.99, max(0.01, _ratio(bins(other), _totals(text, bins, _BINS), least)))

    t = np.zeros(d)
    t[0] = math.log(prior / (1 - prior))
    best, least_risk = t, math.inf
    for _ in range(steps):
        loss_u, grad_u = unlabelled(t)
        loss_p, against, grad_p, grad_against = positive(ours, t)
        negative = loss_u - prior * against
        risk = prior * loss_p + max(0.0, negative) + ridge * (t @ t) / 2
        if risk < least_risk:
            best, least_risk = t, risk
        down = grad_u - prior * grad_against
        t = t - move @ (prior * grad_p + down + ridge * t) if negative >= 0 else t + move @ down
    return Classifier(tuple(space.raw(best).tolist()), prior)


def positives(rows: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> list[bytes]:
    """Features of at most ``max_labelled`` ids that only labels of quality 1 name; of repeated ids the first by bytes."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    ids = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id")
    found = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"))
    return [bytes(r.x) for r in found.orderBy("doc_id").collect()]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Classifier:
    """A classifier from docs (doc_id, text), all of them unlabelled text, and labels (doc_id, quality)."""
    rows = stored(features(docs.select("doc_id", "text")).select("doc_id", "x"), "quality-features", "zstd")
    return fit(rows, positives(rows, labels, max_labelled))


def score_features(rows: DataFrame, model: Classifier) -> DataFrame:
    """Columns of rows (with x) and score."""
    w = np.array(model.weights)

    def compute(column: list[bytes]) -> list[list]:
        return [_sigmoid(_matrix(column) @ w).tolist() if column else []]

    return appended(rows, "x", "score double", compute)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """Columns of docs (with text) and score: how likely a text is good.

    Null and empty texts are scored like each other; rows that repeat get the same
    score; texts are read whole. Columns x and score of docs are replaced.
    """
    return score_features(features(docs), model).drop("x")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    rows = stored(features(docs).select("doc_id", "x"), "quality-features", "zstd")
    model = fit(rows, positives(rows, labels.filter(bucket_of(F.col("doc_id"), 5) != 0)))
    found = score_features(rows, model)
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op12_quality": op12_quality}
ORACLES: dict[str, str] = {}
