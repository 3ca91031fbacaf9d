"""Toxicity: a word-presence classifier, regularised by counterfactuals.

The classifier is logistic over the presence of words and of word beginnings. It is
trained on labelled documents together with counterfactual copies: in every sentence
that mentions an identity term the term is swapped for another of its group; a
document that mentions none gets a neutral mention put in front. The loss adds the
squared change of the score's logit between a document and its copy, so that a
mention of a group moves no score by itself, even if a group stands more often in
toxic texts than in others. Identity terms are words of their own: their beginnings,
which other words share, are no features.

Training uses a bounded sample of labelled ids (``max_labelled``, smallest hash
first). Spark counts the words of the sample by class, keeps the
``max_words`` with the largest chi-square, and returns the sample as short lists
of word numbers; the fit is numpy on the driver. Scoring reads all documents.

Edge cases: null and empty texts score the intercept; labels that are null or not
0/1 are ignored, a doc_id labelled more than once counts as toxic if any label
says so; without labels every score is 0; repeated rows are scored separately;
long texts are read whole; an empty table gives no rows; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchwell.llm.common import appended, bucket_of, stored, table

#: Groups of identity terms; a swap stays within its group.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("frauen", "männer", "christen", "muslime", "juden"),
    ("femmes", "hommes", "chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres", "cristianos", "musulmanes", "judíos"),
)
Groups = tuple[tuple[str, ...], ...]
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def swaps(groups: Groups) -> dict[str, str]:
    """Each identity term's place-taker: the next of its group."""
    return {t: group[(i + 1) % len(group)] for group in groups for i, t in enumerate(group)}


def words(text: str | None, identity: Container[str] = ()) -> set[str]:
    """The text's words, and the first letters of its longer words ("moro*") that are no identity terms."""
    found = set(_WORD.findall((text or "").lower()))
    return found | {w[:4] + "*" for w in found if len(w) > 4 and w not in identity}


def counterfactual(text: str | None, swap: dict[str, str]) -> str:
    """The text with identity terms swapped in its sentences, or one put in."""
    text = text or ""
    if not swap:
        return text
    if not set(_WORD.findall(text.lower())).isdisjoint(swap):
        other = lambda m: swap.get(m[0].lower(), m[0])
        return _SENTENCE.sub(lambda s: _WORD.sub(other, s[0]), text)
    terms = sorted(swap)
    return f"{terms[sum(map(ord, text[:64])) % len(terms)]} {text}"


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic) of at most max_labelled labelled ids."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def _vocabulary(sample: DataFrame, max_words: int, min_docs: int, swap: dict[str, str]) -> list[str]:
    """The words of the largest chi-square, with all identity terms."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [words(t, swap) for t in b["text"]]
            yield pd.DataFrame({"word": [w for s in sets for w in s], "toxic": np.repeat(b["toxic"].to_numpy(), [len(s) for s in sets])})

    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    n = max(pos + neg, 1.0)
    counts = sample.mapInPandas(distinct, "word string, toxic int").groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("d"))
    a, d = F.col("a"), F.col("d")
    spread = F.greatest(d * (n - d) * pos * neg, F.lit(1.0))
    chi = (a * n - d * pos) ** 2 * n / spread
    best = counts.filter(d >= min_docs).withColumn("chi", chi).orderBy(F.desc("chi"), "word").limit(max_words)
    return sorted({r.word for r in best.collect()} | set(swap))


def _numbered(sample: DataFrame, vocabulary: list[str], swap: dict[str, str]) -> pd.DataFrame:
    """The sample as word numbers, of each document and of its counterfactual."""
    at = {w: i for i, w in enumerate(vocabulary)}

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lambda t: np.array(sorted(at[w] for w in at.keys() & words(t, swap)), dtype=np.int32).tobytes()
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "x": [of(t) for t in b["text"]], "y": [of(counterfactual(t, swap)) for t in b["text"]]})

    return sample.mapInPandas(number, "toxic int, x binary, y binary").orderBy("toxic", "x", "y").toPandas()


class _Rows:
    """Sparse 0/1 rows; products with a weight vector and with row values."""

    def __init__(self, column: list[bytes], width: int):
        lists = [np.frombuffer(b, np.int32) for b in column]
        self.cols = np.concatenate([np.zeros(0, np.int32), *lists])
        self.at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.n, self.width = len(lists), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=w[self.cols], minlength=self.n)

    def t_dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=v[self.at], minlength=self.width)


def fit(rows: pd.DataFrame, width: int, swap_weight: float = 1.0, prior: float = 0.5, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept, by Adam on the whole sample.

    Loss: logistic, plus swap_weight * (logit change)^2, both averaged over the
    documents, plus prior / documents * |weights|^2.
    """
    x, y, t = _Rows(list(rows["x"]), width), _Rows(list(rows["y"]), width), rows["toxic"].to_numpy(float)
    n, rate = len(t), min(max(t.mean(), 1e-3), 1 - 1e-3)
    w, b = np.zeros(width), float(np.log(rate / (1 - rate)))
    m, v, lr = np.zeros(width + 1), np.zeros(width + 1), 0.1
    weight = np.where(t > 0, 0.5 / rate, 0.5 / (1 - rate))
    for step in range(1, steps + 1):
        z = x.dot(w) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - t) / n
        change = 2 * swap_weight * (x.dot(w) - y.dot(w)) / n
        g = np.append(x.t_dot(error + change) - y.t_dot(change) + 2 * prior / n * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


@dataclass(frozen=True)
class Classifier:
    """Weights of words and the intercept; identity terms have no beginnings."""

    weights: dict[str, float]
    intercept: float
    identity: frozenset[str] = frozenset()


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_words: int = 4_096, min_docs: int = 3, groups: Groups = IDENTITY, swap_weight: float = 1.0) -> Classifier:
    """A classifier from docs (doc_id, text) and labels (doc_id, toxic); groups: identity terms of the corpus' languages."""
    swap = swaps(groups)
    sample = stored(labelled_sample(docs, labels, max_labelled), "toxicity-sample")
    vocabulary = _vocabulary(sample, max_words, min_docs, swap)
    rows = _numbered(sample, vocabulary, swap)
    if rows.empty:
        return Classifier({}, float("-inf"))
    w, b = fit(rows, len(vocabulary), swap_weight)
    return Classifier({word: float(x) for word, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-6}, b, frozenset(swap))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """Columns of docs and score: the probability that a text is toxic."""
    weights, b, identity = model.weights, model.intercept, model.identity
    keys = frozenset(weights)

    def compute(texts: list[str | None]) -> list[list]:
        z = np.array([b + sum(weights[w] for w in sorted(keys & words(t, identity))) for t in texts], dtype=float)
        return [np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700)))).tolist()]

    return appended(docs, "text", "score double", compute)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(bucket_of(F.col("doc_id"), 5) != 0))
    found = score(docs, model)
    return found.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
