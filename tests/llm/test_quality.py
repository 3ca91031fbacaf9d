"""The quality classifier: its risk, the share of positives, held-out labels, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchwell.llm import quality as q

FOLDER = "/root/testdata/sf0.01"


def text_rows(spark, texts):
    return q.features(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).select("doc_id", "x")


def generated(chance, good, bad):
    words = ["the", "of", "and", "stone", "river", "letter", "house", "under", "green"]
    fine = [" ".join(chance.choice(words, chance.integers(20, 60))).capitalize() + "." for _ in range(good)]
    poor = [" ".join(w + "$$&&" for w in chance.choice(words, chance.integers(20, 60))) for _ in range(bad)]
    return fine, poor


def test_features_see_every_byte_and_word():
    text = "Ab ab. Ab\nAb"
    x = q.text_features(text)
    kind = q._KIND
    for a in range(256):
        for b in (32, 65, 97, 46, 10, 200):
            pairs = sum(kind[p] == kind[a] and kind[r] == kind[b] for p, r in zip(text.encode(), text.encode()[1:]))
            assert x[kind[a] * 13 + kind[b]] == pytest.approx(math.sqrt(pairs / len(text)))
    assert x[13 * 13 :].tolist() == pytest.approx([math.log1p(4) / 20, 2 / 4, math.log1p(2) / math.log1p(4), 1 / 4, len(text) / 4 / 30, 1.0, 3 / 4, 0.0])
    assert (q.text_features("x" * 50_000 + " tail!!") != q.text_features("x" * 50_000 + " tail")).any()


def test_losses_are_sums_with_their_gradient():
    chance = np.random.default_rng(2)
    x, w = chance.normal(size=(9, 5)), chance.normal(size=5)
    n, loss, *gradient = q._losses(x, w)
    assert n == 9 and loss == pytest.approx(np.log1p(np.exp(x @ w)).sum())
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert gradient[k] == pytest.approx((q._losses(x, w + step)[1] - q._losses(x, w - step)[1]) / 2e-6, rel=1e-5)


def test_scaled_space_keeps_scores_and_gradients():
    chance = np.random.default_rng(3)
    x = np.hstack([np.ones((40, 1)), chance.random((40, q.WIDTH)) * chance.random(q.WIDTH)])
    x[:, 5] = 0.25
    space = q._space(x.T @ x / len(x))
    t = chance.normal(size=q.WIDTH + 1)
    scaled = (x - np.append(0, x[:, 1:].mean(0))) * space.scale
    assert np.allclose(x @ space.raw(t), scaled @ t) and scaled[:, 5].max() == 0
    v = chance.random(40)
    assert np.allclose(space.lift(v @ x / 40), v @ scaled / 40)
    assert np.allclose(space.products, scaled.T @ scaled / 40)


def risk(text, ours, model, prior):
    """The non-negative risk, from its definition."""
    u, p = (np.hstack([np.ones((len(x), 1)), x]) @ np.array(model.weights) for x in (text, ours))
    negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
    return prior * np.logaddexp(0, -p).mean() + max(0.0, negative)


def test_fit_lowers_the_risk_and_estimates_the_share(spark):
    chance = np.random.default_rng(4)
    good, bad = generated(chance, 280, 120)
    more, _ = generated(chance, 200, 0)
    rows = text_rows(spark, good + bad)
    ours = [bytes(r.x) for r in text_rows(spark, more).collect()]
    model = q.fit(rows, ours)
    assert 0.6 <= model.prior <= 0.8  # 0.7 of the text is good
    text, trusted = (np.array([q.text_features(t) for t in x]) for x in (good + bad, more))
    found = risk(text, trusted, model, model.prior)
    first = q.Classifier((math.log(model.prior / (1 - model.prior)), *[0.0] * q.WIDTH), model.prior)
    assert found < 0.2 * risk(text, trusted, first, model.prior)
    z = np.hstack([np.ones((len(text), 1)), text]) @ np.array(model.weights)
    assert (z[:280] > 0).mean() > 0.97 and (z[280:] < 0).mean() > 0.97


def test_without_positives_or_text_it_is_undecided(spark):
    rows = text_rows(spark, ["a b", "c"])
    assert set(q.score_features(rows, q.fit(rows, [])).toPandas()["score"]) == {0.5}
    assert q.fit(rows.limit(0), [bytes(rows.first().x)]).prior == 0.5


def test_held_out_labels(spark):
    found = q.op12_quality(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    rows = found.filter("held_out").join(labels, "doc_id").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95
    assert rows[rows.quality == 1]["score"].quantile(0.05) > rows[rows.quality == 0]["score"].quantile(0.9)
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.features(docs.select("doc_id", "text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    kept = q.positives(rows, labels.filter(fold != 0))
    assert kept == q.positives(rows, labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).filter(fold != 0))
    names = {r.doc_id for r in labels.filter((fold != 0) & (F.col("quality") == 1)).collect()}
    assert len(kept) == len(names)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A fine line."), (3, "A fine line."), (None, "z " * 300_000), (4, "é \x00 |")], "doc_id long, text string").withColumns({"x": F.lit(7), "score": F.lit("s"), "quality": F.lit(9)})
    labels = spark.createDataFrame([(3, 1), (3, 1), (1, None), (2, 0), (4, 1), (4, 0), (None, 1)], "doc_id long, quality int").withColumn("text", F.lit("t"))
    model = q.train(docs, labels)
    found = q.score(docs, model)
    scores = {}
    for r in found.collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    assert len(scores[3]) == 2 and scores[3][0] == scores[3][1] and scores[1] == scores[2] and all(0 <= s <= 1 for x in scores.values() for s in x)
    assert sorted(found.columns) == ["doc_id", "quality", "score", "text"]
    assert len(q.positives(q.features(docs), labels)) == 1
    assert q.score(docs.limit(0), model).collect() == []
