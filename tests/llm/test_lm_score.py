import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from watchwell.llm import gru, lm_score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), ""]


def toy(seed=0, kind=np.float64):
    weights = np.array([9.0, 5, 4, 3, 2, 1, 6, 8])
    shape = gru.Shape.of(weights, 6, 3, hidden=4)
    model = gru.Model(shape, weights, seed, kind)
    rng = np.random.default_rng(seed)
    for n in ("out", "word"):
        setattr(model, n, rng.normal(0, 0.5, getattr(model, n).shape).astype(kind))
    return model


def test_probabilities_of_a_step_sum_to_one():
    model = toy()
    state = np.random.default_rng(1).normal(size=(1, 4))
    logs = model.scores(np.repeat(state, 8, axis=0), np.arange(8))
    assert np.exp(logs).sum() == pytest.approx(1)


def test_gradients_match_differences():
    model = toy()
    rng = np.random.default_rng(2)
    inputs, targets, mask = gru.padded([rng.integers(0, 8, n) for n in (5, 3, 7)], 0)
    state = np.zeros((3, 4))
    _, grads, _ = model.window(inputs, targets, mask, state)
    for name in gru.Model.NAMES:
        value = getattr(model, name)
        for at in rng.integers(0, value.size, 6):
            index, step = np.unravel_index(at, value.shape), 1e-6
            old = value[index]
            losses = []
            for d in (step, -step):
                value[index] = old + d
                losses.append(model.window(inputs, targets, mask, state)[0])
            value[index] = old
            assert grads[name][index] == pytest.approx((losses[0] - losses[1]) / (2 * step), abs=1e-6)


def test_windows_carry_the_state():
    model = toy()
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 8, n) for n in (1, 40, 7, 0, 33)]
    want = []
    for x in texts:
        state, last, total = np.zeros((1, 4)), 0, 0.0
        for s in x:
            state, _ = model.step(np.array([last]), state)
            total += float(model.scores(state, np.array([s]))[0])
            last = s
        want.append(total)
    assert gru.log_likelihood(model, texts, 0, rows=3, window=8) == pytest.approx(want)


def test_scores_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = [f"Word{i}," for i in range(40)]
    texts = [" ".join(rng.choice(words, size=rng.integers(0, 60), p=np.arange(1, 41) / 820)) for _ in range(120)] + ["", None, "  Tab\tand\x0bmore\n", "ÀB rare" * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again 3")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = lm_score.op8_gru_scores(spark, str(tmp_path)).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts = Counter(w for d, t in rows if not held(d) for w in plain_tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        ws = plain_tokens(t)
        want.append((-1 if d is None else d, held(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)


def test_small_head_gives_the_same_base_and_the_model_learns(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'a' if i % 2 else 'b'}{rng.integers(30)}" for _ in range(40)) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    model = lm_score.fit(df, head_words=40, n_words=20, n_bands=3, word_classes=4, epochs=3)
    few = {r.doc_id: r for r in lm_score.score(df, *model).collect()}
    all_ = {r.doc_id: r for r in lm_score.score(df, *lm_score.fit(df, rounds=1)).collect()}
    assert all(few[i].base_score == pytest.approx(all_[i].base_score) for i in few)
    assert sum(r.score for r in few.values()) > sum(r.base_score for r in few.values())
    again = {r.doc_id: r for r in lm_score.score(df, *lm_score.fit(df.repartition(7, "text"), head_words=40, n_words=20, n_bands=3, word_classes=4, epochs=3)).collect()}
    assert all(few[i].score == pytest.approx(again[i].score) for i in few)  # partitions of the input don't matter


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(df, *lm_score.fit(df)).collect() == []


def test_training_reads_every_symbol_and_carries_the_state():
    rng = np.random.default_rng(6)
    one, model, by_hand = rng.integers(0, 8, 75), toy(), toy()
    assert gru.train(model, [one], 0, window=16, batch=1) == 75
    adam, state = gru.Adam(by_hand, 0.01), np.zeros((1, 4))
    read = np.concatenate([[0], one[:-1]])
    for t in range(0, 75, 16):
        _, grads, state = by_hand.window(read[t : t + 16, None], one[t : t + 16, None], np.ones((len(one[t : t + 16]), 1), dtype=bool), state)
        adam.apply(grads)
    assert model.flat() == pytest.approx(by_hand.flat())
    assert gru.train(toy(), iter([rng.integers(0, 8, n) for n in (1, 40, 0, 17, 33)]), 0, rows=2) == 91


def test_the_model_learns_from_all_of_a_long_text(spark):
    long = " ".join("abcdefgh" for _ in range(800)).replace("abcdefgh", "a b c d e f g h")
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    (row,) = lm_score.score(df, *lm_score.fit(df)).collect()
    assert row.score > row.base_score / 2  # a stretch of 160 characters is five windows


def test_gathered_windows_move_the_parameters_once():
    rng = np.random.default_rng(8)
    texts, model, by_hand = [rng.integers(0, 8, n) for n in (16, 16)], toy(), toy()
    gru.train(model, texts, 0, rows=1, window=16, batch=32)
    grads = []
    for x in texts:
        _, g, _ = by_hand.window(np.concatenate([[0], x[:-1]])[:, None], x[:, None], np.ones((16, 1), dtype=bool), np.zeros((1, 4)))
        grads.append(g)
    gru.Adam(by_hand, 0.01).apply({n: (grads[0][n] + grads[1][n]) / 2 for n in gru.Model.NAMES})
    assert model.flat() == pytest.approx(by_hand.flat())


def test_held_out_gain_over_the_base(spark):
    """log10 probability a token on documents that were not trained on: better than the base by a tenth."""
    rows = lm_score.op8_gru_scores(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert tokens > 20_000
    assert sum(r.score - r.base_score for r in rows) / tokens > 0.1


def test_many_trainers_are_summed_in_groups(spark):
    """More trainers than the driver takes: their sums come in groups, each whole and numbered."""
    rows = [(i, float(i + 1), bytearray(np.full(3, float(i)).tobytes())) for i in range(150)]
    made = spark.createDataFrame(rows, "trainer long, n double, p binary").repartition(7)
    found = {r.trainer: (r.n, np.frombuffer(bytes(r.p)).tolist()) for r in lm_score._summed(made, 4).collect()}
    assert found == {g: (sum(i + 1.0 for i in range(150) if i % 4 == g), [float(sum(i for i in range(150) if i % 4 == g))] * 3) for g in range(4)}
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c d") for i in range(1200)], "doc_id long, text string")
    _, lex, model = lm_score.fit(docs, trainer_tokens=150, rounds=1)
    assert lex.total == 6000 and np.isfinite(model.flat()).all()
