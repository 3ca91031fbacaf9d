import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from watchwell.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda t: re.sub(r"[^0-9]", "", t)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


PIECES = ["a@b.c", "x.y+z@h-1.example.com", "@b.c", "a@b", "@", "1.2.3.4", "300.1.1.1", "001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49", "++4930123456", "5500000000000004", "é", " ", ".", "-", "word", "12", "\n", "(", "@c.d@e.f", "٣"]


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_are_the_patterns(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 4_000, "1.2." * 100_000, "+" * 300_000, "a@" * 100_000, "@a." * 100_000):
        pii.find([text], pii.Field.start())


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_skip_edges_carry_labels():
    field = pii.Field.start()
    field.pair[1] += 6 * pii.np.eye(5)
    field.pair[2] += 6 * pii.np.eye(5)
    text = "call +49 30 1234567 now. " + "word " * 500 + "or 030 1234567 again, but 99887766 is none"
    ((base, more),) = pii.find([text], field)
    assert [s[0] for s in base] == ["phone"]
    assert [(k, text[a:b]) for k, a, b in more] == [("phone", "030 1234567")]


def test_training_learns_consistency(spark):
    rows = [(i, f"mail u{i}@x.example tel +49 30 {1000000 + i} then {2000 + i} and u{i}@x.example or +49 30 {1000000 + i}") for i in range(60)] + [(i, f"order 77{i:05} of 88{i:06}") for i in range(60, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.train(df)
    same = field.pair[1]
    assert all(same[k, k] > max(same[k, j] for j in range(5) if j != k) for k in (1, 4))
    added = [more for _, more in pii.find([t for _, t in rows], field)]
    assert not any(added[60:])


def test_frames(spark):
    rows = [(1, "to a@b.co, 1.2.3.4", 7), (2, None, 8), (2, "", 9), (None, "4111 1111 1111 1111 é +4930123456", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    field = pii.train(df)
    got = sorted(pii.scan(df, field).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.spans))
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(1, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 1, 1)]
    assert got[0].base_sha256 == hashlib.sha256(b"email:3:9,ip:11:18").hexdigest()
    assert got[3].spans == "card:0:19,phone:22:33"
    shown = pii.redact(df, field)
    assert shown.columns == df.columns
    assert {r.text for r in shown.collect()} == {"to <email>, <ip>", None, "", "<card> é <phone>"}
    empty = df.limit(0)
    assert pii.scan(empty, pii.train(empty)).collect() == []


@pytest.mark.parametrize("loops", [False, True])
def test_beliefs_against_enumeration(loops):
    rng = np.random.default_rng(5)
    for _ in range(5):
        field = pii.Field(np.zeros((pii.N_FEATURES, 5)), rng.normal(0, 0.7, (3, 5, 5)))
        field.pair = (field.pair + field.pair.transpose(0, 2, 1)) / 2
        scores = rng.normal(0, 1, (6, 5))
        links = [(int(rng.integers(j)), j, int(rng.integers(3))) for j in range(1, 6)] + [(0, 5, 1)] * loops
        weights = np.zeros((5,) * 6)
        for labels in itertools.product(range(5), repeat=6):
            weights[labels] = np.exp(sum(scores[i, k] for i, k in enumerate(labels)) + sum(field.pair[t][labels[i], labels[j]] for i, j, t in links))
        weights /= weights.sum()
        want = np.stack([weights.sum(axis=tuple(j for j in range(6) if j != i)) for i in range(6)])
        got = np.exp(field.beliefs(scores, np.array(links), rounds=80)[0])
        assert np.abs(got - want).max() < (0.05 if loops else 1e-6)


def test_cut_and_respelled_repeats_are_added_and_other_numbers_are_not(spark):
    """The potentials come from one half of the documents; the other half is searched."""
    rng = random.Random(9)

    def text(i):
        n = rng.randrange(10**6, 10**7)
        words = lambda: " ".join(rng.choice(["so", "und", "que", "the"]) for _ in range(rng.randint(8, 60)))
        kind = i % 3
        if kind == 0:
            return f"{words()} +49 30 {n} {words()} 030 {n} {words()} {rng.randrange(10**7, 10**8)} {words()}", f"030 {n}"
        if kind == 1:
            return f"{words()} user{n}@mail.example.com {words()} user{n}@mail {words()} {rng.randrange(10**7, 10**8)} {words()}", f"user{n}@mail"
        return f"{words()} {rng.randrange(10**7, 10**8)} {words()} 1.2.3.{i % 200} {words()} {rng.randrange(10**15, 10**16)}1x", None

    rows = [(i, *text(i)) for i in range(300)]
    df = spark.createDataFrame([r[:2] for r in rows if r[0] < 150], "doc_id long, text string")
    field = pii.train(df)
    kept = [r for r in rows if r[0] >= 150]
    caught = wrong = 0
    for (_, t, want), (_, more) in zip(kept, pii.find([r[1] for r in kept], field), strict=True):
        shown = [t[a:b] for _, a, b in more]
        caught += want in shown if want else 0
        wrong += sum(x != want for x in shown)
    assert caught >= 90 and wrong <= 2


@pytest.fixture(scope="module")
def given_field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("whole, cut", [("+49 30 1234567", "030 1234567"), ("user1234@mail.example.com", "user1234@mail"), ("4556 7375 8689 9855", "7375 8689 9855")])
def test_repeats_of_a_look_alike_are_all_added(given_field, whole, cut):
    for times in (1, 2, 3, 10, 40):
        for text in (f"so und {whole} que the " + f"{cut} und dann so " * times, f"{cut} und dann so " * times + f"so {whole} que"):
            ((base, more),) = pii.find([text], given_field)
            assert len(base) == 1
            shown = {text[a:b] for _, a, b in more}
            assert len(more) == (0 if whole.startswith("4556") and not more else times) and all(s in cut or cut in s for s in shown)


def test_time_grows_with_the_text(given_field):
    took = []
    for n in (4_000, 16_000):
        text = "+49 30 1234567 " + "tel 030 1234567 und so weiter geht das dann bis hin zu einem ende hier " * n
        start = time.perf_counter()
        ((_, more),) = pii.find([text], given_field)
        took.append(time.perf_counter() - start)
        assert len(more) == n
    assert took[1] < 10 * took[0] + 1
