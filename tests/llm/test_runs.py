"""Runs against a search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchwell.llm import runs


def brute(words, least):
    """(start, length, period) by looking at every period of every place."""
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            s, size = i, j - i + p
            if size >= max(least, 2 * p) and not any(words[s : s + size - q] == words[s + q : s + size] for q in range(1, p)):
                out.append((s, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The row of the query, word by word."""
    words, h = text.encode().split() if text else [], zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words, 12)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + size for s, size, p in found)]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], digest("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()), digest(b" ".join(kept)))


@pytest.mark.parametrize("least", [2, 3, 6, 12])
def test_runs_equal_a_search_of_every_period(least):
    chance = random.Random(least)
    for _ in range(200):
        docs = []
        for _ in range(chance.randint(1, 4)):
            n, kinds = chance.choice([0, 1, 5, 12, 20, 40, 80]), chance.choice([1, 2, 2, 3, 5])
            words = [chance.randint(1, kinds) for _ in range(n)]
            if n and chance.random() < 0.5:
                a = chance.randrange(n)
                p = chance.randint(1, n - a)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            docs.append(words)
        ends = np.cumsum([len(d) for d in docs])
        found = runs.find_runs(np.array(sum(docs, []), dtype=np.int64), ends, least)
        want = [(s + e - len(d), size, p) for d, e in zip(docs, ends.tolist()) for s, size, p in brute(d, least)]
        assert [tuple(r) for r in found.tolist()] == want


def test_lyndon_arrays_of_both_orders():
    chance = random.Random(5)
    for _ in range(300):
        text = [chance.randint(1, 3) for _ in range(chance.randint(1, 14))]
        for word in (text, [4 - x for x in text]):
            longest = [max(m for m in range(1, len(word) - i + 1) if all(word[i : i + m] < word[i + k : i + m] for k in range(1, m))) for i in range(len(word))]
            assert runs.lyndon_array(np.array([0, *word, 0])).tolist()[1:-1] == longest


def test_query_equals_brute_force(spark):
    found = runs.op11_runs(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = {d.doc_id: d.text for d in docs if len((d.text or "").split()) < 400}
    assert len(found) == len(docs) and len(short) > 100
    assert sorted(tuple(r) for r in found if r.doc_id in short) == sorted(expected(i, t) for i, t in short.items())
    assert sum(r.n_runs > 0 for r in found) > 10


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = "x y " * 60_000 + "z"
    rows = [(1, None), (2, ""), (3, " \t\x0b "), (3, "a b " * 7), (3, "a b " * 7), (None, "q " * 13), (10, "é\xa0é " * 12), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "k": F.lit(2), "n_words": F.lit("x")})
    found = runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = {(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found.collect()}
    assert got == {
        (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (3, 14, ((0, 14, 2),), "a b"), (None, 13, ((0, 13, 1),), "q"),
        (10, 12, ((0, 12, 1),), "é\xa0é"), (4, 120_001, ((0, 120_000, 2),), "x y z"),
    }
    assert found.count() == len(rows)
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_rows_do_not_move(spark):
    plan = runs.op11_runs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
