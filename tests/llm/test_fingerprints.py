import hashlib
import re

from pyspark.sql import functions as F

from watchwell.llm import fingerprints as fp
from watchwell.llm.common import stored


def spots(text):
    words, out, i = re.findall(r"[^\W_]+", text.lower()), set(), 0
    anchors = set(fp.ANCHORS)
    for i, w in enumerate(words[:-1]):
        if w in anchors and words[i + 1] not in anchors:
            out.add(tuple([x for x in words[i + 1 :] if x not in anchors][: fp.CHAIN]))
    return out


def jaccard(a, b):
    x, y = spots(a), spots(b)
    if not x or not y:
        return 1.0 if (a == b and not x and not y) else 0.0
    return len(x & y) / len(x | y)


TEXTS = [
    "The cat sat on the mat and the dog ran to a big red house in the old town.",
    "",
    "The cat sat on the mat and the dog ran to a big red barn in the old town. Été à la mer, der Hund und die Katze!",
    None,
    "no anchors here",
    "x " * 9 + "the " * 5000,
    "of of of word",
    "😀 the face of it 😀 and more",
]


def test_edited_texts_and_likeness(spark):
    rows = [(i * 7, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, key string, n int").repartition(4)
    whole = fp.edited(df)
    out = whole.select("doc_id", "n_chars", "edited", fp.likeness(fp.signatures(F.col("text")), fp.signatures(F.col("edited"))).alias("e"), fp.likeness(fp.signatures(F.col("text")), F.col("next_signs")).alias("x"), fp.fingerprint(fp.signatures(F.col("text"))).alias("f"))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[d].n_chars, got[d].edited) == (len(t), edited)
        assert abs(got[d].e - jaccard(t, edited)) < 1e-9
        assert abs(got[d].x - jaccard(t, after)) < 1e-9
    assert got[7].f == got[21].f  # both empty


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "the end of it"), (2, "the end of it")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = fp.op5_spot_signatures(spark, str(tmp_path)).collect()
    assert {r.near_next for r in rows} == {1.0}
    assert {r.edited_sha256 for r in rows} == {hashlib.sha256(b"the endthe en").hexdigest()}
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert fp.op5_spot_signatures(spark, str(tmp_path)).collect() == []


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(None, "aa"), (3, "bbbb"), (3, "abcd"), (9, "zz")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text, r.edited) for r in fp.edited(df).collect())
    assert got == [(-1, "aa", "aa"), (3, "abcd", "abzz"), (3, "bbbb", "bbzz"), (9, "zz", "za")]


def test_near_duplicates_match_brute_force(spark):
    import random

    rng = random.Random(3)
    sets = []
    for i in range(60):
        base = sorted(rng.sample(range(1000), rng.randint(1, 40)))
        sets.append((i * 2, base))
        sets.append((i * 2 + 1, sorted({*base[: max(1, len(base) - rng.randint(0, 4))], *rng.sample(range(1000), rng.randint(0, 3))})))
    sets.append((500, sets[0][1]))
    df = stored(spark.createDataFrame(sets, "id long, signs array<int>"), "sets")
    first = {}
    for i, s in sets:
        first.setdefault(tuple(s), i)
    distinct = sorted((i, set(s)) for s, i in first.items())
    want = {(a, b) for n, (b, y) in enumerate(distinct) for a, x in distinct[:n] if len(x & y) / len(x | y) >= 0.8}
    assert {(r.a, r.b) for r in fp.near_duplicates(df).collect()} == want
