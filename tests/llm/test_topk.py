import math

from pyspark.sql import functions as F

from watchwell.llm.topk import sparse_rows, top_k


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, x, strict=True)), i) for i, x in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    got = top_k(sparse_rows(df, "vec_id", "embedding"), F.col("id") % 50 == 0, k, block_rows=20, query_rows=2)
    return sorted(map(tuple, got.collect()))


def test_matches_brute_force_with_ties_nulls_and_zeros(spark):
    rows = [(i, [((i * 7 + d * 13) % 11 - 5) / 8 if (i + d) % 3 else 0.0 for d in range(6)]) for i in range(0, 260)]
    rows += [(None, [0.5] * 6), (1000, None), (1050, [None] + [0.5] * 5), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, [0.0] * 6)]
    rows += [(i, [0.5] * 6) for i in range(2000, 2060)]
    assert run(spark, rows) == brute(rows, 5)


def test_few_rows(spark):
    assert run(spark, [(0, [0.5, 0.25]), (1, [1.0, -1.0])]) == [(0, 1, 1, 128 * 256 - 64 * 256)]
    assert run(spark, [(0, [0.5])]) == []
    assert run(spark, []) == []


def test_repeated_query_ids_have_ranks_of_their_own(spark):
    rows = [(0, [1.0]), (0, [2.0]), *((i, [i / 8]) for i in range(1, 10)), (7, [7 / 8])]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert len(run(spark, rows, 3)) == 6
