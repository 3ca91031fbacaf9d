"""Packing: optimal length buckets, then token-budget batches.

The global histogram of lengths (distinct lengths and their counts, one small row
each) goes to the driver, where dynamic programming chooses at most ``buckets``
upper bounds so that padding every document to the bound of its bucket wastes the
fewest tokens of all choices. Inside each bucket all documents have one padded
length, so a batch holds floor(budget / bound) of them (one at least), in a fixed
order. A document's place in its bucket is (documents in earlier groups of the
bucket) + (rank in its own group), where groups are hashes of doc_id of about
``group_rows`` documents: no task sorts a whole bucket.

A length is the number of words of a text, words being runs of other characters
than space, tab, line feed, vertical tab, form feed and carriage return, plus one
end token, so that it is never 0. Its histogram has one row per distinct length:
it is bounded by the longest text, not by the number of documents.

Edge cases: null and empty texts have length 1; texts longer than the budget get
batches of their own; rows with the same doc_id, or none, are packed each, in the
order of their texts' hashes; other columns are ignored whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchwell.llm.common import stored, table

BUCKETS, BUDGET = 16, 16_384


def length_of(text: Column) -> Column:
    """Words and one end token."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return (F.when(plain == "", 0).otherwise(F.size(F.split(plain, " +"))) + 1).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (the last is the greatest length) that minimise padding.

    lengths: distinct and ascending. Of choices with equal padding, the one whose
    later buckets begin first. Padding of a bucket is a Monge cost, so each layer
    of the program is solved by divide and conquer, in O(n log n).
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    docs = np.concatenate([[0], np.cumsum(counts)])
    # Padded tokens of all buckets differ from padding by a constant, the sum of lengths.
    best = lengths * docs[1:]
    begins: list[np.ndarray] = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        new, begin = best.copy(), np.zeros(n, dtype=np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            starts = np.arange(max(first, 1), min(mid, last) + 1)
            at = 0
            new[mid] = lengths[mid] * docs[mid + 1]
            if len(starts):
                cost = best[starts - 1] + lengths[mid] * (docs[mid + 1] - docs[starts])
                i = int(cost.argmin())
                if cost[i] < new[mid]:
                    new[mid], at = cost[i], int(starts[i])
            begin[mid] = at
            todo += [(lo, mid - 1, first, max(at, first)), (mid + 1, hi, max(at, first), last)]
        best = new
        begins.append(begin)
    bounds, at = [], n - 1
    for begin in reversed(begins):
        bounds.append(int(lengths[at]))
        if begin[at] == 0:
            break
        at = int(begin[at]) - 1
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, group_rows: int = 512) -> DataFrame:
    """doc_id, n_tokens, bucket, padded, batch, slot of every row of docs (doc_id, text).

    bucket: from 0, by length; padded: its upper bound; batch: from 0 in the
    bucket; slot: from 0 in the batch.
    """
    rows = docs.select("doc_id", length_of(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("tie"))
    rows = stored(rows, "pack-lengths")
    histogram = rows.groupBy("n_tokens").count().orderBy("n_tokens").collect()
    lengths, counts = np.array([r.n_tokens for r in histogram], dtype=np.int64), np.array([r["count"] for r in histogram], dtype=np.int64)
    bounds = optimal_bounds(lengths, counts, buckets) or [1]
    sizes = [int(x) for x in np.bincount(np.searchsorted(bounds, lengths), weights=counts, minlength=len(bounds))]
    groups = [max(1, -(-x // max(group_rows, -(-sum(sizes) // 100_000)))) for x in sizes]
    of = lambda values, i: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), i + 1)
    bucket = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds[:-1])), lambda b: b < F.col("n_tokens"))) if len(bounds) > 1 else F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("group", F.pmod(F.xxhash64("doc_id", "tie"), of(groups, F.col("bucket"))))
    before = Window.partitionBy("bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("bucket", "group").agg(F.count("*").alias("n")).select("bucket", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "group").orderBy("doc_id", "tie", "n_tokens")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["bucket", "group"])
    place, padded = F.col("start") + F.col("rank"), of(bounds, F.col("bucket"))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / padded))
    return ranked.select("doc_id", "n_tokens", "bucket", padded.alias("padded"), F.floor(place / room).alias("batch"), (place % room).cast("int").alias("slot"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
