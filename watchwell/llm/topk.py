"""Exact top-k search by inner product, term at a time, in blocks.

Rows are sparse: (term, weight) pairs. Candidates are dealt into blocks of
about ``block_rows`` by a hash of their id, queries into blocks of
``query_rows``. Every query block meets every candidate block once. There, the
postings (term -> rows and weights) of both are scattered, term after term, into
one dense array of scores; partition selection keeps the k best of each query in
the block, and the blocks' winners are merged by one ranking per query. The work
is exhaustive, so its cost is queries times candidates by its nature; no task
holds more than two blocks.

Edge cases: vectors that are null or hold null or non-finite components take no
part, neither as queries nor as candidates; null ids neither. Ties go to the
smaller id. A query never meets a row with its own id. Rows that share an id are
separate candidates and separate queries, each with its own ranks. Empty tables give
an empty result. Scores are exact while
they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchwell.llm.common import table

_PACKED = "slot long, ids binary, rows binary, terms binary, weights binary"
_BEST = "query_slot long, query_row int, query_id long, vec_id long, score long"


def sparse_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, terms, weights) of each finite vector: floor(scale * x) where not 0."""
    x = F.col("v").cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * scale))
    used = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.element_at("w", i + 1) != 0)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
        .select("id", whole.alias("w"))
        .select("id", F.when(F.size("w") > 0, used).otherwise(F.array().cast("array<int>")).alias("terms"), F.filter("w", lambda c: c != 0).alias("weights"))
    )


def _packed(rows: DataFrame, slot: Column) -> DataFrame:
    """One row per slot with all its sparse rows as flat arrays."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        sizes = group["terms"].map(len).to_numpy()
        at = np.repeat(np.arange(len(group), dtype=np.int32), sizes)
        flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(x, dtype=kind) for x in group[c])])
        return pd.DataFrame(
            {
                "slot": [group["slot"].iloc[0]],
                "ids": [group["id"].to_numpy(np.int64).tobytes()],
                "rows": [at.tobytes()],
                "terms": [flat("terms", np.int32).astype(np.int32).tobytes()],
                "weights": [flat("weights", np.int64).astype(np.int64).tobytes()],
            }
        )

    return rows.withColumn("slot", slot.cast("long")).groupBy("slot").applyInPandas(pack, _PACKED)


def _postings(rows: bytes, terms: bytes, weights: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    at, term, weight = np.frombuffer(rows, np.int32), np.frombuffer(terms, np.int32), np.frombuffer(weights, np.int64)
    order = np.argsort(term, kind="stable")
    kinds, first = np.unique(term[order], return_index=True)
    return {int(t): (at[part], weight[part]) for t, part in zip(kinds, np.split(order, first[1:]), strict=True)} if len(kinds) else {}


def best_in_block(q_ids: np.ndarray, q_post: dict, c_ids: np.ndarray, c_post: dict, k: int) -> pd.DataFrame:
    """The k best candidates of the block for each query, ties to the smaller id.

    Candidates must be in ascending order of their ids.
    """
    n, terms = len(c_ids), sorted(q_post.keys() & c_post.keys())
    bound = sum(int(np.abs(q_post[t][1]).max()) * int(np.abs(c_post[t][1]).max()) for t in terms)
    kind = np.int32 if bound < 2**31 else np.int64
    scores = np.zeros((len(q_ids), n), dtype=kind)
    for t in terms:
        (qr, qw), (cr, cw) = q_post[t], c_post[t]
        gain = np.multiply.outer(qw.astype(kind), cw.astype(kind))
        if len(qr) == len(q_ids) and len(cr) == n:  # all rows have the term: nothing to scatter
            scores += gain
        else:
            scores[np.ix_(qr, cr)] += gain
    first, last = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
    chosen = np.zeros((len(q_ids), min(n, k + int((last - first).max(initial=0)))), dtype=np.int64)
    if bound < 2**62 // max(n, 1):  # one number holds score and position
        keys = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)
        chosen = np.argpartition(keys, n - chosen.shape[1], axis=1)[:, n - chosen.shape[1] :]
    else:
        for i, row in enumerate(scores):
            chosen[i] = np.lexsort((np.arange(n), -row))[: chosen.shape[1]]
    own = (chosen >= first[:, None]) & (chosen < last[:, None])
    at, col = np.nonzero(~own)
    picks = chosen[at, col]
    return pd.DataFrame({"query_row": at, "query_id": q_ids[at], "vec_id": c_ids[picks], "score": scores[at, picks].astype(np.int64)})


def top_k(rows: DataFrame, is_query: Column, k: int = 5, block_rows: int = 2048, query_rows: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query row.

    rows: (id, terms, weights), see sparse_rows(); is_query: which are queries.
    """
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(is_query.cast("int")), F.lit(0)).alias("q")).first()
    blocks, groups = max(1, -(-counts.n // block_rows)), max(1, -(-counts.q // query_rows))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    candidates = _packed(rows, dealt(blocks))
    queries = _packed(rows.filter(is_query), dealt(groups)).select(*(F.col(c).alias(f"q_{c}") for c in ("slot", "ids", "rows", "terms", "weights")))
    meet = queries.withColumn("q_group", F.col("q_slot")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, post = None, {}
        for batch in batches:
            for r in batch.itertuples():
                if held != r.slot:
                    held, post = r.slot, _postings(r.rows, r.terms, r.weights)
                yield best_in_block(np.frombuffer(r.q_ids, np.int64), _postings(r.q_rows, r.q_terms, r.q_weights), np.frombuffer(r.ids, np.int64), post, k).assign(query_slot=r.q_group)

    best = candidates.join(meet, "slot").mapInPandas(score, _BEST)
    order = Window.partitionBy("query_slot", "query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sparse_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, F.col("id") % 50 == 0)


QUERIES = {"op3_topk": op3_topk}
ORACLES = {
    "op3_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER () AS query_row FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.query_row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM n q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
}
