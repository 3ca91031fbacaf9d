import itertools
import random
import re

import numpy as np
import pytest

from watchwell.llm import packing


def waste(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(25))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
    counts = [rng.randint(1, 20) for _ in lengths]
    for k in range(1, 6):
        got = packing.optimal_bounds(np.array(lengths), np.array(counts), k)
        best = min(waste(lengths, counts, [*some, lengths[-1]]) for n in range(k) for some in itertools.combinations(lengths[:-1], n))
        assert len(got) <= k and got[-1] == lengths[-1] and waste(lengths, counts, got) == best


def test_batches(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.8) * 3 % 900))) for i in range(700)] + [(None, None), (5, ""), (5, "a\tb\x0bc  d\n"), (9999, "x " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(5)
    got = packing.pack(df, buckets=5, budget=1000, group_rows=50).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if d is None else d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1) for d, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    lengths, counts = np.unique([n for _, n in want], return_counts=True)
    bounds = packing.optimal_bounds(lengths, counts, 5)
    places = {}
    for r in got:
        assert r.padded == bounds[r.bucket] >= r.n_tokens and (r.bucket == 0 or bounds[r.bucket - 1] < r.n_tokens)
        places.setdefault((r.bucket, r.batch), []).append(r.slot)
    for (bucket, batch), slots in places.items():
        room = max(1, 1000 // bounds[bucket])
        last = max(b for k, b in places if k == bucket)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= room and (len(slots) == room or batch == last)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
