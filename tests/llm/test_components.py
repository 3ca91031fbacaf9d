"""Components against union-find."""

import random

import pytest

from watchwell.llm.components import components


@pytest.mark.parametrize("kind", ["random", "path", "hub", "grid", "none"])
def test_labels_are_the_smallest_reachable_nodes(spark, kind):
    chance = random.Random(kind)
    if kind == "path":
        order = chance.sample(range(200), 200)
        edges = list(zip(order, order[1:]))
    elif kind == "hub":
        edges = [(7, i) for i in range(8, 150)] + [(500, 501), (501, 7)] + [(900, 900)]
    elif kind == "grid":
        edges = [(20 * i + j, 20 * i + j + 1) for i in range(12) for j in range(19)] + [(20 * i, 20 * i + 20) for i in range(0, 11, 2)]
    else:
        edges = [(chance.randrange(300), chance.randrange(300)) for _ in range(200 if kind == "random" else 0)]
    edges += edges[:10] + [(b, a) for a, b in edges[:10]]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        root[hi] = lo
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in found) == sorted((x, top(x)) for x in root)
