"""The conversation trie against a dictionary of every beginning."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from watchwell.llm import turn_trie as tt


def brute(paths):
    """paths: conv_id -> list of (turn, size); the rows of prefix_trie()."""
    members, sizes = {}, {(): 0}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(t for t, _ in turns[:d]), []).append(c)
            if d:
                sizes[tuple(t for t, _ in turns[:d])] = turns[d - 1][1]
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in convs if len(paths[c]) == len(p))
        out.append(
            (min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(kids[p]), sum(not kids[q] for q in below),
             sum((len(members[q]) - 1) * sizes[q] for q in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        )
    return sorted(out, key=lambda r: (r[0], r[1]))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def test_tree_holds_every_beginning():
    chance = random.Random(3)
    for alphabet in (2, 40, 256):
        keys = {bytes(chance.randrange(alphabet) for _ in range(2 * chance.choice([0, 1, 1, 2, 3, 5]))): None for _ in range(600)}
        tree = tt.RadixTree()
        for k in keys:
            tree.insert(k, 1, lambda a, b: a + b)
        for k in list(keys)[:50]:
            tree.insert(k, 1, lambda a, b: a + b)
        nodes, paths, values = tree.nodes(2), {}, {}
        for i, (depth, digest, parent, unit, value) in enumerate(nodes):
            paths[i] = paths[parent] + unit if parent >= 0 else b""
            assert depth == len(paths[i]) // 2 and digest == hashlib.sha256(paths[i]).digest()[:2] and parent < i
            if value is not None:
                values[paths[i]] = value
        assert sorted(paths.values()) == sorted({k[:d] for k in keys for d in range(0, len(k) + 1, 2)} | {b""})
        assert values == {k: 2 if i < 50 else 1 for i, k in enumerate(keys)}


def test_layouts_grow():
    tree, kinds = tt.RadixTree(), []
    for b in range(256):
        tree.insert(bytes([b, 0]), b, lambda x, y: y)
        kinds.append((type(tree.root.kids).__name__, getattr(tree.root.kids, "size", 0)))
    assert [kinds.index(k) for k in dict.fromkeys(kinds)] == [0, 4, 16, 48]
    assert [n[4] for n in tree.nodes(2)[1:]].count(None) == 0


@pytest.mark.parametrize("tree_bytes", [1, 500, 1 << 20])
def test_trie_equals_a_dictionary_of_beginnings(spark, monkeypatch, tree_bytes):
    monkeypatch.setattr(tt, "_BLOCK", 7)
    chance, paths = random.Random(tree_bytes), {}
    for c in range(-5, 90):
        other = list(paths.get(chance.randrange(-5, 90), []))
        paths[c] = other[: chance.randint(0, 6)] + [(f"{chance.choice('ab')}{i}", i) for i in range(chance.choice([0, 0, 1, 2, 4]))]
    rows = [(c, [(hashlib.sha256(t.encode()).hexdigest()[:32], n) for t, n in turns]) for c, turns in paths.items()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = spark.createDataFrame(rows, "conv_id long, turns array<struct<id: string, size: int>>").repartition(3)
        whole = tt.prefix_trie(given.unionByName(given.limit(0)))
        assert rows_of(whole) == brute(paths)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_trees_add_up():
    """Tasks that cut their conversations into many trees give the same sums."""
    import pyarrow as pa

    keys = [b"a" * 16, b"a" * 16 + b"b" * 16, b"", b"a" * 16]
    batch = pa.RecordBatch.from_pylist([{"conv_id": i, "key": k, "sizes": [3] * (len(k) // 16)} for i, k in enumerate(keys)])
    total = {}
    for rows in tt._count_members(iter([batch, batch.slice(0, 0)])):
        for r in rows.to_pylist():
            total[r["depth"]] = total.get(r["depth"], 0) + r["n_convs"]
    assert total == {0: 4, 1: 3, 2: 1}


def rebuilt(rows):
    """The query's conversations; equal turns come by role, then by digest."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", digest, text or ""))
    turns = {c: [((role, text), len(text.encode())) for _, _, role, _, text in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
    return {c: turns.get(c - int(math.fmod(c, 5)), [])[: h[c]] + t[h[c] :] for c, t in turns.items()}


def test_query_equals_brute_force_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = rows_of(tt.op13_turn_trie(spark, folder))
    assert found == brute(rebuilt([tuple(r) for r in rows]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert sorted(con.sql(tt.ORACLES["op13_turn_trie"]).fetchall(), key=lambda r: r[:2]) == found


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [
        (0, None, "user", "é"), (0, 1, None, "x" * 3_000_000), (0, 1, None, None), (0, None, "user", "é"), (1, 0, "", ""), (1, 5, "user", "é"),
        (7, 2, "user", "a"), (7, 1, "user", "b"), (8, 2, "user", "a"), (8, 1, "user", "b"), (None, 1, "user", "b"), (-3, 0, "user:", "a"),
    ]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit(1), "size": F.lit(2), "family": F.lit(3), "node": F.lit(4)})
    assert rows_of(tt.prefix_trie(tt.rebuilt(tt.turn_ids(given)))) == brute(rebuilt(rows))
    assert tt.prefix_trie(tt.rebuilt(tt.turn_ids(given.limit(0)))).collect() == []
