"""Prefix trie of conversations: which beginnings they share, how often, at what saving.

A turn is known by 16 bytes of a digest of its role and text, so a conversation is a
string of fixed-width big-endian ids and texts never leave the scan. Each task puts
its conversations into adaptive radix trees over these bytes and gives one row for
each depth that is a whole number of turns, with the counts of its own conversations.
Rows of one node are then added up: a beginning that a third of all conversations
share comes as one row of each tree, not as one of each conversation. What lies
below a node is summed the same way: each node is put into the tree of the
conversation that owns it (its smallest member), once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchwell.llm.common import bucket_of, stored, table

#: Bytes of the id of a turn.
WIDTH = 16
#: Bytes of ids in one tree of a task.
_TREE_BYTES = 4 << 20
#: conv_ids whose texts are joined in one group.
_BLOCK = 4096


class _Few:
    """A layout of up to 4, or up to 16, children: sorted bytes beside the children."""

    def __init__(self, size: int = 4):
        self.size, self.bytes, self.kids = size, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid: _Node):
        if len(self.kids) == self.size:
            more = _Few(16) if self.size == 4 else _Some()
            for b, k in self.items():
                more.put(b, k)
            return more.put(byte, kid)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def items(self) -> Iterator[tuple[int, _Node]]:
        return zip(self.bytes, self.kids, strict=True)


class _Some:
    """A layout of up to 48 children: 256 one-byte indices into the children."""

    def __init__(self):
        self.index, self.kids = bytearray(256), []

    def get(self, byte: int):
        at = self.index[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid: _Node):
        if len(self.kids) == 48:
            more = _All()
            for b, k in self.items():
                more.put(b, k)
            return more.put(byte, kid)
        self.kids.append(kid)
        self.index[byte] = len(self.kids)
        return self

    def items(self) -> Iterator[tuple[int, _Node]]:
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.index) if at)


class _All:
    """A layout of 256 children."""

    def __init__(self):
        self.kids: list[_Node | None] = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid: _Node):
        self.kids[byte] = kid
        return self

    def items(self) -> Iterator[tuple[int, _Node]]:
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class _Node:
    """The bytes that all keys below share, the value of the key that ends after them, and children by the next byte."""

    __slots__ = ("kids", "path", "value")

    def __init__(self, path: bytes, value=None, kids=None):
        self.path, self.value, self.kids = path, value, kids


def _shared(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of path are those of key from ``at`` on."""
    lo, hi = 0, min(len(path), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if key.startswith(path[lo:mid], at + lo):
            lo = mid
        else:
            hi = mid - 1
    return lo


class RadixTree:
    """An adaptive radix tree; a key may be the beginning of another."""

    def __init__(self):
        self.root = _Node(b"")

    def insert(self, key: bytes, value, add) -> None:
        """Put ``value`` under key; where there is one, add(old, value)."""
        node, at = self.root, 0
        while True:
            if not key.startswith(node.path, at):
                same = _shared(node.path, key, at)
                rest = _Node(node.path[same + 1 :], node.value, node.kids)
                node.kids = _Few().put(node.path[same], rest)
                node.path, node.value = node.path[:same], None
            at += len(node.path)
            if at == len(key):
                node.value = value if node.value is None else add(node.value, value)
                return
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                node.kids = (node.kids or _Few()).put(key[at], _Node(key[at + 1 :], value))
                return
            node, at = kid, at + 1

    def nodes(self, width: int = WIDTH) -> list[list]:
        """[depth, digest, place of the parent, last id, value] at each depth that is a multiple of ``width`` bytes.

        Parents come before children, the root first (with an empty id). The digest is
        the beginning of the SHA-256 of all bytes down to the node.
        """
        start = hashlib.sha256()
        out, stack = [[0, start.digest()[:width], -1, b"", None]], [(self.root, b"", 0, start)]
        while stack:
            node, before, parent, so_far = stack.pop()
            path = before + node.path
            for a in range(0, len(path) - width + 1, width):
                so_far = so_far.copy()
                so_far.update(path[a : a + width])
                out.append([out[parent][0] + 1, so_far.digest()[:width], parent, path[a : a + width], None])
                parent = len(out) - 1
            out[parent][4] = node.value if node.value is not None else out[parent][4]
            if node.kids:
                rest = path[len(path) - len(path) % width :]
                stack += [(k, rest + bytes((b,)), parent, so_far) for b, k in node.kids.items()]
        return out


def _trees(batches: Iterator, value, add) -> Iterator[tuple[RadixTree, list[dict]]]:
    """Trees of about _TREE_BYTES of keys each, with the rows in them."""
    tree, rows, size = RadixTree(), [], 0
    for batch in batches:
        for row in batch.to_pylist():
            tree.insert(row["key"], value(row), add)
            rows.append(row)
            size += len(row["key"]) + 64
            if size >= _TREE_BYTES:
                yield tree, rows
                tree, rows, size = RadixTree(), [], 0
    if rows:
        yield tree, rows


def _count_members(batches: Iterator) -> Iterator:
    """Nodes of conversations (conv_id, key, sizes): members and the smallest of them, tree by tree."""
    import pyarrow as pa

    for tree, rows in _trees(batches, lambda r: (1, r["conv_id"]), lambda a, b: (a[0] + b[0], min(a[1], b[1]))):
        size_of = {r["key"][WIDTH * i : WIDTH * (i + 1)]: n for r in rows for i, n in enumerate(r["sizes"])}
        nodes = tree.nodes()
        many, least = [v[0] if v else 0 for *_, v in nodes], [v[1] if v else None for *_, v in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            p = nodes[i][2]
            many[p] += many[i]
            least[p] = least[i] if least[p] is None else min(least[p], least[i])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[1] for x in nodes], pa.binary()),
                pa.array([nodes[x[2]][1] if x[2] >= 0 else None for x in nodes], pa.binary()),
                pa.array([x[0] for x in nodes], pa.int64()),
                pa.array([size_of[x[3]] if x[3] else 0 for x in nodes], pa.int64()),
                pa.array(many, pa.int64()),
                pa.array(least, pa.int64()),
            ],
            names=["node", "parent", "depth", "size", "n_convs", "conv_id"],
        )


def _sum_below(batches: Iterator) -> Iterator:
    """Sums of each node's subtree, over nodes that the conversations (key, own: node, leaf, saved) own."""
    import pyarrow as pa

    for tree, rows in _trees(batches, lambda r: True, lambda a, b: a):
        own = {x["node"]: (x["leaf"], x["saved"]) for r in rows for x in r["own"]}
        nodes = tree.nodes()
        leaves, saved = ([own.get(x[1], (0, 0))[k] for x in nodes] for k in (0, 1))
        for i in range(len(nodes) - 1, 0, -1):
            leaves[nodes[i][2]] += leaves[i]
            saved[nodes[i][2]] += saved[i]
        yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in nodes], pa.binary()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], names=["node", "n_leaves", "saved_tokens"])


def _digests(batches: Iterator) -> Iterator:
    """SHA-256 of the pieces of each node, which come sorted by node and block."""
    import pyarrow as pa

    node, running = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["node"] != node:
                if running is not None:
                    done.append((node, running.hexdigest()))
                node, running = row["node"], hashlib.sha256(row["piece"].encode())
            else:
                running.update(b"," + row["piece"].encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in ((0, pa.binary()), (1, pa.string()))], names=["node", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], names=["node", "ends_sha256"])


def turn_ids(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, id, size) of rows (conv_id, turn, role, text): id as hex digits, size in bytes of the text.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation
    and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.left(F.sha2(F.concat_ws(":", F.length(role), role, text), 256), F.lit(2 * WIDTH))
    return rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), digest.alias("id"), F.octet_length(text).alias("size"))


def sequences(ids: DataFrame, family: Column | None = None) -> DataFrame:
    """(family, conv_id, turns: array of (id, size)) in order of turn (null first), then role, then id.

    Conversations of one family (conv_id, unless given) come to one place.
    """
    rows = ids.withColumn("family", F.col("conv_id") if family is None else family).repartition("family")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "id", "size")))
    return rows.groupBy("family", "conv_id").agg(F.transform(turns, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct beginning of conversations (conv_id, turns: array of (id, size)).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves and saved_tokens (of the subtree, the node included),
    ends_sha256 (of the members that end at the node). Each conv_id stands in one row.

    Equal conversations are members of the same nodes; empty turn lists end at the
    root; without conversations there are no nodes. A task holds one tree of a few MB,
    or the ids of one conversation. The members that end at one node are hashed one
    after another, as SHA-256 asks for, from blocks of texts.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = stored(rows.withColumn("node", F.unhex(F.left(F.sha2("key", 256), F.lit(2 * WIDTH)))), "turn-keys")
    found = rows.select("conv_id", "key", "sizes").mapInArrow(_count_members, "node binary, parent binary, depth long, size long, n_convs long, conv_id long")
    nodes = found.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = stored(nodes, "turn-nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(kids, "node", "left").fillna(0, ["n_children"])

    own = F.struct("node", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    owners = counted.groupBy("conv_id").agg(F.collect_list(own).alias("own"))
    below = rows.select("conv_id", "key").join(owners, "conv_id").select("key", "own").mapInArrow(_sum_below, "node binary, n_leaves long, saved_tokens long")
    below = below.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    # At most 1,000 nodes have a thousandth of all nodes as children each: their children find them by broadcast.
    limit = nodes.count() / 1000
    parent = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    busy = F.broadcast(kids.filter(F.col("n_children") > limit).select(F.col("node").alias("parent")))
    children = nodes.filter("depth > 0").select("node", "parent")
    of_busy = children.join(F.broadcast(parent.join(busy, "parent", "left_semi")), "parent")
    of_others = children.join(busy, "parent", "left_anti").join(parent, "parent")
    parents = of_busy.unionByName(of_others).select("node", "parent_conv_id")

    texts = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = rows.groupBy("node", F.floor(F.col("conv_id") / _BLOCK).alias("block")).agg(F.array_join(texts, ",").alias("piece"))
    ends = pieces.repartition("node").sortWithinPartitions("node", "block").select("node", "piece").mapInArrow(_digests, "node binary, ends_sha256 string")

    whole = counted.join(below, "node").join(parents, "node", "left").join(ends, "node", "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt(ids: DataFrame) -> DataFrame:
    """Conversations for the query: each begins with turns of the first one of its five."""
    own = sequences(ids, F.col("conv_id") - F.col("conv_id") % 5)
    heads = own.filter("conv_id = family").select("family", F.col("turns").alias("head"))
    h = bucket_of(F.col("conv_id"), 9).cast("int")
    begin = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return own.join(heads, "family", "left").select("conv_id", F.concat(begin, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_ids(table(spark, sf_dir, "conversations"))))


# crc32 in SQL: a table of 256 steps by its rule, then digit by digit.
_SQL = """
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
crc(c, s, v) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 4294967295::UBIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT c, substr(s, 2), xor(v >> 8, t[(1 + (xor(v, ascii(s)::UBIGINT) & 255))::BIGINT]) FROM crc, crc_table WHERE s <> ''),
h AS (SELECT c, (xor(v, 4294967295::UBIGINT) % 9)::BIGINT AS h FROM crc WHERE s = ''),
turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, octet_length(encode(coalesce(text, ''))) AS size,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, id) - 1 AS n FROM turns),
built AS (
  SELECT h.c, o.n, o.id, o.size FROM h JOIN own o ON o.c = h.c - h.c % 5 AND o.n < h.h
  UNION ALL SELECT h.c, o.n, o.id, o.size FROM h JOIN own o ON o.c = h.c AND o.n >= h.h),
placed AS (SELECT c, id, size, row_number() OVER (PARTITION BY c ORDER BY n) AS d FROM built),
paths AS (
  SELECT c, d, size, string_agg(id, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM h),
nodes AS (SELECT p, d, min(c) AS c, count(*) AS n, any_value(size) AS size FROM paths GROUP BY p, d),
kids AS (SELECT left(p, length(p) - 64) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
ends AS (
  SELECT p, string_agg(c::VARCHAR, ',' ORDER BY c) AS e FROM paths x
  WHERE d = (SELECT max(d) FROM paths y WHERE y.c = x.c) GROUP BY p),
below AS (
  SELECT a.p, count(*) FILTER (k.n IS NULL) AS leaves, sum((b.n - 1) * b.size) AS saved
  FROM nodes a JOIN nodes b ON starts_with(b.p, a.p) LEFT JOIN kids k ON k.p = b.p GROUP BY a.p)
SELECT a.c::BIGINT AS conv_id, a.d::BIGINT AS depth, u.c::BIGINT AS parent_conv_id, a.n::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM nodes a JOIN below USING (p) LEFT JOIN kids k USING (p) LEFT JOIN ends USING (p)
LEFT JOIN nodes u ON a.d > 0 AND u.p = left(a.p, length(a.p) - 64)"""

QUERIES = {"op13_turn_trie": op13_turn_trie}
ORACLES = {"op13_turn_trie": _SQL.strip()}
