"""Periodic runs of words: maximal stretches that repeat themselves at least twice.

Which words can stand in a run is known before any run is: a run of ``least`` words
or more repeats each of its word groups of ``least // 2`` at the distance of its
period, so runs lie whole inside stretches of words whose groups occur twice in the
text. Only stretches go further, those of many texts side by side.

Method: the first phase of Baier's suffix sorter. Suffixes are grouped by a prefix
that grows; groups are taken from the highest down, and the nearest lower suffix
before each member has the member's prefix appended to its own. When a suffix is
taken, its prefix is the longest Lyndon word that begins there. Done under the order
of the words and under its inverse, this gives both Lyndon arrays; each run has a
Lyndon root in one of them, which common extensions to both sides (in ranks of blocks
of doubled length) stretch into the run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchwell.llm.common import table
from watchwell.llm.words import mix

#: Words of texts that are looked at side by side; a longer text is looked at alone.
_BATCH_WORDS = 60_000
_SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def split_words(key, text: str | None) -> list[bytes]:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text, as UTF-8; none of a null."""
    return text.encode().split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers of the words of one text, from 1, equal for equal words."""
    at = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    return np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))


def stretches(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the stretches that can hold runs of ``least`` words or more.

    words: numbers of the words of several texts, one after another; ends: where each
    text ends. Groups of words are compared by 64-bit hashes: equal hashes of
    different groups only make a stretch longer than need be.
    """
    none, group = np.zeros(0, dtype=np.int64), max(1, least // 2)
    if len(words) < group:
        return none, none
    text = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(ends, prepend=0))
    mixed, many = mix(words.astype(np.uint64) + np.uint64(1)), len(words) - group + 1
    hashes = mix(text[:many] + np.uint64(0x9E3779B9))
    for i in range(group):
        hashes = mix(hashes + mixed[i : i + many])
    inside = np.flatnonzero(text[:many] == text[group - 1 :])
    order = inside[np.argsort(hashes[inside], kind="stable")]
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else none
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, twice, 1)
    np.add.at(depth, twice + group, -1)
    covered = np.cumsum(depth[:-1]) > 0
    # Groups don't reach over the end of a text, but covered words of two texts may touch.
    begins = covered & np.concatenate([[True], ~covered[:-1] | (text[1:] != text[:-1])])
    stops = covered & np.concatenate([~covered[1:] | (text[1:] != text[:-1]), [True]])
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = last - first >= least
    return first[long], last[long]


def lyndon_array(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each place; 0 at separators.

    symbols: numbers from 1, with 0 (below all others) before each part and at the end.
    Each place is taken once and moved once for each place taken after it that it is
    the nearest lower one of: linear but for the search of that place, which shares
    paths.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    ordered = symbols[sa]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    group = np.empty(n, dtype=np.int64)
    group[sa] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    place = np.empty(n, dtype=np.int64)
    place[sa] = np.arange(n)
    zeros = int(np.searchsorted(ordered, 1))
    # Plain lists: single places are read and written from here on.
    start, end, prefix = begin.tolist(), np.append(begin[1:], n).tolist(), [1] * len(begin)
    sa, group, place, below, out = sa.tolist(), group.tolist(), place.tolist(), list(range(n)), [0] * n
    parts, top = set(sa[:zeros]), n
    while top > zeros:
        g = group[sa[top - 1]]
        length, first = prefix[g], start[g]
        members, top = sa[first:top], first
        for i in members:
            below[i] = i - 1
            out[i] = length
        counts: dict[int, int] = {}
        for i in members:
            root = below[i]
            while below[root] != root:
                root = below[root]
            while i != root:
                below[i], i = root, below[i]
            counts[root] = counts.get(root, 0) + 1
        # Of one old group those that get the prefix more often are higher.
        kinds = set(counts.values())
        for k in sorted(kinds, reverse=True):
            fresh: dict[int, int] = {}
            for p, many in counts.items():
                if many != k or p in parts:
                    continue
                old = group[p]
                end[old] = e = end[old] - 1
                other, a = sa[e], place[p]
                sa[a], place[other], sa[e], place[p] = other, a, p, e
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(start)
                    start.append(e)
                    end.append(e + 1)
                    prefix.append(prefix[old] + k * length)
                else:
                    start[new] = e
                group[p] = new
    return np.array(out, dtype=np.int64)


class Extensions:
    """Longest common extensions of two places of a sequence, to the right and to the left.

    Blocks of 1, 2, 4, ... symbols have ranks that are equal for equal blocks.
    """

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n, self.ranks = len(symbols), [symbols.astype(np.int32)]
        while 2 ** len(self.ranks) <= min(longest, self.n):
            half, last = 2 ** (len(self.ranks) - 1), self.ranks[-1].astype(np.int64)
            pairs = last[: self.n - 2 * half + 1] * (int(last.max()) + 1) + last[half : self.n - half + 1]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols from i and from j on (i below j)."""
        out = np.zeros_like(i)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, a, b = self.ranks[k], i + out, j + out
            at = np.flatnonzero(b < len(rank))
            at = at[rank[a[at]] == rank[b[at]]]
            out[at] += 2**k
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols before i and before j (i below j)."""
        out = np.zeros_like(i)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, a, b = self.ranks[k], i - out - 2**k, j - out - 2**k
            at = np.flatnonzero(a >= 0)
            at = at[rank[a[at]] == rank[b[at]]]
            out[at] += 2**k
        return out


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``least`` words or more, by start, then period.

    words, ends: as for stretches(); starts count from the first word of all.
    """
    first, last = stretches(words, ends, least)
    if not len(first):
        return np.zeros((0, 3), dtype=np.int64)
    sizes = last - first
    begin = np.cumsum(sizes + 1) - sizes  # in the joined stretches, a separator before each
    at = np.repeat(first - begin, sizes)
    kept = np.arange(len(at)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)
    n = int(sizes.sum()) + len(sizes) + 1
    origin = np.full(n, -1, dtype=np.int64)
    origin[kept] = kept + at
    _, dense = np.unique(words[origin[kept]], return_inverse=True)
    up = np.zeros(n, dtype=np.int64)
    up[kept] = dense + 1
    down = np.zeros(n, dtype=np.int64)
    down[kept] = dense.max() + 1 - dense
    apart = up.copy()
    gaps = np.flatnonzero(origin < 0)
    apart[gaps] = dense.max() + 2 + np.arange(len(gaps))
    common, found = Extensions(apart, int(sizes.max())), []
    for order in (up, down):
        period = lyndon_array(order)
        i = np.flatnonzero((period > 0) & (np.arange(n) + period < n))
        # The root must come again at once, before it or behind it, in part at least.
        i = i[(apart[i] == apart[i + period[i]]) | (apart[i - 1] == apart[i + period[i] - 1])]
        p = period[i]
        left, right = common.left(i, i + p), common.right(i, i + p)
        length = left + p + right
        whole = (length >= 2 * p) & (length >= least)
        found.append(np.stack([origin[(i - left)[whole]], length[whole], p[whole]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Of n words, those that no run holds after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12, words: Callable[[object, str | None], list[bytes]] = split_words) -> DataFrame:
    """Per row of docs: key, n_words, runs (by start, then period) and collapsed (the text without its repeats).

    runs: all maximal runs of the smallest period q with max(least, 2 * q) words or
    more. collapsed: the words that no run holds after its first q words, joined by one
    space. ``words`` makes the words of a row from its key and its text.

    A null or empty text has no words, no runs and an empty collapsed text; rows that
    repeat a key are each looked at; other columns are left out. Whole texts, however
    long: rows stay where they are (no shuffle), a task holds the words of one text and
    about 300 bytes for each word of its repeated stretches.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

        def of(keys: pa.Array, lists: list[list[bytes]]) -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in lists])
            found = find_runs(np.concatenate([numbered(x) for x in lists]), ends, least)
            first = np.searchsorted(found[:, 0], ends - [len(x) for x in lists])
            cut = np.append(first, len(found))
            texts = []
            for i, x in enumerate(lists):
                own = found[cut[i] : cut[i + 1]]
                if len(own):
                    own[:, 0] -= ends[i] - len(x)
                    x = compress(x, kept_words(len(x), own).tolist())
                texts.append(b" ".join(x).decode())
            rows = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(3)], fields=list(struct))
            runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), rows)
            return pa.RecordBatch.from_arrays([keys, pa.array([len(x) for x in lists], pa.int64()), runs, pa.array(texts, pa.string())], names=[key, "n_words", "runs", "collapsed"])

        for batch in batches:
            lists, many, a = [], 0, 0
            for b in range(batch.num_rows):
                lists.append(words(batch.column(0)[b].as_py(), batch.column(1)[b].as_py()))
                many += len(lists[-1])
                if many >= _BATCH_WORDS or b + 1 == batch.num_rows:
                    yield of(batch.column(0).slice(a, b + 1 - a), lists)
                    lists, many, a = [], 0, b + 1

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, {_SCHEMA}")


def folded(key, text: str | None) -> list[bytes]:
    """Words of a document for the query: in one of ten documents the tail repeats itself."""
    words, h = split_words(key, text), zlib.crc32(str("" if key is None else key).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), words=folded)
    better = lambda a, b: F.when((b["length"] > a["length"]) | ((b["length"] == a["length"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"])))), b).otherwise(a)
    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_runs": op11_runs}
ORACLES: dict[str, str] = {}
