"""Near duplicates by Order MinHash over five-word shingles.

Every text is cut into shingles of ``K`` lower-cased words, each labelled by its
occurrence number in the text. A sketch takes, for each of ``SKETCHES`` hash
functions, the ``PICK`` shingles with the smallest values and keeps them in the
order of the text: texts whose shingles agree in another order don't meet. Texts
that agree in a sketch entry are candidates. A candidate pair is verified by
banded alignment: shingles that both texts hold are matched inside the band of
shifts which a pair over the threshold can have, and the longest chain in the
order of both texts aligns the words that its shingles cover. The similarity is that
of the texts as edited words: aligned words / words of the longer text. A changed
word takes five shingles away but one word only. Pairs from ``threshold`` (0.8) on
that also have ``SHARED`` (0.4) of all their shingles in common are links, and
connected texts form a class.

A pair with a share x of common shingles meets in a given entry with probability
x ** 5, so one at 0.6 escapes all 40 with probability 0.04, at 0.7 with 6e-4, at 0.8
with 1e-7; one at 0.3 meets with probability 0.09. Words changed here and there leave
0.6 of the shingles where 1 in 18 is, and 0.7 where 1 in 27 is. Texts of at most
``SHORT`` shingles have entries of fewer picks instead (24 of 3), those of 20 to 24
have both kinds, and those of at most ``TINY`` also 12 of a single pick.

Before texts are compared, a pair must pass bounds that its nodes carry: the
lengths, and two parity signatures of ``BITS`` bits, of the shingles and of the words
with the number of their occurrence. Each flips one bit, so two signatures differ in
no more bits than shingles, or words, that only one text has. Of shingles, a pair with
``SHARED`` in common has 3 (n_a + n_b) / 7 such at most; of words, w_a + w_b less twice
0.8 of the longer text's. For short texts this never loses a pair; where a signature
fills up, a pair goes only if it differs by six standard deviations more than it should
(1e-9). Texts that share a long passage fail by their words.

Members of buckets that hold several components must also pass a bound of their
own before they are paired: the words that are covered by shingles which a member
of another component has too. A link aligns no others, so a text of which less than
0.8 is covered has no link, and a pair has none if the smaller cover is less than 0.8
of the longer text. So texts around one passage that are too long for it go one by
one, in rows that grow with the texts and not with their pairs. For this, texts are cut
into stretches of about ``STRETCH`` shingles where a shingle's hash says so: a passage
is cut alike in all texts, and of equal stretches only one is laid out in shingles. That
makes a row for each stretch of a text and a row for each shingle of different
stretches, at most.

Large groups: equal texts are one node. First all members of each bucket are
compared with one centre, the member that meets most others; so a group of near
copies of one text grows together. Then, in turns, buckets that still hold several
components take more and more centres (``GROWTH`` times as many each turn), which
are compared with all members of other components and leave the bucket, until no
bucket is mixed. Nothing within a component is compared again, as it can't change a
class; a pair is compared in one of its buckets only; no pair that meets and could
reach the threshold is left out.

Edge cases: null and empty texts are equal texts; texts under five words have one
shingle, their words; rows without a doc_id are no documents here and get no
class (null); rows that share a doc_id are one document, whose texts all count;
other columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchwell.llm import words as W
from watchwell.llm.common import stored, table
from watchwell.llm.components import components

K, SKETCHES, PICK = 5, 40, 5
#: Share of common shingles that a link has at least.
SHARED = 0.4
#: Texts of up to so many shingles have the short entries; those of over LONG the others.
SHORT, LONG, SHORT_SKETCHES, SHORT_PICK = 24, 19, 24, 3
#: Texts of up to so many shingles have entries of one pick too.
TINY, TINY_SKETCHES = 6, 12
BITS, GROWTH = 1024, 64
#: Shingles of a stretch, about.
STRETCH = 16
#: Code points that are worked on in one go.
UNITS = 1 << 17
_WEIGHTS = np.array([int(xxhash.xxh3_64_intdigest(b"w%d" % i)) | 1 for i in range(K)], dtype=np.uint64)
_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"s%d" % i) for i in range(64)], dtype=np.uint64)
_A, _B = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _labelled(s: np.ndarray) -> np.ndarray:
    """Hashes with the number of their occurrence, so that no two are equal."""
    ranked = np.sort(s)
    if np.any(ranked[1:] == ranked[:-1]):
        order = np.argsort(s, kind="stable")
        ranked = s[order]
        fresh = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        nth = np.empty(len(s), dtype=np.uint64)
        nth[order] = np.arange(len(s)) - np.repeat(fresh, np.diff(np.append(fresh, len(s))))
        s = np.where(nth > 0, W.mix(s + nth), s)
    return s


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of a text's word hashes, in text order."""
    if len(h) <= K:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], dtype=np.uint64)
    n = len(h) - K + 1
    s = h[:n] * _WEIGHTS[0]
    for j in range(1, K):
        s += h[j : n + j] * _WEIGHTS[j]
    return _labelled(W.mix(s))


def word_lists(texts: list[str]) -> Iterator[np.ndarray]:
    """The word hashes of every text."""
    lower = [t.lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lower])])
    for a, b in W.slices(offsets, UNITS):
        units, at = W.code_points(lower[a:b])
        starts, ends, first = W.spans(units, at, W.word_points())
        h = W.hashes(units, starts, ends)
        for i in range(b - a):
            yield h[first[i] : first[i + 1]]


def shingle_lists(texts: list[str]) -> Iterator[np.ndarray]:
    """The shingles of every text."""
    return map(_shingles, word_lists(texts))


def shingles(text: str | None) -> np.ndarray:
    """The shingles of one text."""
    return next(shingle_lists([text or ""]))


def _entries(s: np.ndarray, count: int, pick: int) -> np.ndarray:
    """One key per hash function: its ``pick`` smallest shingles, in text order."""
    pick, rows, small = min(pick, len(s)), max(1, 1_000_000 // len(s)), (s >> np.uint64(32)).astype(np.uint32)
    keys = []
    for at in range(0, count, rows):
        seeds = _SEEDS[at : min(at + rows, count)]
        if len(s) > pick:
            values = small[None, :] ^ seeds.astype(np.uint32)[:, None]
            values *= _A
            values ^= values >> np.uint32(15)
            values *= _B
            best = np.argpartition(values, pick - 1, axis=1)[:, :pick]
            best.sort(axis=1)
        else:
            best = np.tile(np.arange(pick), (len(seeds), 1))
        key = seeds + np.uint64(pick)
        for j in range(pick):
            key = W.mix(key ^ s[best[:, j]])
        keys.append(key)
    return np.concatenate(keys)


def sketch(s: np.ndarray) -> np.ndarray:
    """The sketch entries of a text's shingles."""
    keys = []
    if len(s) > LONG:
        keys.append(_entries(s, SKETCHES, PICK))
    if len(s) <= SHORT:
        keys.append(_entries(s, SHORT_SKETCHES, SHORT_PICK))
    if len(s) <= TINY:
        keys.append(_entries(s, TINY_SKETCHES, 1))
    return np.concatenate(keys).view(np.int64)


def signature(s: np.ndarray) -> np.ndarray:
    """The parities of BITS counters of shingles, as 64-bit integers."""
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _chain(line: np.ndarray) -> np.ndarray:
    """Places of a longest increasing run of ``line``."""
    if np.all(line[1:] > line[:-1]):
        return np.arange(len(line))
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, x in enumerate(line.tolist()):
        i = bisect_left(ends, x)
        ends[i : i + 1], last[i : i + 1] = [x], [k]
        before.append(last[i - 1] if i else -1)
    out, k = [], last[-1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return np.array(out[::-1])


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = 0.8) -> float:
    """Aligned words / words of the longer text, from shingle lists; 0 if the pair is no link."""
    longer, total = max(len(a), len(b)) + K - 1, len(a) + len(b)
    if min(len(a), len(b)) + K - 1 < threshold * longer - 1e-9:
        return 0.0
    least = int(np.ceil(SHARED / (1 + SHARED) * total - 1e-9))
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(at_a - at_b) <= (1 - threshold) * longer + 1e-9
    at_a, at_b = at_a[inside], at_b[inside]
    if len(at_a) < least or not len(at_a):
        return 0.0
    order = np.argsort(at_a)
    chain = order[_chain(at_b[order])]
    if len(chain) < least:
        return 0.0
    covered = min(K + int(np.minimum(K, np.diff(at[chain])).sum()) for at in (at_a, at_b))
    return covered / longer if covered >= threshold * longer - 1e-9 else 0.0


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, w, keys, bits) of docs (doc_id, text): text hash, shingles, words, sketch entries, signatures of shingles and of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), 256):
                batch = whole.iloc[a : a + 256]
                n, w, keys, bits = [], [], [], []
                for words in word_lists(batch["text"].tolist()):
                    s = _shingles(words)
                    n.append(len(s))
                    w.append(len(words))
                    keys.append(sketch(s))
                    bits.append(np.concatenate([signature(s), signature(_labelled(words))]))
                h = [hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in batch["text"]]
                yield pd.DataFrame({"doc_id": batch["doc_id"], "h": h, "n": n, "w": w, "keys": keys, "bits": bits})

    return docs.mapInPandas(run, "doc_id long, h binary, n int, w int, keys array<long>, bits array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links among pairs (a, b): texts (node, text) compared by alignment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, one = None, None
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch, good = whole.iloc[at : at + 256], []
                for a, ta, two in zip(batch["a"], batch["text_a"], shingle_lists(batch["text_b"].tolist()), strict=True):
                    if a != held:
                        held, one = a, shingles(ta)
                    good.append(similarity(one, two, threshold) > 0)
                yield batch.loc[good, ["a", "b"]]

    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    # The centre, a, last: its rows arrive sorted by it.
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def possible(a: str, b: str, threshold: float) -> Column:
    """Whether rows a and b (n, w, bits) can be similar, by their lengths and signatures."""
    n, m, v, w = (F.col(f"{x}.{c}") for c in "nw" for x in (a, b))
    words = BITS // 64

    def fits(first: int, single: Column) -> Column:
        """Whether signatures differ in no more bits than so many single members flip."""
        apart = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(first, first + words)), F.lit(0))
        filled = F.lit(BITS / 2) * (F.lit(1.0) - F.pow(F.lit(1 - 2 / BITS), single)) + F.lit(6 * BITS**0.5 / 2)
        return apart <= F.least(single, filled)

    longer = F.greatest(v, w) * F.lit(threshold)
    return (F.least(v, w) >= longer - F.lit(1e-6)) & fits(words, v + w - 2 * longer + F.lit(1e-6)) & fits(0, (n + m) * F.lit((1 - SHARED) / (1 + SHARED)) + F.lit(1e-6))


def _starred(buckets: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (centre, member) of each bucket (node, key, size) that can be similar, and the buckets without their centres.

    The centre is the member that meets most others over all its buckets: of near
    copies of a text that is the text itself, if it is there.
    """
    met = buckets.groupBy("node").agg(F.sum("size").alias("met"))
    centres = buckets.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("c")).select("key", F.col("c.node").alias("centre"))
    both = stored(buckets.join(centres, "key"), "sketch-stars")
    facts = nodes.select("node", "n", "w", "bits")
    pairs = both.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(facts.select(F.col("node").alias("a"), F.struct("n", "w", "bits").alias("x")), "a").join(facts.select(F.col("node").alias("b"), F.struct("n", "w", "bits").alias("y")), "b")
    return pairs.filter(possible("x", "y", threshold)).select("a", "b"), both.filter("node <> centre").drop("centre")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their labels."""
    members = members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    return members.join(several, "key")


def _crossing(members: DataFrame) -> tuple[int, int]:
    """How many pairs of different components the buckets hold, and how many members."""
    parts = members.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"))
    zero = F.lit(0)
    sums = parts.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2), zero).alias("pairs"), F.coalesce(F.sum("all"), zero).alias("members")).first()
    return int(sums.pairs), int(sums.members)


def _stretches(s: np.ndarray) -> np.ndarray:
    """Where the stretches of a text's shingles begin, and the end: cut by the shingles alone, so equal passages are cut alike."""
    return np.unique(np.concatenate([[0], np.flatnonzero(s % np.uint64(STRETCH) == 0), [len(s)]]))


def _stretched(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label, at, stretch, shingles) of all stretches of the members' texts; at: the first one's place in the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 32):
                batch = whole.iloc[at : at + 32]
                lists = list(shingle_lists(batch["text"].tolist()))
                cuts = [_stretches(s) for s in lists]
                sizes = [len(c) - 1 for c in cuts]
                parts = [s[i:j] for s, c in zip(lists, cuts, strict=True) for i, j in zip(c[:-1], c[1:], strict=True)]
                names = [xxhash.xxh3_128_digest(x.tobytes()) for x in parts]
                yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), sizes), "label": np.repeat(batch["label"].to_numpy(), sizes), "at": np.concatenate([c[:-1] for c in cuts]), "stretch": names, "shingles": [x.view(np.int64) for x in parts]})

    labelled = members.select("node", "label").distinct()
    return texts.join(labelled, "node").mapInPandas(run, "node long, label long, at int, stretch binary, shingles array<long>")


def _placed(stretches: DataFrame) -> DataFrame:
    """(stretch, low, high, at, shingle) of each different stretch, a row a shingle, with its smallest and largest label."""
    once = stretches.groupBy("stretch").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.first("shingles").alias("shingles"))
    return once.select("stretch", "low", "high", F.posexplode("shingles").alias("at", "shingle"))


def _covered(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those members (node, label, n) that can have a link into another component, with ``cover``: their words in shingles that other components have too."""
    stretches = stored(_stretched(members, texts), "sketch-stretches")
    # Windows: a shingle that many stretches have is spilled, not held, and no rows are made of it and its stretches.
    of_shingle = Window.partitionBy("shingle")
    abroad = _placed(stretches).withColumns({"least": F.min("low").over(of_shingle), "most": F.max("high").over(of_shingle)}).filter("least <> most").select("stretch", "at")
    behind = F.lead("at").over(Window.partitionBy("stretch").orderBy("at")) - F.col("at")
    # Of the last shingle of a stretch the next stretch of a text tells how many words are new.
    steps = abroad.select("stretch", "at", F.when(behind.isNull(), 0).otherwise(F.least(F.lit(K), behind)).alias("new"))
    inside = steps.groupBy("stretch").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("new").alias("inner"))
    of_text = stretches.select("node", "at", "stretch").join(inside, "stretch").select("node", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"), "inner")
    behind = F.lead("first").over(Window.partitionBy("node").orderBy("first")) - F.col("last")
    new = of_text.select("node", (F.col("inner") + F.least(F.lit(K), F.coalesce(behind, F.lit(K)))).alias("new"))
    cover = new.groupBy("node").agg(F.sum("new").alias("cover"))
    return members.join(cover, "node").filter(F.col("cover") >= (F.col("n") + F.lit(K - 1)) * F.lit(threshold) - F.lit(1e-6))


def _turn(members: DataFrame, centres: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of about so many centres of each bucket with its other members, where they can be similar, and the buckets without those centres.

    A pair is taken in the first of the buckets that it shares.
    """
    members = members.withColumn("central", F.pmod(F.xxhash64("node", "key"), F.col("size")) < centres)
    a, b = members.filter("central").alias("a"), members.alias("b")
    once = F.element_at(F.array_intersect("a.keys", "b.keys"), 1) == F.col("a.key")
    apart = (F.col("a.label") != F.col("b.label")) & (~F.col("b.central") | (F.col("a.node") < F.col("b.node")))
    covered = F.least("a.cover", "b.cover") >= (F.greatest("a.n", "b.n") + F.lit(K - 1)) * F.lit(threshold) - F.lit(1e-6)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & covered & possible("a", "b", threshold) & once)
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), members.filter(~F.col("central")).drop("central")


def classes(docs: DataFrame, threshold: float = 0.8, few_pairs: int = 64) -> DataFrame:
    """(doc_id, class_id) of every row of docs (doc_id, text).

    class_id is the smallest doc_id of the class; null for rows without doc_id.
    Buckets take more centres turn by turn; all members are centres once the pairs
    of different components are no more than ``few_pairs`` a bucket member.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = whole.filter(F.col("doc_id").isNotNull())
    rows = stored(sketches(known), "sketches")
    nodes = rows.groupBy("h").agg(F.min("doc_id").alias("doc"), *(F.first(c).alias(c) for c in ("n", "w", "keys", "bits")))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stored(buckets.join(shared, "key"), "sketch-buckets")
    held = nodes.join(buckets.select("node").distinct(), "node").select("node", "doc", "h")
    named = known.join(held, known["doc_id"] == held["doc"]).filter(F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("h"))
    texts = stored(named.select("node", "text").dropDuplicates(["node"]), "sketch-texts")
    pairs, left = _starred(buckets, nodes, threshold)
    near = stored(_repeats(rows, nodes).union(verified(pairs, texts, threshold)), "sketch-links")
    labels = components(near)
    mixed = _mixed(left, labels)
    own = mixed.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    members = stored(mixed.join(own, "node").join(nodes.select("node", "n", "w", "bits"), "node"), "sketch-mixed")
    crossing, size = _crossing(members)
    if crossing:
        members = stored(_covered(members, texts, threshold), "sketch-covered")
        crossing, size = _crossing(members)
    centres = GROWTH
    while crossing:
        last = crossing <= few_pairs * size
        pairs, left = _turn(members, 2**62 if last else centres, threshold)
        found = stored(verified(stored(pairs, "sketch-pairs"), texts, threshold), "sketch-links")
        if found.limit(1).count():
            near = near.union(found)
            labels = components(near)
        if last:
            break
        members = stored(_mixed(left, labels), "sketch-members")
        crossing, size = _crossing(members)
        centres *= GROWTH
    labelled = nodes.select("node", "doc", "h").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = labelled.groupBy("label").agg(F.min("doc").alias("class_id"))
    of_text = labelled.join(names, "label").select("h", "class_id")
    named = rows.select("doc_id", "h").join(of_text, "h").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return whole.select("doc_id").join(named, "doc_id", "left")


def _repeats(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of a doc_id that has several texts."""
    several = rows.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("doc_id")
    own = rows.select("doc_id", "h").join(several, "doc_id").join(nodes.select("h", "node"), "h")
    return own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b").distinct()


def representatives(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of docs (doc_id, text, ...) per class: that of the smallest doc_id.

    Of rows that share this doc_id the one whose text has the smallest hash stays,
    then the one whose row has; rows without doc_id all stay.
    """
    ids = classes(docs, threshold).filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.first("class_id").alias("class_id"), F.count("*").alias("n"))
    # Few ids go or repeat: what most rows need is only not to be among them.
    marked = stored(ids.filter("doc_id <> class_id OR n > 1").select(F.col("doc_id").alias("watchwell_id"), (F.col("doc_id") == F.col("class_id")).alias("watchwell_stays")), "near-dup-marked")
    of_id = docs["doc_id"].cast("long") == marked["watchwell_id"]
    single = docs.join(marked, of_id, "left_anti")
    again = marked.filter("watchwell_stays")
    if again.limit(1).count():
        row = F.struct(*(docs[c] for c in docs.columns))
        first = F.struct(F.sha2(F.coalesce(docs["text"], F.lit("")), 256), F.xxhash64(*(docs[c] for c in docs.columns)))
        several = docs.join(again, docs["doc_id"].cast("long") == again["watchwell_id"]).groupBy("watchwell_id").agg(F.min_by(row, first).alias("watchwell_row"))
        single = single.unionByName(several.select("watchwell_row.*"))
    return single


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op7_near_duplicates": op7_near_duplicates}
ORACLES: dict[str, str] = {}
