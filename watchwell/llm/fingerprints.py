"""SpotSigs fingerprints: chains of content words that follow common words.

A text is lower-cased and cut into words. Wherever a run of anchors (common
function words) ends, the next ``CHAIN`` content words form one signature; the
fingerprint is the sorted set of the signatures' hashes. Two fingerprints are
compared by Jaccard. ``near_duplicates`` partitions fingerprints by set length,
so that only neighbouring partitions can hold pairs over the threshold, and joins
them on the rarest signatures, which every such pair must share.

All of it is DataFrame expressions: no Python runs on the executors.

Edge cases: a null text counts as empty; a text without an anchor has one
signature, the hash of its whole text, so equal texts have equal fingerprints and
likeness 1; likeness of two texts lies in 0..1. Null doc_ids come first in the
order of documents. Where a doc_id repeats, every row keeps its own result, and
the smallest text of that id stands for "the next document". A single document is
its own next. Very long texts are read whole; other columns are ignored whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchwell.llm.common import stored, table

#: Content words in a signature.
CHAIN = 3
#: Common words of four languages.
ANCHORS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "das dem den der des die ein eine ist mit nicht sich und von zu "
    "au dans des du elle en est et la le les par pour que qui sur un une "
    "con de del el es las los no para por se y"
).split()
# One anchor a match: a repeated group would recurse, as deep as the run is long.
_ANCHOR = r"(?<= )(?:" + "|".join(sorted(set(ANCHORS))) + r") "
_NO_ID = -(2**63)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column) -> Column:
    """The sorted set of signature hashes of a text (array<int>)."""
    text = F.coalesce(text, F.lit(""))
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))

    def spots(after: Column) -> Column:
        chain = lambda i: F.concat_ws("", *(F.get(after, i + k) for k in range(CHAIN)))
        sign = lambda i: F.hash(F.substring_index(chain(i), " ", CHAIN))
        found = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(after) - 1), sign)))
        return F.when(F.size(after) > 0, found).otherwise(F.array(F.hash(text)))

    # What follows each anchor, up to the next; anchors side by side leave nothing between them.
    pieces = _bound(F.split(plain, _ANCHOR), lambda p: F.filter(F.slice(p, F.lit(2), F.size(p)), lambda x: x != ""))
    return _bound(pieces, spots)


def fingerprint(signs: Column) -> Column:
    """A signature set as text: hexadecimal hashes, joined by full stops."""
    return F.array_join(F.transform(signs, lambda x: F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def following(keys: DataFrame) -> DataFrame:
    """(key, next): the next greater key of each distinct key; after the last the first.

    Keys are dealt by range and ranked inside each range; only one row per range
    meets its neighbour in a further step.
    """
    ranged = stored(keys.select("key").distinct().repartitionByRange("key").withColumn("part", F.spark_partition_id()), "key-ranges")
    inside = Window.partitionBy("part").orderBy("key")
    edges = ranged.groupBy("part").agg(F.min("key").alias("first"))
    across = Window.orderBy("part")
    edges = edges.select("part", F.coalesce(F.lead("first").over(across), F.first("first").over(across)).alias("other"))
    return ranged.withColumn("own", F.lead("key").over(inside)).join(F.broadcast(edges), "part").select("key", F.coalesce("own", "other").alias("next"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, and the edited text with the next document's signatures.

    docs: doc_id and text. The edited text's last floor(n_chars / 2) code points
    are the first as many (or all) of the next document's.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    repeats = docs.groupBy("key").count().filter("count > 1").limit(1).count() > 0
    one = docs.groupBy("key").agg(F.min("text").alias("text")) if repeats else docs
    halves = docs.groupBy("key").agg(F.max(F.floor(F.length("text") / 2)).alias("half"))
    links = following(docs).join(halves, "key").select(F.col("key").alias("before"), F.col("next").alias("key"), "half")
    heads = one.join(links, "key").select(F.col("before").alias("key"), F.expr("substring(text, 1, cast(half as int))").alias("head"), signatures(F.col("text")).alias("next_signs"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    whole = docs.join(heads, "key").select(
        F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id"),
        "text",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("head", F.lit(1), half)).alias("edited"),
        "next_signs",
    )
    return whole


def near_duplicates(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness), a < b, of different signature sets from threshold on.

    prints: (id long, signs array<int>). Rows with equal sets count once, by their
    smallest id. A set of n signatures only meets sets of between threshold * n
    and n / threshold; those share one of their rarest n - ceil(threshold * n) + 1.
    """
    sets = stored(prints.groupBy("signs").agg(F.min("id").alias("id")).withColumn("n", F.size("signs")), "spot-sets")
    level = lambda n: F.floor(F.log(n.cast("double")) / math.log(1 / threshold) + 1e-9)
    spots = sets.select("id", "n", F.explode("signs").alias("sign"))
    known = spots.groupBy("sign").agg(F.count("*").alias("seen"))
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("seen", "sign"))), lambda s: s["sign"])
    ranked = spots.join(known, "sign").groupBy("id", "n").agg(rarest.alias("signs"))
    prefix = F.slice("signs", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
    front = ranked.select("id", "n", level(F.col("n")).alias("level"), F.explode(prefix).alias("sign"))
    low = front.withColumn("level", F.explode(F.array(F.col("level"), F.col("level") + 1)))
    a, b = front.alias("a"), low.alias("b")
    meet = (F.col("a.sign") == F.col("b.sign")) & (F.col("a.level") == F.col("b.level")) & (F.col("a.id") != F.col("b.id")) & (F.col("b.n") >= F.col("a.n") * threshold - 1e-9) & (F.col("b.n") <= F.col("a.n") / threshold + 1e-9)
    pairs = a.join(b, meet).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("signs").alias("a_signs")), sets.select(F.col("id").alias("b"), F.col("signs").alias("b_signs"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("a_signs"), F.col("b_signs")).alias("likeness"))
    return scored.filter(F.col("likeness") >= threshold)


def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = edited(table(spark, sf_dir, "documents"))
    signed = whole.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("text")).alias("signs"), signatures(F.col("edited")).alias("edited_signs"), "next_signs")
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("signs")).alias("fingerprint"),
        fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


QUERIES = {"op5_spot_signatures": op5_spot_signatures}
ORACLES: dict[str, str] = {}
