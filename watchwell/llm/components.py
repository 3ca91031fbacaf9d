"""Connected components of an undirected graph, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchwell.llm.common import stored

ROWS_PER_FILE = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the smallest node it reaches.

    Each round names every node after the smallest node next to it, then after that
    node's new name, and puts the names into the edges: edges inside a name are gone,
    equal ones are one, and the rounds end when none is left. So later rounds work on
    what the first ones left, which for groups around hubs is next to nothing. Names
    are stored in no more files than their number asks for: Spark knows their size and
    broadcasts them while they are few, else it shuffles. Smallest nodes are partial
    before they are shuffled, so hubs are no hot spots there. An empty graph gives no
    rows; of loops only the node counts; repeated edges change nothing.
    """
    pairs = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph-edges")
    labels = None
    while True:
        files = max(8, -(-pairs.count() // ROWS_PER_FILE))
        both = pairs.toDF("node", "other").union(pairs.select("b", "a"))
        near = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")).coalesce(files), "graph-near")
        names = near.join(near.toDF("label", "far"), "label").select("node", F.col("far").alias("label"))
        names = stored(names.coalesce(files), "graph-names")
        if labels is None:
            labels = names
        else:
            labels = labels.join(names.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        left, right = names.toDF("a", "x"), names.toDF("b", "y")
        named = pairs.join(left, "a").join(right, "b").filter("x <> y")
        pairs = stored(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().coalesce(files), "graph-edges")
        if not pairs.limit(1).count():
            return stored(labels.coalesce(max(8, files)), "graph-labels")
