"""URL filter: host and path rules, then gradient-boosted trees for the rest.

All work is DataFrame expressions and Spark's own tree ensemble. A rule
("net/es/") names a host suffix and a path prefix; the longest rule that fits
decides. URLs that no rule fits are judged by trees over lexical features:
lengths, depth, digit ratio, character entropy, parameter counts, host shape and
the block rate of the host's suffix among the labelled URLs.

The trees are trained from labelled URLs: a DataFrame (url, label) with 1 for
block. The query's labels are the verdicts that the rules give to the table's own
URLs, as the given tables label none; suffix statistics are counted over all of
them, the trees are fitted on a bounded sample of distinct ones
(``max_labelled``, smallest hash first). A URL that the trees are fitted on gets its
suffix statistics from the hosts of the other folds, so that they weigh as much as
they are worth for a new host.

Edge cases: a null url, or one without "://", has an empty host and path, fits no
rule and gets the trees' verdict over all-zero lexical features; very long urls
are used whole; repeated rows are judged separately; without labelled URLs, or
with labels of one kind only, the method's verdict is that kind (else allow);
other columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchwell.llm.common import stored, table

#: (verdict, rule) of the registered query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Parts of the hosts for which suffix statistics are taken from the others.
FOLDS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = ("f_length", "f_host_length", "f_path_length", "f_depth", "f_digit_ratio", "f_entropy", "f_parameters", "f_labels", "f_hyphens", "f_fragment", "f_secure", "f_suffix_rate", "f_suffix_log")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without "://"."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. rules: a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        suffix, slash, prefix = text.partition("/")
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character of a text; 0 if empty."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    kinds = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n > 0, -F.aggregate(kinds, F.lit(0.0), lambda s, c: s + share(c) * F.log2(share(c)))).otherwise(F.lit(0.0))


def _count(text: Column, c: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path) with the lexical features and the host's suffix."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    return df.withColumns(
        {
            "f_length": F.length(url),
            "f_host_length": F.length("host"),
            "f_path_length": F.length("path"),
            "f_depth": _count(F.col("path"), "/"),
            "f_digit_ratio": F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0),
            "f_entropy": entropy(url),
            "f_parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
            "f_labels": F.when(F.col("host") == "", 0).otherwise(_count(F.col("host"), ".") + 1),
            "f_hyphens": _count(F.col("host"), "-"),
            "f_fragment": F.contains(url, F.lit("#")).cast("int"),
            "f_secure": url.startswith("https").cast("int"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


def _rate(blocked: Column, n: Column, weight: float = 20.0) -> tuple[Column, Column]:
    """A smoothed block rate and the log of the count."""
    return ((blocked + weight * 0.5) / (n + weight)).alias("f_suffix_rate"), F.log1p(n).alias("f_suffix_log")


def _fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per host suffix its smoothed block rate and the log of its count: of all rows, and for the hosts of each fold of all other rows."""
    host, _ = parts(F.col("url"))
    folds = labelled.select(F.substring_index(host, ".", -1).alias("suffix"), _fold(host).alias("fold"), "label").groupBy("suffix", "fold").agg(F.sum("label").alias("b"), F.count("*").alias("n"))
    sums = stored(folds, "url-suffixes").groupBy("suffix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("b", "n")))).alias("own"))
    each = sums.select("suffix", "b", "n", "own", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"))
    own = F.try_element_at("own", F.col("fold"))
    rest = each.select("suffix", "fold", *_rate(F.col("b") - F.coalesce(own["b"], F.lit(0.0)), F.col("n") - F.coalesce(own["n"], F.lit(0))))
    return sums.select("suffix", *_rate(F.col("b"), F.col("n"))), rest


def _featured(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    keys = ["suffix", "fold"] if "fold" in suffixes.columns else ["suffix"]
    whole = lexical(df).withColumn("fold", _fold(F.col("host"))).join(suffixes, keys, "left")
    return whole.withColumns({"f_suffix_rate": F.coalesce("f_suffix_rate", F.lit(0.5)), "f_suffix_log": F.coalesce("f_suffix_log", F.lit(0.0))})


def train(labelled: DataFrame, max_labelled: int = 4000, trees: int = 20, depth: int = 4) -> Callable[[DataFrame], DataFrame]:
    """Fit on (url, label in 0/1); gives a function that adds ``method`` (allow or block) to (url, host, path)."""
    labelled = labelled.filter(F.col("label").isin(0, 1) & F.col("url").isNotNull()).select("url", F.col("label").cast("double").alias("label"))
    suffixes, others = suffix_statistics(labelled)
    host, path = parts(F.col("url"))
    sample = labelled.groupBy("url").agg(F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    rows = _featured(sample.withColumns({"host": host, "path": path}), others).select(*FEATURES, "label").coalesce(2)
    rows = stored(rows, "url-labels")
    kinds = {r.label for r in rows.select("label").distinct().collect()}
    if len(kinds) < 2:
        only = "block" if kinds == {1.0} else "allow"
        return lambda df: df.withColumn("method", F.lit(only))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, maxBins=32, seed=7).fit(assembler.transform(rows).select("features", "label"))

    def judge(df: DataFrame) -> DataFrame:
        scored = model.transform(assembler.transform(_featured(df, suffixes)))
        return scored.select(*df.columns, F.when(F.col("prediction") > 0.5, "block").otherwise("allow").alias("method"))

    return judge


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    labelled: (url, label) to train from; None: the rules' verdicts on ``pages``.
    """
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "says": says})
    if labelled is None:
        labelled = urls.filter(F.col("says").isNotNull()).select("url", (F.col("says") == "block").cast("int").alias("label"))
    return train(labelled)(urls).select("page_id", "host", "path", "rule", F.coalesce("says", "method").alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES: dict[str, str] = {}
