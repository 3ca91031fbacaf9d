"""Data-quality profile of raw records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchwell.functions import ip, text
from watchwell.operators.baseline import at_ranks


def unpivoted(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value), trimmed, one row per cell."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("value")) for c in columns))
    return raw.select(F.explode(cells).alias("x")).select("x.column", "x.value")


def columns_profile(raw: DataFrame, columns: Sequence[str], times: Sequence[str] = ()) -> DataFrame:
    """Per column: blank, distinct, whole numbers, valid and wrong times.

    Values are counted first, so that a value that fills a column is one row.
    """
    counts = unpivoted(raw, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    blank, n = F.col("value") == "", F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    is_time = F.col("column").isin(*times) if times else F.lit(False)
    parsed = text.instant(F.col("value")).isNotNull()
    rows = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        total(blank).alias("blank"),
        F.count_if(~blank).alias("distinct_values"),
        total(F.col("value").rlike(r"^[+-]?\d+$")).alias("integer_like"),
        total(is_time & ~blank & parsed).alias("valid_times"),
        total(is_time & ~blank & ~parsed).alias("invalid_times"),
    )
    return rows.withColumn("blank_percent", F.round(100 * F.col("blank") / F.col("rows"), 2))


def top_values(raw: DataFrame, columns: Sequence[str], sensitive: Sequence[str] = (), k: int = 10) -> DataFrame:
    """The k most frequent values of each column that isn't sensitive."""
    shown = [c for c in columns if c not in sensitive]
    counts = unpivoted(raw, shown).filter("value <> ''").groupBy("column", "value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("nth", nth).filter(F.col("nth") <= k)


def time_ranges(raw: DataFrame, times: Sequence[str]) -> DataFrame:
    """First and last instant of each time column."""
    rows = unpivoted(raw, times).withColumn("t", text.instant(F.col("value")))
    return rows.groupBy("column").agg(F.min("t").alias("first"), F.max("t").alias("last"))


def address_quality(raw: DataFrame, column: str) -> DataFrame:
    """Blank, valid, private, public and invalid addresses."""
    rows = ip.address(raw.select(column), column)
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    return rows.agg(
        F.count_if(blank).alias("blank"), F.count_if(F.col("ip").isNotNull()).alias("valid"), F.count_if(F.col("ip.scope") == "private").alias("private"),
        F.count_if(F.col("ip.scope") == "public").alias("public"), F.count_if(~blank & F.col("ip").isNull()).alias("invalid"),
    )


def class_coverage(raw: DataFrame) -> DataFrame:
    """Per keyword class: rows, distinct and missing users and addresses."""
    label = text.keyword_class(F.col("event_name"), F.col("low_level_category"))
    user, _ = text.canonical_user(F.col("custom_user_id"))
    rows = raw.select(label.alias("event_class"), user.alias("u"), F.trim(F.coalesce(F.col("custom_ip_address"), F.lit(""))).alias("a"))
    kinds = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    return rows.groupBy("event_class").agg(F.count("*").alias("rows"), kinds("u").alias("distinct_users"), kinds("a").alias("distinct_ips"), F.count_if(F.col("u") == "").alias("missing_users"), F.count_if(F.col("a") == "").alias("missing_ips"))


def crosstab(raw: DataFrame) -> DataFrame:
    """Rows by name and type id."""
    return raw.groupBy(F.trim("event_name").alias("event_name"), F.trim("event_type_id").alias("event_type_id")).agg(F.count("*").alias("rows"))


def per_period(raw: DataFrame, column: str = "event_time") -> DataFrame:
    """Rows by year and by day."""
    t = text.instant(F.col(column))
    both = F.array(F.struct(F.lit("year").alias("grain"), F.date_format(t, "yyyy").alias("period")), F.struct(F.lit("day").alias("grain"), F.date_format(t, "yyyy-MM-dd").alias("period")))
    return raw.filter(t.isNotNull()).select(F.explode(both).alias("x")).groupBy("x.grain", "x.period").agg(F.count("*").alias("rows"))


def user_formats(raw: DataFrame) -> DataFrame:
    """Rows by the way that users are written."""
    return raw.select(text.canonical_user(F.col("custom_user_id"))[1].alias("format")).groupBy("format").agg(F.count("*").alias("rows"))


def delays(raw: DataFrame, later: str, earlier: str) -> DataFrame:
    """Seconds between two times: count, negative, minimum, median, nearest-rank p95, maximum (P5)."""
    seconds = (F.unix_micros(text.instant(F.col(later))) - F.unix_micros(text.instant(F.col(earlier)))) / 1_000_000
    rows = raw.select(seconds.alias("s")).filter(F.col("s").isNotNull())
    figures = rows.agg(F.count("*").alias("pairs"), F.count_if(F.col("s") < 0).alias("negative"), F.min("s").alias("minimum"))
    ranks = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2), "p95": lambda n: F.bround((n - 1) * F.lit(0.95), 0)}
    found = at_ranks(rows, "s", ranks).select(((F.col("low") + F.col("high")) / 2).alias("median"), *(F.coalesce(c, F.lit(0)).alias(name) for c, name in (("p95", "p95"), ("max", "maximum"))))
    return figures.join(F.broadcast(found))


def repeated_rows(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows are full repeats of another."""
    said = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    return raw.groupBy(said.alias("h")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"))


def anomalies(raw: DataFrame, order: str, k: int = 20) -> DataFrame:
    """The first k rows with something wrong, and what."""
    processed, created, user = text.instant(F.col("event_time")), text.instant(F.col("created_at")), text.canonical_user(F.col("custom_user_id"))[0]
    tests = (("BAD_TIME", processed.isNull()), ("CREATED_BEFORE_EVENT", created < processed), ("MISSING_USER", user == ""), ("MISSING_IP", F.trim(F.coalesce(F.col("custom_ip_address"), F.lit(""))) == ""))
    issues = F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests)))
    return raw.select(order, F.array_join(issues, ";").alias("issues")).filter("issues <> ''").orderBy(order).limit(k)
