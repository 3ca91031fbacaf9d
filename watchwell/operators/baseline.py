"""Behavioural baseline: activity profiles of days, hours, users, addresses and services."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchwell.sources.auth import ZONE, local
from watchwell.sources.tables import stored

NO_SERVICE = "(sin_relying_party)"


@dataclass(frozen=True)
class BaselineConfig:
    zone: str = ZONE
    minimum_events_per_day: int = 1000
    minimum_active_hours: int = 12
    minimum_user_history: int = 20
    training_start: str | None = None
    training_end: str | None = None
    evaluation_start: str | None = None


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, rounded; 0 of nothing (B2)."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, digits))


def nearest_rank(values: Column, fraction: float) -> Column:
    """The value at half-even rank (n - 1) * fraction of a small array; 0 if it is empty."""
    at = F.bround((F.size(values) - 1) * F.lit(fraction), 0).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), F.greatest(at, F.lit(1)))).otherwise(F.lit(0))


def at_ranks(values: DataFrame, column: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values of a column at ranks (from 0; functions of the count), null if there are none, and ``max``.

    Equal values are counted first. The distinct ones are dealt by range and stored;
    they are added up inside each range, and only one row per range meets the others.
    """
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    dealt = stored(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranked-values")
    sums = dealt.groupBy("part").agg(F.sum("n").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("part", before.alias("before"), F.sum("own").over(Window.partitionBy()).alias("total"))
    run = dealt.join(F.broadcast(sums), "part").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    return run.agg(*(F.min(F.when(F.col("upto") > rank(F.col("total")), F.col("v"))).alias(name) for name, rank in ranks.items()), F.max("v").alias("max"))


def ranked_values(values: DataFrame, column: str, fractions: dict[str, float]) -> DataFrame:
    """nearest_rank of a column of counts, one output column a fraction, and its maximum; 0 if it is empty.

    Equal values are counted first; only the distinct ones are ordered, in one task:
    counts that add up to N have fewer than sqrt(2 N) distinct values. at_ranks() is for
    other values.
    """
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    run = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    picks = [F.coalesce(F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * F.lit(f), 0), F.col("v"))), F.lit(0)).alias(name) for name, f in fractions.items()]
    return run.agg(*picks, F.coalesce(F.max("v"), F.lit(0)).alias("max"))


def localized(events: DataFrame, zone: str = ZONE) -> DataFrame:
    """events with their local time, day and hour."""
    wall = local(F.col("ts"), zone)
    return events.withColumns({"local_ts": wall, "day": F.to_date(wall), "hour": F.hour(wall)})


def activity_columns() -> list[Column]:
    """Weighted class counts, distinct keys, hours and first and last time (B1)."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col("event_class") == name, F.col("weight"))), F.lit(0)).cast("long")
    kinds = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    return [
        F.sum("weight").cast("long").alias("total_events"),
        of("success").alias("success_count"),
        of("failure").alias("failure_count"),
        of("lockout").alias("lockout_count"),
        kinds("user_key").alias("distinct_users"),
        kinds("client_ip_key").alias("distinct_client_ips"),
        kinds("relying_party").alias("distinct_relying_parties"),
        F.count_distinct("hour").alias("active_hour_count"),
        F.min("local_ts").alias("first_seen_local"),
        F.max("local_ts").alias("last_seen_local"),
    ]


def profiled(events: DataFrame, *keys: str) -> DataFrame:
    """One row per key: counts, rates, distinct keys (B1, B2)."""
    found = events.groupBy(*keys).agg(*activity_columns())
    tried, bad = F.col("success_count") + F.col("failure_count"), F.col("failure_count") + F.col("lockout_count")
    return found.withColumns({"failure_rate": share(F.col("failure_count"), tried), "adverse_event_rate": share(bad, F.col("total_events"))})


def daily(events: DataFrame, config: BaselineConfig) -> DataFrame:
    """Activity of local days and whether the day is in the baseline.

    events: localized. Blank keys don't count as distinct.
    """
    day = F.col("day")
    inside = (F.col("total_events") >= config.minimum_events_per_day) & (F.col("active_hour_count") >= config.minimum_active_hours)
    if config.training_start:
        inside = inside & (day >= F.lit(config.training_start).cast("date"))
    if config.training_end:
        inside = inside & (day <= F.lit(config.training_end).cast("date"))
    return profiled(events, "day").withColumn("baseline_included", inside)


def evaluation_days(events: DataFrame, config: BaselineConfig) -> DataFrame:
    """Days to be judged: from evaluation_start on and after training_end."""
    days = events.select("day").distinct()
    if config.evaluation_start:
        days = days.filter(F.col("day") >= F.lit(config.evaluation_start).cast("date"))
    if config.training_end:
        days = days.filter(F.col("day") > F.lit(config.training_end).cast("date"))
    return days


def training(events: DataFrame, config: BaselineConfig) -> DataFrame:
    """localized events of the baseline days; unknown services named."""
    days = daily(events, config).filter("baseline_included").select("day")
    named = F.when(F.coalesce(F.col("relying_party"), F.lit("")) == "", NO_SERVICE).otherwise(F.col("relying_party"))
    return events.join(days, "day", "left_semi").withColumn("relying_party", named)


def require_days(train: DataFrame) -> DataFrame:
    """train, or an error where no day is fit for a baseline."""
    if train.limit(1).count() == 0:
        raise ValueError("no day is fit for the baseline")
    return train


def hourly(train: DataFrame) -> DataFrame:
    """24 hours by baseline days, empty cells as 0: totals, mean, median, p95, rates."""
    days = train.select("day").distinct()
    hours = train.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_local"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("event_class") == name, F.col("weight"))), F.lit(0)).cast("long")
    cells = train.groupBy("day", F.col("hour").alias("hour_local")).agg(F.sum("weight").alias("n"), of("success").alias("s"), of("failure").alias("f"), of("lockout").alias("l"))
    grid = days.join(F.broadcast(hours)).join(cells, ["day", "hour_local"], "left").fillna(0, ["n", "s", "f", "l"])
    total, tried, bad = F.col("total_events"), F.col("success_count") + F.col("failure_count"), F.col("failure_count") + F.col("lockout_count")
    rows = grid.groupBy("hour_local").agg(
        F.count("*").alias("days_observed"),
        F.count_if(F.col("n") > 0).alias("days_with_data"),
        F.sum("n").cast("long").alias("total_events"),
        F.median("n").alias("median_events_per_day"),
        nearest_rank(F.collect_list("n"), 0.95).cast("long").alias("p95_events_per_day"),
        F.sum("s").cast("long").alias("success_count"),
        F.sum("f").cast("long").alias("failure_count"),
        F.sum("l").cast("long").alias("lockout_count"),
    )
    return rows.withColumns(
        {
            "coverage_status": F.when(F.col("days_with_data") > 0, "observed").otherwise("unobserved"),
            "average_events_per_day": F.round(total / F.col("days_observed"), 2),
            "failure_rate": share(F.col("failure_count"), tried),
            "adverse_event_rate": share(bad, total),
        }
    )


def users(train: DataFrame, config: BaselineConfig) -> DataFrame:
    """User profiles with history status; reports sort by adverse, then total events."""
    status = F.when(F.col("total_events") >= config.minimum_user_history, "sufficient").otherwise("insufficient")
    return profiled(train.filter(F.col("user_key") != ""), "user_key").withColumn("history_status", status)


def addresses(train: DataFrame) -> DataFrame:
    """Address profiles."""
    return profiled(train.filter(F.col("client_ip_key") != ""), "client_ip_key")


def services(train: DataFrame) -> DataFrame:
    """Service profiles; unknown services are one."""
    return profiled(train, "relying_party")


def user_hours(train: DataFrame) -> DataFrame:
    """Counts of each user and hour, and their share of the user's events."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col("event_class") == name, F.col("weight"))), F.lit(0)).cast("long").alias(f"{name}_count")
    cells = train.filter(F.col("user_key") != "").groupBy("user_key", F.col("hour").alias("hour_local")).agg(F.sum("weight").cast("long").alias("event_count"), of("success"), of("failure"), of("lockout"))
    totals = cells.groupBy("user_key").agg(F.sum("event_count").alias("whole"))
    return cells.join(totals, "user_key").withColumn("share_of_user_events", share(F.col("event_count"), F.col("whole"))).drop("whole")


def relations(train: DataFrame, other: str) -> DataFrame:
    """Profiles of (user, other) pairs with their share of the user's events."""
    pairs = profiled(train.filter((F.col("user_key") != "") & (F.col(other) != "")), "user_key", other)
    totals = train.filter(F.col("user_key") != "").groupBy("user_key").agg(F.sum("weight").alias("whole"))
    return pairs.join(totals, "user_key").withColumn("share_of_user_events", share(F.col("total_events"), F.col("whole"))).drop("whole")


def distributions(train: DataFrame, config: BaselineConfig) -> DataFrame:
    """p50, p95, p99 and maximum of failures by user, by address, and users by address."""
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    by_user, by_ip = users(train, config), addresses(train)
    parts = [("failures_per_user", by_user, "failure_count"), ("failures_per_ip", by_ip, "failure_count"), ("users_per_ip", by_ip, "distinct_users")]
    rows = [ranked_values(df, c, wanted).select(F.lit(name).alias("measure"), *(F.col(x).cast("long") for x in (*wanted, "max"))) for name, df, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def summary(events: DataFrame, train: DataFrame, config: BaselineConfig) -> DataFrame:
    """One row of totals over events, training and evaluation."""
    of = lambda name: F.coalesce(F.sum(F.when(F.col("event_class") == name, F.col("weight"))), F.lit(0)).cast("long").alias(f"{name}_count")
    used = train.agg(
        F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("baseline_events"),
        F.count_distinct("day").alias("baseline_days"),
        F.min("day").cast("string").alias("baseline_start"),
        F.max("day").cast("string").alias("baseline_end"),
        of("success"),
        of("failure"),
        of("lockout"),
        F.count_distinct(F.nullif(F.col("user_key"), F.lit(""))).alias("distinct_users"),
        F.count_distinct(F.nullif(F.col("client_ip_key"), F.lit(""))).alias("distinct_client_ips"),
        F.array_join(F.transform(F.sort_array(F.collect_set("hour")), lambda h: h.cast("string")), ";").alias("observed_hours"),
        (F.lit(24) - F.count_distinct("hour")).alias("unobserved_hours"),
    ).withColumn("failure_rate", share(F.col("failure_count"), F.col("success_count") + F.col("failure_count")))
    later = events.join(evaluation_days(events, config), "day", "left_semi")
    judged = later.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("evaluation_events"), F.count_distinct("day").alias("evaluation_days"))
    rows = events.agg(F.count("*").alias("input_rows"))
    return used.join(F.broadcast(judged)).join(F.broadcast(rows))


def context(train: DataFrame, config: BaselineConfig) -> dict[str, DataFrame]:
    """What detection asks of a baseline: sufficient users and known pairs."""
    known = lambda c: train.filter((F.col("user_key") != "") & (F.col(c) != "")).select("user_key", c).distinct()
    return {
        "users": users(train, config).filter("history_status = 'sufficient'").select("user_key"),
        "user_ips": known("client_ip_key"),
        "user_apps": known("relying_party"),
        "user_hours": train.filter(F.col("user_key") != "").select("user_key", F.col("hour").alias("hour_local")).distinct(),
    }


def compare(found: DataFrame, known: dict[str, DataFrame], training_end: str) -> DataFrame:
    """Per alert: is the baseline older than it, is its user known, and its pair with the address."""
    usable = F.to_date(F.substring("first_seen_local", 1, 10)) > F.lit(training_end).cast("date")
    seen = known["users"].select("user_key", F.lit(True).alias("u"))
    pairs = known["user_ips"].withColumn("p", F.lit(True))
    joined = found.join(seen, "user_key", "left").join(pairs, ["user_key", "client_ip_key"], "left")
    return joined.select("alert_id", usable.alias("baseline_usable"), (usable & F.coalesce("u", F.lit(False))).alias("user_known"), (usable & F.coalesce("p", F.lit(False))).alias("address_known"))


def write(folder: str, frames: dict[str, DataFrame]) -> None:
    """Baseline tables as Parquet, one folder a table."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark, folder: str, names: tuple[str, ...] = ("users", "user_ips", "user_apps", "user_hours")) -> dict[str, DataFrame]:
    """The context tables of a written baseline."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
