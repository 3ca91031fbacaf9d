"""Operational figures, reports and investigations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchwell.operators import around
from watchwell.operators.baseline import share
from watchwell.operators.browse import latest_runs
from watchwell.sources.auth import CLASSES, ZONE, local
from watchwell.sources.tables import stored

CLOSED = ("resolved", "false_positive")
#: Alerts whose context a task puts together: each has up to a few hundred rows.
_ALERTS_OF_TASK = 10_000


def _seconds(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000)


def technical(runs: DataFrame, cursors: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """Per source: last run, its age and duration, failures of a day, cursor age, ingestion lag (M1).

    events: with ingested_at. now: an instant.
    """
    at = F.lit(now).cast("timestamp")
    failed = runs.filter((F.col("status") == "failed") & (F.col("started_at") >= at - F.expr("INTERVAL 24 HOURS"))).groupBy("source_name").agg(F.count("*").alias("failed_runs_24h"))
    newest = events.filter("is_consistent").groupBy("source_name").agg(F.max(F.struct("ingested_at", "ts")).alias("e"))
    rows = latest_runs(runs).join(failed, "source_name", "left").join(cursors, "source_name", "left").join(newest, "source_name", "left")
    return rows.select(
        "source_name",
        "run_id",
        "status",
        F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000, 3).alias("last_run_duration_seconds"),
        _seconds(at, F.col("started_at")).alias("last_run_age_seconds"),
        F.coalesce("failed_runs_24h", F.lit(0)).alias("failed_runs_24h"),
        _seconds(at, F.col("cursor_ts")).alias("checkpoint_age_seconds"),
        F.when(F.col("e").isNotNull(), F.greatest(F.lit(0), _seconds(F.col("e.ingested_at"), F.col("e.ts")))).alias("event_to_soc_seconds"),
    )


def pilot(alerts: DataFrame, log: DataFrame, now: str, days: int = 30, limit: int = 500) -> DataFrame:
    """Handling of the newest alerts of some days (M2).

    alerts: with generated_at and investigation_status. log: with actor_id; what
    "system" did counts for nothing. Medians are exact: the sample has a limit.
    """
    if not (1 <= days <= 90 and 1 <= limit <= 1000):
        raise ValueError("days must be from 1 to 90, limit from 1 to 1000")
    scope = alerts.filter(F.col("generated_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    probe = scope.orderBy(F.desc("generated_at"), F.desc("alert_id")).limit(limit + 1)
    truncated = probe.agg((F.count("*") > limit).alias("sample_truncated"))
    sample = probe.orderBy(F.desc("generated_at"), F.desc("alert_id")).limit(limit)
    acts = log.filter("actor_id <> 'system'").groupBy("alert_id").agg(F.min("changed_at").alias("first_at"), F.max(F.when(F.col("new_status").isin(*CLOSED), F.col("changed_at"))).alias("closed_at"))
    wait = lambda c: F.greatest(F.lit(0.0), (F.unix_micros(c) - F.unix_micros("generated_at")) / 1_000_000)
    rows = sample.join(acts, "alert_id", "left").withColumns({"first_s": F.when(F.col("first_at").isNotNull(), wait("first_at")), "closed_s": F.when(F.col("closed_at").isNotNull(), wait("closed_at"))})
    closed, wrong = F.count_if(F.col("investigation_status").isin(*CLOSED)), F.count_if(F.col("investigation_status") == "false_positive")
    figures = rows.agg(
        F.count("*").alias("sampled_cases"),
        closed.alias("closed_cases"),
        wrong.alias("false_positive_cases"),
        F.when(closed > 0, F.round(100 * wrong / closed, 2)).alias("false_positive_rate_percent"),
        F.count("first_s").alias("cases_with_analyst_action"),
        F.round(F.median("first_s") / 60, 2).alias("median_first_action_minutes"),
        F.round(F.median("closed_s") / 60, 2).alias("median_closure_minutes"),
    )
    return figures.join(F.broadcast(truncated))


def monthly(events: DataFrame, alerts: DataFrame, start: str, stop: str, zone: str = ZONE) -> DataFrame:
    """Per calendar month of local [start, stop): rows, classes, coverage, alerts (R1). Months without rows are there."""
    spark = events.sparkSession
    months = spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date '{start}', 'MM'), trunc(date_sub(date '{stop}', 1), 'MM'), interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    wall = local(F.col("ts"), zone)
    inside = (wall >= F.lit(start).cast("timestamp")) & (wall < F.lit(stop).cast("timestamp"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("event_class") == k, F.col("weight"))), F.lit(0)).cast("long").alias(f"{k}_count")
    rows = events.filter(inside).groupBy(F.date_format(wall, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("stored_rows"), F.count_if("is_consistent").alias("valid_rows"), F.count_if(~F.col("is_consistent")).alias("rejected_rows"), *(of(k) for k in CLASSES), F.min("ts").alias("first_event"), F.max("ts").alias("last_event")
    )
    end = local(F.col("last_seen"), zone)
    found = alerts.filter((end >= F.lit(start).cast("timestamp")) & (end < F.lit(stop).cast("timestamp"))).groupBy(F.date_format(end, "yyyy-MM").alias("month"))
    found = found.agg(F.count("*").alias("stored_alerts"), *(F.count_if(F.col("severity") == s).alias(f"{s}_alerts") for s in ("critical", "high", "medium", "low")))
    return months.join(rows, "month", "left").join(found, "month", "left").fillna(0)


def worst(events: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k keys with most failures (R2)."""
    sums = events.filter((F.col("event_class") == "failure") & (F.col(key) != "")).groupBy(F.col(key).alias("key")).agg(F.sum("weight").cast("long").alias("failures"))
    return sums.orderBy(F.desc("failures"), "key").limit(k).select(F.lit(key).alias("kind"), "key", "failures")


def evidence(alerts: DataFrame, events: DataFrame, most: int = 10) -> DataFrame:
    """The events that each alert names, by any spelling of their ids."""
    ids = F.slice(F.split("evidence_event_ids", ";"), 1, most)
    named = alerts.select("alert_id", F.explode(ids).alias("event_id")).filter("event_id <> ''")
    known = events.withColumn("event_id", F.regexp_replace(F.col("event_id"), "^([^:]*:)?event:", ""))
    return named.join(known, "event_id").select("alert_id", "event_id", "ts", "event_class", "weight", "user_key", "client_ip_key")


def near(alerts: DataFrame, events: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """Events of each alert's user or address in its padded window.

    Both sides meet by key and hour, so that a busy key is spread over its hours.
    """
    lo, hi = F.unix_micros("first_seen") - before * 60_000_000, F.unix_micros("last_seen") + after * 60_000_000
    hour = 3_600_000_000
    spans = alerts.filter(F.col(key) != "").select("alert_id", key, lo.alias("lo"), hi.alias("hi")).withColumn("h", F.explode(F.sequence(F.floor(F.col("lo") / hour), F.floor(F.col("hi") / hour))))
    rows = events.filter("is_consistent").withColumn("us", F.unix_micros("ts")).withColumn("h", F.floor(F.col("us") / hour))
    return spans.join(rows, [key, "h"]).filter((F.col("us") >= F.col("lo")) & (F.col("us") <= F.col("hi"))).drop("lo", "hi", "h", "us")


def entity_events(alerts: DataFrame, events: DataFrame, key: str, before: int, after: int, most: int) -> DataFrame:
    """The newest events around each alert."""
    return around.newest(around.windows(alerts, key, before, after), events.filter("is_consistent"), key, most)


def entity_counts(alerts: DataFrame, events: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """Counts of the events around each alert.

    An alert is one row among the events of its key, however many are around it; its
    users are those whose last event before lies before its window.
    """
    of = lambda k: F.when(F.col("event_class") == k, F.col("weight")).otherwise(0)
    measures = {"records": F.lit(1), "events": F.col("weight"), "failures": of("failure"), "successes": of("success"), "lockouts": of("lockout")}
    known = events.filter(F.col("is_consistent") & (F.col(key) != "")).withColumn("us", F.unix_micros("ts"))
    found = around.counted(around.windows(alerts, key, before, after), known, key, measures, "user_key")
    return found.groupBy("alert_id", key).agg(*(F.sum(n).alias(n) for n in measures), F.max("n_distinct").alias("distinct_users"))


def success_after_failure(around: DataFrame) -> DataFrame:
    """Successes after a failure of the same user and address (I4). around: events by alert."""
    w = Window.partitionBy("alert_id", "user_key", "client_ip_key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    known = around.filter((F.col("user_key") != "") & (F.col("client_ip_key") != ""))
    seen = F.coalesce(F.max(F.col("event_class") == "failure").over(w), F.lit(False))
    return known.withColumn("seen", seen).filter((F.col("event_class") == "success") & F.col("seen")).drop("seen")


def context(alerts: DataFrame, events: DataFrame, before: int, after: int, most: int = 50, addresses: int = 5) -> DataFrame:
    """Per alert: sampled events, successes after failures, other users, addresses, whether it was cut.

    Evidence comes first, then the newest events of the user and of up to
    ``addresses`` addresses (the alert's own, then by key).
    """
    fields = ["alert_id", "event_id", "ts", "event_class", "user_key", "client_ip_key"]
    anchors = stored(evidence(alerts, events).select(*fields), "context-anchors")
    of_anchors = anchors.groupBy("alert_id").agg(F.array_sort(F.collect_set(F.nullif(F.col("client_ip_key"), F.lit("")))).alias("named"))
    own = F.filter(F.array("client_ip_key"), lambda x: x != "")
    ips = F.concat(own, F.array_except(F.coalesce("named", F.array().cast("array<string>")), own))
    asked = alerts.join(of_anchors, "alert_id", "left").withColumn("ips", ips)
    asked = asked.select("alert_id", "first_seen", "last_seen", "user_key", F.slice("ips", 1, addresses).alias("used"), F.size("ips").cast("long").alias("addresses"))
    # More than ``most`` of one user or address can't be kept, and one more shows the cut.
    known = events.filter("is_consistent").select(*fields[1:])
    of_user = around.windows(asked, "user_key", before, after)
    of_ip = around.windows(asked.withColumn("client_ip_key", F.explode("used")), "client_ip_key", before, after)
    by_user, by_ip = (around.newest(x, known, k, most + 1, once=True).select(*fields) for x, k in ((of_user, "user_key"), (of_ip, "client_ip_key")))
    rows = anchors.withColumn("p", F.lit(0)).unionByName(by_user.unionByName(by_ip).withColumn("p", F.lit(1)))
    # An alert's rows are dealt out once, for all that follows, to tasks of so many alerts.
    rows = rows.repartition(-(-alerts.count() // _ALERTS_OF_TASK) or 1, "alert_id").groupBy(*fields).agg(F.min("p").alias("p"))
    nth = F.row_number().over(Window.partitionBy("alert_id").orderBy("p", F.desc("ts"), "event_id"))
    listed = rows.withColumn("nth", nth).filter(F.col("nth") <= most + 1).groupBy("alert_id").agg(F.collect_list(F.struct("nth", *fields[1:])).alias("found"))
    kept = F.filter("found", lambda x: x["nth"] <= most)
    same = lambda x, y: (x["user_key"] == y["user_key"]) & (x["client_ip_key"] == y["client_ip_key"])
    failed = lambda x: F.exists("kept", lambda y: same(x, y) & (y["event_class"] == "failure") & (F.struct(y["ts"], y["event_id"]) < F.struct(x["ts"], x["event_id"])))
    after_failure = F.filter("kept", lambda x: (x["event_class"] == "success") & (x["user_key"] != "") & (x["client_ip_key"] != "") & failed(x))
    others = F.filter("kept", lambda x: F.array_contains("used", x["client_ip_key"]) & (x["user_key"] != "") & (x["user_key"] != F.col("own_user")))
    text = lambda a: F.coalesce(F.array_join(F.array_sort(a), ";"), F.lit(""))
    return asked.withColumnRenamed("user_key", "own_user").join(listed.withColumn("kept", kept), "alert_id", "left").select(
        "alert_id",
        F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("events"),
        text(F.transform(after_failure, lambda x: x["event_id"])).alias("success_after_failure_ids"),
        text(F.array_distinct(F.transform(others, lambda x: x["user_key"]))).alias("other_users"),
        "addresses",
        ((F.coalesce(F.size("found"), F.lit(0)) > most) | (F.col("addresses") > addresses)).alias("truncated"),
    )


def totals(events: DataFrame) -> DataFrame:
    """Period, rows, classes and failure share of a report (R2)."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("event_class") == k, F.col("weight"))), F.lit(0)).cast("long").alias(f"{k}_count")
    rows = events.agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count("*").alias("rows"), *(of(k) for k in CLASSES))
    return rows.withColumn("failure_rate", share(F.col("failure_count"), F.col("success_count") + F.col("failure_count")))
