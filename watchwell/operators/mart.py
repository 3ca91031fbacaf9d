"""Service analytics: minute, hour and day aggregates, and what is read from them.

Buckets hold exact distinct users and addresses through reference counts per
entity, so that rows can also be taken back (``apply_changes``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchwell.operators.baseline import share
from watchwell.sources.auth import ZONE, local

KEYS = ("source_name", "grain", "bucket", "relying_party")
#: Statuses of alerts that wait for somebody.
OPEN = ("new", "notified", "investigating")
COUNTS = ("total_events", "success_count", "failure_count", "lockout_count")


def usable(events: DataFrame) -> DataFrame:
    """Consistent events with a time and a service."""
    return events.filter(F.col("is_consistent") & F.col("ts").isNotNull() & (F.coalesce(F.col("relying_party"), F.lit("")) != ""))


def service_key(service: Column) -> Column:
    return F.sha2(service, 256)


def _sums(sign: Column | None = None) -> list[Column]:
    w = F.col("weight") if sign is None else F.col("weight") * sign
    of = lambda name: F.coalesce(F.sum(F.when(F.col("event_class") == name, w)), F.lit(0)).cast("long").alias(f"{name}_count")
    return [F.sum(w).cast("long").alias("total_events"), of("success"), of("failure"), of("lockout")]


def minutes(events: DataFrame) -> DataFrame:
    """Per source, UTC minute and service: total and class counts (A1)."""
    return _minutes(events, None)


def _minutes(events: DataFrame, sign: Column | None) -> DataFrame:
    w = F.col("weight") if sign is None else F.col("weight") * sign
    other = F.coalesce(F.sum(F.when(F.col("event_class") == "other", w)), F.lit(0)).cast("long").alias("other_count")
    return usable(events).groupBy("source_name", F.date_trunc("minute", "ts").alias("minute"), "relying_party").agg(*_sums(sign), other)


def apply_to_minutes(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Minutes after signed events, as apply_changes() is for buckets; minutes without events vanish."""
    both = stored.select("source_name", "minute", "relying_party", *COUNTS, "other_count").unionByName(_minutes(changes, F.col("sign")))
    return both.groupBy("source_name", "minute", "relying_party").agg(*(F.sum(c).cast("long").alias(c) for c in (*COUNTS, "other_count"))).filter("total_events > 0")


def grained(events: DataFrame, zone: str) -> DataFrame:
    """Two rows per event, for its local hour and its local day; bucket is the UTC instant that the bucket begins."""
    wall = local(F.col("ts"), zone)
    begin = lambda grain: F.to_utc_timestamp(F.date_trunc(grain, wall), zone)
    grains = F.array(*(F.struct(F.lit(g).alias("grain"), begin(g).alias("bucket")) for g in ("hour", "day")))
    return events.withColumn("g", F.explode(grains)).select("*", "g.grain", "g.bucket").drop("g")


def buckets(events: DataFrame, zone: str = ZONE) -> DataFrame:
    """Per source, grain, bucket and service: counts, exact distinct users and addresses (A2)."""
    kinds = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    found = grained(usable(events), zone).groupBy(*KEYS).agg(*_sums(), kinds("user_key").alias("distinct_users"), kinds("client_ip_key").alias("distinct_ips"))
    return found.withColumn("service_key", service_key(F.col("relying_party")))


def _entities(events: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit("user").alias("kind"), F.col("user_key").alias("entity_key")), F.struct(F.lit("ip").alias("kind"), F.col("client_ip_key").alias("entity_key")))
    rows = events.withColumn("x", F.explode(both)).select("*", "x.kind", "x.entity_key").drop("x")
    return rows.filter(F.coalesce(F.col("entity_key"), F.lit("")) != "")


def entities(events: DataFrame, zone: str = ZONE) -> DataFrame:
    """How many rows of a bucket name each user and address (A3)."""
    return _entities(grained(usable(events), zone)).groupBy(*KEYS, "kind", "entity_key").agg(F.count("*").alias("refs"))


def apply_changes(stored: DataFrame, refs: DataFrame, changes: DataFrame, zone: str = ZONE) -> tuple[DataFrame, DataFrame]:
    """Buckets and reference counts after signed events (A4).

    changes: events with ``sign`` +1 (inserted) or -1 (taken back); an update is
    both. Buckets without events and entities without rows vanish.
    """
    marked = grained(usable(changes), zone)
    new_refs = refs.select(*KEYS, "kind", "entity_key", "refs").unionByName(_entities(marked).groupBy(*KEYS, "kind", "entity_key").agg(F.sum("sign").alias("refs")))
    new_refs = new_refs.groupBy(*KEYS, "kind", "entity_key").agg(F.sum("refs").cast("long").alias("refs")).filter("refs > 0")
    sums = stored.select(*KEYS, *COUNTS).unionByName(marked.groupBy(*KEYS).agg(*_sums(F.col("sign"))))
    sums = sums.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS)).filter("total_events > 0")
    live = lambda kind: F.count_if(F.col("kind") == kind)
    alive = new_refs.groupBy(*KEYS).agg(live("user").alias("distinct_users"), live("ip").alias("distinct_ips"))
    out = sums.join(alive, list(KEYS), "left").fillna(0, ["distinct_users", "distinct_ips"])
    return out.withColumn("service_key", service_key(F.col("relying_party"))), new_refs


def labelled(df: DataFrame, labels: DataFrame, digest: str = "sha256", service: str = "relying_party") -> DataFrame:
    """df with service_label: the catalog's, else "Servicio " and ten digits of a hash.

    labels: (relying_party, label), a catalog of services; broadcast while it is small.
    """
    code = F.sha2(F.col(service), 256) if digest == "sha256" else F.md5(F.col(service))
    names = labels.select(F.col("relying_party").alias(service), F.col("label").alias("_label"))
    joined = df.join(names, service, "left")
    return joined.withColumn("service_label", F.coalesce("_label", F.concat(F.lit("Servicio "), F.left(code, F.lit(10))))).drop("_label")


def analytics(mart: DataFrame, labels: DataFrame, grain: str | None = None) -> DataFrame:
    """Buckets with label and failure percent, of one grain or all (A5)."""
    rows = mart if grain is None else mart.filter(F.col("grain") == grain)
    percent = F.when(F.col("total_events") == 0, 0.0).otherwise(F.round(100 * F.col("failure_count") / F.col("total_events"), 2))
    return labelled(rows, labels).withColumn("failure_rate", percent)


def service_alerts(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per alert and service, with key and label."""
    rows = alerts.withColumn("relying_party", F.explode(F.split("relying_parties", ";"))).filter("relying_party <> ''")
    return labelled(rows.withColumn("service_key", service_key(F.col("relying_party"))), labels)


def complete_days(mart: DataFrame, minimum_events: int, minimum_hours: int, zone: str = ZONE) -> DataFrame:
    """Local days of a source with enough events in enough hours, over all services."""
    hours = mart.filter("grain = 'hour'").groupBy("source_name", "bucket").agg(F.sum("total_events").alias("n"))
    days = hours.groupBy("source_name", F.to_date(local(F.col("bucket"), zone)).alias("day"))
    return days.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("hours")).filter((F.col("n") >= minimum_events) & (F.col("hours") >= minimum_hours)).select("source_name", "day")


def oscillations(mart: DataFrame, alerts: DataFrame, service: str, start: str, stop: str, grain: str, training: tuple[str, str], minimum_events: int, minimum_hours: int, minimum_samples: int = 3, max_days: int = 31, zone: str = ZONE) -> DataFrame:
    """Bucket series of one service against its past.

    start, stop: local times (start included, stop not), multiples of the grain.
    Per bucket: the value one range earlier and the change, the mean of complete
    training days (of the same local hour, for hours) before the range with the
    number of samples and the deviation, and the alerts that overlap the bucket.
    """
    lo, hi = (F.to_utc_timestamp(F.lit(x).cast("timestamp"), zone) for x in (start, stop))
    span = F.lit(hi).cast("double") - F.lit(lo).cast("double")
    own = mart.filter((F.col("grain") == grain) & (F.col("relying_party") == service))
    length = 3600 if grain == "hour" else 86_400
    begin = F.col("bucket").cast("double")
    guard = F.when(span > max_days * 86_400, F.raise_error(F.lit("the range is too long")).cast("boolean")).when(span <= 0, F.raise_error(F.lit("the range is empty")).cast("boolean")).otherwise(True)
    series = own.filter((F.col("bucket") >= lo) & (F.col("bucket") < hi) & guard)
    hour = F.hour(local(F.col("bucket"), zone)) if grain == "hour" else F.lit(0)
    series = series.select("source_name", "bucket", "relying_party", *COUNTS, "distinct_users", "distinct_ips", hour.alias("hour"))
    before = own.select("source_name", F.timestamp_micros(F.unix_micros("bucket") + (span * 1_000_000).cast("long")).alias("bucket"), F.col("total_events").alias("previous_events"))
    day = F.to_date(local(F.col("bucket"), zone))
    days = complete_days(mart, minimum_events, minimum_hours, zone).filter((F.col("day") >= F.lit(training[0]).cast("date")) & (F.col("day") <= F.lit(training[1]).cast("date")))
    past = own.filter(F.col("bucket") < lo).withColumn("day", day).join(days, ["source_name", "day"], "left_semi")
    past = past.groupBy("source_name", hour.alias("hour")).agg(F.avg("total_events").alias("expected"), F.count("*").alias("baseline_samples"))
    near = alerts.withColumn("s", F.explode(F.split("relying_parties", ";"))).filter(F.col("s") == service)
    # Which buckets an alert touches is counted out from its ends: an equi join, not a range join.
    touched = F.explode(F.sequence(F.floor(F.col("first_seen").cast("double") / 3600), F.floor(F.col("last_seen").cast("double") / 3600)))
    near = near.select("alert_id", "first_seen", "last_seen", touched.alias("h"))
    slots = series.select("source_name", "bucket", F.explode(F.sequence(F.floor(begin / 3600), F.floor((begin + length - 1) / 3600))).alias("h"))
    over = slots.join(near, "h").filter((F.col("first_seen").cast("double") < begin + length) & (F.col("last_seen").cast("double") >= begin))
    over = over.groupBy("source_name", "bucket").agg(F.count_distinct("alert_id").alias("alerts"))
    joined = series.join(before, ["source_name", "bucket"], "left").join(F.broadcast(past), ["source_name", "hour"], "left").join(over, ["source_name", "bucket"], "left")
    enough = F.coalesce(F.col("baseline_samples"), F.lit(0)) >= minimum_samples
    percent = lambda value, base: F.when(base > 0, F.round(100 * (value - base) / base, 2))
    total, expected = F.col("total_events"), F.when(enough, F.col("expected"))
    return joined.select(
        "source_name", "bucket", "relying_party", *COUNTS, "distinct_users", "distinct_ips", "previous_events",
        percent(total, F.col("previous_events")).alias("change_percent"),
        F.round(expected, 6).alias("expected_events"),
        F.coalesce("baseline_samples", F.lit(0)).alias("baseline_samples"),
        percent(total, expected).alias("deviation_percent"),
        F.coalesce("alerts", F.lit(0)).alias("alerts"),
        (begin + length > F.lit(hi).cast("double")).alias("partial"),
    )


def overview(mart: DataFrame, alerts: DataFrame, start: str, stop: str, grain: str, services: Sequence[str] | None = None, zone: str = ZONE) -> DataFrame:
    """Buckets of several services with the alerts that end in them.

    alerts: with ``investigation_status``. A bucket with alerts alone has null metrics.
    """
    lo, hi = (F.to_utc_timestamp(F.lit(x).cast("timestamp"), zone) for x in (start, stop))
    rows = mart.filter((F.col("grain") == grain) & (F.col("bucket") >= lo) & (F.col("bucket") < hi))
    found = alerts.filter((F.col("last_seen") >= lo) & (F.col("last_seen") < hi)).withColumn("relying_party", F.explode(F.split("relying_parties", ";"))).filter("relying_party <> ''")
    if services is not None:
        rows, found = rows.filter(F.col("relying_party").isin(*services)), found.filter(F.col("relying_party").isin(*services))
    is_open = F.col("investigation_status").isin(*OPEN)
    of = lambda cond: F.count_distinct(F.when(cond, F.col("alert_id")))
    ends = found.withColumn("bucket", F.to_utc_timestamp(F.date_trunc(grain, local(F.col("last_seen"), zone)), zone)).groupBy("bucket", "relying_party").agg(
        F.count_distinct("alert_id").alias("alerts"),
        of(is_open).alias("open_alerts"),
        of(is_open & (F.col("severity") == "critical")).alias("critical_alerts"),
        of(is_open & (F.col("severity") == "high")).alias("high_alerts"),
    )
    joined = rows.select("bucket", "relying_party", *COUNTS, "distinct_users", "distinct_ips").join(ends, ["bucket", "relying_party"], "full_outer")
    return joined.fillna(0, ["alerts", "open_alerts", "critical_alerts", "high_alerts"]).withColumn("service_key", service_key(F.col("relying_party")))


def triage(rows: DataFrame, top: int = 10) -> DataFrame:
    """Services by open alerts, over an overview."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (*COUNTS, "alerts", "open_alerts", "critical_alerts", "high_alerts")]
    found = rows.groupBy("relying_party", "service_key").agg(*sums)
    found = found.withColumn("failure_percent", share(100 * F.col("failure_count"), F.col("total_events"), 2))
    return found.orderBy(F.desc("open_alerts"), F.desc("critical_alerts"), F.desc("total_events"), "relying_party").limit(top)


def choices(first: DataFrame, second: DataFrame, none: str = "(sin servicios)") -> DataFrame:
    """Distinct services of two views, or one placeholder if there are none."""
    found = first.select("relying_party").union(second.select("relying_party")).distinct()
    blank = found.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(none).alias("relying_party"))
    return found.unionByName(blank)


def minute_services(rows: DataFrame, top: int = 100) -> DataFrame:
    """Totals of each service over minutes, the largest first."""
    sums = [F.sum(c).cast("long").alias(c) for c in COUNTS]
    found = rows.groupBy("relying_party").agg(*sums, F.max("minute").alias("last_minute"))
    found = found.withColumn("failure_percent", share(100 * F.col("failure_count"), F.col("total_events"), 2))
    return found.orderBy(F.desc("total_events"), "relying_party").limit(top)


def freshness(rows: DataFrame) -> DataFrame:
    """The last minute with events of each source."""
    return rows.groupBy("source_name").agg(F.max("minute").alias("last_minute"))
