"""Reading alerts and services: filters, pages, counts, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchwell.operators.mart import OPEN, service_key
from watchwell.sources.auth import day_start

#: Severities by rank.
RANKS = ("low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in RANKS)), severity)


def page(rows: DataFrame, keys: Sequence[str], descending: bool, size: int, anchor: Sequence | None = None, backwards: bool = False) -> tuple[DataFrame, DataFrame]:
    """A page of rows in the order of ``keys``, and (has_next, has_previous) (Q11).

    anchor: the keys of the row to go on from: after it, or before it if
    ``backwards``. One row more than the page is read to see whether there is more.
    """
    down = descending != backwards
    if anchor is not None:
        after = F.lit(False)
        for i in range(len(keys)):
            same = F.lit(True)
            for k, v in zip(keys[:i], anchor[:i], strict=True):
                same = same & (F.col(k) == F.lit(v))
            step = F.col(keys[i]) < F.lit(anchor[i]) if down else F.col(keys[i]) > F.lit(anchor[i])
            after = after | (same & step)
        rows = rows.filter(after)
    order = [F.desc(k) if down else F.asc(k) for k in keys]
    probe = rows.orderBy(*order).limit(size + 1)
    more = probe.agg((F.count("*") > size).alias("more"), F.count("*").alias("n"))
    going, back = F.lit(anchor is not None and backwards), F.lit(anchor is not None and not backwards)
    state = more.select(
        ((F.col("n") > 0) & (going if backwards else F.col("more"))).alias("has_next"),
        ((F.col("n") > 0) & (F.col("more") if backwards else back)).alias("has_previous"),
    )
    shown = probe.orderBy(*order).limit(size)
    return shown.orderBy(*(F.desc(k) if descending else F.asc(k) for k in keys)), state


def browse_alerts(
    alerts: DataFrame, *, severity: str | None = None, status: str | None = None, rule_id: str | None = None, date_from: str | None = None, date_to: str | None = None,
    service: str | None = None, key: str | None = None, overlap: tuple[str, str] | None = None, zone: str = "America/Guayaquil",
) -> DataFrame:
    """Alerts by equality, local days (both included), service or service key, and overlap with [from, to) (Q9)."""
    found = alerts
    for column, value in (("severity", severity), ("investigation_status", status), ("rule_id", rule_id)):
        if value:
            found = found.filter(F.col(column) == value)
    if date_from:
        found = found.filter(F.col("first_seen") >= day_start(date_from, zone))
    if date_to:
        found = found.filter(F.col("first_seen") < day_start(date_to, zone, 1))
    services = F.split("relying_parties", ";")
    if service:
        found = found.filter(F.array_contains(services, service))
    if key:
        found = found.filter(F.exists(services, lambda s: service_key(s) == key))
    if overlap:
        found = found.filter((F.col("first_seen") < F.lit(overlap[1]).cast("timestamp")) & (F.col("last_seen") >= F.lit(overlap[0]).cast("timestamp")))
    return found


SORTS = {"risk": (("risk_score", "first_seen", "alert_id"), True), "newest": (("first_seen", "alert_id"), True), "oldest": (("first_seen", "alert_id"), False)}
SERVICE_SORTS = {"volume": (("total_events", "relying_party"), True), "failures": (("failure_count", "relying_party"), True), "recent": (("last_seen", "relying_party"), True), "service": (("relying_party",), False)}


def list_alerts(alerts: DataFrame, limit: int, **equal: str) -> DataFrame:
    """The alerts of highest risk with equal columns (Q8). limit: 1 to 5000."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be from 1 to 5000")
    for column, value in equal.items():
        alerts = alerts.filter(F.col(column) == value)
    return alerts.orderBy(F.desc("risk_score"), F.desc("last_seen"), "alert_id").limit(limit)


def scope(events: DataFrame, window_days: int = 0, date_from: str | None = None, date_to: str | None = None, service: str | None = None, among: Sequence[str] | None = None, zone: str = "America/Guayaquil") -> DataFrame:
    """Consistent events with a service, of the days before the newest event, local days and services (Q1, Q10)."""
    good = events.filter("is_consistent")
    if window_days:
        newest = good.agg(F.max("ts").alias("_newest"))
        good = good.join(F.broadcast(newest)).filter(F.col("ts") >= F.timestamp_micros(F.unix_micros("_newest") - window_days * 86_400_000_000)).drop("_newest")
    found = good.filter(F.trim(F.coalesce(F.col("relying_party"), F.lit(""))) != "")
    if date_from:
        found = found.filter(F.col("ts") >= day_start(date_from, zone))
    if date_to:
        found = found.filter(F.col("ts") < day_start(date_to, zone, 1))
    if service:
        found = found.filter(F.col("relying_party") == service)
    if among is not None:
        found = found.filter(F.col("relying_party").isin(*among)) if among else found.filter(F.lit(False))
    return found


def _metrics() -> list[Column]:
    of = lambda name: F.coalesce(F.sum(F.when(F.col("event_class") == name, F.col("weight"))), F.lit(0)).cast("long").alias(f"{name}_count")
    kinds = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    return [F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("total_events"), of("success"), of("failure"), of("lockout"), kinds("user_key").alias("distinct_users"), kinds("client_ip_key").alias("distinct_client_ips"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")]


def service_metrics(scoped: DataFrame) -> DataFrame:
    """Counts, distinct keys and times of each service, and shares of the whole (Q1, Q3)."""
    rows = scoped.groupBy("relying_party").agg(*_metrics())
    whole = rows.agg(F.sum("total_events").alias("_all"), F.max("total_events").alias("_most"))
    percent = lambda a, b: F.when(b > 0, F.round(100 * a / b, 2)).otherwise(0.0)
    total = F.col("total_events")
    return rows.join(F.broadcast(whole)).select(
        *rows.columns,
        percent(F.col("failure_count") + F.col("lockout_count"), total).alias("adverse_rate"),
        percent(total, F.col("_all")).alias("share_percent"),
        percent(total, F.col("_most")).alias("bar_percent"),
    )


def scope_summary(scoped: DataFrame) -> DataFrame:
    """One row of totals of a scope (Q10)."""
    return scoped.agg(*_metrics(), F.count_distinct("relying_party").alias("distinct_services"))


def top_services(metrics: DataFrame, k: int) -> DataFrame:
    """The k largest services (Q2)."""
    return metrics.orderBy(F.desc("total_events"), "relying_party").limit(k)


def rare_services(metrics: DataFrame, most: int) -> DataFrame:
    """Services of few events (Q2)."""
    return metrics.filter(F.col("total_events") <= most)


def counts(alerts: DataFrame) -> DataFrame:
    """Alerts in total, by severity, status and rule (Q4)."""
    keys = ("severity", "investigation_status", "rule_id")
    sets = alerts.groupingSets([[F.col(k)] for k in keys] + [[]], *keys)
    return sets.agg(F.count("*").alias("alerts"))


def queue_summary(alerts: DataFrame) -> DataFrame:
    """The work queue of each source (Q5)."""
    status = F.col("investigation_status")
    is_open = status.isin(*OPEN)
    return alerts.groupBy("source_name").agg(
        F.count("*").alias("total"),
        F.count_if(status.isin("new", "notified")).alias("pending_review"),
        F.count_if(status == "investigating").alias("investigating"),
        F.count_if(status == "resolved").alias("resolved"),
        F.count_if(status == "false_positive").alias("false_positive"),
        *(F.count_if(is_open & (F.col("severity") == s)).alias(f"open_{s}") for s in RANKS),
        F.max("updated_at").alias("last_updated_at"),
    )


def open_by_service(alerts: DataFrame, services: Sequence[str] | None = None) -> DataFrame:
    """Open alerts of each service: count, highest severity, latest alert (Q6, Q7)."""
    rows = alerts.filter(F.col("investigation_status").isin(*OPEN)).withColumn("relying_party", F.explode(F.split("relying_parties", ";"))).filter("relying_party <> ''")
    if services is not None:
        rows = rows.filter(F.col("relying_party").isin(*services))
    latest = F.max(F.struct("updated_at", "alert_id"))["alert_id"]
    found = rows.groupBy("relying_party").agg(F.count("*").alias("open_alerts"), F.max(severity_rank(F.col("severity"))).alias("_rank"), latest.alias("latest_alert_id"))
    return found.withColumn("highest_severity", F.element_at(F.array(*(F.lit(x) for x in RANKS)), F.col("_rank").cast("int"))).drop("_rank")


def monitored(metrics: DataFrame, catalog: DataFrame, waiting: DataFrame) -> DataFrame:
    """metrics with the catalog's level and the open alerts, and rank among sensitive services (Q12).

    catalog: (relying_party, label, level, category), small. Services that are not
    sensitive have no rank.
    """
    rows = metrics.join(catalog, "relying_party", "left").join(waiting, "relying_party", "left")
    rows = rows.withColumns({"display_name": F.coalesce("label", "relying_party"), "sensitivity_level": F.coalesce("level", F.lit("normal")), "sensitivity_category": F.coalesce("category", F.lit("General")), "open_alerts": F.coalesce("open_alerts", F.lit(0)), "highest_severity": F.coalesce("highest_severity", F.lit(""))})
    level = F.when(F.col("sensitivity_level") == "high", 2).when(F.col("sensitivity_level") == "medium", 1).otherwise(0)
    sensitive = rows.filter(level > 0)
    order = Window.orderBy(F.desc("open_alerts"), F.desc(level), F.desc(F.col("failure_count") + F.col("lockout_count")), "display_name", "relying_party")
    ranked = sensitive.select("relying_party", F.row_number().over(order).alias("sensitive_rank"))
    return rows.join(F.broadcast(ranked), "relying_party", "left").select("relying_party", "display_name", "sensitivity_level", "sensitivity_category", "total_events", "failure_count", "lockout_count", "open_alerts", "highest_severity", "sensitive_rank")


def sensitive_alerts(alerts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per alert its sensitive services, most sensitive first, and the highest level (Q13)."""
    level = F.when(F.col("level") == "high", 2).when(F.col("level") == "medium", 1)
    rows = alerts.select("alert_id", F.explode_outer(F.split("relying_parties", ";")).alias("relying_party")).join(F.broadcast(catalog), "relying_party", "left")
    listed = F.array_sort(F.collect_list(F.when(level.isNotNull(), F.struct((-level).alias("o"), "relying_party", "level"))))
    found = rows.groupBy("alert_id").agg(listed.alias("s"))
    return found.select("alert_id", F.array_join(F.transform("s", lambda x: x["relying_party"]), ";").alias("sensitive_services"), (F.size("s") > 0).alias("has_sensitive_service"), F.coalesce(F.try_element_at("s", F.lit(1))["level"], F.lit("normal")).alias("sensitivity_level"))


def history(log: DataFrame, alert_id: str) -> DataFrame:
    """Rows of one alert in the order of time (Q14)."""
    return log.filter(F.col("alert_id") == alert_id).orderBy("changed_at")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each source (A10)."""
    rest = [c for c in runs.columns if c not in ("source_name", "run_id")]
    return runs.groupBy("source_name").agg(F.max(F.struct("run_id", *rest)).alias("r")).select("source_name", "r.*")


def health(runs: DataFrame, events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per source: the last run, whether it went well, and table sizes (Q15)."""
    sizes = events.groupBy("source_name").agg(F.count("*").alias("events")).join(alerts.groupBy("source_name").agg(F.count("*").alias("alerts")), "source_name", "full_outer")
    return latest_runs(runs).join(sizes, "source_name", "left").fillna(0, ["events", "alerts"]).withColumn("healthy", F.col("status") == "completed")


def revisions(events: DataFrame, alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Numbers per source that move only when rows are added (Q16)."""
    e = events.groupBy("source_name").agg(F.count("*").alias("events_revision"))
    a = alerts.select("source_name").unionAll(log.select("source_name")).groupBy("source_name").agg(F.count("*").alias("alerts_revision"))
    return e.join(a, "source_name", "full_outer").fillna(0)


def latest_source(runs: DataFrame) -> DataFrame:
    """The source of the newest run (Q17)."""
    return runs.agg(F.max(F.struct("run_id", "source_name"))["source_name"].alias("source_name"))


def rule_overview(rules, alerts: DataFrame, disabled: dict[str, str]) -> DataFrame:
    """Enabled rules with their alerts, disabled ones with the reason (Q18)."""
    rows = [(r.rule_id, r.name, r.enabled, r.reason_disabled) for r in rules.all()] + [(k, k, False, v) for k, v in disabled.items()]
    known = alerts.sparkSession.createDataFrame(rows, "rule_id string, rule_name string, enabled boolean, reason string")
    n = alerts.groupBy("rule_id").agg(F.count("*").alias("alerts"))
    return known.join(n, "rule_id", "left").fillna(0, ["alerts"])
