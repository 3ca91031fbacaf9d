"""Registered queries of the detection rules."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from watchwell.operators import baseline, detect
from watchwell.operators.rules import Exclusions
from watchwell.plans.common import ALERT_FIELDS, ALL_RULES, CONFIG, E, R_BRUTE, R_LOCK, R_NEW, R_SPRAY, R_SUCCESS, RULES, TRAIN, TRAINING_END, Registry, all_alerts, consistent, found_alerts, one_rule, trained
from watchwell.sources.tables import shared_dir
from watchwell.streaming.growing import GrowingAlerts

REGISTRY = Registry()


@REGISTRY.add("brute_force_alerts", one_rule(R_BRUTE, "brute"))
def brute_force_alerts(spark, sf_dir):
    return detect.brute_force(consistent(spark, sf_dir), RULES).select(*ALERT_FIELDS)


@REGISTRY.add("password_spray_alerts", one_rule(R_SPRAY, "spray"))
def password_spray_alerts(spark, sf_dir):
    return detect.password_spray(consistent(spark, sf_dir), RULES).select(*ALERT_FIELDS)


@REGISTRY.add("success_after_failures_alerts", one_rule(R_SUCCESS, "succ"))
def success_after_failures_alerts(spark, sf_dir):
    return detect.success_after_failures(consistent(spark, sf_dir), RULES).select(*ALERT_FIELDS)


@REGISTRY.add("lockout_alerts", one_rule(R_LOCK, "lockd"))
def lockout_alerts(spark, sf_dir):
    return detect.lockouts(consistent(spark, sf_dir), RULES).select(*ALERT_FIELDS)


@REGISTRY.add("new_ip_alerts", one_rule(R_NEW, "newip", TRAIN))
def new_ip_alerts(spark, sf_dir):
    known = baseline.context(trained(spark, sf_dir), CONFIG)
    return detect.new_ip(consistent(spark, sf_dir), RULES, known["users"], known["user_ips"], TRAINING_END).select(*ALERT_FIELDS)


@REGISTRY.add("alerts_all", ALL_RULES + " SELECT " + ", ".join(ALERT_FIELDS) + " FROM alerts")
def alerts_all(spark, sf_dir):
    return found_alerts(spark, sf_dir).select(*ALERT_FIELDS)


@REGISTRY.add("alerts_grown", ALL_RULES + " SELECT " + ", ".join(ALERT_FIELDS) + " FROM alerts")
def alerts_grown(spark, sf_dir):
    """The same alerts, found range by range of about a third of the time that the events span."""
    events, known = consistent(spark, sf_dir), baseline.context(trained(spark, sf_dir), CONFIG)
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if span.lo is None:
        return found_alerts(spark, sf_dir).select(*ALERT_FIELDS)
    bounds = [str(span.lo + (span.hi - span.lo) * i / 3) for i in range(3)] + [str(span.hi + timedelta(seconds=1))]
    table = GrowingAlerts(f"{shared_dir(spark)}/alerts-grown-{uuid.uuid4().hex}", RULES, (known["users"], known["user_ips"], TRAINING_END))
    table.refresh(events, bounds)
    return table.alerts(spark).select(*ALERT_FIELDS)


@REGISTRY.add(
    "alert_summary",
    ALL_RULES + " SELECT rule_id, severity, count(*) AS alerts, round(avg(risk_score), 2) AS mean_score FROM alerts GROUP BY GROUPING SETS ((rule_id), (severity), ())",
)
def alert_summary(spark, sf_dir):
    return detect.summary(all_alerts(spark, sf_dir))


@REGISTRY.add(
    "evaluation_events",
    f"WITH {E} SELECT id AS event_id, cls AS event_class, usr AS user_key FROM e WHERE CAST(loc AS DATE) > DATE '2024-01-07'",
)
def evaluation_events(spark, sf_dir):
    return detect.evaluation(consistent(spark, sf_dir), TRAINING_END, RULES.zone).select("event_id", "event_class", "user_key")


@REGISTRY.add(
    "authorized_events",
    f"""WITH {E}, a AS (SELECT *, usr IN ('usr_1', 'usr_2') OR ip IN ('ip_3') OR rp IN ('svc_4') AS authorized FROM e)
    SELECT id AS event_id, authorized, CAST(CASE WHEN authorized THEN 25 ELSE 6 END AS BIGINT) AS failure_threshold FROM a""",
)
def authorized_events(spark, sf_dir):
    lists = Exclusions(("usr_1", "usr_2"), ("ip_3",), ("svc_4",), {"failures_per_user": 25})
    marked = consistent(spark, sf_dir).withColumn("authorized", detect.authorized(lists))
    return marked.select("event_id", "authorized", detect.threshold(lists, "failures_per_user", 6).alias("failure_threshold"))


@REGISTRY.add(
    "risk_scores",
    f"""WITH {E}, c AS (SELECT usr AS user_key, CAST(sum(w) FILTER (cls = 'failure') AS BIGINT) AS n FROM e GROUP BY 1 HAVING n > 0),
    s AS (SELECT *, least(100, 65 + least(10, greatest(0, n - 6)) + CASE WHEN n >= 20 THEN 20 ELSE 0 END) AS score FROM c)
    SELECT user_key, n AS failures, CAST(score AS INTEGER) AS risk_score, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 65 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS severity FROM s""",
)
def risk_scores(spark, sf_dir):
    failed = consistent(spark, sf_dir).filter("event_class = 'failure'").groupBy("user_key").agg(F.sum("weight").alias("failures"))
    extra = [("intense_pattern", F.when(F.col("failures") >= 20, 20).otherwise(0))]
    score = detect.risk_score(detect.risk_factors(RULES, RULES.brute_force, F.col("failures"), F.lit(6), extra))
    return failed.withColumn("risk_score", score).withColumn("severity", detect.severity(F.col("risk_score"), RULES))
