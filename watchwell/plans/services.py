"""Registered queries of the service mart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from watchwell.operators import mart
from watchwell.plans.common import ALL_RULES, E, E_ALL, Registry, all_alerts, text_time
from watchwell.sources.auth import activity
from watchwell.sources.tables import shared_dir
from watchwell.streaming import live

REGISTRY = Registry()
_CLASS = """CAST(sum(w) AS BIGINT) AS total_events, CAST(coalesce(sum(w) FILTER (cls = 'success'), 0) AS BIGINT) AS success_count,
CAST(coalesce(sum(w) FILTER (cls = 'failure'), 0) AS BIGINT) AS failure_count, CAST(coalesce(sum(w) FILTER (cls = 'lockout'), 0) AS BIGINT) AS lockout_count"""
_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_BUCKETS = f"""b AS (
  SELECT 'demo' AS source_name, grain, date_trunc(grain, loc) + INTERVAL 5 HOUR AS bucket, rp AS relying_party, {_CLASS}, count(DISTINCT usr) AS distinct_users, count(DISTINCT ip) AS distinct_ips, sha256(rp) AS service_key
  FROM e, (VALUES ('hour'), ('day')) g(grain) GROUP BY ALL)"""
_MINUTES = f"mi AS (SELECT 'demo' AS source_name, date_trunc('minute', ts) AS minute, rp AS relying_party, {_CLASS}, CAST(coalesce(sum(w) FILTER (cls = 'other'), 0) AS BIGINT) AS other_count FROM e GROUP BY ALL)"
_LABEL = "CASE WHEN relying_party IN ('svc_0', 'svc_1') THEN 'Portal ' || relying_party ELSE 'Servicio ' || left(sha256(relying_party), 10) END"


def _labels(spark):
    return spark.createDataFrame([("svc_0", "Portal svc_0"), ("svc_1", "Portal svc_1")], "relying_party string, label string")


def _mart(spark, sf_dir):
    return mart.buckets(activity(spark, sf_dir))


# A status for the test alerts, by the first digit of their ids: new, investigating, resolved or false_positive.
_HEX = "('0x' || substr(alert_id, 5, 1))::BIGINT"
STATUS_SQL = f"CASE {_HEX} % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolved' ELSE 'false_positive' END"


def with_status(alerts):
    n = F.conv(F.substring("alert_id", 5, 1), 16, 10).cast("int") % 4
    return alerts.withColumn("investigation_status", F.when(n == 0, "new").when(n == 1, "investigating").when(n == 2, "resolved").otherwise("false_positive"))


@REGISTRY.add("minute_metrics", f"WITH {E},{_MINUTES} SELECT * REPLACE ({_T.format('minute')} AS minute) FROM mi")
def minute_metrics(spark, sf_dir):
    return mart.minutes(activity(spark, sf_dir)).withColumn("minute", text_time("minute"))


@REGISTRY.add("service_buckets", f"WITH {E},{_BUCKETS} SELECT * REPLACE ({_T.format('bucket')} AS bucket) FROM b")
def service_buckets(spark, sf_dir):
    return _mart(spark, sf_dir).withColumn("bucket", text_time("bucket"))


@REGISTRY.add(
    "bucket_entities",
    f"""WITH {E} SELECT 'demo' AS source_name, grain, {_T.format('date_trunc(grain, loc) + INTERVAL 5 HOUR')} AS bucket, rp AS relying_party, kind, CASE kind WHEN 'user' THEN usr ELSE ip END AS entity_key, count(*) AS refs
    FROM e, (VALUES ('hour'), ('day')) g(grain), (VALUES ('user'), ('ip')) k(kind) GROUP BY ALL""",
)
def bucket_entities(spark, sf_dir):
    return mart.entities(activity(spark, sf_dir)).withColumn("bucket", text_time("bucket"))


@REGISTRY.add(
    "bucket_changes",
    f"""WITH {E_ALL}, kept AS (SELECT *, id::BIGINT AS n FROM e_all WHERE ok), e AS (
      SELECT id, ts, us, cls, CASE WHEN n % 7 = 1 THEN 'usr_moved' ELSE usr END AS usr, ip, rp, CASE WHEN n % 7 = 1 THEN w + 5 ELSE w END AS w, loc FROM kept WHERE n % 7 <> 2),{_BUCKETS}
    SELECT * REPLACE ({_T.format('bucket')} AS bucket) FROM b""",
)
def bucket_changes(spark, sf_dir):
    """Buckets after rows with id % 7 = 1 were updated and those with id % 7 = 2 deleted."""
    events = activity(spark, sf_dir)
    n = F.col("event_id").cast("long") % 7
    gone = events.filter(n.isin(1, 2)).withColumn("sign", F.lit(-1))
    came = events.filter(n == 1).withColumns({"user_key": F.lit("usr_moved"), "weight": F.col("weight") + 5, "sign": F.lit(1)})
    out, _ = mart.apply_changes(mart.buckets(events), mart.entities(events), gone.unionByName(came))
    return out.withColumn("bucket", text_time("bucket"))


@REGISTRY.add(
    "live_buckets",
    f"""WITH {E_ALL}, e AS (
      SELECT id, ts, us, cls, usr, ip, CASE WHEN cls = 'other' THEN 'svc_moved' ELSE rp END AS rp, w, loc FROM e_all WHERE ok AND cls <> 'lockout'),{_BUCKETS}
    SELECT * REPLACE ({_T.format('bucket')} AS bucket) FROM b""",
)
def live_buckets(spark, sf_dir):
    """Buckets of the live mart after batches of changes whose times are in no order, one of them twice.

    Every event is inserted; then events of class other move to another service and
    lockouts are deleted.
    """
    events = activity(spark, sf_dir)
    order = F.when(F.col("op") == "insert", 0).when(F.col("op") == "update", 1).otherwise(2).cast("long")
    moved = events.filter("event_class = 'other'").withColumn("relying_party", F.lit("svc_moved"))
    changes = live.as_changes(events).unionByName(live.as_changes(moved, "update")).unionByName(live.as_changes(events.filter("event_class = 'lockout'"), "delete")).withColumn("seq", order)
    one = live.LiveMart(f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", slots=1, key_slots=2)
    step, part = one.step(), F.pmod(F.xxhash64("event_id"), F.lit(2))
    for number, which in enumerate((0, 1, 0)):
        step(changes.filter(part == which), number)
    return one.buckets(spark).withColumn("bucket", text_time("bucket"))


@REGISTRY.add(
    "service_analytics_hour",
    f"WITH {E},{_BUCKETS} SELECT * REPLACE ({_T.format('bucket')} AS bucket), {_LABEL} AS service_label, round(100 * failure_count / total_events, 2) AS failure_rate FROM b WHERE grain = 'hour'",
)
def service_analytics_hour(spark, sf_dir):
    return mart.analytics(_mart(spark, sf_dir), _labels(spark), "hour").withColumn("bucket", text_time("bucket"))


@REGISTRY.add(
    "service_analytics_day",
    f"WITH {E},{_BUCKETS} SELECT * REPLACE ({_T.format('bucket')} AS bucket), {_LABEL} AS service_label, round(100 * failure_count / total_events, 2) AS failure_rate FROM b WHERE grain = 'day'",
)
def service_analytics_day(spark, sf_dir):
    return mart.analytics(_mart(spark, sf_dir), _labels(spark), "day").withColumn("bucket", text_time("bucket"))


@REGISTRY.add(
    "alerts_by_service",
    ALL_RULES + f", x AS (SELECT alert_id, rule_id, severity, unnest(string_split(relying_parties, ';')) AS relying_party FROM alerts) SELECT alert_id, rule_id, severity, relying_party, sha256(relying_party) AS service_key, {_LABEL} AS service_label FROM x",
)
def alerts_by_service(spark, sf_dir):
    return mart.service_alerts(all_alerts(spark, sf_dir), _labels(spark)).select("alert_id", "rule_id", "severity", "relying_party", "service_key", "service_label")


_COMPLETE = """comp AS (SELECT day FROM (SELECT bucket, CAST(bucket - INTERVAL 5 HOUR AS DATE) AS day, sum(total_events) AS n FROM b WHERE grain = 'hour' GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) >= 20 AND count(*) >= 12)"""


@REGISTRY.add("complete_days", f"WITH {E},{_BUCKETS},{_COMPLETE} SELECT 'demo' AS source_name, CAST(day AS VARCHAR) AS day FROM comp")
def complete_days(spark, sf_dir):
    return mart.complete_days(_mart(spark, sf_dir), 20, 12).select("source_name", F.col("day").cast("string"))


def _oscillation_sql(grain: str, start: str, stop: str, length: str) -> str:
    hour = "hour(bucket - INTERVAL 5 HOUR)" if grain == "hour" else "0"
    lo, hi = f"(TIMESTAMP '{start}' + INTERVAL 5 HOUR)", f"(TIMESTAMP '{stop}' + INTERVAL 5 HOUR)"
    return (
        ALL_RULES
        + f""",{_BUCKETS},{_COMPLETE}, own AS (SELECT *, {hour} AS hr FROM b WHERE grain = '{grain}' AND relying_party = 'svc_3'),
    past AS (SELECT hr, avg(total_events) AS expected, count(*) AS samples FROM own WHERE bucket < {lo} AND CAST(bucket - INTERVAL 5 HOUR AS DATE) IN (SELECT day FROM comp WHERE day BETWEEN DATE '2023-12-31' AND DATE '2024-01-07') GROUP BY 1),
    near AS (SELECT * FROM alerts WHERE list_contains(string_split(relying_parties, ';'), 'svc_3'))
    SELECT o.source_name, {_T.format('o.bucket')} AS bucket, o.relying_party, o.total_events, o.success_count, o.failure_count, o.lockout_count, o.distinct_users, o.distinct_ips, p.total_events AS previous_events,
      CASE WHEN p.total_events > 0 THEN round(100 * (o.total_events - p.total_events) / p.total_events, 2) END AS change_percent,
      CASE WHEN samples >= 3 THEN round(expected, 6) END AS expected_events, coalesce(samples, 0) AS baseline_samples,
      CASE WHEN samples >= 3 AND expected > 0 THEN round(100 * (o.total_events - expected) / expected, 2) END AS deviation_percent,
      (SELECT count(*) FROM near n WHERE n.first_seen < o.bucket + {length} AND n.last_seen >= o.bucket) AS alerts, o.bucket + {length} > {hi} AS partial
    FROM own o LEFT JOIN own p ON p.bucket = o.bucket - ({hi} - {lo}) LEFT JOIN past ON past.hr = o.hr WHERE o.bucket >= {lo} AND o.bucket < {hi}"""
    )


@REGISTRY.add("oscillations_hour", _oscillation_sql("hour", "2024-01-10 00:00:00", "2024-01-12 00:00:00", "INTERVAL 1 HOUR"))
def oscillations_hour(spark, sf_dir):
    return mart.oscillations(_mart(spark, sf_dir), all_alerts(spark, sf_dir), "svc_3", "2024-01-10 00:00:00", "2024-01-12 00:00:00", "hour", ("2023-12-31", "2024-01-07"), 20, 12).withColumn("bucket", text_time("bucket"))


@REGISTRY.add("oscillations_day", _oscillation_sql("day", "2024-01-10 00:00:00", "2024-01-20 00:00:00", "INTERVAL 1 DAY"))
def oscillations_day(spark, sf_dir):
    return mart.oscillations(_mart(spark, sf_dir), all_alerts(spark, sf_dir), "svc_3", "2024-01-10 00:00:00", "2024-01-20 00:00:00", "day", ("2023-12-31", "2024-01-07"), 20, 12).withColumn("bucket", text_time("bucket"))


_OVERVIEW = (
    ALL_RULES
    + f""",{_BUCKETS}, al AS (SELECT *, {STATUS_SQL} AS st, unnest(string_split(relying_parties, ';')) AS relying_party FROM alerts WHERE last_seen >= TIMESTAMP '2024-01-10 05:00:00' AND last_seen < TIMESTAMP '2024-01-24 05:00:00'),
  en AS (SELECT date_trunc('day', last_seen - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS bucket, relying_party, count(*) AS alerts, count(*) FILTER (st IN ('new', 'investigating')) AS open_alerts,
    count(*) FILTER (st IN ('new', 'investigating') AND severity = 'critical') AS critical_alerts, count(*) FILTER (st IN ('new', 'investigating') AND severity = 'high') AS high_alerts FROM al GROUP BY 1, 2),
  ov AS (SELECT bucket, relying_party, total_events, success_count, failure_count, lockout_count, distinct_users, distinct_ips, coalesce(alerts, 0) AS alerts, coalesce(open_alerts, 0) AS open_alerts,
    coalesce(critical_alerts, 0) AS critical_alerts, coalesce(high_alerts, 0) AS high_alerts, sha256(relying_party) AS service_key
    FROM (SELECT * FROM b WHERE grain = 'day' AND bucket >= TIMESTAMP '2024-01-10 05:00:00' AND bucket < TIMESTAMP '2024-01-24 05:00:00') FULL JOIN en USING (bucket, relying_party))"""
)


def _overview(spark, sf_dir):
    return mart.overview(_mart(spark, sf_dir), with_status(all_alerts(spark, sf_dir)), "2024-01-10 00:00:00", "2024-01-24 00:00:00", "day")


@REGISTRY.add("services_overview", _OVERVIEW + f" SELECT * REPLACE ({_T.format('bucket')} AS bucket) FROM ov")
def services_overview(spark, sf_dir):
    return _overview(spark, sf_dir).withColumn("bucket", text_time("bucket"))


@REGISTRY.add(
    "triage_top10",
    _OVERVIEW
    + """ SELECT *, CASE WHEN total_events = 0 THEN 0 ELSE round(100 * failure_count / total_events, 2) END AS failure_percent FROM (
    SELECT relying_party, service_key, CAST(coalesce(sum(total_events), 0) AS BIGINT) AS total_events, CAST(coalesce(sum(success_count), 0) AS BIGINT) AS success_count, CAST(coalesce(sum(failure_count), 0) AS BIGINT) AS failure_count,
      CAST(coalesce(sum(lockout_count), 0) AS BIGINT) AS lockout_count, CAST(sum(alerts) AS BIGINT) AS alerts, CAST(sum(open_alerts) AS BIGINT) AS open_alerts, CAST(sum(critical_alerts) AS BIGINT) AS critical_alerts, CAST(sum(high_alerts) AS BIGINT) AS high_alerts
    FROM ov GROUP BY 1, 2) ORDER BY open_alerts DESC, critical_alerts DESC, total_events DESC, relying_party LIMIT 10""",
)
def triage_top10(spark, sf_dir):
    return mart.triage(_overview(spark, sf_dir))


@REGISTRY.add("service_choices", f"WITH {E} SELECT DISTINCT rp AS relying_party FROM e")
def service_choices(spark, sf_dir):
    rows = _mart(spark, sf_dir)
    return mart.choices(rows.filter("grain = 'hour'"), rows.filter("grain = 'day'"))


@REGISTRY.add(
    "minute_services",
    f"""WITH {E},{_MINUTES} SELECT relying_party, CAST(sum(total_events) AS BIGINT) AS total_events, CAST(sum(success_count) AS BIGINT) AS success_count, CAST(sum(failure_count) AS BIGINT) AS failure_count, CAST(sum(lockout_count) AS BIGINT) AS lockout_count,
    {_T.format('max(minute)')} AS last_minute, round(100 * sum(failure_count) / sum(total_events), 2) AS failure_percent FROM mi GROUP BY 1 ORDER BY total_events DESC, relying_party LIMIT 100""",
)
def minute_services(spark, sf_dir):
    return mart.minute_services(mart.minutes(activity(spark, sf_dir))).withColumn("last_minute", text_time("last_minute"))


@REGISTRY.add("freshness", f"WITH {E} SELECT 'demo' AS source_name, {_T.format('max(date_trunc($$minute$$, ts))')} AS last_minute FROM e")
def freshness(spark, sf_dir):
    return mart.freshness(mart.minutes(activity(spark, sf_dir))).withColumn("last_minute", text_time("last_minute"))
