"""Registered queries of the behavioural baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchwell.operators import baseline
from watchwell.plans.common import ALL_RULES, CONFIG, DAYS, E, TRAIN, TRAINING_END, Registry, all_alerts, localized, text_time, trained

REGISTRY = Registry()

_COUNTS = """CAST(sum(w) AS BIGINT) AS total_events, CAST(coalesce(sum(w) FILTER (cls = 'success'), 0) AS BIGINT) AS success_count,
CAST(coalesce(sum(w) FILTER (cls = 'failure'), 0) AS BIGINT) AS failure_count, CAST(coalesce(sum(w) FILTER (cls = 'lockout'), 0) AS BIGINT) AS lockout_count,
count(DISTINCT usr) AS distinct_users, count(DISTINCT ip) AS distinct_client_ips, count(DISTINCT rp) AS distinct_relying_parties, count(DISTINCT hour(loc)) AS active_hour_count,
strftime(min(loc), '%Y-%m-%d %H:%M:%S.%f') AS first_seen_local, strftime(max(loc), '%Y-%m-%d %H:%M:%S.%f') AS last_seen_local"""
_RATES = """*, CASE WHEN success_count + failure_count = 0 THEN 0 ELSE round(failure_count / (success_count + failure_count), 6) END AS failure_rate,
CASE WHEN total_events = 0 THEN 0 ELSE round((failure_count + lockout_count) / total_events, 6) END AS adverse_event_rate"""


def _profile(keys: str, more: str = "", source: str = "tr") -> str:
    return f"SELECT {_RATES}{more} FROM (SELECT {keys}, {_COUNTS} FROM {source} GROUP BY ALL)"


def _shown(df):
    return df.withColumns({c: text_time(c) for c in ("first_seen_local", "last_seen_local")})


@REGISTRY.add("baseline_daily", f"WITH {E},{DAYS} SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day), day IN (SELECT day FROM days) AS baseline_included FROM ({_profile('CAST(loc AS DATE) AS day', source='e')})")
def baseline_daily(spark, sf_dir):
    return _shown(baseline.daily(localized(spark, sf_dir), CONFIG)).withColumn("day", F.col("day").cast("string"))


@REGISTRY.add("baseline_evaluation_days", f"WITH {E} SELECT DISTINCT strftime(loc, '%Y-%m-%d') AS day FROM e WHERE CAST(loc AS DATE) >= DATE '2024-01-08'")
def baseline_evaluation_days(spark, sf_dir):
    return baseline.evaluation_days(localized(spark, sf_dir), CONFIG).select(F.col("day").cast("string"))


@REGISTRY.add(
    "baseline_hourly",
    f"""WITH {TRAIN}, hours AS (SELECT CAST(range AS INTEGER) AS hour_local FROM range(24)), cells AS (
      SELECT day, hr, sum(w) AS n, sum(w) FILTER (cls = 'success') AS s, sum(w) FILTER (cls = 'failure') AS f, sum(w) FILTER (cls = 'lockout') AS l FROM tr GROUP BY 1, 2),
    grid AS (SELECT hour_local, d.day, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(f, 0) AS f, coalesce(l, 0) AS l
      FROM (SELECT DISTINCT day FROM tr) d CROSS JOIN hours LEFT JOIN cells c ON c.day = d.day AND c.hr = hour_local),
    r AS (SELECT hour_local, count(*) AS days_observed, count(*) FILTER (n > 0) AS days_with_data, CAST(sum(n) AS BIGINT) AS total_events, median(n) AS median_events_per_day,
      CAST(list_sort(list(n))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INTEGER) + 1] AS BIGINT) AS p95_events_per_day,
      CAST(sum(s) AS BIGINT) AS success_count, CAST(sum(f) AS BIGINT) AS failure_count, CAST(sum(l) AS BIGINT) AS lockout_count FROM grid GROUP BY 1)
    SELECT {_RATES}, CASE WHEN days_with_data > 0 THEN 'observed' ELSE 'unobserved' END AS coverage_status, round(total_events / days_observed, 2) AS average_events_per_day FROM r""",
)
def baseline_hourly(spark, sf_dir):
    return baseline.hourly(trained(spark, sf_dir))


@REGISTRY.add("baseline_users", f"WITH {TRAIN} SELECT *, CASE WHEN total_events >= 5 THEN 'sufficient' ELSE 'insufficient' END AS history_status FROM ({_profile('usr AS user_key')})")
def baseline_users(spark, sf_dir):
    return _shown(baseline.users(trained(spark, sf_dir), CONFIG))


@REGISTRY.add("baseline_addresses", f"WITH {TRAIN} {_profile('ip AS client_ip_key')}")
def baseline_addresses(spark, sf_dir):
    return _shown(baseline.addresses(trained(spark, sf_dir)))


@REGISTRY.add("baseline_services", f"WITH {TRAIN} {_profile('rp AS relying_party')}")
def baseline_services(spark, sf_dir):
    return _shown(baseline.services(trained(spark, sf_dir)))


@REGISTRY.add(
    "baseline_user_hours",
    f"""WITH {TRAIN}, c AS (SELECT usr AS user_key, CAST(hr AS INTEGER) AS hour_local, CAST(sum(w) AS BIGINT) AS event_count, CAST(coalesce(sum(w) FILTER (cls = 'success'), 0) AS BIGINT) AS success_count,
      CAST(coalesce(sum(w) FILTER (cls = 'failure'), 0) AS BIGINT) AS failure_count, CAST(coalesce(sum(w) FILTER (cls = 'lockout'), 0) AS BIGINT) AS lockout_count FROM tr GROUP BY 1, 2)
    SELECT *, round(event_count / sum(event_count) OVER (PARTITION BY user_key), 6) AS share_of_user_events FROM c""",
)
def baseline_user_hours(spark, sf_dir):
    return baseline.user_hours(trained(spark, sf_dir))


def _related(column: str, name: str) -> str:
    return f"WITH {TRAIN} SELECT *, round(total_events / sum(total_events) OVER (PARTITION BY user_key), 6) AS share_of_user_events FROM ({_profile(f'usr AS user_key, {column} AS {name}')})"


@REGISTRY.add("baseline_user_addresses", _related("ip", "client_ip_key"))
def baseline_user_addresses(spark, sf_dir):
    return _shown(baseline.relations(trained(spark, sf_dir), "client_ip_key"))


@REGISTRY.add("baseline_user_services", _related("rp", "relying_party"))
def baseline_user_services(spark, sf_dir):
    return _shown(baseline.relations(trained(spark, sf_dir), "relying_party"))


def _ranks(measure: str, key: str, value: str) -> str:
    pick = lambda f: f"CAST(v[CAST(round_even((len(v) - 1) * {f}, 0) AS INTEGER) + 1] AS BIGINT)"
    return f"SELECT '{measure}' AS measure, {pick(0.5)} AS p50, {pick(0.95)} AS p95, {pick(0.99)} AS p99, CAST(v[len(v)] AS BIGINT) AS max FROM (SELECT list_sort(list(x)) AS v FROM (SELECT {key}, {value} AS x FROM tr GROUP BY 1))"


@REGISTRY.add(
    "baseline_distributions",
    f"""WITH {TRAIN} {_ranks('failures_per_user', 'usr', "coalesce(sum(w) FILTER (cls = 'failure'), 0)")} UNION ALL {_ranks('failures_per_ip', 'ip', "coalesce(sum(w) FILTER (cls = 'failure'), 0)")} UNION ALL {_ranks('users_per_ip', 'ip', 'count(DISTINCT usr)')}""",
)
def baseline_distributions(spark, sf_dir):
    return baseline.distributions(trained(spark, sf_dir), CONFIG)


@REGISTRY.add(
    "baseline_summary",
    f"""WITH {TRAIN}, t AS (SELECT CAST(sum(w) AS BIGINT) AS baseline_events, count(DISTINCT day) AS baseline_days, CAST(min(day) AS VARCHAR) AS baseline_start, CAST(max(day) AS VARCHAR) AS baseline_end,
      CAST(sum(w) FILTER (cls = 'success') AS BIGINT) AS success_count, CAST(sum(w) FILTER (cls = 'failure') AS BIGINT) AS failure_count, CAST(sum(w) FILTER (cls = 'lockout') AS BIGINT) AS lockout_count,
      count(DISTINCT usr) AS distinct_users, count(DISTINCT ip) AS distinct_client_ips, array_to_string(list_sort(list(DISTINCT hr)), ';') AS observed_hours, 24 - count(DISTINCT hr) AS unobserved_hours FROM tr)
    SELECT *, round(failure_count / (success_count + failure_count), 6) AS failure_rate,
      (SELECT CAST(sum(w) AS BIGINT) FROM e WHERE CAST(loc AS DATE) >= DATE '2024-01-08') AS evaluation_events,
      (SELECT count(DISTINCT CAST(loc AS DATE)) FROM e WHERE CAST(loc AS DATE) >= DATE '2024-01-08') AS evaluation_days, (SELECT count(*) FROM e) AS input_rows FROM t""",
)
def baseline_summary(spark, sf_dir):
    return baseline.summary(localized(spark, sf_dir), trained(spark, sf_dir), CONFIG)


@REGISTRY.add(
    "baseline_context",
    f"""WITH {TRAIN} SELECT 'users' AS part, count(*) AS rows FROM (SELECT usr FROM tr GROUP BY 1 HAVING sum(w) >= 5)
    UNION ALL SELECT 'user_ips', count(*) FROM (SELECT DISTINCT usr, ip FROM tr) UNION ALL SELECT 'user_apps', count(*) FROM (SELECT DISTINCT usr, rp FROM tr) UNION ALL SELECT 'user_hours', count(*) FROM (SELECT DISTINCT usr, hr FROM tr)""",
)
def baseline_context(spark, sf_dir):
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows") for name, df in baseline.context(trained(spark, sf_dir), CONFIG).items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@REGISTRY.add(
    "alert_baseline_comparison",
    ALL_RULES
    + """, good AS (SELECT usr FROM tr GROUP BY 1 HAVING sum(w) >= 5)
    SELECT alert_id, CAST(first_seen - INTERVAL 5 HOUR AS DATE) > DATE '2024-01-07' AS baseline_usable,
      CAST(first_seen - INTERVAL 5 HOUR AS DATE) > DATE '2024-01-07' AND user_key IN (SELECT usr FROM good) AS user_known,
      CAST(first_seen - INTERVAL 5 HOUR AS DATE) > DATE '2024-01-07' AND (user_key, client_ip_key) IN (SELECT usr, ip FROM tr) AS address_known FROM alerts""",
)
def alert_baseline_comparison(spark, sf_dir):
    known = baseline.context(trained(spark, sf_dir), CONFIG)
    return baseline.compare(all_alerts(spark, sf_dir), known, TRAINING_END)
