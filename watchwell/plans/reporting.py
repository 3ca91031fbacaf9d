"""Registered queries of operations, reports, investigations and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchwell.operators import profile, reports, store
from watchwell.plans.alerts import _CHANGES, _ST, RUNS_SQL, _alerts, _log, runs
from watchwell.plans.common import ALL_RULES, E, E_ALL, Registry, all_alerts, consistent, text_time
from watchwell.plans.records import _RAW_SQL, raw_records
from watchwell.sources.auth import activity

REGISTRY = Registry()
_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_NOW = "2024-01-30 00:00:00"


@REGISTRY.add(
    "technical_metrics",
    f"""WITH {E},{RUNS_SQL}, l AS (SELECT source_name, max(run_id) AS run_id, arg_max(status, run_id) AS status, arg_max(started_at, run_id) AS s, arg_max(finished_at, run_id) AS f FROM runs GROUP BY 1)
    SELECT source_name, run_id, status, round((epoch_us(f) - epoch_us(s)) / 1000000, 3) AS last_run_duration_seconds, CAST(floor((epoch_us(TIMESTAMP '{_NOW}') - epoch_us(s)) / 1000000) AS BIGINT) AS last_run_age_seconds,
      (SELECT count(*) FROM runs r WHERE r.source_name = l.source_name AND status = 'failed' AND started_at >= TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR) AS failed_runs_24h,
      CASE WHEN source_name = 'demo' THEN CAST(floor((epoch_us(TIMESTAMP '{_NOW}') - (SELECT max(us) FROM e)) / 1000000) AS BIGINT) END AS checkpoint_age_seconds,
      CASE WHEN source_name = 'demo' THEN CAST(90 AS BIGINT) END AS event_to_soc_seconds FROM l""",
)
def technical_metrics(spark, sf_dir):
    e = consistent(spark, sf_dir).withColumn("ingested_at", F.col("ts") + F.expr("INTERVAL 90 SECONDS"))
    return reports.technical(runs(spark, sf_dir), store.cursors(e), e, _NOW)


@REGISTRY.add(
    "pilot_metrics",
    _ST
    + _CHANGES
    + f""", p AS (SELECT alert_id, last_seen AS g, status FROM st WHERE last_seen >= TIMESTAMP '{_NOW}' - INTERVAL 20 DAY ORDER BY last_seen DESC, alert_id DESC LIMIT 301), s AS (SELECT * FROM p ORDER BY g DESC, alert_id DESC LIMIT 300),
    h AS (SELECT alert_id, min(changed_at) AS f, max(CASE WHEN new_status IN ('resolved', 'false_positive') THEN changed_at END) AS c FROM lg WHERE new_status <> 'notified' GROUP BY 1), j AS (SELECT s.*, f, c FROM s LEFT JOIN h USING (alert_id))
    SELECT count(*) AS sampled_cases, count(*) FILTER (status IN ('resolved', 'false_positive')) AS closed_cases, count(*) FILTER (status = 'false_positive') AS false_positive_cases,
      round(100 * count(*) FILTER (status = 'false_positive') / count(*) FILTER (status IN ('resolved', 'false_positive')), 2) AS false_positive_rate_percent, count(f) AS cases_with_analyst_action,
      round(median((epoch_us(f) - epoch_us(g)) / 1000000) / 60, 2) AS median_first_action_minutes, round(median((epoch_us(c) - epoch_us(g)) / 1000000) / 60, 2) AS median_closure_minutes, (SELECT count(*) > 300 FROM p) AS sample_truncated FROM j""",
)
def pilot_metrics(spark, sf_dir):
    found = _alerts(spark, sf_dir)
    log = _log(found).withColumn("actor_id", F.when(F.col("new_status") == "notified", "system").otherwise("analyst"))
    return reports.pilot(found.withColumn("generated_at", F.col("last_seen")), log, _NOW, 20, 300)


@REGISTRY.add(
    "monthly_metrics",
    ALL_RULES.replace(E_ALL, E_ALL, 1)
    + f""", ev AS (SELECT *, strftime(ts - INTERVAL 5 HOUR, '%Y-%m') AS month FROM e_all WHERE ts >= TIMESTAMP '2023-11-15 05:00:00' AND ts < TIMESTAMP '2024-01-20 05:00:00'), m AS (SELECT unnest(['2023-11', '2023-12', '2024-01']) AS month),
    r AS (SELECT month, count(*) AS stored_rows, count(*) FILTER (ok) AS valid_rows, count(*) FILTER (NOT ok) AS rejected_rows, sum(w) FILTER (cls = 'success') AS s, sum(w) FILTER (cls = 'failure') AS f, sum(w) FILTER (cls = 'lockout') AS l, sum(w) FILTER (cls = 'other') AS o, min(ts) AS a, max(ts) AS b FROM ev GROUP BY 1),
    x AS (SELECT strftime(last_seen - INTERVAL 5 HOUR, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS md, count(*) FILTER (severity = 'low') AS lo FROM alerts WHERE last_seen < TIMESTAMP '2024-01-20 05:00:00' GROUP BY 1)
    SELECT month, coalesce(stored_rows, 0) AS stored_rows, coalesce(valid_rows, 0) AS valid_rows, coalesce(rejected_rows, 0) AS rejected_rows, CAST(coalesce(s, 0) AS BIGINT) AS success_count, CAST(coalesce(f, 0) AS BIGINT) AS failure_count, CAST(coalesce(l, 0) AS BIGINT) AS lockout_count, CAST(coalesce(o, 0) AS BIGINT) AS other_count,
      {_T.format('a')} AS first_event, {_T.format('b')} AS last_event, coalesce(n, 0) AS stored_alerts, coalesce(c, 0) AS critical_alerts, coalesce(h, 0) AS high_alerts, coalesce(md, 0) AS medium_alerts, coalesce(lo, 0) AS low_alerts FROM m LEFT JOIN r USING (month) LEFT JOIN x USING (month)""",
)
def monthly_metrics(spark, sf_dir):
    rows = reports.monthly(activity(spark, sf_dir), all_alerts(spark, sf_dir), "2023-11-15", "2024-01-20")
    return rows.withColumns({c: text_time(c) for c in ("first_event", "last_event")})


@REGISTRY.add(
    "report_worst",
    f"""WITH {E} SELECT * FROM (SELECT 'user_key' AS kind, usr AS key, CAST(sum(w) AS BIGINT) AS failures FROM e WHERE cls = 'failure' GROUP BY 2 ORDER BY failures DESC, key LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'client_ip_key' AS kind, ip AS key, CAST(sum(w) AS BIGINT) AS failures FROM e WHERE cls = 'failure' GROUP BY 2 ORDER BY failures DESC, key LIMIT 10)""",
)
def report_worst(spark, sf_dir):
    e = consistent(spark, sf_dir)
    return reports.worst(e, "user_key").unionByName(reports.worst(e, "client_ip_key"))


@REGISTRY.add(
    "report_totals",
    f"""WITH {E}, t AS (SELECT {_T.format('min(ts)')} AS first_event, {_T.format('max(ts)')} AS last_event, count(*) AS rows, CAST(sum(w) FILTER (cls = 'success') AS BIGINT) AS success_count, CAST(sum(w) FILTER (cls = 'failure') AS BIGINT) AS failure_count,
    CAST(sum(w) FILTER (cls = 'lockout') AS BIGINT) AS lockout_count, CAST(sum(w) FILTER (cls = 'other') AS BIGINT) AS other_count FROM e) SELECT *, round(failure_count / (success_count + failure_count), 6) AS failure_rate FROM t""",
)
def report_totals(spark, sf_dir):
    return reports.totals(consistent(spark, sf_dir)).withColumns({c: text_time(c) for c in ("first_event", "last_event")})


@REGISTRY.add("alert_evidence", ALL_RULES + f", i AS (SELECT alert_id, unnest(string_split(evidence_event_ids, ';')) AS id FROM alerts) SELECT alert_id, id AS event_id, {_T.format('ts')} AS ts, cls AS event_class, w AS weight, usr AS user_key, ip AS client_ip_key FROM i JOIN e USING (id)")
def alert_evidence(spark, sf_dir):
    return reports.evidence(all_alerts(spark, sf_dir), consistent(spark, sf_dir)).withColumn("ts", text_time("ts"))


_SPAN = "e.ts BETWEEN a.first_seen - INTERVAL 60 MINUTE AND a.last_seen + INTERVAL 30 MINUTE"


@REGISTRY.add(
    "investigation_events",
    ALL_RULES + f" SELECT alert_id, event_id, CAST(nth AS INTEGER) AS nth FROM (SELECT alert_id, id AS event_id, row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC, id) AS nth FROM alerts a JOIN e ON usr = user_key AND {_SPAN}) WHERE nth <= 5",
)
def investigation_events(spark, sf_dir):
    return reports.entity_events(all_alerts(spark, sf_dir), consistent(spark, sf_dir), "user_key", 60, 30, 5).select("alert_id", "event_id", "nth")


@REGISTRY.add(
    "investigation_counts",
    ALL_RULES
    + f""" SELECT alert_id, client_ip_key, count(*) AS records, CAST(sum(w) AS BIGINT) AS events, CAST(coalesce(sum(w) FILTER (cls = 'failure'), 0) AS BIGINT) AS failures, CAST(coalesce(sum(w) FILTER (cls = 'success'), 0) AS BIGINT) AS successes,
    CAST(coalesce(sum(w) FILTER (cls = 'lockout'), 0) AS BIGINT) AS lockouts, count(DISTINCT usr) AS distinct_users FROM alerts a JOIN e ON ip = client_ip_key AND {_SPAN} GROUP BY 1, 2""",
)
def investigation_counts(spark, sf_dir):
    return reports.entity_counts(all_alerts(spark, sf_dir), consistent(spark, sf_dir), "client_ip_key", 60, 30)


@REGISTRY.add(
    "investigation_success_after_failure",
    ALL_RULES + f""", n AS (SELECT alert_id, id, us, cls, usr, ip, coalesce(max(CASE WHEN cls = 'failure' THEN 1 ELSE 0 END) OVER (PARTITION BY alert_id, usr, ip ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM alerts a JOIN e ON usr = user_key AND {_SPAN})
    SELECT alert_id, id AS event_id FROM n WHERE cls = 'success' AND seen = 1""",
)
def investigation_success_after_failure(spark, sf_dir):
    return reports.success_after_failure(reports.near(all_alerts(spark, sf_dir), consistent(spark, sf_dir), "user_key", 60, 30)).select("alert_id", "event_id")


@REGISTRY.add(
    "investigation_context",
    ALL_RULES
    + f""", an AS (SELECT DISTINCT i.alert_id, e.* FROM (SELECT alert_id, unnest(string_split(evidence_event_ids, ';')) AS id FROM alerts) i JOIN e USING (id)),
    ips AS (SELECT alert_id, ip, min(o) AS o, row_number() OVER (PARTITION BY alert_id ORDER BY min(o), ip) AS nth FROM (SELECT alert_id, client_ip_key AS ip, 0 AS o FROM alerts WHERE client_ip_key <> '' UNION ALL SELECT alert_id, ip, 1 FROM an) GROUP BY 1, 2),
    c AS (SELECT alert_id, id, us, cls, usr, ip, 0 AS p FROM an UNION ALL SELECT alert_id, id, us, cls, usr, ip, 1 FROM alerts a JOIN e ON usr = user_key AND {_SPAN}
      UNION ALL SELECT a.alert_id, id, us, cls, usr, e.ip, 1 FROM alerts a JOIN ips ON ips.alert_id = a.alert_id AND ips.nth <= 5 JOIN e ON e.ip = ips.ip AND {_SPAN}),
    d AS (SELECT alert_id, id, us, cls, usr, ip, min(p) AS p FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY p, us DESC, id) AS nth FROM d), k AS (SELECT * FROM r WHERE nth <= 20),
    f AS (SELECT *, coalesce(max(CASE WHEN cls = 'failure' THEN 1 ELSE 0 END) OVER (PARTITION BY alert_id, usr, ip ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM k),
    s AS (SELECT alert_id, string_agg(id, ';' ORDER BY id) AS ids FROM f WHERE cls = 'success' AND seen = 1 GROUP BY 1),
    o AS (SELECT k.alert_id, string_agg(DISTINCT k.usr, ';' ORDER BY k.usr) AS others FROM k JOIN ips ON ips.alert_id = k.alert_id AND ips.ip = k.ip AND ips.nth <= 5 JOIN alerts a ON a.alert_id = k.alert_id WHERE k.usr <> a.user_key GROUP BY 1)
    SELECT a.alert_id, (SELECT count(*) FROM k WHERE k.alert_id = a.alert_id) AS events, coalesce(s.ids, '') AS success_after_failure_ids, coalesce(o.others, '') AS other_users, (SELECT count(*) FROM ips WHERE ips.alert_id = a.alert_id) AS addresses,
      (SELECT count(*) FROM d WHERE d.alert_id = a.alert_id) > 20 OR (SELECT count(*) FROM ips WHERE ips.alert_id = a.alert_id) > 5 AS truncated FROM alerts a LEFT JOIN s USING (alert_id) LEFT JOIN o USING (alert_id)""",
)
def investigation_context(spark, sf_dir):
    return reports.context(all_alerts(spark, sf_dir), consistent(spark, sf_dir), 60, 30, 20)


# --- data quality of the raw records

_COLUMNS = ("id", "event_name", "event_type_id", "event_count", "event_time", "created_at", "event_id", "custom_user_id", "custom_ip_address", "custom_relying_party")
_TIMES = ("event_time", "created_at", "event_time_origen")
_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, trim({c}) AS value, CASE WHEN '{c}' IN ('event_time', 'created_at') THEN 1 ELSE 0 END AS tm FROM raw" for c in _COLUMNS) + ")"


@REGISTRY.add(
    "profile_columns",
    f"""WITH {_RAW_SQL}, {_CELLS} SELECT col AS "column", count(*) AS rows, count(*) FILTER (value = '') AS blank, count(DISTINCT value) FILTER (value <> '') AS distinct_values, count(*) FILTER (regexp_matches(value, '^[+-]?[0-9]+$')) AS integer_like,
    count(*) FILTER (tm = 1 AND value NOT IN ('', 'no time')) AS valid_times, count(*) FILTER (tm = 1 AND value = 'no time') AS invalid_times, round(100 * count(*) FILTER (value = '') / count(*), 2) AS blank_percent FROM cells GROUP BY 1""",
)
def profile_columns(spark, sf_dir):
    return profile.columns_profile(raw_records(spark, sf_dir), _COLUMNS, _TIMES)


@REGISTRY.add(
    "profile_top_values",
    f"""WITH {_RAW_SQL}, {_CELLS}, n AS (SELECT col, value, count(*) AS n FROM cells WHERE value <> '' AND col NOT IN ('custom_user_id', 'custom_ip_address') GROUP BY 1, 2) SELECT col AS "column", value, n, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS nth FROM n) WHERE nth <= 10""",
)
def profile_top_values(spark, sf_dir):
    return profile.top_values(raw_records(spark, sf_dir), _COLUMNS, ("custom_user_id", "custom_ip_address"))


@REGISTRY.add(
    "profile_time_ranges",
    f"""WITH {_RAW_SQL}, t AS (SELECT 'event_time' AS c, CASE WHEN n % 37 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' WHEN n % 41 = 0 THEN NULL ELSE ts END AS t FROM raw UNION ALL SELECT 'event_time_origen', CASE WHEN n % 5 = 0 THEN ts - INTERVAL 1 MINUTE END FROM raw
    UNION ALL SELECT 'created_at', CASE WHEN n % 43 = 0 THEN NULL WHEN n % 47 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts + INTERVAL 1 MINUTE END FROM raw) SELECT c AS "column", {_T.format('min(t)')} AS first, {_T.format('max(t)')} AS last FROM t GROUP BY 1""",
)
def profile_time_ranges(spark, sf_dir):
    return profile.time_ranges(raw_records(spark, sf_dir), _TIMES).withColumns({c: text_time(c) for c in ("first", "last")})


@REGISTRY.add(
    "profile_addresses",
    f"WITH {_RAW_SQL}, a AS (SELECT custom_ip_address AS a FROM raw) SELECT count(*) FILTER (a = '') AS blank, count(*) FILTER (a NOT IN ('', 'not-an-ip')) AS valid, count(*) FILTER (a LIKE '10.%') AS private, count(*) FILTER (a NOT IN ('', 'not-an-ip') AND a NOT LIKE '10.%') AS public, count(*) FILTER (a = 'not-an-ip') AS invalid FROM a",
)
def profile_addresses(spark, sf_dir):
    return profile.address_quality(raw_records(spark, sf_dir), "custom_ip_address")


@REGISTRY.add(
    "profile_classes",
    f"""WITH {_RAW_SQL}, c AS (SELECT CASE WHEN event_name LIKE '%Lockout%' THEN 'lockout' WHEN event_name LIKE '%Error%' THEN 'failure' WHEN event_name LIKE '%Success%' THEN 'success' ELSE 'other' END AS event_class,
      CASE WHEN n % 29 = 0 THEN NULL ELSE regexp_extract(lower(custom_user_id), 'user[0-9]+') END AS u, nullif(custom_ip_address, '') AS a FROM raw)
    SELECT event_class, count(*) AS rows, count(DISTINCT u) AS distinct_users, count(DISTINCT a) AS distinct_ips, count(*) FILTER (u IS NULL) AS missing_users, count(*) FILTER (a IS NULL) AS missing_ips FROM c GROUP BY 1""",
)
def profile_classes(spark, sf_dir):
    return profile.class_coverage(raw_records(spark, sf_dir))


@REGISTRY.add("profile_crosstab", f"WITH {_RAW_SQL} SELECT trim(event_name) AS event_name, event_type_id, count(*) AS rows FROM raw GROUP BY 1, 2")
def profile_crosstab(spark, sf_dir):
    return profile.crosstab(raw_records(spark, sf_dir))


@REGISTRY.add(
    "profile_periods",
    f"""WITH {_RAW_SQL}, t AS (SELECT CASE WHEN n % 37 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE ts END AS t FROM raw WHERE n % 37 = 0 OR n % 41 <> 0)
    SELECT 'year' AS grain, strftime(t, '%Y') AS period, count(*) AS rows FROM t GROUP BY 2 UNION ALL SELECT 'day', strftime(t, '%Y-%m-%d'), count(*) FROM t GROUP BY 2""",
)
def profile_periods(spark, sf_dir):
    return profile.per_period(raw_records(spark, sf_dir))


@REGISTRY.add("profile_user_formats", f"WITH {_RAW_SQL} SELECT CASE WHEN n % 29 = 0 THEN 'missing' WHEN n % 2 = 0 THEN 'domain_backslash_user' ELSE 'email_like' END AS format, count(*) AS rows FROM raw GROUP BY 1")
def profile_user_formats(spark, sf_dir):
    return profile.user_formats(raw_records(spark, sf_dir))


@REGISTRY.add(
    "profile_delays",
    f"""WITH {_RAW_SQL}, d AS (SELECT CASE WHEN n % 47 = 0 THEN -3600.0 ELSE 60.0 END + CASE WHEN n % 37 = 0 THEN epoch_us(ts) / 1000000 ELSE 0 END AS s FROM raw WHERE n % 43 <> 0 AND (n % 37 = 0 OR n % 41 <> 0)), v AS (SELECT list_sort(list(s)) AS v FROM d)
    SELECT count(*) AS pairs, count(*) FILTER (s < 0) AS negative, min(s) AS minimum, median(s) AS median, (SELECT v[CAST(round_even((len(v) - 1) * 0.95, 0) AS INTEGER) + 1] FROM v) AS p95, max(s) AS maximum FROM d""",
)
def profile_delays(spark, sf_dir):
    return profile.delays(raw_records(spark, sf_dir), "created_at", "event_time")


@REGISTRY.add("profile_repeats", f"WITH {_RAW_SQL}, g AS (SELECT count(*) AS n FROM raw GROUP BY event_name, event_type_id, event_count, custom_user_id, custom_relying_party) SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS repeated_rows FROM g")
def profile_repeats(spark, sf_dir):
    return profile.repeated_rows(raw_records(spark, sf_dir), ("event_name", "event_type_id", "event_count", "custom_user_id", "custom_relying_party"))


@REGISTRY.add(
    "profile_anomalies",
    f"""WITH {_RAW_SQL}, i AS (SELECT n AS pos, array_to_string(list_filter([CASE WHEN n % 37 <> 0 AND n % 41 = 0 THEN 'BAD_TIME' END, CASE WHEN n % 43 <> 0 AND n % 47 = 0 AND n % 37 <> 0 AND n % 41 <> 0 THEN 'CREATED_BEFORE_EVENT' END,
      CASE WHEN n % 29 = 0 THEN 'MISSING_USER' END, CASE WHEN custom_ip_address = '' THEN 'MISSING_IP' END], lambda x: x IS NOT NULL), ';') AS issues FROM raw) SELECT pos, issues FROM i WHERE issues <> '' ORDER BY pos LIMIT 20""",
)
def profile_anomalies(spark, sf_dir):
    return profile.anomalies(raw_records(spark, sf_dir), "pos")
