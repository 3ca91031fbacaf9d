"""Registered queries over alerts: acceptance, workflow, browsing, health.

Stored state is derived from the alerts by their ids' digits, so that SQL can
repeat it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from watchwell.operators import baseline, browse, store
from watchwell.operators.rules import DISABLED
from watchwell.plans.common import ALL_RULES, CONFIG, E, E_ALL, RULE_CTES, RULES, TRAIN, TRAINING_END, Registry, all_alerts, consistent, text_time, trained
from watchwell.plans.services import STATUS_SQL, with_status
from watchwell.sources.auth import activity

REGISTRY = Registry()
_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_DIGIT = "('0x' || substr(alert_id, {0}, 1))::BIGINT"


def _digit(at: int):
    return F.conv(F.substring("alert_id", at, 1), 16, 10).cast("int")


def _alerts(spark, sf_dir):
    return with_status(all_alerts(spark, sf_dir)).withColumns({"source_name": F.lit("demo"), "updated_at": F.col("last_seen")})


_ST = ALL_RULES + f", st AS (SELECT *, {STATUS_SQL} AS status, 'demo' AS source_name FROM alerts)"
_OPEN = "status IN ('new', 'notified', 'investigating')"
_EACH = ", ex AS (SELECT *, unnest(string_split(relying_parties, ';')) AS rp FROM st)"

# --- acceptance

_KEPT = """kept AS (SELECT alert_id, rule_id, user_key, client_ip_key, last_seen FROM alerts WHERE last_seen < TIMESTAMP '2024-01-11 00:00:00'),
cand AS (SELECT *, row_number() OVER (PARTITION BY rule_id, user_key, client_ip_key ORDER BY first_seen, last_seen, alert_id) AS rn FROM alerts WHERE last_seen >= TIMESTAMP '2024-01-10 00:00:00'),
cd AS (SELECT * FROM (VALUES ('AUTH_BRUTE_FORCE_USER', 900), ('AUTH_PASSWORD_SPRAY_IP', 900), ('AUTH_SUCCESS_AFTER_FAILURES', 900), ('AUTH_ACCOUNT_LOCKOUT', 86400), ('AUTH_NEW_IP_FOR_USER', 86400)) v(rule_id, wait)),
fold AS (
  SELECT c.alert_id, c.rule_id, c.user_key, c.client_ip_key, c.rn,
    CASE WHEN c.alert_id IN (SELECT alert_id FROM kept) THEN 'duplicate_alert' WHEN k.newest IS NOT NULL AND epoch_us(c.last_seen) - k.newest < wait::BIGINT * 1000000 THEN 'persistent_cooldown' ELSE 'created' END AS outcome,
    CASE WHEN c.alert_id IN (SELECT alert_id FROM kept) OR (k.newest IS NOT NULL AND epoch_us(c.last_seen) - k.newest < wait::BIGINT * 1000000) THEN k.newest ELSE greatest(coalesce(k.newest, 0), epoch_us(c.last_seen)) END AS latest
  FROM cand c JOIN cd USING (rule_id) LEFT JOIN (SELECT rule_id, user_key, client_ip_key, max(epoch_us(last_seen)) AS newest FROM kept GROUP BY 1, 2, 3) k USING (rule_id, user_key, client_ip_key) WHERE c.rn = 1
  UNION ALL
  SELECT c.alert_id, c.rule_id, c.user_key, c.client_ip_key, c.rn,
    CASE WHEN c.alert_id IN (SELECT alert_id FROM kept) THEN 'duplicate_alert' WHEN f.latest IS NOT NULL AND epoch_us(c.last_seen) - f.latest < wait::BIGINT * 1000000 THEN 'persistent_cooldown' ELSE 'created' END,
    CASE WHEN c.alert_id IN (SELECT alert_id FROM kept) OR (f.latest IS NOT NULL AND epoch_us(c.last_seen) - f.latest < wait::BIGINT * 1000000) THEN f.latest ELSE greatest(coalesce(f.latest, 0), epoch_us(c.last_seen)) END
  FROM fold f JOIN cand c ON c.rule_id = f.rule_id AND c.user_key = f.user_key AND c.client_ip_key = f.client_ip_key AND c.rn = f.rn + 1 JOIN cd ON cd.rule_id = c.rule_id)"""
_ACCEPT = ALL_RULES + "," + _KEPT


def _accepted(spark, sf_dir):
    found = all_alerts(spark, sf_dir)
    kept = found.filter("last_seen < timestamp '2024-01-11 00:00:00'").select("alert_id", F.lit("demo").alias("source_name"), "rule_id", "user_key", "client_ip_key", "last_seen")
    new = found.filter("last_seen >= timestamp '2024-01-10 00:00:00'")
    return store.accept(new, kept, store.cooldown_minutes(RULES), "demo")


@REGISTRY.add("accept_alerts", _ACCEPT + " SELECT alert_id, rule_id, user_key, client_ip_key, outcome FROM fold")
def accept_alerts(spark, sf_dir):
    return _accepted(spark, sf_dir).select("alert_id", "rule_id", "user_key", "client_ip_key", "outcome")


@REGISTRY.add(
    "suppressions",
    _ACCEPT + """ SELECT outcome AS reason, rule_id, rule_id || '|' || user_key || '|' || client_ip_key AS entity_key, '{"alert_id":"' || alert_id || '","source_name":"demo"}' AS details FROM fold WHERE outcome <> 'created'""",
)
def suppressions(spark, sf_dir):
    return store.suppressions(_accepted(spark, sf_dir), "demo")


_JOB = (
    "WITH RECURSIVE " + TRAIN.replace("FROM e ", "FROM ef ").replace("e.*", "ef.*").replace("e AS (SELECT * FROM e_all WHERE ok)", "ef AS (SELECT * FROM e_all WHERE ok)")
    + ", e AS (SELECT * FROM ef WHERE ts >= TIMESTAMP '2024-01-11 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00')," + RULE_CTES
    + """, cand AS (SELECT *, row_number() OVER (PARTITION BY rule_id, user_key, client_ip_key ORDER BY last_seen, alert_id) AS rn FROM alerts WHERE last_seen >= TIMESTAMP '2024-01-12 00:00:00' AND last_seen < TIMESTAMP '2024-01-20 00:00:00'),
    cd AS (SELECT * FROM (VALUES ('AUTH_BRUTE_FORCE_USER', 900), ('AUTH_PASSWORD_SPRAY_IP', 900), ('AUTH_SUCCESS_AFTER_FAILURES', 900), ('AUTH_ACCOUNT_LOCKOUT', 86400), ('AUTH_NEW_IP_FOR_USER', 86400)) v(rule_id, wait)),
    fold AS (SELECT rule_id, user_key, client_ip_key, alert_id, severity, rn, epoch_us(last_seen) AS latest, 'created' AS outcome FROM cand WHERE rn = 1
      UNION ALL
      SELECT c.rule_id, c.user_key, c.client_ip_key, c.alert_id, c.severity, c.rn, CASE WHEN epoch_us(c.last_seen) - f.latest < wait::BIGINT * 1000000 THEN f.latest ELSE greatest(f.latest, epoch_us(c.last_seen)) END,
        CASE WHEN epoch_us(c.last_seen) - f.latest < wait::BIGINT * 1000000 THEN 'persistent_cooldown' ELSE 'created' END
      FROM fold f JOIN cand c ON c.rule_id = f.rule_id AND c.user_key = f.user_key AND c.client_ip_key = f.client_ip_key AND c.rn = f.rn + 1 JOIN cd ON cd.rule_id = c.rule_id)
    SELECT alert_id, rule_id, severity, outcome FROM fold"""
)


@REGISTRY.add("history_job", _JOB)
def history_job(spark, sf_dir):
    """A past range, analyzed and accepted; windows begin at the range's lookback."""
    events = consistent(spark, sf_dir)
    kept = spark.createDataFrame([], "alert_id string, source_name string, rule_id string, user_key string, client_ip_key string, last_seen timestamp")
    known = baseline.context(trained(spark, sf_dir), CONFIG)
    done = store.analyze(events, kept, RULES, "2024-01-12 00:00:00", "2024-01-20 00:00:00", "demo", (known["users"], known["user_ips"], TRAINING_END))
    return done.select("alert_id", "rule_id", "severity", "outcome")


def _preview_side(name: str, minimum: int) -> str:
    from watchwell.plans.common import _INTENSE, rule_sql

    return rule_sql(name, "AUTH_BRUTE_FORCE_USER", "cls = 'failure'", "usr", "true", minimum, 0, 65, "CASE WHEN total >= 20 THEN 20 ELSE 0 END", _INTENSE.format(20, 20))


@REGISTRY.add(
    "rule_preview",
    f"""WITH RECURSIVE {E_ALL}, e AS (SELECT * FROM e_all WHERE ok AND ts >= TIMESTAMP '2024-01-09 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'),{_preview_side('one', 6)},{_preview_side('two', 9)},
    both_ AS (SELECT 1 AS side, * FROM one UNION ALL SELECT 2, * FROM two), r AS (SELECT * FROM both_ WHERE last_seen >= TIMESTAMP '2024-01-10 00:00:00' AND last_seen < TIMESTAMP '2024-01-20 00:00:00'),
    x AS (SELECT side, unnest(['total', 'rule', 'severity']) AS measure, unnest(['', rule_id, severity]) AS name FROM r)
    SELECT measure, name, count(*) FILTER (side = 1) AS first, count(*) FILTER (side = 2) AS second, count(*) FILTER (side = 2) - count(*) FILTER (side = 1) AS difference FROM x GROUP BY 1, 2""",
)
def rule_preview(spark, sf_dir):
    """Two thresholds of the brute-force rule, without cooldown."""
    only = replace(RULES, spray=replace(RULES.spray, enabled=False), success_after=replace(RULES.success_after, enabled=False), lockout=replace(RULES.lockout, enabled=False), brute_force=replace(RULES.brute_force, cooldown_minutes=0))
    other = replace(only, brute_force=replace(only.brute_force, minimum=9))
    return store.preview(consistent(spark, sf_dir), only, other, "2024-01-10 00:00:00", "2024-01-20 00:00:00")


# --- events that are kept


@REGISTRY.add(
    "append_events",
    "WITH b AS (SELECT event_id // 4 AS k, ts FROM events), f AS (SELECT k FROM b WHERE k % 3 <> 0 GROUP BY 1) SELECT (SELECT count(*) FROM f) AS inserted, (SELECT count(*) FROM b) - (SELECT count(*) FROM f) AS duplicates",
)
def append_events(spark, sf_dir):
    """A batch whose keys repeat, against a store that has every third key."""
    e = activity(spark, sf_dir).withColumn("k", F.floor(F.col("event_id").cast("long") / 4))
    e = e.withColumn("event_key", store.event_key(F.col("source_name"), F.col("k")))
    kept = e.filter("k % 3 = 0").select("event_key").distinct()
    return store.append_events(e, kept)[1]


@REGISTRY.add("replay_check", "SELECT CAST(0 AS BIGINT) AS inserted, count(*) AS duplicates FROM events")
def replay_check(spark, sf_dir):
    e = activity(spark, sf_dir).withColumn("event_key", store.event_key(F.col("source_name"), F.col("event_id")))
    return store.verify_replay(e, e)


@REGISTRY.add("source_cursors", f"SELECT 'demo' AS source_name, {_T.format('ts')} AS cursor_ts, CAST(event_id AS VARCHAR) AS cursor_id FROM events ORDER BY ts DESC LIMIT 1")
def source_cursors(spark, sf_dir):
    return store.cursors(activity(spark, sf_dir)).withColumn("cursor_ts", text_time("cursor_ts"))


@REGISTRY.add("history_bounds", f"WITH {E} SELECT 'demo' AS source_name, {_T.format('min(ts)')} AS first_ts, {_T.format('max(ts)')} AS last_ts FROM e")
def history_bounds(spark, sf_dir):
    return store.bounds(activity(spark, sf_dir)).withColumns({c: text_time(c) for c in ("first_ts", "last_ts")})


@REGISTRY.add("recent_events", f"WITH {E} SELECT id AS event_id, cls AS event_class, w AS weight FROM e WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'")
def recent_events(spark, sf_dir):
    return store.since(activity(spark, sf_dir), "2024-01-25 00:00:00", "demo").select("event_id", "event_class", "weight")


# --- workflow

_CHANGES = f""", ch AS (
  SELECT alert_id, CASE {_DIGIT.format(6)} % 3 WHEN 0 THEN 'notified' WHEN 1 THEN 'investigating' ELSE 'nonsense' END AS new_status, last_seen + INTERVAL 1 MINUTE AS changed_at FROM alerts
  UNION ALL SELECT alert_id, CASE {_DIGIT.format(7)} % 3 WHEN 0 THEN 'investigating' WHEN 1 THEN 'resolved' ELSE 'new' END, last_seen + INTERVAL 5 MINUTE FROM alerts
  UNION ALL SELECT 'alt_unknown', 'resolved', TIMESTAMP '2024-01-01 00:00:00'),
lg AS (SELECT * FROM (SELECT alert_id, new_status, changed_at, coalesce(lag(new_status) OVER (PARTITION BY alert_id ORDER BY changed_at), 'new') AS old_status FROM ch
  WHERE new_status <> 'nonsense' AND alert_id <> 'alt_unknown') WHERE old_status <> new_status)"""


def _log(found):
    spark = found.sparkSession
    one = F.when(_digit(6) % 3 == 0, "notified").when(_digit(6) % 3 == 1, "investigating").otherwise("nonsense")
    two = F.when(_digit(7) % 3 == 0, "investigating").when(_digit(7) % 3 == 1, "resolved").otherwise("new")
    later = lambda m: (F.col("last_seen") + F.expr(f"INTERVAL {m} MINUTE")).alias("changed_at")
    changes = found.select("alert_id", one.alias("new_status"), later(1)).unionByName(found.select("alert_id", two.alias("new_status"), later(5)))
    changes = changes.unionByName(spark.sql("SELECT 'alt_unknown' AS alert_id, 'resolved' AS new_status, timestamp '2024-01-01 00:00:00' AS changed_at"))
    return store.transitions(changes, found)


@REGISTRY.add("status_log", ALL_RULES + _CHANGES + f" SELECT alert_id, old_status, new_status, {_T.format('changed_at')} AS changed_at FROM lg")
def status_log(spark, sf_dir):
    return _log(all_alerts(spark, sf_dir)).select("alert_id", "old_status", "new_status", text_time("changed_at"))


@REGISTRY.add(
    "status_current",
    ALL_RULES + _CHANGES + f" SELECT a.alert_id, coalesce(l.s, 'new') AS investigation_status, {_T.format('coalesce(l.t, a.last_seen)')} AS updated_at FROM alerts a LEFT JOIN (SELECT alert_id, max_by(new_status, changed_at) AS s, max(changed_at) AS t FROM lg GROUP BY 1) l USING (alert_id)",
)
def status_current(spark, sf_dir):
    found = all_alerts(spark, sf_dir)
    return store.current_status(_log(found), found).select("alert_id", "investigation_status", text_time("updated_at"))


_LEDGER = f""", le AS (SELECT alert_id, 'mail' AS channel, i AS "at", CASE WHEN i = 2 AND {_DIGIT.format(9)} % 2 = 0 THEN 'sent' ELSE 'failed' END AS outcome
  FROM (SELECT alert_id, unnest(range(CAST({_DIGIT.format(8)} % 5 AS BIGINT))) AS i FROM alerts))"""


def _ledger(found):
    tries = found.select("alert_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("at")).filter(F.col("at") < _digit(8) % 5)
    return tries.select("alert_id", F.lit("mail").alias("channel"), F.col("at").cast("long").alias("at"), F.when((F.col("at") == 2) & (_digit(9) % 2 == 0), "sent").otherwise("failed").alias("outcome"))


@REGISTRY.add(
    "notification_routing",
    ALL_RULES + _LEDGER + """, p AS (SELECT alert_id, count(*) AS tries, bool_or(outcome = 'sent') AS done FROM le GROUP BY 1), o AS (SELECT *, severity IN ('critical', 'high') AS now FROM alerts),
    r AS (SELECT *, row_number() OVER (PARTITION BY now ORDER BY first_seen_local, alert_id) AS n FROM o)
    SELECT alert_id, severity, CASE WHEN NOT now THEN 'notification_deferred_by_severity_policy' WHEN n > 200 THEN 'notification_run_limit' WHEN coalesce(done, false) THEN 'notification_already_delivered'
      WHEN coalesce(tries, 0) >= 3 THEN 'notification_retry_limit' ELSE 'send' END AS outcome FROM r LEFT JOIN p USING (alert_id)""",
)
def notification_routing(spark, sf_dir):
    found = all_alerts(spark, sf_dir)
    return store.route(found.withColumn("run_order", F.col("first_seen_local")), _ledger(found), ("critical", "high"), 200, 3)


@REGISTRY.add("delivery_ledger", ALL_RULES + _LEDGER + """ SELECT alert_id, channel, "at", outcome, CAST(row_number() OVER (PARTITION BY alert_id ORDER BY "at") AS INTEGER) AS attempt, bool_or(outcome = 'sent') OVER (PARTITION BY alert_id) AS delivered FROM le""")
def delivery_ledger(spark, sf_dir):
    return store.deliveries(_ledger(all_alerts(spark, sf_dir)))


# --- counts and lists


@REGISTRY.add("alert_counts", _ST + " SELECT severity, status AS investigation_status, rule_id, count(*) AS alerts FROM st GROUP BY GROUPING SETS ((severity), (status), (rule_id), ())")
def alert_counts(spark, sf_dir):
    return browse.counts(_alerts(spark, sf_dir))


@REGISTRY.add(
    "alert_queue",
    _ST
    + f""" SELECT source_name, count(*) AS total, count(*) FILTER (status IN ('new', 'notified')) AS pending_review, count(*) FILTER (status = 'investigating') AS investigating, count(*) FILTER (status = 'resolved') AS resolved,
    count(*) FILTER (status = 'false_positive') AS false_positive, count(*) FILTER ({_OPEN} AND severity = 'low') AS open_low, count(*) FILTER ({_OPEN} AND severity = 'medium') AS open_medium, count(*) FILTER ({_OPEN} AND severity = 'high') AS open_high,
    count(*) FILTER ({_OPEN} AND severity = 'critical') AS open_critical, {_T.format('max(last_seen)')} AS last_updated_at FROM st GROUP BY 1""",
)
def alert_queue(spark, sf_dir):
    return browse.queue_summary(_alerts(spark, sf_dir)).withColumn("last_updated_at", text_time("last_updated_at"))


_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_OPEN_BY = _ST + _EACH + f""", ob AS (SELECT rp AS relying_party, count(*) AS open_alerts, arg_max(alert_id, last_seen::VARCHAR || alert_id) AS latest_alert_id, arg_max(severity, {_RANK}) AS highest_severity FROM ex WHERE {_OPEN} AND rp <> '' GROUP BY 1)"""


@REGISTRY.add("open_alerts_by_service", _OPEN_BY + " SELECT * FROM ob")
def open_alerts_by_service(spark, sf_dir):
    return browse.open_by_service(_alerts(spark, sf_dir))


@REGISTRY.add("open_alerts_of_services", _OPEN_BY + " SELECT * FROM ob WHERE relying_party IN ('svc_2', 'svc_5')")
def open_alerts_of_services(spark, sf_dir):
    return browse.open_by_service(_alerts(spark, sf_dir), ("svc_2", "svc_5"))


@REGISTRY.add("alert_list", _ST + " SELECT alert_id, rule_id, severity, risk_score FROM st WHERE severity = 'high' ORDER BY risk_score DESC, last_seen DESC, alert_id LIMIT 100")
def alert_list(spark, sf_dir):
    return browse.list_alerts(_alerts(spark, sf_dir), 100, severity="high").select("alert_id", "rule_id", "severity", "risk_score")


_BROWSE = """status = 'new' AND CAST(first_seen - INTERVAL 5 HOUR AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND list_contains(string_split(relying_parties, ';'), 'svc_3')"""


def _browsed(spark, sf_dir):
    return browse.browse_alerts(_alerts(spark, sf_dir), status="new", date_from="2024-01-10", date_to="2024-01-20", service="svc_3")


@REGISTRY.add("alert_browse", _ST + f" SELECT alert_id, rule_id, severity, risk_score FROM st WHERE {_BROWSE} ORDER BY risk_score DESC, first_seen DESC, alert_id DESC LIMIT 25")
def alert_browse(spark, sf_dir):
    keys, down = browse.SORTS["risk"]
    return browse.page(_browsed(spark, sf_dir), keys, down, 25)[0].select("alert_id", "rule_id", "severity", "risk_score")


@REGISTRY.add("alert_browse_next", _ST + f" SELECT alert_id, rule_id, severity, risk_score FROM st WHERE {_BROWSE} AND (risk_score, alert_id) < (75, 'alt_8') ORDER BY risk_score DESC, alert_id DESC LIMIT 25")
def alert_browse_next(spark, sf_dir):
    """The page after an anchor."""
    return browse.page(_browsed(spark, sf_dir), ("risk_score", "alert_id"), True, 25, (75, "alt_8"))[0].select("alert_id", "rule_id", "severity", "risk_score")


@REGISTRY.add(
    "alert_browse_page_state",
    _ST + f" SELECT count(*) FILTER (n > 0) > 0 AS has_next, count(*) > 25 AS has_previous FROM (SELECT 1 AS n FROM st WHERE {_BROWSE} AND (risk_score, alert_id) > (75, 'alt_8') ORDER BY risk_score, alert_id LIMIT 26)",
)
def alert_browse_page_state(spark, sf_dir):
    """Going back from an anchor: whether there are pages on both sides."""
    return browse.page(_browsed(spark, sf_dir), ("risk_score", "alert_id"), True, 25, (75, "alt_8"), backwards=True)[1]


@REGISTRY.add("alert_overlap", _ST + " SELECT alert_id FROM st WHERE first_seen < TIMESTAMP '2024-01-15 12:00:00' AND last_seen >= TIMESTAMP '2024-01-15 00:00:00'")
def alert_overlap(spark, sf_dir):
    return browse.browse_alerts(_alerts(spark, sf_dir), overlap=("2024-01-15 00:00:00", "2024-01-15 12:00:00")).select("alert_id")


# --- services

_SERVICES = f"""{E}, sc AS (SELECT * FROM e WHERE us >= (SELECT max(us) FROM e) - 7 * 86400000000), sm AS (
  SELECT rp AS relying_party, CAST(sum(w) AS BIGINT) AS total_events, CAST(coalesce(sum(w) FILTER (cls = 'success'), 0) AS BIGINT) AS success_count, CAST(coalesce(sum(w) FILTER (cls = 'failure'), 0) AS BIGINT) AS failure_count,
    CAST(coalesce(sum(w) FILTER (cls = 'lockout'), 0) AS BIGINT) AS lockout_count, count(DISTINCT usr) AS distinct_users, count(DISTINCT ip) AS distinct_client_ips, {_T.format('min(ts)')} AS first_seen, {_T.format('max(ts)')} AS last_seen FROM sc GROUP BY 1),
sv AS (SELECT *, round(100 * (failure_count + lockout_count) / total_events, 2) AS adverse_rate, round(100 * total_events / sum(total_events) OVER (), 2) AS share_percent, round(100 * total_events / max(total_events) OVER (), 2) AS bar_percent FROM sm)"""


def _services(spark, sf_dir):
    rows = browse.service_metrics(browse.scope(activity(spark, sf_dir), window_days=7))
    return rows.withColumns({c: text_time(c) for c in ("first_seen", "last_seen")})


@REGISTRY.add("service_metrics", f"WITH {_SERVICES} SELECT * FROM sv")
def service_metrics(spark, sf_dir):
    return _services(spark, sf_dir)


@REGISTRY.add("service_top", f"WITH {_SERVICES} SELECT relying_party, total_events FROM sv ORDER BY total_events DESC, relying_party LIMIT 5")
def service_top(spark, sf_dir):
    return browse.top_services(_services(spark, sf_dir), 5).select("relying_party", "total_events")


@REGISTRY.add("service_rare", f"WITH {_SERVICES} SELECT relying_party, total_events FROM sv WHERE total_events <= 220")
def service_rare(spark, sf_dir):
    return browse.rare_services(_services(spark, sf_dir), 220).select("relying_party", "total_events")


@REGISTRY.add("service_browse", f"WITH {_SERVICES} SELECT relying_party, failure_count FROM sv ORDER BY failure_count DESC, relying_party DESC LIMIT 10")
def service_browse(spark, sf_dir):
    keys, down = browse.SERVICE_SORTS["failures"]
    return browse.page(_services(spark, sf_dir), keys, down, 10)[0].select("relying_party", "failure_count")


@REGISTRY.add(
    "service_scope_summary",
    f"""WITH {E} SELECT CAST(sum(w) AS BIGINT) AS total_events, CAST(sum(w) FILTER (cls = 'success') AS BIGINT) AS success_count, CAST(sum(w) FILTER (cls = 'failure') AS BIGINT) AS failure_count, CAST(sum(w) FILTER (cls = 'lockout') AS BIGINT) AS lockout_count,
    count(DISTINCT usr) AS distinct_users, count(DISTINCT ip) AS distinct_client_ips, {_T.format('min(ts)')} AS first_seen, {_T.format('max(ts)')} AS last_seen, count(DISTINCT rp) AS distinct_services
    FROM e WHERE CAST(loc AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND rp IN ('svc_1', 'svc_2', 'svc_3')""",
)
def service_scope_summary(spark, sf_dir):
    rows = browse.scope_summary(browse.scope(activity(spark, sf_dir), date_from="2024-01-05", date_to="2024-01-12", among=("svc_1", "svc_2", "svc_3")))
    return rows.withColumns({c: text_time(c) for c in ("first_seen", "last_seen")})


_CATALOG_SQL = "ct AS (SELECT * FROM (VALUES ('svc_1', 'Portal', 'high', 'Academic'), ('svc_4', 'Payroll', 'medium', 'Finance'), ('svc_9', 'Library', 'normal', 'General')) v(relying_party, label, level, category))"


def _catalog(spark):
    return spark.createDataFrame([("svc_1", "Portal", "high", "Academic"), ("svc_4", "Payroll", "medium", "Finance"), ("svc_9", "Library", "normal", "General")], "relying_party string, label string, level string, category string")


@REGISTRY.add(
    "service_monitoring",
    _OPEN_BY
    + f""", {_SERVICES.partition("e AS (SELECT * FROM e_all WHERE ok),")[2]}, {_CATALOG_SQL}, j AS (
    SELECT s.relying_party, coalesce(label, s.relying_party) AS display_name, coalesce(level, 'normal') AS sensitivity_level, coalesce(category, 'General') AS sensitivity_category, total_events, failure_count, lockout_count, coalesce(open_alerts, 0) AS open_alerts, coalesce(highest_severity, '') AS highest_severity
    FROM sv s LEFT JOIN ct USING (relying_party) LEFT JOIN ob USING (relying_party))
    SELECT *, CAST(CASE WHEN sensitivity_level <> 'normal' THEN row_number() OVER (PARTITION BY sensitivity_level <> 'normal' ORDER BY open_alerts DESC, CASE sensitivity_level WHEN 'high' THEN 2 ELSE 1 END DESC, failure_count + lockout_count DESC, display_name) END AS INTEGER) AS sensitive_rank FROM j""",
)
def service_monitoring(spark, sf_dir):
    return browse.monitored(_services(spark, sf_dir), _catalog(spark), browse.open_by_service(_alerts(spark, sf_dir)))


@REGISTRY.add(
    "sensitive_alerts",
    _ST + _EACH + f""", {_CATALOG_SQL}, k AS (SELECT alert_id, rp, CASE level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 END AS r, level FROM ex LEFT JOIN ct ON rp = relying_party)
    SELECT alert_id, coalesce(string_agg(rp, ';' ORDER BY r DESC, rp) FILTER (r IS NOT NULL), '') AS sensitive_services, count(r) > 0 AS has_sensitive_service, coalesce(arg_max(level, r), 'normal') AS sensitivity_level FROM k GROUP BY 1""",
)
def sensitive_alerts(spark, sf_dir):
    return browse.sensitive_alerts(_alerts(spark, sf_dir), _catalog(spark))


# --- runs

RUNS_SQL = f"""runs AS (SELECT CASE WHEN dayofyear(CAST(loc AS DATE)) % 2 = 0 THEN 'demo' ELSE 'file' END AS source_name, CAST(datediff('day', DATE '2023-12-01', CAST(loc AS DATE)) AS BIGINT) AS run_id, min(ts) AS started_at, max(ts) AS finished_at,
  CASE WHEN datediff('day', DATE '2023-12-01', CAST(loc AS DATE)) % 7 = 3 THEN 'failed' ELSE 'completed' END AS status, count(*) AS fetched FROM e GROUP BY CAST(loc AS DATE))"""


def runs(spark, sf_dir):
    """A run per local day of the activity."""
    e = baseline.localized(consistent(spark, sf_dir))
    n = F.datediff("day", F.lit("2023-12-01").cast("date"))
    rows = e.groupBy("day").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count("*").alias("fetched"))
    return rows.select(F.when(F.dayofyear("day") % 2 == 0, "demo").otherwise("file").alias("source_name"), n.cast("long").alias("run_id"), "started_at", "finished_at", F.when(n % 7 == 3, "failed").otherwise("completed").alias("status"), "fetched")


@REGISTRY.add("latest_runs", f"WITH {E},{RUNS_SQL} SELECT source_name, max(run_id) AS run_id, {_T.format('arg_max(started_at, run_id)')} AS started_at, {_T.format('arg_max(finished_at, run_id)')} AS finished_at, arg_max(status, run_id) AS status, arg_max(fetched, run_id) AS fetched FROM runs GROUP BY 1")
def latest_runs(spark, sf_dir):
    return browse.latest_runs(runs(spark, sf_dir)).withColumns({c: text_time(c) for c in ("started_at", "finished_at")})


@REGISTRY.add(
    "monitor_health",
    ALL_RULES + f",{RUNS_SQL} SELECT source_name, max(run_id) AS run_id, arg_max(status, run_id) AS status, CASE WHEN source_name = 'demo' THEN (SELECT count(*) FROM e) ELSE 0 END AS events, CASE WHEN source_name = 'demo' THEN (SELECT count(*) FROM alerts) ELSE 0 END AS alerts, arg_max(status, run_id) = 'completed' AS healthy FROM runs GROUP BY 1",
)
def monitor_health(spark, sf_dir):
    return browse.health(runs(spark, sf_dir), consistent(spark, sf_dir), _alerts(spark, sf_dir)).select("source_name", "run_id", "status", "events", "alerts", "healthy")


@REGISTRY.add("source_revisions", ALL_RULES + _CHANGES + " SELECT 'demo' AS source_name, (SELECT count(*) FROM e) AS events_revision, (SELECT count(*) FROM alerts) + (SELECT count(*) FROM lg) AS alerts_revision")
def source_revisions(spark, sf_dir):
    found = _alerts(spark, sf_dir)
    return browse.revisions(consistent(spark, sf_dir), found, _log(found).withColumn("source_name", F.lit("demo")))


@REGISTRY.add("latest_source", f"WITH {E},{RUNS_SQL} SELECT arg_max(source_name, run_id) AS source_name FROM runs")
def latest_source(spark, sf_dir):
    return browse.latest_source(runs(spark, sf_dir))


@REGISTRY.add(
    "rule_overview",
    ALL_RULES
    + """, k AS (SELECT * FROM (VALUES ('AUTH_BRUTE_FORCE_USER', true, ''), ('AUTH_PASSWORD_SPRAY_IP', true, ''), ('AUTH_SUCCESS_AFTER_FAILURES', true, ''), ('AUTH_ACCOUNT_LOCKOUT', true, ''), ('AUTH_NEW_IP_FOR_USER', true, ''),
    ('after_hours', false, 'off'), ('unusual_hour_for_user', false, 'off'), ('unauthorized_network', false, 'off'), ('new_application_for_user', false, 'off'), ('global_failure_spike', false, 'off'), ('authentication_pattern_change', false, 'off'), ('repeated_lockout', false, 'off')) v(rule_id, enabled, reason))
    SELECT rule_id, enabled, reason, (SELECT count(*) FROM alerts a WHERE a.rule_id = k.rule_id) AS alerts FROM k""",
)
def rule_overview(spark, sf_dir):
    return browse.rule_overview(RULES, all_alerts(spark, sf_dir), {k: "off" for k in DISABLED}).drop("rule_name")


@REGISTRY.add("alert_history", ALL_RULES + _CHANGES + f" SELECT alert_id, old_status, new_status, {_T.format('changed_at')} AS changed_at FROM lg WHERE alert_id = (SELECT min(alert_id) FROM lg)")
def alert_history(spark, sf_dir):
    log = _log(all_alerts(spark, sf_dir))
    first = log.agg(F.min("alert_id").alias("alert_id"))
    return log.join(F.broadcast(first), "alert_id", "left_semi").select("alert_id", "old_status", "new_status", text_time("changed_at"))
