"""Shared pieces of the registered queries and of their SQL."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchwell.operators import baseline, detect
from watchwell.operators.rules import slow_rules
from watchwell.sources import tables
from watchwell.sources.auth import activity

#: The test activity: its first seven local days are the training period.
TRAINING_START, TRAINING_END = "2023-12-31", "2024-01-07"
CONFIG = baseline.BaselineConfig(minimum_events_per_day=20, minimum_active_hours=12, minimum_user_history=5, training_start=TRAINING_START, training_end=TRAINING_END, evaluation_start="2024-01-08")
RULES = slow_rules()


@dataclass
class Registry:
    """Queries and SQL by name."""

    queries: dict = field(default_factory=dict)
    oracles: dict = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None):
        def keep(query):
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql.strip()
            return query

        return keep


def consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).filter("is_consistent")


def localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.localized(consistent(spark, sf_dir))


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.training(localized(spark, sf_dir), CONFIG)


#: Alert tables of this session: (application, events, their version) -> folder.
_ALERTS: dict[tuple, str] = {}


def found_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all rules over the whole activity, with the baseline of its first days."""
    known = baseline.context(trained(spark, sf_dir), CONFIG)
    return detect.detect(consistent(spark, sf_dir), RULES, (known["users"], known["user_ips"], TRAINING_END))


def all_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert table: found once for a state of the events, stored, and read by every query over alerts."""
    events = f"{sf_dir}/events.parquet"
    key = (spark.sparkContext.applicationId, events, tables.version(spark, events))
    if key not in _ALERTS or tables.version(spark, _ALERTS[key]) is None:
        folder = f"{tables.shared_dir(spark)}/alerts-{uuid.uuid4().hex}"
        found_alerts(spark, sf_dir).write.parquet(folder)
        _ALERTS[key] = folder
    return spark.read.parquet(_ALERTS[key])


def text_time(column: str, name: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or column)


# The same events in SQL: id, ts, us, cls, usr, ip, rp, w, loc (local time).
E_ALL = """
e_all AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ts, epoch_us(ts) AS us,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'lockout' WHEN 'purchase' THEN 'other' ELSE 'success' END AS cls,
    'usr_' || user_id AS usr, 'ip_' || json_extract_string(props, '$.k') AS ip, 'svc_' || (event_id % 20) AS rp,
    CAST(1 + event_id % 3 AS BIGINT) AS w, ts - INTERVAL 5 HOUR AS loc, event_id % 50 <> 0 AS ok
  FROM events)"""
E = E_ALL + """,
e AS (SELECT * FROM e_all WHERE ok)"""
DAYS = """
days AS (
  SELECT CAST(loc AS DATE) AS day FROM e GROUP BY 1
  HAVING sum(w) >= 20 AND count(DISTINCT hour(loc)) >= 12
    AND CAST(loc AS DATE) BETWEEN DATE '2023-12-31' AND DATE '2024-01-07')"""
TRAIN = E + "," + DAYS + """,
tr AS (SELECT e.*, CAST(loc AS DATE) AS day, hour(loc) AS hr FROM e WHERE CAST(loc AS DATE) IN (SELECT day FROM days))"""
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END || '-05:00'"


def rule_sql(name: str, rule_id: str, where: str, keys: str, entity: str, minimum: int, cooldown: int, base: int, extra: str = "0", factors: str = "", lim: int | None = None, hit: str = "true", users: int = 0, ctes: str = "", evidence: str = "true") -> str:
    """CTEs e_<name> .. <name>: alerts of one rule over 1440-minute windows (no equal instants)."""
    lim = minimum if lim is None else lim
    day = 1440 * 60_000_000
    return f"""{ctes}
m_{name} AS (SELECT *, {keys} AS ent FROM e WHERE {where}),
s_{name} AS (
  SELECT *, sum(CASE WHEN {entity} THEN w ELSE 0 END) OVER (PARTITION BY ent ORDER BY us RANGE BETWEEN {day} PRECEDING AND CURRENT ROW) AS total,
    list_distinct(list(usr) OVER (PARTITION BY ent ORDER BY us RANGE BETWEEN {day} PRECEDING AND CURRENT ROW)) AS us_list
  FROM m_{name}),
h_{name} AS (
  SELECT ent, us, total, len(us_list) AS n_users, row_number() OVER (PARTITION BY ent ORDER BY us) AS rn
  FROM s_{name} WHERE total >= {minimum} AND {hit} AND len(us_list) >= {users}),
k_{name} AS (
  SELECT ent, us, rn, total, n_users, us AS last, true AS keep FROM h_{name} WHERE rn = 1
  UNION ALL
  SELECT h.ent, h.us, h.rn, h.total, h.n_users, CASE WHEN h.us - k.last >= {cooldown * 60_000_000} THEN h.us ELSE k.last END, h.us - k.last >= {cooldown * 60_000_000}
  FROM k_{name} k JOIN h_{name} h ON h.ent = k.ent AND h.rn = k.rn + 1),
g_{name} AS (
  SELECT k.ent, k.us AS hit, any_value(k.total) AS total, any_value(k.n_users) AS n_users, min(m.ts) AS first_seen, max(m.ts) AS last_seen,
    CAST(sum(w) AS BIGINT) AS event_count,
    CAST(coalesce(sum(w) FILTER (cls = 'success'), 0) AS BIGINT) AS success_count, CAST(coalesce(sum(w) FILTER (cls = 'failure'), 0) AS BIGINT) AS failure_count,
    CAST(coalesce(sum(w) FILTER (cls = 'lockout'), 0) AS BIGINT) AS lockout_count,
    count(DISTINCT usr) AS distinct_users, count(DISTINCT ip) AS distinct_client_ips,
    CASE WHEN count(DISTINCT usr) = 1 THEN min(usr) ELSE '' END AS user_key, CASE WHEN count(DISTINCT ip) = 1 THEN min(ip) ELSE '' END AS client_ip_key,
    array_to_string(list_slice(list_sort(list(DISTINCT rp)), 1, 8), ';') AS relying_parties, list_slice(list(id ORDER BY m.us), 1, 10) AS ids
  FROM k_{name} k JOIN m_{name} m ON m.ent = k.ent AND m.us BETWEEN k.us - {day} AND k.us AND ({evidence})
  WHERE k.keep GROUP BY k.ent, k.us),
r_{name} AS (SELECT *, least(10, greatest(0, event_count - {lim})) AS volume, {extra} AS more FROM g_{name}),
t_{name} AS (SELECT *, least(100, {base} + volume + more) AS score FROM r_{name}),
{name} AS (
  SELECT 'alt_' || left(sha256('{rule_id}|' || user_key || '|' || client_ip_key || '|' || {ISO.format('(first_seen - INTERVAL 5 HOUR)')} || '|' || {ISO.format('(last_seen - INTERVAL 5 HOUR)')} || '|' || array_to_string(list_sort(ids), ',')), 20) AS alert_id,
    '{rule_id}' AS rule_id, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 65 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS severity,
    CAST(score AS INTEGER) AS risk_score,
    '[{{"factor":"base_rule","points":{base}}}' || CASE WHEN volume > 0 THEN ',{{"factor":"volume_above_threshold","points":' || volume || '}}' ELSE '' END {factors} || ']' AS risk_factors,
    {ISO.format('(first_seen - INTERVAL 5 HOUR)')} AS first_seen_local, {ISO.format('(last_seen - INTERVAL 5 HOUR)')} AS last_seen_local,
    user_key, client_ip_key,
    array_to_string(list_filter([CASE WHEN failure_count > 0 THEN 'failure:' || failure_count END, CASE WHEN lockout_count > 0 THEN 'lockout:' || lockout_count END, CASE WHEN success_count > 0 THEN 'success:' || success_count END], lambda x: x IS NOT NULL), ';') AS event_types,
    event_count, success_count, failure_count, lockout_count, distinct_users, distinct_client_ips, relying_parties, array_to_string(ids, ';') AS evidence_event_ids,
    first_seen, last_seen
  FROM t_{name})"""


ALERT_FIELDS = ("alert_id", "rule_id", "severity", "risk_score", "risk_factors", "first_seen_local", "last_seen_local", "user_key", "client_ip_key", "event_types", "event_count", "success_count", "failure_count", "lockout_count", "distinct_users", "distinct_client_ips", "relying_parties", "evidence_event_ids")
_FIELDS = ", ".join(ALERT_FIELDS)
_INTENSE = """|| CASE WHEN total >= {0} THEN ',{{"factor":"intense_pattern","points":{1}}}' ELSE '' END"""
R_BRUTE = rule_sql("brute", "AUTH_BRUTE_FORCE_USER", "cls = 'failure'", "usr", "true", 6, 15, 65, "CASE WHEN total >= 20 THEN 20 ELSE 0 END", _INTENSE.format(20, 20))
R_SPRAY = rule_sql("spray", "AUTH_PASSWORD_SPRAY_IP", "cls = 'failure'", "ip", "true", 4, 15, 65, "5 + CASE WHEN total >= 20 OR n_users >= 10 THEN 20 ELSE 0 END", """|| ',{"factor":"multiple_accounts","points":5}' || CASE WHEN total >= 20 OR n_users >= 10 THEN ',{"factor":"intense_pattern","points":20}' ELSE '' END""", users=3)
R_SUCCESS = rule_sql("succ", "AUTH_SUCCESS_AFTER_FAILURES", "cls IN ('failure', 'success')", "usr", "cls = 'failure'", 4, 15, 75, "5 + CASE WHEN total >= 10 THEN 10 ELSE 0 END", """|| ',{"factor":"success_after_failures","points":5}' """ + _INTENSE.format(10, 10), lim=5, hit="cls = 'success'", evidence="m.cls = 'failure' OR m.us = k.us")
R_LOCK = rule_sql("lockd", "AUTH_ACCOUNT_LOCKOUT", "cls = 'lockout'", "usr", "true", 6, 1440, 85)
R_NEW = rule_sql("newip", "AUTH_NEW_IP_FOR_USER", "cls IN ('success', 'failure', 'lockout') AND CAST(loc AS DATE) > DATE '2024-01-07' AND usr IN (SELECT usr FROM tr GROUP BY usr HAVING sum(w) >= 5) AND (usr, ip) NOT IN (SELECT usr, ip FROM tr)", "usr || ':' || ip", "true", 3, 1440, 40)
RULE_CTES = ",".join((R_BRUTE, R_SPRAY, R_SUCCESS, R_LOCK, R_NEW)) + """,
alerts AS (SELECT * FROM brute UNION ALL SELECT * FROM spray UNION ALL SELECT * FROM succ UNION ALL SELECT * FROM lockd UNION ALL SELECT * FROM newip)"""
ALL_RULES = "WITH RECURSIVE " + TRAIN + "," + RULE_CTES


def one_rule(ctes: str, name: str, base: str = E) -> str:
    return f"WITH RECURSIVE {base},{ctes} SELECT {_FIELDS} FROM {name}"
