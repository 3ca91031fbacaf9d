"""Registered queries of normalization. Raw records are made from the activity table, with defects by event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchwell.functions import ip, text
from watchwell.operators import normalize
from watchwell.plans.common import Registry, text_time
from watchwell.sources.auth import activity, from_normalized

REGISTRY = Registry()
CONFIG = normalize.NormalizeConfig(b"test-secret")

_RAW_SQL = """
raw AS (
  SELECT event_id AS n, CAST(event_id AS VARCHAR) AS id,
    CASE event_type WHEN 'error' THEN 'Fresh Credential Validation Error' WHEN 'signup' THEN ' Extranet Lockout Audit' WHEN 'purchase' THEN 'Something Else' ELSE 'Application Token Success' END AS event_name,
    CASE WHEN event_id % 31 = 0 THEN '1210' WHEN event_type = 'error' THEN '1203' WHEN event_type = 'signup' THEN '1210' ELSE '1200' END AS event_type_id,
    CASE WHEN event_id % 19 = 0 THEN '0' WHEN event_id % 67 = 0 THEN 'x' ELSE CAST(1 + event_id % 3 AS VARCHAR) END AS event_count,
    CASE WHEN event_id % 37 = 0 THEN '1970-01-01 00:00:00 +00:00' WHEN event_id % 41 = 0 THEN 'no time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' +00:00' END AS event_time,
    CASE WHEN event_id % 43 = 0 THEN '' WHEN event_id % 47 = 0 THEN strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') || ' +00:00' ELSE strftime(ts + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S.%f') || ' +00:00' END AS created_at,
    CASE WHEN event_id % 5 = 0 THEN strftime(ts - INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') ELSE '' END AS event_time_origen,
    CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 1 THEN CAST(event_id - 1 AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS event_id,
    CASE WHEN event_id % 29 = 0 THEN ' ' WHEN event_id % 2 = 0 THEN 'CORP\\User' || user_id ELSE 'user' || user_id || '@Example.com' END AS custom_user_id,
    CASE WHEN event_id % 23 = 0 THEN 'not-an-ip' WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN '10.0.0.' || user_id % 256 WHEN event_id % 61 = 0 THEN '2001:4860::' || user_id % 256 ELSE '8.8.' || user_id % 256 || '.' || event_id % 256 END AS custom_ip_address,
    CASE WHEN event_id % 20 = 7 THEN ' N/A' ELSE 'svc_' || event_id % 20 END AS custom_relying_party, ts
  FROM events),
norm AS (
  SELECT *, trim(event_name) AS name,
    CASE trim(event_name) WHEN 'Application Token Success' THEN 'success' WHEN 'Fresh Credential Validation Error' THEN 'failure' WHEN 'Extranet Lockout Audit' THEN 'lockout' ELSE 'other' END AS event_class,
    CASE WHEN n % 5 = 0 THEN ts - INTERVAL 1 MINUTE WHEN n % 37 = 0 OR n % 41 = 0 THEN NULL ELSE ts END AS event_time_utc,
    CASE WHEN n % 43 = 0 THEN NULL WHEN n % 47 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts + INTERVAL 1 MINUTE END AS created,
    CASE WHEN n % 23 = 0 OR n % 53 = 0 THEN NULL WHEN n % 59 <> 0 AND n % 61 = 0 THEN 6 ELSE 4 END AS client_ip_version,
    CASE WHEN n % 19 = 0 OR n % 67 = 0 THEN 1 ELSE 1 + n % 3 END AS weight
  FROM raw),
flagged AS (
  SELECT *, list_filter([
    CASE WHEN event_id = '' THEN 'MISSING_SOURCE_EVENT_ID' END, CASE WHEN event_class = 'other' THEN 'UNKNOWN_EVENT_NAME' END,
    CASE WHEN (event_class = 'success' AND event_type_id <> '1200') OR (event_class = 'failure' AND event_type_id <> '1203') OR (event_class = 'lockout' AND event_type_id <> '1210') THEN 'EVENT_TYPE_MISMATCH' END,
    CASE WHEN event_time_utc IS NULL THEN 'INVALID_EVENT_TIME' END, CASE WHEN created IS NULL THEN 'INVALID_CREATED_AT' END,
    CASE WHEN created < event_time_utc THEN 'CREATED_BEFORE_EVENT' END, CASE WHEN n % 29 = 0 THEN 'MISSING_USER_ID' END,
    CASE WHEN custom_ip_address = '' THEN 'MISSING_CLIENT_IP' END, CASE WHEN custom_ip_address = 'not-an-ip' THEN 'INVALID_CLIENT_IP' END,
    CASE WHEN n % 19 = 0 OR n % 67 = 0 THEN 'INVALID_EVENT_COUNT' END], lambda x: x IS NOT NULL) AS flags,
    CASE WHEN event_id = '' THEN 'row:' || n ELSE event_id END AS key
  FROM norm),
judged AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY n) > 1 THEN 'DUPLICATE_EVENT'
    ELSE array_to_string(list_sort(list_filter(flags, lambda x: x IN ('INVALID_EVENT_TIME', 'UNKNOWN_EVENT_NAME', 'MISSING_USER_ID', 'MISSING_CLIENT_IP', 'INVALID_CLIENT_IP'))), ';') END AS rejection_reason
  FROM flagged)"""
_OUT_SQL = """SELECT id AS record_id, event_id AS source_event_id, event_type_id, name AS event_name, event_class, strftime(event_time_utc, '%Y-%m-%d %H:%M:%S.%f') AS event_time_utc,
  CASE WHEN event_time_utc IS NULL THEN '' WHEN n % 5 = 0 THEN 'event_time_origen' ELSE 'event_time' END AS event_time_source, CASE WHEN n % 29 = 0 THEN 'missing' WHEN n % 2 = 0 THEN 'domain_backslash_user' ELSE 'email_like' END AS user_id_format,
  CAST(client_ip_version AS INTEGER) AS client_ip_version, CASE WHEN client_ip_version IS NULL THEN '' WHEN custom_ip_address LIKE '10.%' THEN 'private' ELSE 'public' END AS client_ip_scope,
  CASE WHEN n % 20 = 7 THEN '' ELSE custom_relying_party END AS relying_party, CAST(weight AS BIGINT) AS event_count, array_to_string(flags, ';') AS quality_flags, rejection_reason FROM judged"""
_SHOWN = ("record_id", "source_event_id", "event_type_id", "event_name", "event_class", "event_time_utc", "event_time_source", "user_id_format", "client_ip_version", "client_ip_scope", "relying_party", "event_count", "quality_flags", "rejection_reason")


def raw_records(spark, sf_dir):
    """18 texts and ``pos`` per activity row."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    stamp = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" +00:00"))
    every = lambda k, r=0: n % k == r
    text_of = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return e.select(
        n.cast("string").alias("id"),
        F.when(kind == "error", "Fresh Credential Validation Error").when(kind == "signup", " Extranet Lockout Audit").when(kind == "purchase", "Something Else").otherwise("Application Token Success").alias("event_name"),
        F.lit("ADFS").alias("log_source"),
        F.when(every(19), "0").when(every(67), "x").otherwise((n % 3 + 1).cast("string")).alias("event_count"),
        F.when(every(37), "1970-01-01 00:00:00 +00:00").when(every(41), "no time").otherwise(stamp(ts)).alias("event_time"),
        F.when(every(43), "").when(every(47), stamp(ts - F.expr("INTERVAL 1 HOUR"))).otherwise(stamp(ts + F.expr("INTERVAL 1 MINUTE"))).alias("created_at"),
        F.lit("").alias("updated_at"),
        F.when(every(13), "").when(every(17, 1), (n - 1).cast("string")).otherwise(n.cast("string")).alias("event_id"),
        F.lit("").alias("low_level_category"),
        F.lit("").alias("source_ip"),
        F.lit("").alias("destination_ip"),
        F.lit("").alias("username"),
        F.when(every(29), " ").when(every(2), text_of("CORP\\User", F.col("user_id"))).otherwise(text_of("user", F.col("user_id"), "@Example.com")).alias("custom_user_id"),
        F.when(every(23), "not-an-ip").when(every(53), "").when(every(59), text_of("10.0.0.", F.col("user_id") % 256)).when(every(61), text_of("2001:4860::", F.col("user_id") % 256)).otherwise(text_of("8.8.", F.col("user_id") % 256, ".", n % 256)).alias("custom_ip_address"),
        F.when(every(20, 7), " N/A").otherwise(text_of("svc_", n % 20)).alias("custom_relying_party"),
        F.lit("").alias("custom_message"),
        F.when(every(31), "1210").when(kind == "error", "1203").when(kind == "signup", "1210").otherwise("1200").alias("event_type_id"),
        F.when(every(5), F.date_format(ts - F.expr("INTERVAL 1 MINUTE"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("").alias("event_time_origen"),
        n.alias("pos"),
    )


def judged_records(spark, sf_dir):
    return normalize.judged(normalize.normalize(raw_records(spark, sf_dir), CONFIG, ("pos",)), "pos", CONFIG)


def _out(rows):
    return rows.withColumns({"event_time_utc": text_time("event_time_utc"), "quality_flags": F.array_join("quality_flags", ";")}).select(*_SHOWN)


@REGISTRY.add("normalize_valid", f"WITH {_RAW_SQL} {_OUT_SQL} WHERE rejection_reason = ''")
def normalize_valid(spark, sf_dir):
    return _out(judged_records(spark, sf_dir).filter("rejection_reason = ''"))


@REGISTRY.add("normalize_rejected", f"WITH {_RAW_SQL} {_OUT_SQL} WHERE rejection_reason <> ''")
def normalize_rejected(spark, sf_dir):
    return _out(judged_records(spark, sf_dir).filter("rejection_reason <> ''"))


@REGISTRY.add(
    "normalize_stats",
    f"""WITH {_RAW_SQL}
    SELECT 'total' AS measure, unnest(['input', 'valid', 'rejected', 'duplicate', 'malformed', 'valid_with_warnings']) AS name,
      unnest([count(*), count(*) FILTER (rejection_reason = ''), count(*) FILTER (rejection_reason <> ''), count(*) FILTER (rejection_reason = 'DUPLICATE_EVENT'), 0, count(*) FILTER (rejection_reason = '' AND len(flags) > 0)]) AS rows FROM judged
    UNION ALL SELECT 'class', event_class, count(*) FROM judged GROUP BY 2
    UNION ALL SELECT 'flag', f, count(*) FROM (SELECT unnest(flags) AS f FROM judged) GROUP BY 2
    UNION ALL SELECT 'reason', r, count(*) FROM (SELECT unnest(string_split(rejection_reason, ';')) AS r FROM judged WHERE rejection_reason <> '') GROUP BY 2""",
)
def normalize_stats(spark, sf_dir):
    return normalize.statistics(judged_records(spark, sf_dir))


@REGISTRY.add("dedup_first", f"WITH {_RAW_SQL} SELECT id AS record_id FROM judged WHERE rejection_reason = 'DUPLICATE_EVENT'")
def dedup_first(spark, sf_dir):
    return judged_records(spark, sf_dir).filter("rejection_reason = 'DUPLICATE_EVENT'").select("record_id")


def _hmac_sql(value: str, prefix: str) -> str:
    """prefix_ and 24 hexadecimal digits of HMAC-SHA256, in SQL; blank stays blank."""
    key = CONFIG.secret.ljust(64, b"\0")
    inner, outer = (f"unhex('{bytes(b ^ x for b in key).hex()}')" for x in (0x36, 0x5C))
    return f"CASE WHEN {value} = '' THEN '' ELSE '{prefix}_' || left(sha256({outer} || unhex(sha256({inner} || encode({value})))), 24) END"


_KEYS_SQL = f"""plain AS (
  SELECT *, CASE WHEN n % 29 = 0 THEN '' WHEN n % 2 = 0 THEN lower(substr(custom_user_id, 6)) ELSE lower(string_split(custom_user_id, '@')[1]) END AS usr,
    CASE WHEN client_ip_version IS NULL THEN '' WHEN custom_ip_address LIKE '%::0' THEN left(custom_ip_address, -1) ELSE custom_ip_address END AS addr, 'ADFS' AS log_source,
    CASE WHEN n % 20 = 7 THEN '' ELSE custom_relying_party END AS service,
    CASE WHEN event_time_utc IS NULL THEN '' ELSE strftime(event_time_utc, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(event_time_utc) % 1000000 = 0 THEN '' ELSE strftime(event_time_utc, '.%f') END || '+00:00' END AS said_at FROM judged),
keyed AS (SELECT *, {_hmac_sql("log_source", "src")} AS log_source_key, {_hmac_sql("usr", "usr")} AS user_key, {_hmac_sql("addr", "ip")} AS client_ip_key FROM plain)
SELECT id AS record_id, log_source_key, user_key, client_ip_key, CASE WHEN event_id <> '' THEN 'event:' || event_id
  ELSE 'fingerprint:' || sha256(said_at || '|' || event_type_id || '|' || event_class || '|' || user_key || '|' || client_ip_key || '|' || service || '|' || log_source_key || '|' || CAST(weight AS VARCHAR)) END AS deduplication_key FROM keyed"""


@REGISTRY.add("pseudonyms", f"WITH {_RAW_SQL}, {_KEYS_SQL}")
def pseudonyms(spark, sf_dir):
    return normalize.normalize(raw_records(spark, sf_dir), CONFIG).select("record_id", "log_source_key", "user_key", "client_ip_key", "deduplication_key")


@REGISTRY.add(
    "typed_events",
    f"""WITH {_RAW_SQL} SELECT CASE WHEN event_id = '' THEN 'fingerprint' ELSE event_id END AS event_id, strftime(event_time_utc, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_class, CASE WHEN n % 20 = 7 THEN '' ELSE custom_relying_party END AS relying_party, CAST(weight AS BIGINT) AS weight, rejection_reason = '' AS is_consistent
    FROM judged WHERE event_time_utc IS NOT NULL""",
)
def typed_events(spark, sf_dir):
    rows = from_normalized(judged_records(spark, sf_dir), "demo")
    return rows.select(F.regexp_replace("event_id", "^fingerprint:.*", "fingerprint").alias("event_id"), text_time("ts"), "event_class", "relying_party", "weight", "is_consistent")


@REGISTRY.add(
    "keyword_classes",
    f"WITH {_RAW_SQL} SELECT id AS record_id, CASE WHEN lower(event_name) LIKE '%lockout%' THEN 'lockout' WHEN lower(event_name) LIKE '%error%' OR lower(event_name) LIKE '%fail%' THEN 'failure' WHEN lower(event_name) LIKE '%success%' THEN 'success' ELSE 'other' END AS event_class FROM raw",
)
def keyword_classes(spark, sf_dir):
    return raw_records(spark, sf_dir).select(F.col("id").alias("record_id"), text.keyword_class(F.col("event_name"), F.col("low_level_category")).alias("event_class"))


@REGISTRY.add("public_addresses", f"WITH {_RAW_SQL} SELECT id AS record_id, n % 23 <> 0 AND n % 53 <> 0 AND n % 59 <> 0 AS routable FROM raw")
def public_addresses(spark, sf_dir):
    return ip.address(raw_records(spark, sf_dir), "custom_ip_address").select(F.col("id").alias("record_id"), F.coalesce("ip.routable", F.lit(False)).alias("routable"))


@REGISTRY.add(
    "display_values",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts - INTERVAL 5 HOUR, '%d/%m/%Y %H:%M:%S') AS shown, 'Page ' || event_id % 20 AS display_name, sha256('svc_' || event_id % 20) AS service_key,
    hour(ts - INTERVAL 5 HOUR) >= 22 OR hour(ts - INTERVAL 5 HOUR) < 6 AS restricted FROM events""",
)
def display_values(spark, sf_dir):
    e = activity(spark, sf_dir)
    stated = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    page = F.concat(F.lit("https://example.test/app/page-"), F.col("event_id").cast("long") % 20, F.lit("/"))
    hour = F.hour(F.from_utc_timestamp("ts", "America/Guayaquil"))
    return e.select(
        "event_id",
        text.shown(stated, "America/Guayaquil").alias("shown"),
        text.display_name(page, F.lit(None).cast("string")).alias("display_name"),
        F.sha2("relying_party", 256).alias("service_key"),
        text.restricted(hour, 22, 6).alias("restricted"),
    )
