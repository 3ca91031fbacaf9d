"""Typed sign-in events: the shape that every detection and mart operator reads.

``EVENT_COLUMNS``: event_id string, ts timestamp (UTC), event_class string
(success, failure, lockout or other), user_key, client_ip_key, relying_party
strings ("" if unknown), weight long (1 or more), source_name string,
is_consistent boolean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_COLUMNS = ("event_id", "ts", "event_class", "user_key", "client_ip_key", "relying_party", "weight", "source_name", "is_consistent")
CLASSES = ("success", "failure", "lockout", "other")
#: Zone of local days and hours.
ZONE = "America/Guayaquil"


def local(ts, zone: str = ZONE):
    """The wall-clock timestamp of a UTC instant in ``zone``."""
    return F.from_utc_timestamp(ts, zone)


def day_start(day: str, zone: str = ZONE, later: int = 0):
    """The instant at which a local day, or one so many days later, begins.

    A constant: filters on an instant reach the scan, filters on its local day don't.
    """
    return F.to_utc_timestamp(F.date_add(F.lit(day).cast("date"), later).cast("timestamp"), zone)


def from_activity(events: DataFrame) -> DataFrame:
    """Events of an activity table (event_id, ts, user_id, event_type, props)."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "error", "failure").when(kind == "signup", "lockout").when(kind == "purchase", "other").otherwise("success").alias("event_class"),
        F.concat(F.lit("usr_"), F.col("user_id")).alias("user_key"),
        F.concat(F.lit("ip_"), F.get_json_object("props", "$.k")).alias("client_ip_key"),
        F.concat(F.lit("svc_"), F.col("event_id") % 20).alias("relying_party"),
        (F.col("event_id") % 3 + 1).cast("long").alias("weight"),
        F.lit("demo").alias("source_name"),
        (F.col("event_id") % 50 != 0).alias("is_consistent"),
    )


def from_normalized(rows: DataFrame, source: str) -> DataFrame:
    """Events of normalized records: rows without a time go, ids fall back to the deduplication key."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.filter(F.col("event_time_utc").isNotNull()).select(
        F.when(blank("source_event_id") != "", F.col("source_event_id")).otherwise(blank("deduplication_key")).alias("event_id"),
        F.col("event_time_utc").alias("ts"),
        F.coalesce("event_class", F.lit("other")).alias("event_class"),
        blank("user_key").alias("user_key"),
        blank("client_ip_key").alias("client_ip_key"),
        blank("relying_party").alias("relying_party"),
        F.greatest(F.lit(1).cast("long"), F.coalesce(F.col("event_count").cast("long"), F.lit(1).cast("long"))).alias("weight"),
        F.lit(source).alias("source_name"),
        (F.coalesce(F.col("rejection_reason"), F.lit("")) == "").alias("is_consistent") if "rejection_reason" in rows.columns else F.lit(True).alias("is_consistent"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_activity(spark.read.parquet(f"{sf_dir}/events.parquet"))
