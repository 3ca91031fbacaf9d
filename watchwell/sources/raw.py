"""Raw records from files and databases, read at once or from a cursor on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from watchwell.sources.auth import day_start

# The columns of a raw file, in order; those that a historical read needs.
RAW_COLUMNS = (
    "id", "event_name", "log_source", "event_count", "event_time", "created_at", "updated_at", "event_id", "low_level_category", "source_ip",
    "destination_ip", "username", "custom_user_id", "custom_ip_address", "custom_relying_party", "custom_message", "event_type_id", "event_time_origen",
)
HISTORY_COLUMNS = (
    "id", "event_name", "log_source", "event_count", "event_time", "created_at", "updated_at", "event_id", "custom_user_id", "custom_ip_address",
    "custom_relying_party", "event_type_id", "event_time_origen",
)
RAW_SCHEMA = StructType([StructField(c, StringType()) for c in (*RAW_COLUMNS, "_corrupt_record")])


def read_csv(spark: SparkSession, path: str, line_ends_in_fields: bool = True) -> DataFrame:
    """A headerless file of 18 columns; lines of another width have ``_corrupt_record``.

    Quoted line ends and a byte-order mark are read, blank lines are skipped.
    ``pos`` is the place in the file. Files whose fields hold no line ends
    (``line_ends_in_fields`` false) are split between tasks; others take one task each.
    """
    rows = spark.read.schema(RAW_SCHEMA).csv(path, mode="PERMISSIVE", multiLine=line_ends_in_fields, escape='"', columnNameOfCorruptRecord="_corrupt_record", ignoreLeadingWhiteSpace=False)
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    return rows.withColumn("id", F.regexp_replace("id", "^﻿", ""))


def well_formed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def _id_order(column: str) -> list[Column]:
    """Numeric ids by value and before all others, which come by text."""
    number = F.when(F.col(column).rlike(r"^[0-9]{1,18}$"), F.col(column).cast("bigint"))
    return [number.isNull(), F.coalesce(number, F.lit(0)), F.col(column)]


def _after(ts: str, id_column: str, cursor: tuple[str, str]) -> Column:
    at, last = F.lit(cursor[0]).cast("timestamp"), cursor[1]
    numeric = last.isdigit() and len(last) <= 18
    anchor = [F.lit(not numeric), F.lit(int(last) if numeric else 0), F.lit(last)]
    later, same = F.lit(False), F.lit(True)
    for key, value in zip(_id_order(id_column), anchor, strict=True):
        later, same = later | (same & (key > value)), same & (key == value)
    return (F.col(ts) > at) | ((F.col(ts) == at) & later)


def fetch_after(rows: DataFrame, cursor: tuple[str, str] | None, limit: int, ts: str = "ts", id_column: str = "event_id") -> DataFrame:
    """The next ``limit`` rows after a cursor (time, id), in order."""
    if cursor is not None:
        rows = rows.filter(_after(ts, id_column, cursor))
    return rows.orderBy(ts, *_id_order(id_column)).limit(limit)


def keyset_query(table: str, cursor: tuple[str, str] | None, limit: int, ts: str = "event_time", id_column: str = "id") -> str:
    """SQL text of the same read, for a database that compares rows (S3)."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    where = f" WHERE ({ts}, {id_column}) > ({quoted(cursor[0])}, {quoted(cursor[1])})" if cursor else ""
    return f"SELECT {', '.join(RAW_COLUMNS)} FROM {table}{where} ORDER BY {ts}, {id_column} LIMIT {int(limit)}"


def read_jdbc(spark: SparkSession, url: str, query: str, fetch_size: int = 2000, **options: str) -> DataFrame:
    """A query's rows from a database (S3)."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch_size), **options).load()


def read_jdbc_range(spark: SparkSession, url: str, table: str, start: str, stop: str, column: str = "event_time", partitions: int = 32, fetch_size: int = 2000, **options: str) -> DataFrame:
    """A table's rows with a time in [start, stop), read in ranges of it, one task each.

    The database filters: both bounds are pushed down.
    """
    bounds = {"partitionColumn": column, "lowerBound": start, "upperBound": stop, "numPartitions": str(partitions)}
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_size), **bounds, **options).load()
    return rows.filter((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.lit(stop).cast("timestamp")))


def history(rows: DataFrame, start: str, stop: str, lookback_minutes: int = 0, columns: tuple[str, ...] = HISTORY_COLUMNS) -> DataFrame:
    """Rows whose origin (else processed) time lies in [start - lookback, stop); only the columns needed."""
    at = F.coalesce(F.try_to_timestamp("event_time_origen"), F.try_to_timestamp("event_time"))
    lo = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) - lookback_minutes * 60_000_000)
    return rows.filter((at >= lo) & (at < F.lit(stop).cast("timestamp"))).select(*columns)


def live_sample(rows: DataFrame, day: str, limit: int, zone: str, ts: str = "ts", id_column: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """The newest ``limit`` rows of a local day, and the cursor just before them."""
    today = rows.filter((F.col(ts) >= day_start(day, zone)) & (F.col(ts) < day_start(day, zone, 1)))
    newest = today.orderBy(F.desc(ts), F.desc(id_column)).limit(limit + 1)
    nth = F.row_number().over(Window.orderBy(F.desc(ts), F.desc(id_column)))  # over limit + 1 rows
    ranked = newest.withColumn("_nth", nth)
    return ranked.filter(F.col("_nth") <= limit).drop("_nth"), ranked.filter(F.col("_nth") == limit + 1).select(F.col(ts).alias("cursor_ts"), F.col(id_column).alias("cursor_id"))


def write_outputs(judged: DataFrame, statistics: DataFrame, folder: str) -> None:
    """Valid rows (by event date), rejected rows and counters as Parquet."""
    judged.filter("rejection_reason = ''").withColumn("event_date", F.to_date("event_time_utc")).write.mode("overwrite").partitionBy("event_date").parquet(f"{folder}/valid")
    judged.filter("rejection_reason <> ''").write.mode("overwrite").parquet(f"{folder}/rejected")
    statistics.write.mode("overwrite").parquet(f"{folder}/statistics")


def write_alerts(alerts: DataFrame, summary: DataFrame, folder: str) -> None:
    """Alerts and their summary as Parquet."""
    alerts.write.mode("overwrite").parquet(f"{folder}/alerts")
    summary.write.mode("overwrite").parquet(f"{folder}/summary")
