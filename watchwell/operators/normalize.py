"""Raw audit records to normalized, checked and de-duplicated records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchwell.functions import ip, text

# Event name -> (type id, class); the flags in their order; flags that reject.
EVENTS = {
    "Application Token Success": ("1200", "success"),
    "Fresh Credential Validation Error": ("1203", "failure"),
    "Extranet Lockout Audit": ("1210", "lockout"),
}
FLAGS = (
    "MISSING_SOURCE_EVENT_ID", "UNKNOWN_EVENT_NAME", "EVENT_TYPE_MISMATCH", "INVALID_EVENT_TIME", "INVALID_CREATED_AT",
    "CREATED_BEFORE_EVENT", "MISSING_USER_ID", "MISSING_CLIENT_IP", "INVALID_CLIENT_IP", "INVALID_EVENT_COUNT",
)
REJECTING = ("INVALID_EVENT_TIME", "UNKNOWN_EVENT_NAME", "MISSING_USER_ID", "MISSING_CLIENT_IP", "INVALID_CLIENT_IP")


@dataclass(frozen=True)
class NormalizeConfig:
    secret: bytes
    minimum_year: int = 2020
    rejecting: tuple[str, ...] = REJECTING


NORMALIZED = (
    "record_id", "source_event_id", "deduplication_key", "event_type_id", "event_name", "event_class", "event_time_utc", "event_time_source",
    "created_at_utc", "updated_at_utc", "log_source_key", "user_key", "user_id_format", "client_ip_key", "client_ip_version", "client_ip_scope",
    "relying_party", "event_count", "quality_flags",
)


def _trimmed(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def deduplication_key() -> Column:
    """event:<id>, else a hash of what the record says."""
    said = [text.iso_utc(F.col("event_time_utc")), *(F.col(c).cast("string") for c in ("event_type_id", "event_class", "user_key", "client_ip_key", "relying_party", "log_source_key", "event_count"))]
    return F.when(F.col("source_event_id") != "", F.concat(F.lit("event:"), "source_event_id")).otherwise(F.concat(F.lit("fingerprint:"), F.sha2(F.concat_ws("|", *said), 256)))


def normalize(raw: DataFrame, config: NormalizeConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """One normalized record (NORMALIZED and ``keep``) per raw record of 18 texts.

    event_time_utc and its like are instants, quality_flags an array.
    """
    kinds = F.create_map(*(F.lit(x) for name, (kind, _) in EVENTS.items() for x in (name, kind)))
    classes = F.create_map(*(F.lit(x) for name, (_, label) in EVENTS.items() for x in (name, label)))
    user, user_format = text.canonical_user(F.col("custom_user_id"))
    count, counted = text.weight(F.col("event_count"))
    rows = ip.address(raw, "custom_ip_address").withColumns(
        {
            "record_id": _trimmed("id"),
            "source_event_id": _trimmed("event_id"),
            "event_name": _trimmed("event_name"),
            "event_type_id": _trimmed("event_type_id"),
            "_origin": text.instant(F.col("event_time_origen")),
            "_processed": text.instant(F.col("event_time")),
            "created_at_utc": text.instant(F.col("created_at")),
            "updated_at_utc": text.instant(F.col("updated_at")),
            "_user": user,
            "user_id_format": user_format,
            "_count": count,
            "_counted": counted,
            "relying_party": text.service(F.col("custom_relying_party")),
        }
    )
    expected = F.try_element_at(kinds, F.col("event_name"))
    chosen = F.coalesce("_origin", "_processed")
    usable = F.coalesce(F.year(chosen) >= config.minimum_year, F.lit(False))
    rows = rows.withColumns(
        {
            "_expected": expected,
            "event_class": F.coalesce(F.try_element_at(classes, F.col("event_name")), F.lit("other")),
            "event_time_utc": F.when(usable, chosen),
            "event_time_source": F.when(~usable, "").when(F.col("_origin").isNotNull(), "event_time_origen").otherwise("event_time"),
        }
    )
    no_ip = _trimmed("custom_ip_address") == ""
    tests = (
        F.col("source_event_id") == "",
        F.col("_expected").isNull(),
        F.col("_expected").isNotNull() & (F.col("event_type_id") != F.col("_expected")),
        F.col("event_time_utc").isNull(),
        F.col("created_at_utc").isNull(),
        F.col("created_at_utc") < F.col("event_time_utc"),
        F.col("_user") == "",
        no_ip,
        ~no_ip & F.col("ip").isNull(),
        ~F.col("_counted"),
    )
    rows = rows.withColumns(
        {
            "quality_flags": F.array_compact(F.array(*(F.when(t, F.lit(name)) for t, name in zip(tests, FLAGS, strict=True)))),
            "log_source_key": text.pseudonym(_trimmed("log_source"), config.secret, "src"),
            "user_key": text.pseudonym(F.col("_user"), config.secret, "usr"),
            "client_ip_key": F.coalesce(text.pseudonym(F.col("ip.canonical"), config.secret, "ip"), F.lit("")),
            "client_ip_version": F.col("ip.version"),
            "client_ip_scope": F.coalesce("ip.scope", F.lit("")),
            "event_count": F.col("_count"),
        }
    )
    return rows.withColumn("deduplication_key", deduplication_key()).select(*NORMALIZED, *keep)


def judged(rows: DataFrame, order: Column | str, config: NormalizeConfig) -> DataFrame:
    """rows with rejection_reason: duplicates first, then flags that reject.

    The first row of a key, in ``order``, claims it even if it is rejected itself.
    A busy key costs a sort of its own rows only.
    """
    nth = F.row_number().over(Window.partitionBy("deduplication_key").orderBy(order))
    reasons = F.array_join(text.listed(F.col("quality_flags"), config.rejecting), ";")
    return rows.withColumn("_nth", nth).withColumn("rejection_reason", F.when(F.col("_nth") > 1, "DUPLICATE_EVENT").otherwise(reasons)).drop("_nth")


def malformed(rows: DataFrame, column: str = "_corrupt_record") -> DataFrame:
    """Rejections of lines of the wrong width, keyed by the hash of their text."""
    bad = rows.filter(F.col(column).isNotNull())
    return bad.select(F.concat(F.lit("malformed:"), F.sha2(column, 256)).alias("deduplication_key"), F.lit("MALFORMED_COLUMN_COUNT").alias("quality_flags"), F.lit("MALFORMED_COLUMN_COUNT").alias("rejection_reason"))


def statistics(rows: DataFrame, n_malformed: int = 0) -> DataFrame:
    """(measure, name, rows) of judged rows: totals, classes, flags and reasons.

    One pass: every row becomes the counters that it moves.
    """
    good = F.col("rejection_reason") == ""
    counter = lambda measure, name: F.struct(F.lit(measure).alias("measure"), name.alias("name"))
    total = lambda name, on: F.when(on, counter("total", F.lit(name)))
    moved = F.concat(
        F.array(
            total("input", F.lit(True)), total("valid", good), total("rejected", ~good), total("duplicate", F.col("rejection_reason") == "DUPLICATE_EVENT"),
            total("valid_with_warnings", good & (F.size("quality_flags") > 0)), counter("class", F.col("event_class")),
        ),
        F.transform("quality_flags", lambda f: counter("flag", f)),
        F.when(good, F.array().cast("array<struct<measure:string,name:string>>")).otherwise(F.transform(F.split("rejection_reason", ";"), lambda r: counter("reason", r))),
    )
    found = rows.select(F.explode(F.array_compact(moved)).alias("x")).groupBy("x.measure", "x.name").agg(F.count("*").alias("n"))
    fixed = {"input": n_malformed, "valid": 0, "rejected": n_malformed, "duplicate": 0, "malformed": n_malformed, "valid_with_warnings": 0}
    plus = rows.sparkSession.createDataFrame([("total", k, v) for k, v in fixed.items()], "measure string, name string, n long")
    return found.unionByName(plus).groupBy("measure", "name").agg(F.sum("n").alias("rows"))
