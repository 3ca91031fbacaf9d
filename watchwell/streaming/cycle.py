"""Structured Streaming forms: the monitor cycle, live aggregates, stateful rules."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from watchwell.operators import mart, store
from watchwell.operators.detect import authorized, detect
from watchwell.operators.rules import Exclusions, Rule, RuleSet
from watchwell.streaming.keyed import KeyedLog
from watchwell.streaming.parts import drop, there

LOOKBACK_MINUTES = 720


def _read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A Parquet table that may not be there yet."""
    return spark.read.schema(schema).parquet(folder) if there(spark, folder) else spark.createDataFrame([], schema)


def _write(rows: DataFrame, folder: str, *parts: str) -> None:
    """Rows into their partitions, which are replaced if they are there."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(folder)


_RUN = StructType(
    [
        StructField("run_id", LongType()), StructField("source_name", StringType()), StructField("started_at", TimestampType()), StructField("finished_at", TimestampType()), StructField("status", StringType()),
        StructField("events_fetched", LongType()), StructField("events_inserted", LongType()), StructField("events_duplicate", LongType()), StructField("alerts_created", LongType()), StructField("alerts_suppressed", LongType()),
        StructField("notifications", LongType()), StructField("rule_version", LongType()), StructField("error", StringType()), StructField("newest_ts", TimestampType()),
    ]
)
_LEDGER = StructType([StructField("alert_id", StringType()), StructField("outcome", StringType())])
_KEY = StructType([StructField("event_key", StringType())])


@dataclass(frozen=True)
class Notify:
    """Which alerts of a cycle are to be sent: severities, how many in a cycle, attempts for each."""

    immediate: tuple[str, ...] = ("critical", "high")
    per_run: int = 20
    attempts: int = 3


def monitor_cycle(
    folder: str, rules: RuleSet | Callable[[], tuple[RuleSet, int]], source: str, lookback_minutes: int = LOOKBACK_MINUTES, baseline: Callable[[SparkSession], tuple[DataFrame, DataFrame, str] | None] | None = None,
    exclusions: Callable[[], Exclusions | None] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, notify: Notify | None = None, key_slots: int = 16,
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: append new events, detect over the lookback, accept, route, log the run.

    ``rules`` (with their version, else 0), ``baseline`` and ``exclusions`` are read anew
    in every cycle; without a baseline the new-address rule doesn't run. ``prepare`` makes
    events of raw rows (normalize, then sources.auth.from_normalized); without it batches
    are events. With ``notify``, what becomes of each new alert is decided, from the
    deliveries that a sender keeps in ``folder``/deliveries (alert_id, outcome).

    Kept in ``folder``: events, their keys, alerts with the version of their rules,
    suppressions, routing, and runs with one row a batch: ``running`` from its start on,
    then ``completed``, or ``failed`` with the class of the error, which goes on to the
    stream. From the runs the next cycle knows the newest event. A batch may come twice
    after a failure: events are known by key, alerts by id, and each batch writes into
    folders of its own number, so nothing doubles.
    """
    keys = KeyedLog(f"{folder}/keys", _KEY, "event_key", key_slots)

    def cycle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        row = dict.fromkeys(_RUN.names, 0) | {"run_id": number, "source_name": source, "started_at": datetime.now(timezone.utc), "finished_at": None, "error": None, "newest_ts": None}

        def log(**values) -> None:
            row.update(values)
            _write(spark.createDataFrame([tuple(row.values())], _RUN).withColumn("batch", F.lit(number).cast("long")), f"{folder}/runs", "batch")

        log(status="running")
        try:
            work(spark, batch, number, row)
        except Exception as error:
            log(status="failed", finished_at=datetime.now(timezone.utc), error=type(error).__name__)
            raise
        log(status="completed", finished_at=datetime.now(timezone.utc))

    def work(spark: SparkSession, batch: DataFrame, number: int, row: dict) -> None:
        active, row["rule_version"] = rules() if callable(rules) else (rules, 0)
        of_batch = F.lit(number).cast("long")
        events = prepare(batch) if prepare else batch
        made = events.withColumn("event_key", store.event_key(F.col("source_name"), F.col("event_id"))).withColumn("event_date", F.to_date("ts"))
        made.write.mode("overwrite").parquet(f"{folder}/work")  # prepared once, read by what follows
        keyed = spark.read.schema(made.schema).parquet(f"{folder}/work")
        schema = StructType([*made.schema.fields, StructField("batch", LongType())])
        fresh, counts = store.append_events(keyed, keys.find(keyed, number))
        _write(fresh.withColumn("batch", of_batch), f"{folder}/events", "batch", "event_date")
        written = _read(spark, f"{folder}/events", schema).filter(F.col("batch") == number)
        keys.append(written.select("event_key"), number)
        row["events_fetched"], row["events_inserted"] = keyed.count(), written.count()
        row["events_duplicate"] = row["events_fetched"] - row["events_inserted"]
        before = _read(spark, f"{folder}/runs", StructType([*_RUN.fields, StructField("batch", LongType())])).filter(F.col("batch") < number).select("newest_ts")
        newest = before.unionAll(keyed.filter("is_consistent").select("ts")).agg(F.max("newest_ts").alias("t")).first().t
        row["newest_ts"] = newest
        if newest is not None:
            start = newest - timedelta(minutes=lookback_minutes)
            # The date is a partition column: older days aren't read.
            kept = _read(spark, f"{folder}/events", schema).filter((F.col("batch") <= number) & F.col("is_consistent"))
            recent = kept.filter((F.col("event_date") >= F.lit(start).cast("date")) & (F.col("ts") >= F.lit(start)))
            found = detect(recent.drop("batch", "event_date", "event_key"), active, baseline(spark) if baseline else None, exclusions() if exclusions else None)
            alert_schema = StructType([*found.schema.fields, StructField("source_name", StringType()), StructField("rule_version", LongType()), StructField("batch", LongType())])
            old = _read(spark, f"{folder}/alerts", alert_schema).filter(F.col("batch") != number)
            judged = store.accept(found, old.select("alert_id", "source_name", "rule_id", "user_key", "client_ip_key", "last_seen"), store.cooldown_minutes(active), source)
            judged.write.mode("overwrite").parquet(f"{folder}/work")
            judged = spark.read.schema(judged.schema).parquet(f"{folder}/work")
            created = judged.filter("outcome = 'created'").drop("outcome").withColumns({"source_name": F.lit(source), "rule_version": F.lit(row["rule_version"]).cast("long"), "batch": of_batch})
            _write(created, f"{folder}/alerts", "batch")
            quiet = store.suppressions(judged, source)
            if notify:
                routed = store.route(created.withColumn("run_order", F.unix_micros("first_seen")), _read(spark, f"{folder}/deliveries", _LEDGER), notify.immediate, notify.per_run, notify.attempts)
                _write(routed.withColumn("batch", of_batch), f"{folder}/routing", "batch")
                held = created.join(routed.filter(F.col("outcome") != "send").select("alert_id", "outcome"), "alert_id")
                quiet = quiet.unionByName(store.suppressions(held, source))
                row["notifications"] = routed.filter("outcome = 'send'").count()
            _write(quiet.withColumn("batch", of_batch), f"{folder}/suppressions", "batch")
            row["alerts_created"], row["alerts_suppressed"] = created.count(), quiet.count()
        drop(spark, f"{folder}/work")

    return cycle


def unique_events(stream: DataFrame, delay: str = "720 minutes") -> DataFrame:
    """Events whose (source, id) wasn't seen within the watermark (T3). Beyond it, append_events decides."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_name", "event_id"])


def minute_stream(stream: DataFrame, delay: str = "720 minutes") -> DataFrame:
    """Running counts of each minute and service, in update mode (T4); late rows count within the watermark."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("event_class") == k, F.col("weight"))), F.lit(0)).cast("long").alias(f"{k}_count")
    rows = mart.usable(stream).withWatermark("ts", delay)
    counts = rows.groupBy(F.window("ts", "1 minute"), "source_name", "relying_party").agg(F.sum("weight").cast("long").alias("total_events"), of("success"), of("failure"), of("lockout"))
    return counts.select("source_name", F.col("window.start").alias("minute"), "relying_party", "total_events", "success_count", "failure_count", "lockout_count")


_HIT = StructType([StructField("entity_key", StringType()), StructField("authorized", BooleanType()), StructField("event_id", StringType()), StructField("at_us", LongType()), StructField("total", LongType())])
_ROW = StructType([StructField("us", LongType()), StructField("id", StringType()), StructField("w", LongType()), StructField("kind", StringType()), StructField("who", StringType())])


class _TrailingRule(StatefulProcessor):
    """A rule over the trailing window of one entity, with cooldown (T5).

    Events wait until the watermark passes them and are then taken in (time, id)
    order; of those behind, the ones of one window are kept. ``counted``: the class
    whose weights count (all if empty); ``fires_on``: the class of events that may hit
    (all if empty). ``raised``: thresholds of weight and users for authorized events,
    which are entities of their own. A timer clears an entity's state once the watermark
    is past its last event by window and cooldown.
    """

    def __init__(self, rule: Rule, counted: str = "", fires_on: str = "", raised: tuple[int, int] | None = None):
        self.window, self.cooldown = rule.window_minutes * 60_000_000, rule.cooldown_minutes * 60_000_000
        self.plain, self.counted, self.fires_on = (rule.minimum, rule.minimum_users), counted, fires_on
        self.raised = raised or self.plain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.recent = handle.getListState("recent", _ROW)
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for us, i, w, kind, who in zip(*(batch[c].tolist() for c in ("us", "event_id", "weight", "event_class", "who")), strict=True):
                self.waiting.appendValue((int(us), i, int(w), kind, who))
                self.handle.registerTimer(int(us) // 1000 + 1)
                self.handle.registerTimer((int(us) + self.window + self.cooldown) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ready, later = [x for x in waiting if x[0] < mark], [x for x in waiting if x[0] >= mark]
        if not ready:
            newest = max((x[0] for x in self.recent.get()), default=None)
            if not later and (newest is None or newest + self.window + self.cooldown < mark):
                for state in (self.waiting, self.recent, self.last):
                    state.clear()
            return iter([])
        minimum, minimum_users = self.raised if key[1] else self.plain
        recent: deque = deque()
        last = self.last.get()[0] if self.last.exists() else None
        total, users, hits = 0, Counter(), []

        def count(x: tuple, sign: int) -> None:
            nonlocal total
            if self.counted in ("", x[3]):
                total += sign * x[2]
                if x[4]:
                    users[x[4]] += sign
                    if not users[x[4]]:
                        del users[x[4]]

        for x in self.recent.get():
            recent.append(tuple(x))
            count(recent[-1], 1)
        for x in ready:
            while recent and recent[0][0] < x[0] - self.window:
                count(recent.popleft(), -1)
            recent.append(x)
            count(x, 1)
            if self.fires_on in ("", x[3]) and total >= minimum and len(users) >= minimum_users and (last is None or x[0] - last >= self.cooldown):
                hits.append((key[0], key[1], x[1], x[0], total))
                last = x[0]
        self.recent.put(list(recent))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if last is not None:
            self.last.update((last,))
        return iter([pd.DataFrame(hits, columns=_HIT.names)] if hits else [])

    def close(self) -> None:
        pass


def rule_stream(stream: DataFrame, rules: RuleSet, rule_id: str, delay: str = "0 minutes", baseline: tuple[DataFrame, DataFrame] | None = None, exclusions: Exclusions | None = None) -> DataFrame:
    """Hits of one rule as they become certain: (entity_key, authorized, event_id, at_us, total). Needs the RocksDB state store.

    The entity is the user; the address for password spraying; "user|address" for new
    addresses, which need ``baseline``: users with history, and their known addresses.
    Events on a list of ``exclusions`` are counted apart, against raised thresholds.
    """
    user, address = F.col("user_key"), F.col("client_ip_key")
    plan = {
        rules.brute_force.rule_id: (rules.brute_force, "event_class = 'failure' AND user_key <> ''", user, "", "", "failures_per_user"),
        rules.lockout.rule_id: (rules.lockout, "event_class = 'lockout' AND user_key <> ''", user, "", "", "lockouts_per_user"),
        rules.spray.rule_id: (rules.spray, "event_class = 'failure' AND client_ip_key <> ''", address, "", "", "failures_per_ip"),
        rules.success_after.rule_id: (rules.success_after, "event_class IN ('failure', 'success') AND user_key <> ''", user, "failure", "success", "success_after_failures"),
        rules.new_ip.rule_id: (rules.new_ip, "event_class IN ('success', 'failure', 'lockout') AND user_key <> '' AND client_ip_key <> ''", F.concat_ws("|", user, address), "", "", "new_ip_events"),
    }
    rule, where, entity, counted, fires_on, limit = plan[rule_id]
    rows = stream.filter(where)
    if rule_id == rules.new_ip.rule_id:
        if baseline is None:
            raise ValueError("new addresses need a baseline")
        users, known = baseline
        rows = rows.join(users.select("user_key"), "user_key", "left_semi").join(known.select("user_key", "client_ip_key"), ["user_key", "client_ip_key"], "left_anti")
    rows = rows.select(entity.alias("entity_key"), authorized(exclusions).alias("authorized"), "event_id", "ts", F.unix_micros("ts").alias("us"), "weight", "event_class", user.alias("who")).withWatermark("ts", delay)
    raised = None
    if exclusions:
        users_limit = exclusions.threshold("distinct_users_per_ip", rule.minimum_users) if rule is rules.spray else rule.minimum_users
        raised = (exclusions.threshold(limit, rule.minimum), users_limit)
    return rows.groupBy("entity_key", "authorized").transformWithStateInPandas(statefulProcessor=_TrailingRule(rule, counted, fires_on, raised), outputStructType=_HIT, outputMode="Append", timeMode="EventTime")


def brute_force_stream(stream: DataFrame, rules: RuleSet, delay: str = "0 minutes") -> DataFrame:
    """Brute-force hits as they become certain: (user_key, event_id, at_us, total)."""
    return rule_stream(stream, rules, rules.brute_force.rule_id, delay).withColumnRenamed("entity_key", "user_key")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, into Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
