"""What is kept: events, alerts, statuses, deliveries; decisions are DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from watchwell.operators.detect import detect, evaluation
from watchwell.operators.rules import Exclusions, RuleSet

#: Before any instant.
_NEVER = -(2**62)
# Statuses of an alert.
STATUSES = ("new", "notified", "investigating", "resolved", "false_positive")


def append_events(batch: DataFrame, kept: DataFrame, key: str = "event_key") -> tuple[DataFrame, DataFrame]:
    """New rows of batch, and counts (inserted, duplicates).

    Rows are known by ``key``; of equal keys in the batch the first by ts stays.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy("ts", F.xxhash64(*batch.columns)))
    fresh = batch.withColumn("_nth", first).filter("_nth = 1").drop("_nth").join(kept.select(key), key, "left_anti")
    counts = batch.agg(F.count("*").alias("n")).join(F.broadcast(fresh.agg(F.count("*").alias("inserted")))).select("inserted", (F.col("n") - F.col("inserted")).alias("duplicates"))
    return fresh, counts


def event_key(source: Column, key: Column) -> Column:
    return F.concat_ws(":", source, key)


def cursors(events: DataFrame) -> DataFrame:
    """The newest (ts, event_id) of each source."""
    return events.groupBy("source_name").agg(F.max(F.struct("ts", "event_id")).alias("c")).select("source_name", F.col("c.ts").alias("cursor_ts"), F.col("c.event_id").alias("cursor_id"))


def since(events: DataFrame, start: str, source: str | None = None) -> DataFrame:
    """Consistent events from an instant on."""
    found = events.filter(F.col("is_consistent") & (F.col("ts") >= F.lit(start).cast("timestamp")))
    return found if source is None else found.filter(F.col("source_name") == source)


def bounds(events: DataFrame) -> DataFrame:
    """First and last consistent event of each source."""
    return events.filter("is_consistent").groupBy("source_name").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def accept(found: DataFrame, kept: DataFrame, cooldowns: dict[str, int], source: str, order: tuple[str, ...] = ("first_seen", "rule_id", "last_seen"), simulate: bool = False) -> DataFrame:
    """found with alert_id and outcome: created, duplicate_alert or persistent_cooldown.

    kept: stored alerts (alert_id, source_name, rule_id, user_key, client_ip_key,
    last_seen). Candidates of one rule, user and address are folded in ``order``, then
    by id, beginning at the newest kept one. Spark sorts them; the fold holds the last
    time and the last id created, however many candidates a key has (equal ids have
    equal times, so they follow each other).
    ``simulate``: as a preview does, where a cooldown of 0 still drops older alerts.
    """
    keys = ["rule_id", "user_key", "client_ip_key"]
    other = kept.groupBy("alert_id").agg(F.max(F.col("source_name") != source).alias("_elsewhere"), F.max(F.col("source_name") == source).alias("_here"))
    named = found.join(other, "alert_id", "left")
    again = F.concat(F.lit("alt_"), F.left(F.sha2(F.concat(F.lit(source + "|"), F.col("alert_id")), 256), F.lit(20)))
    named = named.withColumn("alert_id", F.when(F.coalesce("_elsewhere", F.lit(False)) & ~F.coalesce("_here", F.lit(False)), again).otherwise(F.col("alert_id"))).drop("_elsewhere", "_here")
    own = kept.filter(F.col("source_name") == source)
    named = named.join(own.select("alert_id", F.lit(True).alias("_known")).distinct(), "alert_id", "left")
    newest = own.groupBy(*keys).agg(F.max(F.unix_micros("last_seen")).alias("_newest"))
    minutes = F.create_map(*(F.lit(x) for pair in cooldowns.items() for x in pair)) if cooldowns else F.create_map(F.lit(""), F.lit(0))
    wait = F.coalesce(F.try_element_at(minutes, F.col("rule_id")), F.lit(0)).cast("long") * 60_000_000
    rows = named.join(newest, keys, "left").withColumns({"_known": F.coalesce("_known", F.lit(False)), "_newest": F.coalesce("_newest", F.lit(_NEVER)), "_at": F.unix_micros("last_seen"), "_wait": wait})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = latest = created = None
        for batch in batches:
            outcomes = []
            for *k, i, known, newest, at, wait in zip(*(batch[c] for c in (*keys, "alert_id", "_known", "_newest", "_at", "_wait")), strict=True):
                if k != key:
                    key, latest, created = k, newest, None
                if known or i == created:
                    outcomes.append("duplicate_alert")
                elif (wait > 0 or simulate) and latest != _NEVER and at - latest < wait:
                    outcomes.append("persistent_cooldown")
                else:
                    latest, created = max(latest, at), i
                    outcomes.append("created")
            yield batch[out_names[:-1]].assign(outcome=outcomes)

    out = StructType([*found.schema.fields, StructField("outcome", StringType())])
    out_names = out.names
    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, *order, "alert_id")
    return sorted_.mapInPandas(fold, out)


def suppressions(judged: DataFrame, source: str) -> DataFrame:
    """A log row for each alert that was not created."""
    entity = F.concat_ws("|", "rule_id", "user_key", "client_ip_key")
    details = F.to_json(F.struct("alert_id", F.lit(source).alias("source_name")))
    return judged.filter("outcome <> 'created'").select(F.col("outcome").alias("reason"), "rule_id", entity.alias("entity_key"), details.alias("details"))


def ending(found: DataFrame, start: str, stop: str) -> DataFrame:
    """Alerts whose last event lies in [start, stop)."""
    return found.filter((F.col("last_seen") >= F.lit(start).cast("timestamp")) & (F.col("last_seen") < F.lit(stop).cast("timestamp")))


def with_lookback(events: DataFrame, start: str, stop: str, minutes: int) -> DataFrame:
    """Events of [start - minutes, stop)."""
    from_us = F.unix_micros(F.lit(start).cast("timestamp")) - minutes * 60_000_000
    return events.filter((F.col("ts") >= F.timestamp_micros(from_us)) & (F.col("ts") < F.lit(stop).cast("timestamp")))


def cooldown_minutes(rules: RuleSet) -> dict[str, int]:
    return {r.rule_id: r.cooldown_minutes for r in rules.all()}


def analyze(events: DataFrame, kept: DataFrame, rules: RuleSet, start: str, stop: str, source: str, baseline=None, exclusions: Exclusions | None = None) -> DataFrame:
    """Alerts of a past range, accepted in the order of their last events."""
    found = ending(detect(with_lookback(events, start, stop, rules.longest_window()), rules, baseline, exclusions), start, stop)
    return accept(found, kept, cooldown_minutes(rules), source, ("last_seen", "rule_id"))


def preview(events: DataFrame, first: RuleSet, second: RuleSet, start: str, stop: str, baseline=None, exclusions: Exclusions | None = None, training_end: str | None = None) -> DataFrame:
    """Counts of accepted alerts under two rule sets and their difference.

    (measure, name, first, second, difference), by total, rule and severity. Events
    of days up to ``training_end`` are no evaluation and are left out.
    """
    look = max(first.longest_window(), second.longest_window())
    scope = evaluation(with_lookback(events, start, stop, look), training_end, first.zone)
    parts = []
    for name, rules in (("first", first), ("second", second)):
        found = ending(detect(scope, rules, baseline, exclusions), start, stop)
        kept = found.select("alert_id", F.lit("").alias("source_name"), "rule_id", "user_key", "client_ip_key", "last_seen").limit(0)
        good = accept(found, kept, cooldown_minutes(rules), "preview", simulate=True).filter("outcome = 'created'")
        items = F.array(F.struct(F.lit("total").alias("measure"), F.lit("").alias("name")), F.struct(F.lit("rule").alias("measure"), F.col("rule_id").alias("name")), F.struct(F.lit("severity").alias("measure"), F.col("severity").alias("name")))
        parts.append(good.select(F.explode(items).alias("x")).groupBy("x.measure", "x.name").agg(F.count("*").alias(name)))
    both = parts[0].join(parts[1], ["measure", "name"], "full_outer").fillna(0, ["first", "second"])
    return both.withColumn("difference", F.col("second") - F.col("first"))


def verify_replay(sample: DataFrame, kept: DataFrame, key: str = "event_key") -> DataFrame:
    """How many rows of a sample would be inserted again; 0 is right."""
    return append_events(sample, kept, key)[1]


def transitions(changes: DataFrame, alerts: DataFrame) -> DataFrame:
    """The status log: old to new, of known alerts and statuses, without repeats.

    changes: (alert_id, new_status, changed_at). An alert begins as "new".
    """
    good = changes.filter(F.col("new_status").isin(*STATUSES)).join(alerts.select("alert_id"), "alert_id", "left_semi")
    before = F.lag("new_status").over(Window.partitionBy("alert_id").orderBy("changed_at", "new_status"))
    return good.withColumn("old_status", F.coalesce(before, F.lit("new"))).filter("old_status <> new_status")


def current_status(log: DataFrame, alerts: DataFrame) -> DataFrame:
    """alerts with investigation_status and updated_at: their latest transition's."""
    last = log.groupBy("alert_id").agg(F.max(F.struct("changed_at", "new_status")).alias("l"))
    return alerts.join(last, "alert_id", "left").withColumn("investigation_status", F.coalesce("l.new_status", F.lit("new"))).withColumn("updated_at", F.coalesce("l.changed_at", "last_seen")).drop("l")


def route(alerts: DataFrame, ledger: DataFrame, immediate: tuple[str, ...], per_run: int, attempts: int) -> DataFrame:
    """What becomes of each alert of a run: outcome.

    alerts: with run_order. ledger: (alert_id, outcome). Alerts under the severity
    policy don't count against the cap of the run.
    """
    past = ledger.groupBy("alert_id").agg(F.count("*").alias("tries"), F.max(F.col("outcome").isin("sent", "dry_run")).alias("done"))
    now = F.col("severity").isin(*immediate)
    # The cap is reached after per_run alerts: only that many are ranked.
    first = alerts.filter(now).orderBy("run_order", "alert_id").limit(per_run).select("alert_id", F.lit(True).alias("in_run"))
    rows = alerts.join(past, "alert_id", "left").join(first, "alert_id", "left")
    outcome = (
        F.when(~now, "notification_deferred_by_severity_policy")
        .when(F.col("in_run").isNull(), "notification_run_limit")
        .when(F.coalesce("done", F.lit(False)), "notification_already_delivered")
        .when(F.coalesce("tries", F.lit(0)) >= attempts, "notification_retry_limit")
        .otherwise("send")
    )
    return rows.select("alert_id", "severity", outcome.alias("outcome"))


def deliveries(ledger: DataFrame) -> DataFrame:
    """The ledger with attempt numbers, and whether the alert is delivered on the channel."""
    w = Window.partitionBy("alert_id", "channel")
    return ledger.withColumn("attempt", F.row_number().over(w.orderBy("at"))).withColumn("delivered", F.max(F.col("outcome").isin("sent", "dry_run")).over(w))
