import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from watchwell.operators import detect, mart
from watchwell.operators.rules import Exclusions, RuleSet
from watchwell.streaming import cycle

SCHEMA = "event_id string, ts timestamp, event_class string, user_key string, client_ip_key string, relying_party string, weight long, source_name string, is_consistent boolean"
T = datetime(2026, 3, 21, 15)
RULES = replace(RuleSet(), brute_force=replace(RuleSet().brute_force, minimum=4))


def events(seed=0, n=120):
    rng = random.Random(seed)
    return [(f"e{i:04}", T + timedelta(seconds=rng.randint(0, 3600)), rng.choice(["failure", "failure", "success"]), f"u{rng.randint(0, 3)}", f"ip{rng.randint(0, 3)}", f"s{rng.randint(0, 2)}", rng.randint(1, 2), "demo", True) for i in range(n)]


def batches(spark, tmp_path, rows, parts):
    folder = f"{tmp_path}/in"
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_cycle_keeps_each_event_once_and_finds_the_same_windows(spark, tmp_path):
    rows = sorted(events(), key=lambda r: r[1])
    stream = batches(spark, tmp_path, rows + rows[:20], 1)
    store_dir = f"{tmp_path}/store"
    query = stream.writeStream.foreachBatch(cycle.monitor_cycle(store_dir, RULES, "demo", key_slots=2)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{store_dir}/events").count() == len(rows)
    got = {r.alert_id for r in spark.read.parquet(f"{store_dir}/alerts").collect()}
    whole = {r.alert_id for r in detect.detect(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert got and got <= whole
    # The same batch once more changes nothing.
    cycle.monitor_cycle(store_dir, RULES, "demo", key_slots=2)(spark.createDataFrame(rows, SCHEMA), 0)
    assert spark.read.parquet(f"{store_dir}/events").count() == len(rows)
    assert {r.alert_id for r in spark.read.parquet(f"{store_dir}/alerts").collect()} == got
    (run,) = spark.read.parquet(f"{store_dir}/runs").collect()
    assert (run.run_id, run.status, run.events_inserted, run.alerts_created, run.newest_ts) == (0, "completed", len(rows), len(got), max(r[1] for r in rows))
    # A later batch of the same events adds neither events nor alerts.
    cycle.monitor_cycle(store_dir, RULES, "demo", key_slots=2)(spark.createDataFrame(rows, SCHEMA), 1)
    assert spark.read.parquet(f"{store_dir}/events").count() == len(rows)
    assert spark.read.parquet(f"{store_dir}/alerts").count() == len(got)


def test_minute_stream_equals_batch(spark, tmp_path):
    rows = events(1)
    stream = cycle.minute_stream(batches(spark, tmp_path, rows, 3))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("minutes").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    want = mart.minutes(spark.createDataFrame(rows, SCHEMA)).drop("other_count")
    assert sorted(map(tuple, spark.table("minutes").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_unique_events(spark, tmp_path):
    rows = events(2, 40)
    stream = cycle.unique_events(batches(spark, tmp_path, rows + rows, 2))
    cycle.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40


def test_stateful_rule_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events(3)
    late = ("zz", T + timedelta(days=1), "failure", "u9", "ip", "s", 1, "demo", True)
    stream = cycle.brute_force_stream(batches(spark, tmp_path, [*rows, late], 1), RULES)
    cycle.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    got = sorted((r.user_key, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r.user_key, r.event_count) for r in detect.brute_force(spark.createDataFrame(rows, SCHEMA), RULES).collect())
    assert got == want


def test_cycle_uses_the_baseline_and_exclusions(spark, tmp_path):
    rows = events(3)
    users, known = spark.createDataFrame([("u0",), ("u1",)], "user_key string"), spark.createDataFrame([("u0", "ip0")], "user_key string, client_ip_key string")
    lists = Exclusions(user_keys=("u2",), thresholds={"failures_per_user": 1000})
    baseline = (users, known, "2026-03-20")
    store_dir = f"{tmp_path}/store"
    cycle.monitor_cycle(store_dir, RULES, "demo", baseline=lambda _: baseline, exclusions=lambda: lists)(spark.createDataFrame(rows, SCHEMA), 0)
    stored = spark.read.parquet(f"{store_dir}/alerts").collect()
    got = {r.alert_id for r in stored}
    # What the same events give with and without both; acceptance may suppress some.
    found = {r.alert_id: (r.rule_id, r.user_key) for r in detect.detect(spark.createDataFrame(rows, SCHEMA), RULES, baseline, lists).collect()}
    assert got and got <= set(found)
    assert any(r.rule_id == "AUTH_NEW_IP_FOR_USER" for r in stored)
    assert not any((r.rule_id, r.user_key) == ("AUTH_BRUTE_FORCE_USER", "u2") for r in stored)


def test_cycle_prepares_raw_rows_and_reads_the_newest_time_from_the_runs(spark, tmp_path):
    raw = spark.createDataFrame([(f"e{i}", T + timedelta(seconds=i), "u0") for i in range(6)], "id string, at timestamp, who string")
    made = lambda b: b.select(
        F.col("id").alias("event_id"), F.col("at").alias("ts"), F.lit("failure").alias("event_class"), F.col("who").alias("user_key"), F.lit("ip").alias("client_ip_key"),
        F.lit("s").alias("relying_party"), F.lit(1).cast("long").alias("weight"), F.lit("demo").alias("source_name"), F.lit(True).alias("is_consistent"),
    )
    run = cycle.monitor_cycle(f"{tmp_path}/store", RULES, "demo", lookback_minutes=30, prepare=made)
    run(raw, 0)
    old = spark.createDataFrame([("late", T - timedelta(hours=5), "u0")], "id string, at timestamp, who string")
    run(old, 1)
    log = spark.read.parquet(f"{tmp_path}/store/runs").orderBy("run_id").collect()
    assert [(r.events_inserted, r.events_duplicate, r.newest_ts) for r in log] == [(6, 0, T + timedelta(seconds=5)), (1, 0, T + timedelta(seconds=5))]
    assert log[0].alerts_created == 1 and log[1].alerts_created == 0


def test_every_stateful_rule_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(11)
    rows = [(f"e{i:04}", T + timedelta(seconds=rng.randint(0, 3600)), rng.choice(["failure", "failure", "success", "lockout"]), f"u{rng.randint(0, 4)}", f"ip{rng.randint(0, 3)}", "s", rng.randint(1, 2), "demo", True) for i in range(160)]
    late = [(f"z{i}", T + timedelta(days=1, seconds=i), kind, "u9", "ip9", "s", 1, "demo", True) for i, kind in enumerate(("failure", "lockout", "success"))]
    whole = spark.createDataFrame(rows, SCHEMA)
    users, known = spark.createDataFrame([("u0",), ("u1",), ("u9",)], "user_key string"), spark.createDataFrame([("u0", "ip0"), ("u1", "ip1")], "user_key string, client_ip_key string")
    # Cooldowns that outlast the windows, as a stream may not know an alert's evidence but its total.
    rules = replace(RULES, lockout=replace(RULES.lockout, minimum=3), spray=replace(RULES.spray, minimum=5), success_after=replace(RULES.success_after, minimum=3))
    pair = lambda r: f"{r.user_key}|{r.client_ip_key}"
    for rule, batch, entity, total in (
        (rules.lockout, detect.lockouts(whole, rules), lambda r: r.user_key, "event_count"),
        (rules.spray, detect.password_spray(whole, rules), lambda r: r.client_ip_key, "event_count"),
        (rules.success_after, detect.success_after_failures(whole, rules), lambda r: r.user_key, "failure_count"),
        (rules.new_ip, detect.new_ip(whole, rules, users, known, "2026-03-20"), pair, "event_count"),
    ):
        at = tmp_path / rule.rule_id
        stream = cycle.rule_stream(batches(spark, at, [*rows, *late], 1), rules, rule.rule_id, baseline=(users, known))
        cycle.run_available(stream, f"{at}/out", f"{at}/c")
        got = sorted((r.entity_key, r.total) for r in spark.read.parquet(f"{at}/out").collect())
        want = sorted((entity(r), r[total]) for r in batch.collect())
        assert got == want and want, rule.rule_id


def test_cycle_logs_failures_versions_and_routing(spark, tmp_path):
    rows, folder = events(4), f"{tmp_path}/store"
    whole = spark.createDataFrame(rows, SCHEMA)
    ready = []

    def active():
        ready.append(1)
        if len(ready) == 1:
            raise LookupError("no rules yet")
        return RULES, 7

    run = cycle.monitor_cycle(folder, active, "demo", notify=cycle.Notify(immediate=("high", "critical"), per_run=1))
    with pytest.raises(LookupError):
        run(whole, 0)
    (log,) = spark.read.parquet(f"{folder}/runs").collect()
    assert (log.status, log.error, log.newest_ts) == ("failed", "LookupError", None) and log.finished_at >= log.started_at
    run(whole, 0)  # the stream brings the batch again
    (log,) = spark.read.parquet(f"{folder}/runs").collect()
    alerts, routing = spark.read.parquet(f"{folder}/alerts").collect(), spark.read.parquet(f"{folder}/routing").collect()
    assert (log.status, log.error, log.events_fetched, log.events_inserted, log.rule_version, log.alerts_created) == ("completed", None, len(rows), len(rows), 7, len(alerts))
    assert alerts and {a.rule_version for a in alerts} == {7} and {r.alert_id for r in routing} == {a.alert_id for a in alerts}
    assert log.notifications == sum(r.outcome == "send" for r in routing) == min(1, sum(a.severity in ("high", "critical") for a in alerts))
    quiet = spark.read.parquet(f"{folder}/suppressions").groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in quiet if r.reason.startswith("notification")} == {o: sum(r.outcome == o for r in routing) for o in {r.outcome for r in routing} - {"send"}}


def test_cycle_reads_only_parts_that_may_hold_its_keys(spark, tmp_path):
    run = cycle.monitor_cycle(f"{tmp_path}/store", RULES, "demo", key_slots=2)
    one, two = events(5, 30), [("n" + r[0], *r[1:]) for r in events(6, 30)]
    for number, rows in enumerate((one, two, one)):
        run(spark.createDataFrame(rows, SCHEMA), number)
    log = spark.read.parquet(f"{tmp_path}/store/runs").orderBy("run_id").collect()
    assert [(r.events_inserted, r.events_duplicate) for r in log] == [(30, 0), (30, 0), (0, 30)]
    keys = cycle.KeyedLog(f"{tmp_path}/store/keys", cycle._KEY, "event_key", 2)
    asked = spark.createDataFrame([(f"demo:{r[0]}",) for r in one], "event_key string")
    assert {p.batch for p in keys.opened(asked, 3)} == {0}


def test_stateful_rules_with_exclusions_equal_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lists = Exclusions(user_keys=("u2",), client_ip_keys=("ip1",), thresholds={"failures_per_user": 6, "failures_per_ip": 6, "distinct_users_per_ip": 2})
    rules = replace(RULES, spray=replace(RULES.spray, minimum=5))
    rows = events(3)
    late = ("zz", T + timedelta(days=1), "failure", "u9", "ip9", "s", 1, "demo", True)
    whole = spark.createDataFrame(rows, SCHEMA)
    for rule, batch, entity in ((rules.brute_force, detect.brute_force(whole, rules, lists), "user_key"), (rules.spray, detect.password_spray(whole, rules, lists), "client_ip_key")):
        at = tmp_path / rule.rule_id
        stream = cycle.rule_stream(batches(spark, at, [*rows, late], 1), rules, rule.rule_id, exclusions=lists)
        cycle.run_available(stream, f"{at}/out", f"{at}/c")
        found = spark.read.parquet(f"{at}/out").collect()
        want = sorted((r[entity], r.event_count) for r in batch.collect())
        assert sorted((r.entity_key, r.total) for r in found) == want and any(r.authorized for r in found), rule.rule_id
