"""The live mart, the keyed log under it, and repeated batches."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from watchwell.operators import mart
from watchwell.sources.auth import EVENT_COLUMNS, activity
from watchwell.streaming import keyed, live
from watchwell.streaming.keyed import KeyedLog

FOLDER = "/root/testdata/sf0.001"
EVENT = "event_id string, ts timestamp, event_class string, user_key string, client_ip_key string, relying_party string, weight long, source_name string, is_consistent boolean"


def same(found, wanted):
    columns = sorted(wanted.columns)
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, wanted.select(columns).collect()))


def same_mart(spark, one, events):
    same(one.buckets(spark), mart.buckets(events))
    same(one.entities(spark), mart.entities(events))
    same(one.minutes(spark), mart.minutes(events))


def end_state(changes):
    """What a database holds after the changes, one by one."""
    held = {}
    for row in sorted(changes, key=lambda r: r["seq"]):
        key = (row["source_name"], row["event_id"])
        if row["op"] == "delete":
            held.pop(key, None)
        elif (row["op"] == "insert") != (key in held):
            held[key] = tuple(row[c] for c in EVENT_COLUMNS)
    return list(held.values())


def test_bloom_filters_forget_nothing_and_take_few_others():
    chance = np.random.default_rng(1)
    for n in (1, 50, 5000):
        inside, outside = (chance.integers(-(2**63), 2**63 - 1, n, dtype=np.int64) for _ in range(2))
        made = keyed.bloom(inside)
        assert all(keyed.may_hold(made, inside[i : i + 1]) for i in range(n)) and len(made) <= 4 * n + 128
        assert sum(keyed.may_hold(made, outside[i : i + 1]) for i in range(n)) <= 1 + n // 500
    assert not keyed.may_hold(keyed.bloom(inside), np.zeros(0, np.int64))


def test_log_opens_only_parts_that_may_hold_a_key(spark, tmp_path):
    schema = StructType([StructField("k", StringType()), StructField("v", LongType())])
    log = KeyedLog(str(tmp_path / "log"), schema, "k", slots=4)
    rows = lambda n, v, m=200: spark.range(n * 1000, n * 1000 + m).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(v).cast("long").alias("v"))
    for n in range(5):
        assert log.opened(rows(n, 0), n) == [] and log.find(rows(n, 0), n).count() == 0
        log.append(rows(n, n), n)
    again = log.opened(rows(2, 0), 5)
    assert {p.batch for p in again} == {2} and len(again) == 4
    assert {(r.k, r.v) for r in log.find(rows(2, 0).union(rows(9, 0)), 5).collect()} == {(f"k{i}", 2) for i in range(2000, 2200)}
    assert log.find(rows(2, 0), 2).count() == 0  # as it was before batch 2
    log.append(rows(2, 77, 10), 5)
    before = sorted(map(str, log.rows.read(spark).select("k", "v").distinct().collect()))
    log.append(rows(2, 77, 10), 5)  # the same batch again
    assert sorted(map(str, log.rows.read(spark).select("k", "v").distinct().collect())) == before
    values = lambda: {r.k: r.v for r in log.find(rows(2, 0), 6).collect()}
    assert values()["k2003"] == 77 and values()["k2100"] == 2
    log.merge(spark, 5)
    assert values()["k2003"] == 77 and values()["k2100"] == 2 and log.rows.live(spark).count() == 4 and log.rows.read(spark).count() == 1000
    assert 1 <= log.rows.sweep(spark) <= 4  # only the own parts of batch 5: earlier listings still name the others
    assert log.find(rows(2, 0), 5).count() == 200
    log.append(rows(7, 7), 6)
    assert log.find(rows(0, 0), 7).count() == 200 and log.find(rows(7, 0), 7).count() == 200


def test_reference_case_of_live_counts(spark, tmp_path):
    """Late rows count, a second insert doesn't, sources are apart, inconsistent rows are out."""
    at = lambda t: f"2026-03-16 {t}"
    row = lambda i, t, kind, source="test", ok=True: (i, at(t) if t else None, kind, "u", "i", "app", 2, source, ok)
    rows = [row("e1", "15:00:05", "failure"), row("e1", "15:00:05", "failure"), row("e2", "15:00:12", "success"), row("e3", "15:01:00", "lockout"), row("e1", "15:00:05", "failure", "other"), row("bad", None, "failure", ok=False)]
    events = spark.createDataFrame(rows, EVENT.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    one, rows = live.LiveMart(str(tmp_path), slots=1, key_slots=1), events.collect()
    step = one.step()
    for number, batch in enumerate(([rows[3]], [rows[0], rows[5]], [rows[1], rows[2], rows[4]])):  # the newest first
        step(live.as_changes(spark.createDataFrame(batch, EVENT)), number)
    found = {(r.source_name, str(r.minute)): (r.total_events, r.failure_count, r.success_count, r.lockout_count) for r in one.minutes(spark).collect()}
    assert found == {("test", at("15:00:00")): (4, 2, 2, 0), ("test", at("15:01:00")): (2, 0, 0, 2), ("other", at("15:00:00")): (2, 2, 0, 0)}


def test_shuffled_late_changed_and_deleted_rows_equal_the_end_state(spark, tmp_path):
    chance, changes = random.Random(1), []
    events = activity(spark, FOLDER).orderBy("ts").limit(120).collect()
    for e in events:
        for op in chance.choice((["insert"], ["insert", "update"], ["insert", "delete"], ["insert", "delete", "insert", "update"], ["update"], ["delete", "insert", "insert"], ["insert", "update", "update", "delete"])):
            other = chance.choice(events)
            values = {**e.asDict(), **({"relying_party": other.relying_party, "user_key": other.user_key, "ts": other.ts, "weight": other.weight} if op != "insert" or chance.random() < 0.5 else {})}
            changes.append({**values, "op": op, "seq": len(changes)})
    cuts = sorted(chance.sample(range(len(changes)), 2))
    batches = [changes[a:b] for a, b in zip([0, *cuts], [*cuts, len(changes)])]
    for b in batches:
        chance.shuffle(b)
    one = live.LiveMart(str(tmp_path), slots=2, key_slots=1)
    schema = EVENT + ", op string, seq long"
    frame = lambda rows: spark.createDataFrame([tuple(r[c] for c in (*EVENT_COLUMNS, "op", "seq")) for r in rows], schema)
    for number, b in enumerate(batches):
        one.step()(frame(b), number)
        if number == 1:
            one.step()(frame(b), number)  # comes again after a failure
            one.events.merge(spark, number)
    same_mart(spark, one, spark.createDataFrame(end_state(changes), EVENT))


def test_a_stream_of_files_and_its_restart(spark, tmp_path):
    whole = activity(spark, FOLDER).orderBy("ts").limit(200)
    source, folder = str(tmp_path / "in"), str(tmp_path / "mart")
    parts = live.as_changes(whole).randomSplit([1.0, 1.0], 3)
    one = live.LiveMart(folder, slots=1, key_slots=1)

    def run():
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(one.step()).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()

    parts[0].coalesce(1).write.mode("append").parquet(source)
    run()
    parts[1].coalesce(1).write.mode("append").parquet(source)
    live.as_changes(whole.filter("event_class = 'other'"), "delete").coalesce(1).write.mode("append").parquet(source)
    shutil.rmtree(f"{folder}/offsets/commits")  # the first batch runs again: nothing doubles
    run()
    same_mart(spark, one, whole.filter("event_class <> 'other'"))
