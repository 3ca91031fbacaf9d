import hashlib
import json
import random
from collections import deque
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from watchwell.operators import detect
from watchwell.operators.rules import Exclusions, RuleSet

SCHEMA = "event_id string, ts timestamp, event_class string, user_key string, client_ip_key string, relying_party string, weight long"
START = datetime(2026, 3, 21, 15, 0)  # 10:00 in the rules' zone


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def minute(i, kind, user, ip, m):
    return (str(i), START + timedelta(minutes=m), kind, user, ip, "app", 1)


def golden():
    who = [("failure", "usr_a", "ip_x")] * 3 + [("failure", "usr_b", "ip_x"), ("failure", "usr_c", "ip_x"), ("success", "usr_a", "ip_x"), ("lockout", "usr_d", "ip_y"), ("lockout", "usr_d", "ip_y")]
    return [minute(i + 1, *w, i) for i, w in enumerate(who)]


def low_rules():
    d = RuleSet()
    return replace(d, brute_force=replace(d.brute_force, minimum=3), spray=replace(d.spray, minimum=3), success_after=replace(d.success_after, minimum=2))


def test_golden_alerts(spark):
    users = spark.createDataFrame([("usr_a",)], "user_key string")
    known = spark.createDataFrame([("usr_a", "ip_known")], "user_key string, client_ip_key string")
    found = detect.detect(frame(spark, golden()), low_rules(), (users, known, "2026-03-20")).collect()
    got = {(r.rule_id, r.severity, r.risk_score, r.event_count) for r in found}
    assert got == {
        ("AUTH_BRUTE_FORCE_USER", "high", 65, 3),
        ("AUTH_NEW_IP_FOR_USER", "medium", 40, 3),
        ("AUTH_PASSWORD_SPRAY_IP", "high", 72, 5),
        ("AUTH_SUCCESS_AFTER_FAILURES", "high", 81, 4),
        ("AUTH_ACCOUNT_LOCKOUT", "critical", 85, 2),
    }
    ordered = sorted(found, key=lambda r: (r.first_seen_local, r.rule_id))
    said = json.dumps([{c: r[c] for c in detect.ALERT_COLUMNS} for r in ordered], sort_keys=True, separators=(",", ":"))
    assert hashlib.sha256(said.encode()).hexdigest() == "90d253eca6e21d93c266e7f358b682ec34dc9d720daabf08cf5c2772a6b4a1bf"
    assert {r.first_seen_local for r in found if r.rule_id == "AUTH_BRUTE_FORCE_USER"} == {"2026-03-21T10:00:00-05:00"}


def deque_hits(rows, minutes, minimum, cooldown):
    """The rule event by event, in Python."""
    hits, windows, last = [], {}, {}
    for i, ts, kind, user, *_, w in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind != "failure":
            continue
        q = windows.setdefault(user, deque())
        q.append((ts, w))
        while q[0][0] < ts - timedelta(minutes=minutes):
            q.popleft()
        total = sum(x[1] for x in q)
        if total >= minimum and (user not in last or ts - last[user] >= timedelta(minutes=cooldown)):
            last[user] = ts
            hits.append((user, ts, total))
    return sorted(hits)


@pytest.mark.parametrize("seed", range(3))
def test_windows_and_cooldown_match_event_by_event_with_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(f"e{i:04}", START + timedelta(minutes=rng.randint(0, 90)), rng.choice(["failure", "failure", "success"]), f"u{rng.randint(0, 2)}", "ip", "app", rng.randint(1, 3)) for i in range(150)]
    rules = replace(RuleSet(), brute_force=replace(RuleSet().brute_force, minimum=7))
    got = detect.brute_force(frame(spark, rows), rules).select("user_key", "last_seen", "event_count").collect()
    assert sorted(map(tuple, got)) == deque_hits(rows, 10, 7, 15)


def test_authorized_events_have_windows_and_thresholds_of_their_own(spark):
    rows = [minute(i, "failure", "usr_ok", "ip", i) for i in range(8)]
    lists = Exclusions(user_keys=("usr_ok",), thresholds={"failures_per_user": 8})
    assert detect.brute_force(frame(spark, rows[:6]), RuleSet(), lists).count() == 0
    (one,) = detect.brute_force(frame(spark, rows), RuleSet(), lists).collect()
    assert (one.event_count, "autorizada" in one.description) == (8, True)


def test_thresholds(spark):
    lock = [minute(i, "lockout", "u", "ip", i) for i in range(2)]
    assert detect.lockouts(frame(spark, lock[:1]), RuleSet()).count() == 0
    assert detect.lockouts(frame(spark, lock), RuleSet()).select("severity").first()[0] == "critical"
    scattered = [minute(i, "failure", f"u{i}", f"ip{i}", i) for i in range(10)]
    assert detect.detect(frame(spark, scattered), RuleSet()).count() == 0
    assert detect.detect(frame(spark, []), RuleSet()).count() == 0


def test_summary(spark):
    found = spark.createDataFrame([("r1", "high", 70), ("r1", "low", 30), ("r2", "high", 66)], "rule_id string, severity string, risk_score int")
    got = {(r.rule_id, r.severity): (r.alerts, r.mean_score) for r in detect.summary(found).collect()}
    assert got == {("r1", None): (2, 50.0), ("r2", None): (1, 66.0), (None, "high"): (2, 68.0), (None, "low"): (1, 30.0), (None, None): (3, 55.33)}


def test_severity_bounds(spark):
    rows = spark.createDataFrame([(0,), (39,), (40,), (64,), (65,), (84,), (85,)], "s int")
    got = [r[0] for r in rows.orderBy("s").select(detect.severity(F.col("s"), RuleSet())).collect()]
    assert got == ["low", "low", "medium", "medium", "high", "high", "critical"]


def test_any_number_of_events_at_one_instant(spark):
    rows = [(f"e{i:05}", START + timedelta(minutes=20 * (i >= 1500)), "failure", f"u{i % 7}", "ip", "app", 1) for i in range(3001)]
    rules = replace(RuleSet(), brute_force=replace(RuleSet().brute_force, minimum=200))
    got = detect.brute_force(frame(spark, rows), rules).select("user_key", "last_seen", "event_count").collect()
    assert sorted(map(tuple, got)) == deque_hits(rows, 10, 200, 15)
    one = [(i, t, k, "u", ip, a, w) for i, t, k, _, ip, a, w in rows]
    rules = replace(rules, brute_force=replace(rules.brute_force, minimum=1400))
    got = detect.brute_force(frame(spark, one), rules).select("user_key", "last_seen", "event_count").collect()
    assert sorted(map(tuple, got)) == deque_hits(one, 10, 1400, 15)
    assert [r.event_count for r in detect.password_spray(frame(spark, rows), rules).orderBy("last_seen").collect()] == [6, 6]


def test_cooldown_holds_no_list_of_a_keys_hits(spark):
    rng = random.Random(9)
    rows = [(f"u{rng.randint(0, 1)}", True, rng.randint(0, 400) * 1_000_000, i) for i in range(5000)]
    hits = spark.createDataFrame(rows, "user_key string, authorized boolean, us long, at long").repartition(3)
    out = detect.cooled(hits, ["user_key", "authorized"], 1)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = sorted((r.user_key, r.us, r.at) for r in out.collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], {}
    for u, _, us, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if u not in last or us - last[u] >= 60_000_000:
            last[u] = us
            want.append((u, us, i))
    assert got == sorted(want)


def test_evidence_ids_services_and_users_are_bounded(spark):
    rows = [(f"e{i:03}" if i % 3 else "", START + timedelta(seconds=i), "failure", f"u{i % 40}", "ip", f"app{i % 12:02}", 1) for i in range(60)]
    rules = replace(RuleSet(), spray=replace(RuleSet().spray, minimum=60))
    (r,) = detect.password_spray(frame(spark, rows), rules).collect()
    assert (r.user_key, r.client_ip_key, r.distinct_users, r.distinct_client_ips) == ("", "ip", 40, 1)
    assert r.evidence_event_ids.split(";") == [f"e{i:03}" for i in range(16) if i % 3][:10]
    assert r.relying_parties.split(";") == [f"app{i:02}" for i in range(8)]
    assert "collect_set(CASE WHEN NOT (user_key" not in detect.password_spray(frame(spark, rows), rules)._jdf.queryExecution().toString()


def test_distinct_values_of_trailing_windows_in_linear_rows(spark):
    """One busy address, ties in time, values that go and come back; no pair of events is made."""
    chance, start = random.Random(9), datetime(2026, 3, 21, 15)
    rows = [(f"e{i:03}", start + timedelta(minutes=chance.choice([0, 1, 7, 19, 20, 21, 22, 40, 41, 60, 61, 90, 91, 130])), "failure", chance.choice(["", "a", "b", "c", "d"]), "ip", "s", 1, "demo", True) for i in range(60)]
    given = spark.createDataFrame(rows, "event_id string, ts timestamp, event_class string, user_key string, client_ip_key string, relying_party string, weight long, source_name string, is_consistent boolean")
    for minutes in (20, 45):
        marked = detect.sliced(given, ["client_ip_key"], minutes)
        found = detect.trailing_distinct(marked, ["client_ip_key"], "user_key", minutes, "n").filter("home")
        order = sorted(rows, key=lambda r: (r[1], r[0]))
        want = {r[0]: len({x[3] for x in order[: i + 1] if x[3] and x[1] >= r[1] - timedelta(minutes=minutes)}) for i, r in enumerate(order)}
        assert {r.event_id: r.n for r in found.collect()} == want
    plan = detect.password_spray(given, RuleSet())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of the few hits with their evidence


def test_cooldown_of_a_busy_key_is_worked_on_in_blocks(spark):
    """Random and regular times, one key with most hits, hits kept before; as one fold from the first hit on."""
    chance = random.Random(12)
    for minutes, step in ((1, 7), (15, 60), (3, 180)):
        rows = []
        for key, n in (("busy", 1500), ("b", 40), ("c", 1), ("regular", 700)):
            at = -500_000_000
            for i in range(n):
                at += step * 1_000_000 if key == "regular" else chance.choice([0, 1, 40, 400, 4000]) * chance.randrange(200_000)
                rows.append((key, chance.random() < 0.5 if key == "b" else False, at, i))
        hits = spark.createDataFrame(rows, "user_key string, authorized boolean, us long, at long").repartition(5)
        for last in ({}, {("busy", False): -500_000_000 + 30_000_000, ("c", False): -10**15}):
            given = spark.createDataFrame([(*k, v) for k, v in last.items()], "user_key string, authorized boolean, last_us long")
            found = detect.cooled(hits, ["user_key", "authorized"], minutes, given if last else None)
            want, kept = [], dict(last)
            for key, auth, at, i in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
                before = kept.get((key, auth))
                if before is None or at - before >= minutes * 60_000_000:
                    kept[key, auth] = at
                    want.append((key, auth, at, i))
            assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or "AdaptiveSparkPlan" in plan


def test_small_blocks_are_searched_together(spark):
    """What a task makes of its blocks is some tables, not one a block; the blocks come out as one by one."""
    chance, gap = random.Random(3), 60_000_000
    rows = [(f"u{k:04}", False, b * gap * 16 + at, at) for k in range(900) for b in (-2, 0, 1) for at in sorted(chance.sample(range(gap * 16), chance.choice([1, 2, 9])))]
    frames = [pd.DataFrame(rows[i : i + 1000], columns=["user_key", "authorized", "us", "at"]) for i in range(0, len(rows), 1000)]
    frames = [f.assign(block=f["us"] // (gap * 16)) for f in frames]
    made = list(detect._groups(iter(frames), ["user_key", "authorized", "block"]))
    assert len(made) <= 2 * len(frames)
    got = [(*k, us) for keyed, sizes, times in made for k, us in zip(keyed.itertuples(index=False, name=None), np.split(times, np.cumsum(sizes)[:-1]), strict=True)]
    want = {}
    for u, auth, us, _ in rows:
        want.setdefault((u, auth, us // (gap * 16)), []).append(us)
    assert [(*k, us.tolist()) for *k, us in got] == [(*k, v) for k, v in want.items()]
    hits = spark.createDataFrame(rows, "user_key string, authorized boolean, us long, at long")
    for minutes in (1, 2):
        kept, last = [], {}
        for u, auth, us, at in rows:
            if u not in last or us - last[u] >= minutes * gap:
                last[u] = us
                kept.append((u, auth, us, at))
        assert sorted(map(tuple, detect.cooled(hits, ["user_key", "authorized"], minutes).collect())) == sorted(kept)


def test_evidence_of_keys_that_batches_cut(spark):
    """Windows of many keys, worked on together and cut by Arrow batches, hold what a plain scan finds; events are not paired with hits."""
    chance = random.Random(4)
    rows = [(f"e{i:04}" if i % 9 else "", START + timedelta(seconds=chance.randrange(3000), microseconds=i), "failure", f"u{chance.randrange(6)}", chance.choice(["", "a", "b"]), f"app{chance.randrange(11):02}", 1 + i % 2) for i in range(500)]
    rules = replace(RuleSet(), brute_force=replace(RuleSet().brute_force, cooldown_minutes=0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    found = detect.brute_force(frame(spark, rows), rules)
    assert "Join Inner" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.user_key, r.last_seen, r.first_seen, r.event_count, r.distinct_client_ips, r.client_ip_key, r.relying_parties, r.evidence_event_ids) for r in found.collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for _, t, _, u, *_ in rows:
        near = sorted((r for r in rows if r[3] == u and t - timedelta(minutes=10) <= r[1] <= t), key=lambda r: (r[1], r[0]))
        if sum(r[6] for r in near) >= 6:
            ips = {r[4] for r in near} - {""}
            apps, ids = sorted({r[5] for r in near})[:8], [r[0] for r in near if r[0]][:10]
            want.append((u, t, near[0][1], sum(r[6] for r in near), len(ips), "".join(ips) if len(ips) == 1 else "", ";".join(apps), ";".join(ids)))
    assert got == sorted(want)
