import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from watchwell.operators import baseline, browse, mart, store

EVENTS = "event_id string, ts timestamp, event_class string, user_key string, client_ip_key string, relying_party string, weight long, source_name string, is_consistent boolean"
ALERTS = "alert_id string, source_name string, rule_id string, user_key string, client_ip_key string, first_seen timestamp, last_seen timestamp, relying_parties string, severity string, risk_score int, investigation_status string"
T = datetime(2026, 3, 21, 15)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def event(i, ts, w=1, user="u", ip="ip", service="svc", kind="failure", ok=True):
    return (str(i), ts, kind, user, ip, service, w, "demo", ok)


def alert(spark, *rows):
    return spark.createDataFrame(rows, ALERTS)


def test_changes_equal_a_mart_made_anew(spark):
    rng = random.Random(1)
    make = lambda i: event(i, T + timedelta(minutes=rng.randint(0, 3000)), rng.randint(1, 4), f"u{rng.randint(0, 3)}", rng.choice(["", "ip1", "ip2"]), rng.choice(["a", "b", ""]), rng.choice(["success", "failure", "lockout"]), rng.random() > 0.1)
    old = [make(i) for i in range(200)]
    gone, new = set(rng.sample(range(200), 90)), [make(i) for i in range(200, 240)]
    changes = [(*old[i], -1) for i in gone] + [(*e, 1) for e in new]
    cdf = spark.createDataFrame(changes, EVENTS + ", sign int")
    buckets, refs = mart.apply_changes(mart.buckets(events(spark, old)), mart.entities(events(spark, old)), cdf)
    now = events(spark, [e for i, e in enumerate(old) if i not in gone] + new)
    want, want_refs = mart.buckets(now), mart.entities(now)
    assert sorted(map(str, buckets.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, refs.select(*want_refs.columns).collect())) == sorted(map(str, want_refs.collect()))


def test_minutes_take_late_rows(spark):
    rows = [event(1, T, 2), event(2, T + timedelta(seconds=70), kind="lockout", w=2), event(3, T + timedelta(seconds=20), 2), event(4, T, ok=False), event(5, T, service="")]
    got = {r.minute: (r.total_events, r.lockout_count) for r in mart.minutes(events(spark, rows)).collect()}
    assert got == {T: (4, 0), T + timedelta(minutes=1): (2, 2)}


def test_oscillation_of_a_day(spark):
    day = lambda d, w: event(d, datetime(2026, 3, d, 15), w)
    rows = [day(14, 10), day(15, 10), day(16, 10), day(20, 15), day(21, 30), day(22, 1000)]
    found = alert(spark, ("a", "demo", "r", "u", "ip", datetime(2026, 3, 20, 12), datetime(2026, 3, 21, 12), "svc", "high", 70, "new"))
    (r,) = mart.oscillations(mart.buckets(events(spark, rows)), found, "svc", "2026-03-21 00:00:00", "2026-03-22 00:00:00", "day", ("2026-03-14", "2026-03-16"), 1, 1).collect()
    assert (r.previous_events, r.change_percent, r.baseline_samples, r.expected_events, r.deviation_percent, r.alerts) == (15, 100.0, 3, 10.0, 200.0, 1)
    with pytest.raises(Exception, match="too long"):
        mart.oscillations(mart.buckets(events(spark, rows)), found, "svc", "2026-01-01 00:00:00", "2026-03-22 00:00:00", "day", ("2026-03-14", "2026-03-16"), 1, 1).collect()


def test_overview_keeps_services_with_alerts_alone(spark):
    rows = [event(1, T, service="a"), event(2, T, service="b")]
    found = alert(spark, ("x", "demo", "r", "u", "", T, T, "c;a", "critical", 90, "new"), ("y", "demo", "r", "u", "", T, T, "c", "high", 70, "resolved"))
    got = {r.relying_party: (r.total_events, r.alerts, r.open_alerts, r.critical_alerts) for r in mart.overview(mart.buckets(events(spark, rows)), found, "2026-03-21 00:00:00", "2026-03-22 00:00:00", "day").collect()}
    assert got == {"a": (1, 1, 1, 1), "b": (1, 0, 0, 0), "c": (None, 2, 1, 1)}


def test_choices(spark):
    none = spark.createDataFrame([], "relying_party string")
    assert [r[0] for r in mart.choices(none, none, "-").collect()] == ["-"]


def test_acceptance(spark):
    kept = alert(spark, ("a1", "demo", "r", "u", "", T, T, "", "high", 70, "new")).select("alert_id", "source_name", "rule_id", "user_key", "client_ip_key", "last_seen")
    at = lambda i, m, rule="r": (i, "", rule, "u", "", T + timedelta(minutes=m), T + timedelta(minutes=m), "", "high", 70, "new")
    new = alert(spark, at("a1", 0), at("a2", 5), at("a3", 20), at("a4", 30), at("a5", 36), at("a6", -90), at("b1", 1, "free"), at("b2", 2, "free"))
    got = {r.alert_id: r.outcome for r in store.accept(new, kept, {"r": 15}, "demo").collect()}
    assert got == {"a1": "duplicate_alert", "a2": "persistent_cooldown", "a3": "created", "a4": "persistent_cooldown", "a5": "created", "a6": "persistent_cooldown", "b1": "created", "b2": "created"}
    other = store.accept(alert(spark, at("a1", 0)), kept, {"r": 15}, "file").collect()
    assert [(r.outcome, r.alert_id != "a1") for r in other] == [("created", True)]
    back = alert(spark, at("c1", 9), at("c2", 4)).withColumn("first_seen", F.when(F.col("alert_id") == "c1", F.col("first_seen") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("first_seen")))
    assert {r.outcome for r in store.accept(back, kept.limit(0), {"r": 0}, "demo").collect()} == {"created"}
    assert sorted(r.outcome for r in store.accept(back, kept.limit(0), {"r": 0}, "demo", simulate=True).collect()) == ["created", "persistent_cooldown"]


def test_status_log(spark):
    known = alert(spark, ("a", "demo", "r", "u", "", T, T, "", "high", 70, "new"))
    steps = [("a", "new", 1), ("a", "investigating", 2), ("a", "investigating", 3), ("a", "what", 4), ("a", "resolved", 5), ("z", "resolved", 6)]
    changes = spark.createDataFrame([(i, s, T + timedelta(minutes=m)) for i, s, m in steps], "alert_id string, new_status string, changed_at timestamp")
    log = store.transitions(changes, known)
    assert sorted((r.old_status, r.new_status) for r in log.collect()) == [("investigating", "resolved"), ("new", "investigating")]
    assert store.current_status(log, known.drop("investigation_status")).first().investigation_status == "resolved"


@pytest.mark.parametrize("down", [True, False])
def test_pages_forward_and_back_hold_every_row_once(spark, down):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), f"k{i:02}") for i in range(23)]
    df = spark.createDataFrame(rows, "score int, id string").cache()
    want = sorted(rows, reverse=down)
    seen, anchor, firsts = [], None, []
    while True:
        page, state = browse.page(df, ("score", "id"), down, 5, anchor)
        got, flags = [tuple(r) for r in page.collect()], state.first()
        seen += got
        firsts.append(got)
        assert flags.has_previous == (anchor is not None)
        if not flags.has_next:
            break
        anchor = got[-1]
    assert seen == want
    page, state = browse.page(df, ("score", "id"), down, 5, firsts[2][0], backwards=True)
    assert [tuple(r) for r in page.collect()] == firsts[1]
    assert tuple(state.first()) == (True, True)


def test_baseline_of_seven_days(spark):
    rows = []
    for d in range(8):
        user, ip = ("usr_training", "ip_known") if d < 7 else ("usr_evaluation", "ip_evaluation")
        for h, kind in ((9, "success"), (10, "failure")):
            rows.append(event(f"{d}{h}", datetime(2026, 3, 14 + d, h), user=user, ip=ip, kind=kind))
    config = baseline.BaselineConfig(minimum_events_per_day=1, minimum_active_hours=1, minimum_user_history=5, training_start="2026-03-14", training_end="2026-03-20", evaluation_start="2026-03-21")
    local = baseline.localized(events(spark, rows))
    train = baseline.require_days(baseline.training(local, config))
    one = baseline.summary(local, train, config).first()
    assert (one.baseline_days, one.baseline_events, one.evaluation_events, one.success_count, one.failure_count) == (7, 14, 2, 7, 7)
    assert [r[0] for r in baseline.context(train, config)["users"].collect()] == ["usr_training"]
    hours = {r.hour_local: (r.days_with_data, r.median_events_per_day, r.p95_events_per_day, r.coverage_status) for r in baseline.hourly(train).collect()}
    assert len(hours) == 24 and hours[4] == (7, 1.0, 1, "observed") and hours[0] == (0, 0.0, 0, "unobserved")
    with pytest.raises(ValueError):
        baseline.require_days(baseline.training(local, baseline.BaselineConfig()))


def test_nearest_rank(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],), ([7],)], "v array<long>")
    assert [r[0] for r in df.select(baseline.nearest_rank(F.col("v"), 0.95)).collect()] == [5, 0, 7]
    values = spark.createDataFrame([(x,) for x in (5, 1, 1, 2, 9, 9, None)], "x long")
    r = baseline.ranked_values(values, "x", {"p50": 0.5, "p95": 0.95}).first()
    want = sorted([5, 1, 1, 2, 9, 9])
    assert (r.p50, r.p95, r.max) == (want[round(5 * 0.5)], want[round(5 * 0.95)], 9)


def test_counts_around_alerts_equal_all_pairs(spark):
    """Ties at both ends, windows over hours, an address with most rows; no rows of alerts times events."""
    import random
    from datetime import datetime, timedelta

    from watchwell.operators import reports

    chance, start = random.Random(4), datetime(2026, 3, 21, 10)
    at = lambda: start + timedelta(minutes=chance.choice([0, 10, 59, 60, 61, 90, 119, 120, 180, 200, 400]))
    events = [(f"e{i}", at(), chance.choice(["success", "failure", "lockout", "other"]), chance.choice(["", "a", "b", "c"]), chance.choice(["x", "x", "x", "y", ""]), chance.randint(1, 3), chance.random() < 0.9) for i in range(150)]
    alerts = [(f"a{i}", *sorted((at(), at())), chance.choice(["x", "y", "z", ""])) for i in range(25)]
    given = spark.createDataFrame(events, "event_id string, ts timestamp, event_class string, user_key string, client_ip_key string, weight long, is_consistent boolean")
    asked = spark.createDataFrame(alerts, "alert_id string, first_seen timestamp, last_seen timestamp, client_ip_key string")
    for before, after in ((60, 30), (10, 0), (0, 1)):
        found = reports.entity_counts(asked, given, "client_ip_key", before, after)
        want = []
        for i, lo, hi, ip in alerts:
            near = [e for e in events if e[6] and ip and e[4] == ip and lo - timedelta(minutes=before) <= e[1] <= hi + timedelta(minutes=after)]
            if near:
                of = lambda k: sum(e[5] for e in near if e[2] == k)  # noqa: B023, E731
                want.append((i, ip, len(near), sum(e[5] for e in near), of("failure"), of("success"), of("lockout"), len({e[3] for e in near} - {""})))
        columns = ["alert_id", "client_ip_key", "records", "events", "failures", "successes", "lockouts", "distinct_users"]
        assert sorted(tuple(r) for r in found.select(columns).collect()) == sorted(want)


def test_newest_around_alerts_equal_all_pairs(spark):
    """Windows of minutes and of weeks, ties in time, equal rows; ranges of distinct names; no join of alerts with events."""
    import random
    from datetime import datetime, timedelta

    from watchwell.operators import around, reports

    chance, start = random.Random(8), datetime(2026, 3, 21, 10)
    at = lambda: start + timedelta(minutes=chance.choice([0, 1, 60, 479, 480, 481, 700, 4000, 9000, 40000]))
    events = [(f"e{i % 150}", at(), chance.choice(["success", "failure"]), chance.choice(["", "a", "b", None]), chance.choice(["x", "x", "y", ""]), 1, chance.random() < 0.9) for i in range(200)]
    events += events[:40]
    alerts = [(f"a{i}", *sorted((at(), at())), chance.choice(["x", "y", "z", ""])) for i in range(25)]
    given = spark.createDataFrame(events, "event_id string, ts timestamp, event_class string, user_key string, client_ip_key string, weight long, is_consistent boolean")
    asked = spark.createDataFrame(alerts, "alert_id string, first_seen timestamp, last_seen timestamp, client_ip_key string")
    near = {i: [e for e in events if e[6] and ip and e[4] == ip and lo - timedelta(minutes=60) <= e[1] <= hi + timedelta(minutes=30)] for i, lo, hi, ip in alerts}
    for once in (False, True):
        found = around.newest(around.windows(asked, "client_ip_key", 60, 30), given.filter("is_consistent"), "client_ip_key", 6, once)
        want = [(i, n + 1, e[0], e[1]) for i, rows in near.items() for n, e in enumerate(sorted(set(rows) if once else rows, key=lambda e: (start - e[1], e[0]))[:6])]
        assert sorted((r.alert_id, r.nth, r.event_id, r.ts) for r in found.collect()) == sorted(want)
    found = reports.entity_counts(asked, given, "client_ip_key", 60, 30)
    assert {r.alert_id: (r.records, r.distinct_users) for r in found.collect()} == {i: (len(rows), len({e[3] for e in rows} - {"", None})) for i, rows in near.items() if rows}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("Join LeftSemi") + 1  # of events with the few levels, and with the slices that are asked for


def test_context_equals_all_pairs(spark):
    """Busy addresses, equal rows, evidence inside and outside of the newest; windows of addresses are cut before they meet the alert."""
    import random
    from datetime import datetime, timedelta

    from watchwell.operators import reports

    chance, start = random.Random(5), datetime(2026, 3, 21, 10)
    at = lambda: start + timedelta(minutes=chance.choice([0, 1, 2, 60, 90, 480, 500, 1400]))
    events = [(f"e{i:03}", at(), chance.choice(["success", "failure"]), chance.choice(["", "a", "b", "c"]), chance.choice(["x", "x", "x", "y", "z", ""]), 1, True) for i in range(120)]
    alerts = [(f"a{i:02}", *sorted((at(), at())), chance.choice(["a", "b", ""]), chance.choice(["x", "y", ""]), ";".join(e[0] for e in chance.sample(events, 3))) for i in range(20)]
    given = spark.createDataFrame(events + events[:30], "event_id string, ts timestamp, event_class string, user_key string, client_ip_key string, weight long, is_consistent boolean")
    asked = spark.createDataFrame(alerts, "alert_id string, first_seen timestamp, last_seen timestamp, user_key string, client_ip_key string, evidence_event_ids string")
    want = []
    for i, lo, hi, user, ip, ids in alerts:
        named = [e for e in events if e[0] in ids.split(";")]
        ips = [x for x in (ip, *sorted({e[4] for e in named} - {ip})) if x]
        near = [e for e in events if lo - timedelta(minutes=60) <= e[1] <= hi + timedelta(minutes=30) and ((user and e[3] == user) or e[4] in ips[:2])]
        found = sorted(named, key=lambda e: (start - e[1], e[0])) + sorted(set(near) - set(named), key=lambda e: (start - e[1], e[0]))
        kept = found[:8]
        after = [e[0] for e in kept if e[2] == "success" and e[3] and e[4] and any(y[2] == "failure" and y[3:5] == e[3:5] and (y[1], y[0]) < (e[1], e[0]) for y in kept)]
        others = {e[3] for e in kept if e[4] in ips[:2]} - {"", user}
        want.append((i, len(kept), ";".join(sorted(after)), ";".join(sorted(others)), len(ips), len(found) > 8 or len(ips) > 2))
    found = reports.context(asked, given, 60, 30, 8, 2)
    assert sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert " <= hi#" not in plan  # no range of instants is a condition of a join
