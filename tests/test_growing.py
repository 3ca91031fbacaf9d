"""Alerts that grow range by range equal those of one whole run."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

from watchwell.operators import detect
from watchwell.operators.rules import Exclusions, RuleSet
from watchwell.streaming.growing import GrowingAlerts

SCHEMA = "event_id string, ts timestamp, event_class string, user_key string, client_ip_key string, relying_party string, weight long, source_name string, is_consistent boolean"
T = datetime(2026, 3, 21)
RULES = replace(RuleSet(), brute_force=replace(RuleSet().brute_force, minimum=3, window_minutes=180, cooldown_minutes=500), lockout=replace(RuleSet().lockout, minimum=2, window_minutes=240, cooldown_minutes=2000), spray=replace(RuleSet().spray, minimum=4, minimum_users=2, window_minutes=200), new_ip=replace(RuleSet().new_ip, window_minutes=300), success_after=replace(RuleSet().success_after, minimum=2, window_minutes=200))
BOUNDS = ["2026-03-21 00:00:00", "2026-03-22 00:00:00", "2026-03-23 00:00:00", "2026-03-24 00:00:00"]


def events(n=260, first=0):
    chance = random.Random(first)
    return [(f"e{first + i:04}", T + timedelta(minutes=chance.randint(0, 3 * 24 * 60 - 1)), chance.choice(["failure", "failure", "success", "lockout"]), f"u{chance.randint(0, 3)}", f"ip{chance.randint(0, 2)}", "s", chance.randint(1, 2), "demo", True) for i in range(n)]


def test_range_by_range_equals_one_run_and_reads_only_what_it_needs(spark, tmp_path):
    rows = events()
    users, known = spark.createDataFrame([("u0",), ("u1",)], "user_key string"), spark.createDataFrame([("u0", "ip0")], "user_key string, client_ip_key string")
    baseline, lists = (users, known, "2026-03-20"), Exclusions(user_keys=("u2",), thresholds={"failures_per_user": 5})
    folder = str(tmp_path / "events")
    spark.createDataFrame(rows, SCHEMA).write.parquet(folder)
    table = GrowingAlerts(str(tmp_path / "alerts"), RULES, baseline, lists)
    table.refresh(spark.read.parquet(folder), BOUNDS)
    plain = lambda df: sorted(map(str, df.drop("part").collect()))
    whole = lambda given: detect.detect(spark.createDataFrame(given, SCHEMA), RULES, baseline, lists)
    assert plain(table.alerts(spark)) == plain(whole(rows))
    assert {r.rule_id for r in table.alerts(spark).collect()} == {r.rule_id for r in RULES.all()}
    table.add(spark.read.parquet(folder), BOUNDS[2], BOUNDS[3], BOUNDS[1])  # once more
    assert plain(table.alerts(spark)) == plain(whole(rows))

    # Late events of the second day: only it and the third are searched again.
    late = [r for r in events(60, 1000) if "2026-03-22" <= str(r[1]) < "2026-03-23"]
    spark.createDataFrame(late, SCHEMA).write.mode("append").parquet(folder)
    first = lambda: plain(table.alerts(spark).filter("part LIKE '2026-03-21%'"))
    before = first()
    table.refresh(spark.read.parquet(folder), BOUNDS, since=str(min(r[1] for r in late)))
    assert first() == before
    # Without reading what lies a window or more before the range.
    table.add(spark.read.parquet(folder).filter("ts >= '2026-03-22 19:00:00'"), BOUNDS[2], BOUNDS[3], BOUNDS[1])
    assert plain(table.alerts(spark)) == plain(whole(rows + late))
    assert spark.read.parquet(f"{tmp_path}/alerts/last").count() > 0


def test_a_last_hit_inside_the_first_block_holds_into_the_next(spark):
    """The hit kept before a range may lie in the block of the range's first hits, a cooldown and more after the block's begin."""
    gap, block = 60_000_000, 16 * 60_000_000
    rows, last = [("a", True, int(2.1 * gap), 0), ("a", True, int(15.5 * gap), 1), ("a", True, block + gap // 6, 2)], [("a", True, 2 * gap)]
    for i in range(40):
        chance = random.Random(i)
        begin = chance.randrange(block)
        rows += [(f"u{i:02}", True, begin + t, n) for n, t in enumerate(sorted(chance.sample(range(3 * block), 30)))]
        last.append((f"u{i:02}", True, begin - chance.randrange(gap)))
    hits, known = spark.createDataFrame(rows, "user_key string, authorized boolean, us long, at long"), spark.createDataFrame(last, "user_key string, authorized boolean, last_us long")
    want, kept = [], {k: us for k, _, us in last}
    for k, auth, us, n in rows:
        if us - kept[k] >= gap:
            kept[k] = us
            want.append((k, auth, us, n))
    assert sorted(map(tuple, detect.cooled(hits, ["user_key", "authorized"], 1, known).collect())) == want
