from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchwell.functions import text
from watchwell.operators import baseline, normalize
from watchwell.sources import raw

CONFIG = normalize.NormalizeConfig(b"secret")


def record(i, **cells):
    base = dict.fromkeys(raw.RAW_COLUMNS, "")
    base |= {
        "id": str(i), "event_name": "Fresh Credential Validation Error", "log_source": "ADFS_TEST", "event_count": "1", "event_time": "2026-03-16 10:00:00 +00:00",
        "created_at": "2026-03-16 10:01:00 +00:00", "event_id": str(i), "custom_user_id": "CORP\\real-user", "custom_ip_address": "203.0.113.10",
        "custom_relying_party": "urn:test", "event_type_id": "1203",
    }
    return base | cells


def line(r):
    return ",".join('"' + r[c].replace('"', '""') + '"' for c in raw.RAW_COLUMNS)


def judged(spark, records):
    rows = spark.createDataFrame([(*(r[c] for c in raw.RAW_COLUMNS), i) for i, r in enumerate(records)], ", ".join(f"{c} string" for c in raw.RAW_COLUMNS) + ", pos long")
    return normalize.judged(normalize.normalize(rows, CONFIG, ("pos",)), "pos", CONFIG)


def test_csv_scan_and_rejections(spark, tmp_path):
    lines = [line(record(1)), line(record(1)), line(record(2, custom_ip_address="bad")), line(record(3, event_time="never")), "lonely", "", line(record(4, custom_message='two\nlines, "quoted"'))]
    (tmp_path / "raw.csv").write_bytes("﻿".encode() + "\n".join(lines).encode())
    rows = raw.read_csv(spark, str(tmp_path / "raw.csv")).cache()
    assert normalize.malformed(rows).count() == 1
    good = raw.well_formed(rows)
    got = normalize.judged(normalize.normalize(good, CONFIG, ("pos",)), "pos", CONFIG)
    assert sorted((r.record_id, r.rejection_reason) for r in got.collect()) == [("1", ""), ("1", "DUPLICATE_EVENT"), ("2", "INVALID_CLIENT_IP"), ("3", "INVALID_EVENT_TIME"), ("4", "")]
    totals = {r.name: r.rows for r in normalize.statistics(got, 1).filter("measure = 'total'").collect()}
    assert totals == {"input": 6, "valid": 2, "rejected": 4, "duplicate": 1, "malformed": 1, "valid_with_warnings": 0}
    raw.write_outputs(got, normalize.statistics(got, 1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/valid")).count() == 2


def test_normalized_record(spark):
    import hashlib
    import hmac

    r = judged(spark, [record(99)]).first()
    key = lambda v, p: f"{p}_" + hmac.new(b"secret", v.encode(), hashlib.sha256).hexdigest()[:24]
    assert (r.user_key, r.client_ip_key, r.log_source_key) == (key("real-user", "usr"), key("203.0.113.10", "ip"), key("ADFS_TEST", "src"))
    assert (r.event_class, r.client_ip_version, r.client_ip_scope, r.event_count, r.quality_flags) == ("failure", 4, "private", 1, [])
    assert r.deduplication_key == "event:99"


def test_flags(spark):
    rows = [
        record(1, event_name="Application Token Success", event_type_id="1210", event_time="1970-01-01 00:00:00 +00:00"),
        record(2, custom_user_id=" ", custom_ip_address="not-an-ip", event_count="0", event_id="", custom_relying_party="N/A"),
        record(3, custom_user_id="real-user@corp.example", custom_ip_address="2001:DB8:0::1", event_time_origen="2026-03-16T09:00:00", created_at="2026-03-16 08:00:00 +00:00"),
    ]
    got = {r.record_id: r for r in judged(spark, rows).collect()}
    assert (got["1"].quality_flags, got["1"].event_class) == (["EVENT_TYPE_MISMATCH", "INVALID_EVENT_TIME"], "success")
    assert got["2"].quality_flags == ["MISSING_SOURCE_EVENT_ID", "MISSING_USER_ID", "INVALID_CLIENT_IP", "INVALID_EVENT_COUNT"]
    assert (got["2"].relying_party, got["2"].deduplication_key[:12]) == ("", "fingerprint:")
    assert (got["3"].quality_flags, got["3"].client_ip_version, got["3"].event_time_source) == (["CREATED_BEFORE_EVENT"], 6, "event_time_origen")
    assert got["3"].user_key == judged(spark, [record(1)]).first().user_key


def test_cursor_ties_and_numeric_order(spark):
    t = datetime(2026, 3, 16, 10)
    rows = spark.createDataFrame([("11", t), ("10", t), ("9", t), ("a", t), ("12", t + timedelta(minutes=1))], "event_id string, ts timestamp")
    first = raw.fetch_after(rows, None, 2).collect()
    assert [r.event_id for r in first] == ["9", "10"]
    assert [r.event_id for r in raw.fetch_after(rows, ("2026-03-16 10:00:00", "10"), 5).collect()] == ["11", "a", "12"]
    sample, cursor = raw.live_sample(rows, "2026-03-16", 2, "UTC")
    assert (sorted(r.event_id for r in sample.collect()), cursor.first().cursor_id) == (["12", "a"], "9")


def test_history_and_query_text(spark):
    rows = spark.createDataFrame([tuple(record(i, event_time=f"2026-03-1{i} 10:00:00 +00:00").values()) for i in range(5)], ", ".join(f"{c} string" for c in raw.RAW_COLUMNS))
    got = raw.history(rows, "2026-03-12 00:00:00", "2026-03-14 00:00:00", 24 * 60)
    assert (sorted(r.id for r in got.collect()), "custom_message" in got.columns) == (["1", "2", "3"], False)
    assert raw.keyset_query("t", ("2026-01-01", "o'x"), 5).endswith("FROM t WHERE (event_time, id) > ('2026-01-01', 'o''x') ORDER BY event_time, id LIMIT 5")


def test_address_forms(spark):
    from watchwell.functions import ip

    texts = ["8.8.8.8", "10.1.2.3", "192.0.0.9", "100.64.0.1", "256.1.1.1", "01.2.3.4", "1.2.3", "::1", "2001:4860:0:0::8888", "x:y", "", None, "172.32.0.1", "203.0.113.7"]
    import ipaddress

    def want(t):
        try:
            a = ipaddress.ip_address((t or "").strip())
        except ValueError:
            return None
        return a.compressed, a.version, "private" if a.is_private else "public", a.is_global

    got = ip.address(spark.createDataFrame([(t,) for t in texts], "a string"), "a").collect()
    assert {r.a: tuple(r.ip) if r.ip else None for r in got} == {t: want(t) for t in texts}
    assert F is not None


def test_alert_and_baseline_tables_are_read_back(spark, tmp_path):
    found = spark.createDataFrame([("a", "r", 5)], "alert_id string, rule_id string, risk_score int")
    raw.write_alerts(found, found.groupBy("rule_id").count(), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/alerts").collect() == found.collect()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/summary").collect()] == [("r", 1)]
    frames = {name: spark.createDataFrame([(name, 1)], "k string, n int") for name in ("users", "user_ips", "user_apps", "user_hours", "daily")}
    baseline.write(str(tmp_path / "baseline"), frames)
    back = baseline.load(spark, str(tmp_path / "baseline"))
    assert {name: [tuple(r) for r in df.collect()] for name, df in back.items()} == {name: [(name, 1)] for name in ("users", "user_ips", "user_apps", "user_hours")}


def test_zoned_instants(spark):
    rows = [("2026-03-16T10:00:00",), ("2026-03-16T10:00:00Z",), ("2026-03-16 10:00:00+02:00",), (" ",), ("never",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.zoned_instant(F.col("t"), "America/Guayaquil")).collect()]
    assert got == [datetime(2026, 3, 16, 15), datetime(2026, 3, 16, 10), datetime(2026, 3, 16, 8), None, None, None]


def test_values_at_ranks(spark):
    import statistics

    values = [((i * 7919) % 1000) / 8 for i in range(501)] + [3.0] * 40
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
    got = baseline.at_ranks(df, "v", {"first": lambda n: n * 0, "low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)}).first()
    assert (got.first, (got.low + got.high) / 2, got.max) == (min(values), statistics.median(values), max(values))
    assert baseline.at_ranks(df.limit(0), "v", {"low": lambda n: n}).first() == (None, None)


def test_csv_without_line_ends_in_fields(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("\n".join(line(record(i)) for i in range(50)))
    assert raw.read_csv(spark, str(tmp_path / "raw.csv"), line_ends_in_fields=False).drop("pos").collect() == raw.read_csv(spark, str(tmp_path / "raw.csv")).drop("pos").collect()


def test_addresses_equal_the_standard_library(spark):
    """Canonical form, version, scope and routability of many texts, right and wrong."""
    import ipaddress
    import random

    from watchwell.functions import ip

    chance = random.Random(6)
    starts = ["::", "::1", "64:ff9b:1::", "100::", "2001::", "2001:1::1", "2001:1::2", "2001:3::", "2001:4:112::", "2001:20::", "2001:30::", "2001:db8::", "2002::", "3fff::", "fc00::", "fe80::", "ff02::1", "2600::", "::ffff:0:0", "2001:200::", "64:ff9b::"]
    numbers = [max(0, min(2**128 - 1, int(ipaddress.IPv6Address(s)) + d)) for s in starts for d in (-1, 0, 1, 2**40, 2**90)]
    for _ in range(150):
        numbers.append(sum((chance.choice([0, 0, 0, 1, 0xFFFF, chance.randrange(65536)])) << (16 * k) for k in range(8)))
        numbers.append((0xFFFF << 32) + chance.choice([0x0A000001, 0x08080808, 0x64400001, chance.randrange(2**32)]))
    texts = ["", "1.2.3.4", "10.0.0.1", "01.2.3.4", "256.1.1.1", ":::", ":1", "1:", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "1:2:3:4:5:6:7:8::", "::12345", "::g", "FE80::1%eth0", "fe80::1%", "fe80::1%a%b", "1.2.3.4%x", "::1.2.3.4", "::1.2.3", "::ffff:01.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4:5", "1.2.3.4::", "::", "0:0:0:0:0:0:0:0", " ::1 ", "%eth0:1"]
    for n in numbers:
        a = ipaddress.IPv6Address(n)
        texts += [a.exploded.upper(), str(a), ":".join(f"{n >> (16 * k) & 0xFFFF:x}" for k in range(7, -1, -1))]

    def expected(t):
        try:
            a = ipaddress.ip_address(t.strip())
        except ValueError:
            return None
        return a.compressed, a.version, "private" if a.is_private else "public", a.is_global

    found = ip.address(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        assert (tuple(r.ip) if r.ip else None) == expected(texts[r.i]), texts[r.i]
