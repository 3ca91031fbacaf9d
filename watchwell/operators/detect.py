"""Detection rules over trailing windows, with cooldown and risk scores.

Every rule marks hits, thins them by a cooldown and turns what is left into alert
records. Windows are cut into slices as long as the window: each event is put into
its own slice and the next, and results are taken from its own. A frame never
spans more than two slices, so the result is exact while a busy key (a shared
address, say) is spread over many partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, NumericType, StringType, StructField, StructType

from watchwell.operators.rules import TEXTS, Exclusions, Rule, RuleSet
from watchwell.sources.auth import CLASSES, day_start, local

_EPOCH_US = 1_577_836_800_000_000  # 2020-01-01
#: Cooldowns of a block of time that is thinned by itself.
_GAPS = 16
#: Before any instant.
_NONE = -(2**62)

ALERT_COLUMNS = (
    "alert_id", "rule_id", "rule_name", "severity", "risk_score", "risk_factors", "status", "first_seen_local", "last_seen_local",
    "user_key", "client_ip_key", "event_types", "event_count", "success_count", "failure_count", "lockout_count", "distinct_users",
    "distinct_client_ips", "relying_parties", "evidence_event_ids", "description", "recommendation", "requires_human_review",
)


def authorized(exclusions: Exclusions | None) -> Column:
    """Whether an event's user, address or service is on a list of exclusions."""
    if exclusions is None:
        return F.lit(False)
    hit = F.lit(False)
    for column, keys in (("user_key", exclusions.user_keys), ("client_ip_key", exclusions.client_ip_keys), ("relying_party", exclusions.relying_parties)):
        if keys:
            hit = hit | (F.coalesce(F.col(column), F.lit("")).isin(*keys) & (F.col(column) != ""))
    return hit


def threshold(exclusions: Exclusions | None, name: str, default: int) -> Column:
    """The threshold of an event: raised where it is authorized (D3)."""
    raised = exclusions.threshold(name, default) if exclusions else default
    return F.when(F.col("authorized"), F.lit(raised)).otherwise(F.lit(default)).cast("long")


def evaluation(events: DataFrame, training_end: str | None, zone: str) -> DataFrame:
    """Events on local days after the training period."""
    if not training_end:
        return events
    return events.filter(F.col("ts") >= day_start(training_end, zone, 1))


def sliced(events: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """events, twice, with slice, home, the time ``us`` and the number ``at``.

    ``at`` counts the events of a key and slice in the order of (time, id), then of a
    hash of the row, so that it is the same wherever it is computed. The trailing window
    of an event holds those up to its ``at`` from the window's edge on, the edge included.
    """
    us = F.unix_micros("ts") - F.lit(_EPOCH_US)
    own = F.floor(us / F.lit(minutes * 60_000_000))
    twice = events.withColumn("us", us).withColumn("copy", F.explode(F.array(F.struct(own.alias("slice"), F.lit(True).alias("home")), F.struct((own + 1).alias("slice"), F.lit(False).alias("home")))))
    twice = twice.select("*", "copy.slice", "copy.home").drop("copy")
    return twice.withColumn("at", F.row_number().over(Window.partitionBy(*keys, "slice").orderBy("us", "event_id", F.xxhash64(*events.columns))).cast("long"))


def trailing_sum(value: Column, keys: list[str], minutes: int) -> Column:
    """The sum over the trailing window: all up to an event, less all before its window."""
    part = Window.partitionBy(*keys, "slice")
    until = F.sum(value).over(part.orderBy("us", "at").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum(value).over(part.orderBy("us").rangeBetween(Window.unboundedPreceding, -minutes * 60_000_000 - 1))
    return until - F.coalesce(before, F.lit(0))


def trailing_distinct(rows: DataFrame, keys: list[str], value: str, minutes: int, name: str) -> DataFrame:
    """rows (sliced) with ``name``: how many values but "" the trailing window of each holds.

    A value comes in with its first event and goes out when the window has passed its
    last one. Sums of these steps in the order of time give the count: two rows of each
    event at most, and no event is ever paired with another.
    """
    span = minutes * 60_000_000
    of_value, there = Window.partitionBy(*keys, "slice", value).orderBy("at"), F.coalesce(F.col(value) != "", F.lit(False))
    came = there & F.coalesce(F.lag("us").over(of_value) < F.col("us") - span, F.lit(True))
    gone = there & F.coalesce(F.lead("us").over(of_value) > F.col("us") + span, F.lit(True))
    step = lambda t, is_event, n: F.struct(t.alias("_t"), F.lit(is_event).alias("_event"), n.cast("long").alias("_step"))
    steps = F.array_compact(F.array(step(F.col("us"), True, F.col("_came")), F.when(F.col("_gone"), step(F.col("us") + span + 1, False, F.lit(-1)))))
    stepped = rows.withColumns({"_came": came, "_gone": gone}).select(*rows.columns, F.inline(steps))
    count = F.sum("_step").over(Window.partitionBy(*keys, "slice").orderBy("_t", "_event", "at").rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn(name, count).filter("_event").drop("_t", "_event", "_step")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(keys, sizes, times) of many whole keys of sorted rows at a time; of a key that goes on only the times are held."""
    last, held = None, []
    for batch in batches:
        rows, us = batch[keys], batch["us"].to_numpy()
        if not len(us):
            continue
        begins = np.flatnonzero((rows != rows.shift()).any(axis=1).to_numpy())
        if last is not None and tuple(rows.iloc[0]) == tuple(last.iloc[0]):
            held.append(us[: begins[1] if len(begins) > 1 else len(us)])
            begins = begins[1:]
        if not len(begins):
            continue
        if last is not None:
            yield last, np.array([sum(map(len, held))]), np.concatenate(held)
        if len(begins) > 1:
            yield rows.iloc[begins[:-1]], np.diff(begins), us[begins[0] : begins[-1]]
        last, held = rows.iloc[begins[-1:]], [us[begins[-1] :]]
    if last is not None:
        yield last, np.array([sum(map(len, held))]), np.concatenate(held)


def cooled(hits: DataFrame, keys: list[str], minutes: int, last: DataFrame | None = None) -> DataFrame:
    """Of each key's hits those at least ``minutes`` after the last one kept.

    A key's time is cut into blocks of ``_GAPS`` cooldowns, which are worked on apart. Which
    hit a block keeps last depends only on which one it keeps first, and that is one of
    the cooldown from its first hit on or the next behind it, wherever in the block the
    one kept before lies; for these a block tells where they lead to, in ranges that
    lead to the same. One pass over the ranges of a key gives what was
    kept before each block, and each block then keeps its own. last: (keys, last_us),
    the hits kept before these.
    """
    gap, names, spread = minutes * 60_000_000, hits.columns, [*keys, "block"]
    if gap <= 0:
        return hits
    key_fields = [hits.schema[k] for k in keys] + [StructField("block", LongType())]
    # Both uses take all columns of these rows, so they are found and dealt out once.
    base = hits.withColumn("block", F.floor(F.col("us") / F.lit(gap * _GAPS))).repartition(*spread).sortWithinPartitions(*spread, "us", "at")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Blocks lie side by side on one line, a cooldown and more apart, so that they are searched together.
        length = gap * _GAPS
        stride, most = length + gap + 1, max(1, 2**62 // (length + gap + 1))
        for keyed, sizes, times in _groups(batches, spread):
            stops_at = np.cumsum(sizes)
            for g in range(0, len(sizes), most):
                some, size = keyed.iloc[g : g + most], sizes[g : g + most]
                us = times[stops_at[g] - size[0] : stops_at[g + len(size) - 1]]
                n, of, nth = len(us), np.repeat(np.arange(len(size)), size), np.arange(len(size)) * stride
                starts = np.cumsum(size) - size
                line = us - some["block"].to_numpy()[of] * length + nth[of]
                following = np.searchsorted(line, line + gap)
                to = np.where(following < (starts + size)[of], following, np.arange(n))
                for _ in range(_GAPS.bit_length() + 1):  # a block keeps _GAPS + 1 at most
                    to = to[to]
                first = np.minimum(starts + size, np.searchsorted(line, line[starts] + gap) + 1)
                entries = np.flatnonzero(np.arange(n) < first[of])
                leads, own = us[to[entries]], of[entries]
                stops = np.flatnonzero(np.append((leads[1:] != leads[:-1]) | (own[1:] != own[:-1]), True))
                out = some.iloc[own[stops]].reset_index(drop=True)
                yield out.assign(reach=us[entries[stops]], lead=leads[stops])

    ranges = base.mapInPandas(ends, StructType([*key_fields, StructField("reach", LongType()), StructField("lead", LongType())]))
    ranges = ranges.withColumn("last_us", F.lit(None).cast("long")) if last is None else ranges.join(last, keys, "left")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = block = kept = None
        taken = False
        for batch in batches:
            out, known = [], batch["last_us"].astype("Int64")
            for i, (*k, at, reach, lead) in enumerate(zip(*(batch[c] for c in (*spread, "reach", "lead")), strict=True)):
                if k != key:
                    key, block, kept = k, None, None if pd.isna(known.iloc[i]) else int(known.iloc[i])
                if at != block:
                    block, taken = at, False
                    out.append((*k, at, kept))
                if not taken and (kept is None or reach >= kept + gap):
                    kept, taken = lead, True
            yield pd.DataFrame(out, columns=[*spread, "last_us"]).astype({"last_us": "Int64"})

    before = ranges.repartition(*keys).sortWithinPartitions(*spread, "reach").mapInPandas(chain, StructType([*key_fields, StructField("last_us", LongType())]))
    # A block's hits follow the row that tells what was kept before it; columns that only hits have are filled.
    filled = [(F.lit(0) if isinstance(f.dataType, NumericType | BooleanType) else F.lit(None)).cast(f.dataType).alias(f.name) for f in hits.schema if f.name not in (*keys, "us")]
    heads = before.select(*keys, "block", F.coalesce("last_us", F.lit(_NONE)).alias("us"), F.lit(False).alias("_hit"), *filled)
    rows = base.withColumn("_hit", F.lit(True)).unionByName(heads).repartition(*spread)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = _NONE
        for batch in batches:
            kept = []
            for i, (hit, us) in enumerate(zip(batch["_hit"].tolist(), batch["us"].tolist(), strict=True)):
                if not hit:
                    last = us
                elif us - last >= gap:
                    last = us
                    kept.append(i)
            yield batch.iloc[kept][names]

    return rows.sortWithinPartitions(*spread, "_hit", "us", "at").mapInPandas(fold, hits.schema)


@dataclass(frozen=True)
class Resume:
    """Detection that goes on at an instant: hits from there on, cooldowns from before.

    last: the hits kept before, of a rule, as (keys, last_us). keep: given a rule, its
    keys and its kept hits, stores and returns them.
    """

    start: Column
    last: Callable[[Rule, list[str]], DataFrame]
    keep: Callable[[Rule, list[str], DataFrame], DataFrame]


def _thinned(hits: DataFrame, keys: list[str], rule: Rule, resume: Resume | None) -> DataFrame:
    if resume is None:
        return cooled(hits, keys, rule.cooldown_minutes)
    later = hits.filter(F.col("us") >= F.unix_micros(resume.start) - F.lit(_EPOCH_US))
    return resume.keep(rule, keys, cooled(later, keys, rule.cooldown_minutes, resume.last(rule, keys)))


def severity(score: Column, rules: RuleSet) -> Column:
    """The first severity whose bound the score reaches."""
    out = F.lit("low")
    for name, bound in reversed(rules.severities):
        out = F.when(score >= bound, F.lit(name)).otherwise(out)
    return out


def risk_factors(rules: RuleSet, rule: Rule, count: Column, limit: Column, extra: list[tuple[str, Column]]) -> Column:
    """array<struct<factor, points>>; factors without points are left out."""
    volume = F.least(F.lit(rules.max_bonus).cast("long"), F.greatest(F.lit(0).cast("long"), count - limit) * rules.bonus_per_event)
    rows = [("base_rule", F.lit(rule.base_risk).cast("long")), ("volume_above_threshold", volume), *extra]
    factors = F.array(*(F.struct(F.lit(n).alias("factor"), p.cast("long").alias("points")) for n, p in rows))
    return F.filter(factors, lambda f, i: (i == 0) | (f["points"] != 0))


def risk_score(factors: Column) -> Column:
    total = F.aggregate(factors, F.lit(0).cast("long"), lambda s, f: s + f["points"])
    return F.least(F.lit(100), F.greatest(F.lit(0), total)).cast("int")


def iso_local(ts: Column, zone: str) -> Column:
    """ISO-8601 text with offset; the fraction only where there is one."""
    wall = local(ts, zone)
    shift = ((F.unix_micros(wall) - F.unix_micros(ts)) / 60_000_000).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(shift < 0, "-").otherwise("+"), F.floor(F.abs(shift) / 60).cast("int"), F.abs(shift) % 60)
    fraction = F.when(F.unix_micros(ts) % 1_000_000 == 0, "").otherwise(F.date_format(wall, ".SSSSSS"))
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), fraction, offset)


def _told(rows: pd.DataFrame, keys: list[str], span: int, failures_only: bool) -> pd.DataFrame:
    """What the windows of the hits hold, of all events of some keys and slices in order."""
    us, weight, kind = rows["us"].to_numpy(), rows["weight"].to_numpy(), rows["event_class"].to_numpy()
    # Keys and slices lie side by side on one line, more than a window apart, so that they are searched together.
    spread = rows[[*keys, "slice"]]
    nth = np.cumsum((spread != spread.shift()).any(axis=1).to_numpy())
    line = us - (rows["slice"].to_numpy() - 1) * span + nth * (3 * span + 1)
    at = np.flatnonzero(rows["_hit"].to_numpy(dtype=bool))
    used = np.flatnonzero(kind == "failure") if failures_only else np.arange(len(rows))
    lo, hi = np.searchsorted(used, np.searchsorted(line, line[at] - span)), np.searchsorted(used, at)
    out = rows.iloc[at].copy()
    own = np.append(used, 0)[np.minimum(lo, len(used))]
    out["first_us"] = us[np.where(hi > lo, own, at)]
    for name, of in (("event_count", np.ones(len(rows), dtype=bool)), *((f"{k}_count", kind == k) for k in CLASSES)):
        part = np.where(of, weight, 0)
        sums = np.concatenate([[0], np.cumsum(part[used])])
        out[name] = sums[hi] - sums[lo] + part[at]
    inside = [np.append(used[a:b], i) for a, b, i in zip(lo, hi, at, strict=True)]
    for c in ("user_key", "client_ip_key"):
        names, codes = np.unique(rows[c].fillna("").to_numpy(dtype=str), return_inverse=True)
        found = [codes[at[i : i + 1]] if c in keys else np.unique(codes[x]) for i, x in enumerate(inside)]
        found = [x[names[x] != ""] for x in found]
        out[f"n_{c}s"], out[f"a_{c}"] = [len(x) for x in found], [str(names[x[-1]]) if len(x) else None for x in found]
    names, codes = np.unique(rows["relying_party"].fillna("").to_numpy(dtype=str), return_inverse=True)
    out["apps"] = pd.Series([[str(n) for n in names[np.unique(codes[x])] if n][:8] for x in inside], index=out.index, dtype=object)
    ids = rows["event_id"].fillna("").to_numpy(dtype=object)
    named = ids != ""
    out["ids"] = pd.Series([ids[x[named[x]][:10]].tolist() for x in inside], index=out.index, dtype=object)
    return out


def _gathered(hits: DataFrame, evidence: DataFrame, keys: list[str], minutes: int, failures_only: bool) -> DataFrame:
    """hits with counts, users, addresses, first ten ids and first eight services of their windows (and, of failures_only, themselves).

    A task reads the events of a key and slice once, in order, and tells of each hit what
    its window holds: no rows of hits times events are made, and no more is held than the
    events of one key in two windows.
    """
    spread, own = [*keys, "slice"], [c for c in hits.columns if c not in (*keys, "slice", "at", "us")]
    columns = [*dict.fromkeys([*spread, "at", "us", "event_id", "event_class", "weight", "user_key", "client_ip_key", "relying_party"])]
    marked = evidence.select(*columns).join(hits.select(*spread, "at", *own, F.lit(True).alias("_hit")), [*spread, "at"], "left")
    marked = marked.withColumns({"_hit": F.coalesce("_hit", F.lit(False)), **{c: F.coalesce(c, F.lit(0)).cast(hits.schema[c].dataType) for c in own}})
    marked = marked.withColumn("_any", F.max("_hit").over(Window.partitionBy(*spread))).filter("_any").drop("_any")

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            begins = np.flatnonzero((batch[spread] != batch[spread].shift()).any(axis=1).to_numpy())
            cut = int(begins[-1])  # the last key may go on
            if held and (cut or tuple(batch[spread].iloc[0]) != tuple(held[-1][spread].iloc[-1])):
                yield _told(pd.concat([*held, batch.iloc[:cut]], ignore_index=True), keys, minutes * 60_000_000, failures_only)[names]
                held = []
            elif cut:
                yield _told(batch.iloc[:cut].reset_index(drop=True), keys, minutes * 60_000_000, failures_only)[names]
            held.append(batch.iloc[cut:])
        if held:
            yield _told(pd.concat(held, ignore_index=True), keys, minutes * 60_000_000, failures_only)[names]

    long, text = LongType(), StringType()
    fields = [*(hits.schema[c] for c in keys), *(StructField(c, long) for c in ("slice", "at", "us")), *(hits.schema[c] for c in own)]
    fields += [StructField(c, long) for c in ("first_us", "event_count", *(f"{k}_count" for k in CLASSES), "n_user_keys", "n_client_ip_keys")]
    fields += [StructField("a_user_key", text), StructField("a_client_ip_key", text), StructField("apps", ArrayType(text)), StructField("ids", ArrayType(text))]
    names = [f.name for f in fields]
    told = marked.sortWithinPartitions(*spread, "at").mapInPandas(tell, StructType(fields))
    instant = lambda c: F.timestamp_micros(F.col(c) + F.lit(_EPOCH_US))
    return told.withColumns({"first_seen": instant("first_us"), "last_seen": instant("us")})


def alerts(hits: DataFrame, evidence: DataFrame, keys: list[str], rules: RuleSet, rule: Rule, extra: list[tuple[str, Column]], more_limit: int = 0) -> DataFrame:
    """Alert records (ALERT_COLUMNS, first_seen, last_seen) of kept hits.

    hits: keys, slice, at, us, lim (threshold), and what ``extra`` reads. evidence:
    sliced events; a hit's are those of its key and slice in the window.
    """
    grouped = _gathered(hits, evidence, keys, rule.window_minutes, rule.rule_id == "AUTH_SUCCESS_AFTER_FAILURES")
    factors = risk_factors(rules, rule, F.col("event_count"), F.col("lim") + more_limit, extra)
    rows = grouped.withColumn("factors", factors)
    rows = rows.withColumn("score", risk_score(F.col("factors")))
    only = lambda c: F.when(F.col(f"n_{c}s") == 1, F.col(f"a_{c}")).otherwise("")
    kinds = F.array(*(F.when(F.col(f"{k}_count") > 0, F.concat(F.lit(f"{k}:"), F.col(f"{k}_count"))) for k in ("failure", "lockout", "other", "success")))
    first, last = iso_local(F.col("first_seen"), rules.zone), iso_local(F.col("last_seen"), rules.zone)
    print_ = F.concat_ws("|", F.lit(rule.rule_id), only("user_key"), only("client_ip_key"), first, last, F.array_join(F.sort_array("ids"), ","))
    plain, special, advice = TEXTS[rule.rule_id]
    return rows.select(
        F.concat(F.lit("alt_"), F.left(F.sha2(print_, 256), F.lit(20))).alias("alert_id"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.name).alias("rule_name"),
        severity(F.col("score"), rules).alias("severity"),
        F.col("score").alias("risk_score"),
        F.to_json("factors").alias("risk_factors"),
        F.lit("new").alias("status"),
        first.alias("first_seen_local"),
        last.alias("last_seen_local"),
        only("user_key").alias("user_key"),
        only("client_ip_key").alias("client_ip_key"),
        F.array_join(F.array_compact(kinds), ";").alias("event_types"),
        "event_count",
        "success_count",
        "failure_count",
        "lockout_count",
        F.col("n_user_keys").cast("long").alias("distinct_users"),
        F.col("n_client_ip_keys").cast("long").alias("distinct_client_ips"),
        F.array_join("apps", ";").alias("relying_parties"),
        F.array_join("ids", ";").alias("evidence_event_ids"),
        F.when(F.col("authorized"), special).otherwise(plain).alias("description"),
        F.lit(advice).alias("recommendation"),
        F.lit("true").alias("requires_human_review"),
        "first_seen",
        "last_seen",
    )


def _weighty(events: DataFrame, rules: RuleSet, rule: Rule, exclusions: Exclusions | None, keys: list[str], limit_name: str, extra: list[tuple[str, Column]], resume: Resume | None = None) -> DataFrame:
    """A rule that fires where the window's weight of a key reaches the threshold."""
    keys = [*keys, "authorized"]
    marked = sliced(events.withColumn("authorized", authorized(exclusions)), keys, rule.window_minutes)
    total = trailing_sum(F.col("weight"), keys, rule.window_minutes)
    hits = marked.withColumn("total", total).withColumn("lim", threshold(exclusions, limit_name, rule.minimum))
    hits = hits.filter(F.col("home") & (F.col("total") >= F.col("lim"))).select(*keys, "at", "us", "slice", "total", "lim")
    return alerts(_thinned(hits, keys, rule, resume), marked, keys, rules, rule, extra)


def _intense(rule: Rule, count: Column) -> tuple[str, Column]:
    return "intense_pattern", F.when(count >= rule.critical, rule.intense_bonus).otherwise(0)


def brute_force(events: DataFrame, rules: RuleSet, exclusions: Exclusions | None = None, resume: Resume | None = None) -> DataFrame:
    """Failures of one user."""
    failures = events.filter((F.col("event_class") == "failure") & (F.col("user_key") != ""))
    return _weighty(failures, rules, rules.brute_force, exclusions, ["user_key"], "failures_per_user", [_intense(rules.brute_force, F.col("total"))], resume)


def lockouts(events: DataFrame, rules: RuleSet, exclusions: Exclusions | None = None, resume: Resume | None = None) -> DataFrame:
    """Lockouts of one user."""
    locked = events.filter((F.col("event_class") == "lockout") & (F.col("user_key") != ""))
    return _weighty(locked, rules, rules.lockout, exclusions, ["user_key"], "lockouts_per_user", [], resume)


def password_spray(events: DataFrame, rules: RuleSet, exclusions: Exclusions | None = None, resume: Resume | None = None) -> DataFrame:
    """Failures from one address against several users."""
    rule, keys = rules.spray, ["client_ip_key", "authorized"]
    failures = events.filter((F.col("event_class") == "failure") & (F.col("client_ip_key") != ""))
    marked = sliced(failures.withColumn("authorized", authorized(exclusions)), keys, rule.window_minutes)
    summed = marked.withColumn("total", trailing_sum(F.col("weight"), keys, rule.window_minutes)).select(*keys, "slice", "home", "at", "us", "user_key", "total")
    counted = trailing_distinct(summed, keys, "user_key", rule.window_minutes, "n_users").withColumn("lim", threshold(exclusions, "failures_per_ip", rule.minimum))
    hits = counted.filter(F.col("home") & (F.col("total") >= F.col("lim")) & (F.col("n_users") >= threshold(exclusions, "distinct_users_per_ip", rule.minimum_users)))
    hits = hits.select(*keys, "slice", "at", "us", "total", "lim", "n_users")
    many = (F.col("total") >= rule.critical) | (F.col("n_users") >= rule.critical_users)
    extra = [("multiple_accounts", F.lit(rule.bonus)), ("intense_pattern", F.when(many, rule.intense_bonus).otherwise(0))]
    return alerts(_thinned(hits, keys, rule, resume), marked, keys, rules, rule, extra)


def success_after_failures(events: DataFrame, rules: RuleSet, exclusions: Exclusions | None = None, resume: Resume | None = None) -> DataFrame:
    """A success after failures of the same user."""
    rule, keys = rules.success_after, ["user_key", "authorized"]
    used = events.filter(F.col("event_class").isin("failure", "success") & (F.col("user_key") != ""))
    marked = sliced(used.withColumn("authorized", authorized(exclusions)), keys, rule.window_minutes)
    failed = trailing_sum(F.when(F.col("event_class") == "failure", F.col("weight")).otherwise(0), keys, rule.window_minutes)
    hits = marked.withColumn("total", failed).withColumn("lim", threshold(exclusions, "success_after_failures", rule.minimum))
    hits = hits.filter(F.col("home") & (F.col("event_class") == "success") & (F.col("total") >= F.col("lim"))).select(*keys, "at", "us", "slice", "total", "lim")
    extra = [("success_after_failures", F.lit(rule.bonus)), _intense(rule, F.col("total"))]
    return alerts(_thinned(hits, keys, rule, resume), marked, keys, rules, rule, extra, more_limit=1)


def new_ip(events: DataFrame, rules: RuleSet, users: DataFrame, known: DataFrame, training_end: str, exclusions: Exclusions | None = None, resume: Resume | None = None) -> DataFrame:
    """Activity of a well-known user from an address not seen in training.

    users: user_key with sufficient history; known: (user_key, client_ip_key).
    """
    later = evaluation(events, training_end, rules.zone)
    used = later.filter(F.col("event_class").isin("success", "failure", "lockout") & (F.col("user_key") != "") & (F.col("client_ip_key") != ""))
    used = used.join(users.select("user_key"), "user_key", "left_semi").join(known.select("user_key", "client_ip_key"), ["user_key", "client_ip_key"], "left_anti")
    return _weighty(used, rules, rules.new_ip, exclusions, ["user_key", "client_ip_key"], "new_ip_events", [], resume)


def detect(events: DataFrame, rules: RuleSet, baseline: tuple[DataFrame, DataFrame, str] | None = None, exclusions: Exclusions | None = None, resume: Resume | None = None) -> DataFrame:
    """All enabled rules (D14); order by first_seen_local, rule_id for the reports. ``resume``: only what is new."""
    parts = [f(events, rules, exclusions, resume) for r, f in ((rules.brute_force, brute_force), (rules.spray, password_spray), (rules.success_after, success_after_failures), (rules.lockout, lockouts)) if r.enabled]
    if baseline is not None and rules.new_ip.enabled:
        users, known, end = baseline
        parts.append(new_ip(events, rules, users, known, end, exclusions, resume))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def summary(found: DataFrame) -> DataFrame:
    """Counts and mean score in total, by rule and by severity."""
    sets = found.groupingSets([[F.col("rule_id")], [F.col("severity")], []], "rule_id", "severity")
    return sets.agg(F.count("*").alias("alerts"), F.round(F.avg("risk_score"), 2).alias("mean_score"))
