"""Events around alerts, told by ordered passes: no rows of alerts times events.

Windows are dealt to slices by their length: those under 8 hours to slices of 8
hours, those under 64 hours to slices of 64, and so on. A window lies in the slice
that it begins in and the next one, so each event stands in its own slice and the one
before, for each length that occurs. A task reads the events of a key and slice once,
in order, and holds no more than those of one key in two slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

_HOUR = 3_600_000_000


def windows(alerts: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """(alert_id, key, lo, hi) of alerts with a key: their padded windows."""
    lo, hi = F.unix_micros("first_seen") - before * 60_000_000, F.unix_micros("last_seen") + after * 60_000_000
    return alerts.filter(F.col(key) != "").select("alert_id", key, lo.alias("lo"), hi.alias("hi"))


def _dealt(spans: DataFrame, events: DataFrame, key: str, order: list) -> tuple[DataFrame, list[str]]:
    """Events (with us) and windows by key, level and slice in the order of time, windows (alert_id filled) at their beginning."""
    spread = [key, "level", "slice"]
    # Three more bits of the hours are one more level: a window is shorter than its slice.
    bits = F.length(F.bin(F.floor((F.col("hi") - F.col("lo")) / _HOUR)))
    size = F.pow(F.lit(8.0), F.col("level")).cast("long") * _HOUR
    asked = spans.filter("lo <= hi").withColumn("level", F.floor((bits + 2) / 3).cast("int")).withColumn("slice", F.floor(F.col("lo") / size))
    own = F.floor(F.col("us") / size)
    rows = events.join(F.broadcast(asked.select("level").distinct())).withColumn("slice", F.explode(F.array(own, own - 1)))
    rows = rows.join(asked.select(*spread).distinct(), spread, "left_semi").withColumns({"alert_id": F.lit(None).cast("string"), "hi": F.lit(0).cast("long")})
    filled = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name not in (key, "us")]
    begins = asked.select(*spread, F.col("lo").alias("us"), "alert_id", "hi", *filled)
    both = rows.unionByName(begins).withColumn("_event", F.col("alert_id").isNull())
    return both.repartition(*spread).sortWithinPartitions(*spread, "us", "_event", *order), spread


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole keys of sorted rows, many at a time, with the places where they begin."""

    def begins(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        named = rows.select(keys).to_pandas()
        return np.flatnonzero((named != named.shift()).any(axis=1).to_numpy())

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(begins(batch)[-1])  # the last key may go on
        if cut or (held and any(batch[k][0] != held[-1][k][-1] for k in keys)):
            rows = pa.Table.from_batches([*held, batch.slice(0, cut)])
            yield rows, begins(rows)
            held = []
        held.append(batch.slice(cut))
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, begins(rows)


def _placed(rows: pd.DataFrame, begins: np.ndarray, fresh: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The events (those that are fresh), the windows, the first and the end of each window's events, the key number of each event."""
    event = rows["_event"].to_numpy(dtype=bool)
    known, asked = rows[event & fresh], rows[~event]
    nth = np.cumsum(np.bincount(begins, minlength=len(rows))) - 1
    first = np.cumsum(event & fresh)[~event]
    us, hi, of, of_asked = known["us"].to_numpy(), asked["hi"].to_numpy(), nth[event & fresh], nth[~event]
    numbers = np.arange(len(begins))
    event_at, asked_at = np.searchsorted(of, [numbers, numbers + 1]), np.searchsorted(of_asked, [numbers, numbers + 1])
    end = np.empty(len(asked), dtype=np.int64)
    for a, b, c, d in zip(*event_at, *asked_at, strict=True):
        end[c:d] = a + np.searchsorted(us[a:b], hi[c:d], side="right")
    return known, asked, first, end, of


def below(values: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each pair of an end and a bound, how many of values[:end] are less than the bound.

    Values are dealt by one bit after another, the highest first, and each pair is
    followed through all bits: O((values + pairs) * bits).
    """
    lo, hi, found = np.zeros_like(ends), ends, np.zeros_like(ends)
    most = int(max(values.max(initial=0), bounds.max(initial=0)))
    for bit in range(most.bit_length() - 1, -1, -1):
        zero = (values >> bit) & 1 == 0
        zeros = np.concatenate([[0], np.cumsum(zero)])
        a, b, one = zeros[lo], zeros[hi], (bounds >> bit) & 1 == 1
        found = found + np.where(one, b - a, 0)
        lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        values = np.concatenate([values[zero], values[~zero]])
    return found


def _distinct(names: pd.Series, of: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many names but "" and null stand in each range: those whose last place before lies before the range."""
    there = (names.notna() & (names != "")).to_numpy()
    places = np.concatenate([[0], np.cumsum(there)])
    first, end = places[first], places[end]
    codes, different = pd.factorize(names[there])
    same = of[there] * max(1, len(different)) + codes
    order = np.argsort(same, kind="stable")
    again = np.flatnonzero(same[order[1:]] == same[order[:-1]])
    last = np.zeros(len(same), dtype=np.int64)  # place + 1 of the last one, 0 if there is none
    last[order[1:][again]] = order[:-1][again] + 1
    return below(last, end, first + 1) - first


def counted(spans: DataFrame, events: DataFrame, key: str, measures: dict, distinct: str) -> DataFrame:
    """(alert_id, key, measures, n_distinct) of windows (alert_id, key, lo, hi) that hold events (us, key, ...).

    measures: long columns to sum, by name; n_distinct: of the different values but "" of ``distinct``.
    """
    names = list(measures)
    given = events.select(key, "us", F.col(distinct).alias("_value"), *(c.cast("long").alias(n) for n, c in measures.items()))
    rows, spread = _dealt(spans, given, key, [])
    # Sums of windows: 0 where a window's own row stands.
    rows = rows.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names})
    columns = ["alert_id", key, *names, "n_distinct"]
    made = StructType([spans.schema["alert_id"], spans.schema[key], *(StructField(n, LongType()) for n in columns[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begins in _whole(batches, spread):
            known, asked, first, end, of = _placed(part.to_pandas(), begins, np.ones(part.num_rows, dtype=bool))
            out = asked[["alert_id", key]].copy()
            for n in names:
                sums = np.concatenate([[0], np.cumsum(known[n].to_numpy())])
                out[n] = sums[end] - sums[first]
            out["n_distinct"] = _distinct(known["_value"], of, first, end)
            yield from pa.Table.from_pandas(out[end > first][columns], to_arrow_schema(made), preserve_index=False).to_batches()

    return rows.mapInArrow(run, made)


def newest(spans: DataFrame, events: DataFrame, key: str, most: int, once: bool = False) -> DataFrame:
    """(alert_id, nth, columns of events): the newest events of each window, those of an instant by event_id.

    once: rows of events that are equal in all columns count as one.
    """
    names = events.columns
    given = events.withColumn("us", F.unix_micros("ts"))
    others = [c for c in names if c not in (key, "event_id")]
    rows, spread = _dealt(spans, given, key, [F.desc("event_id"), *others])
    seen = [*spread, "us", "_event", *(c for c in names if c not in (key, "ts") and once)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, begins in _whole(batches, spread):
            told = part.select([*seen, "hi"]).to_pandas()
            fresh = np.ones(len(told), dtype=bool)
            if once:
                own, last = told[seen], told[seen].shift()
                fresh = ~((own == last) | (own.isna() & last.isna())).all(axis=1).to_numpy()
            known, asked, first, end, _ = _placed(told, begins, fresh)
            size = np.minimum(end - first, most)
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            whole = part.combine_chunks()
            found = whole.select(names).take(pa.array(known.index.to_numpy()[np.repeat(end, size) - 1 - nth]))
            ids = whole["alert_id"].take(pa.array(np.repeat(asked.index.to_numpy(), size)))
            found = pa.Table.from_arrays([ids, pa.array(nth + 1, pa.int32()), *found.columns], ["alert_id", "nth", *names])
            yield from found.to_batches(65_536)

    return rows.mapInArrow(run, StructType([spans.schema["alert_id"], StructField("nth", IntegerType()), *events.schema.fields]))
