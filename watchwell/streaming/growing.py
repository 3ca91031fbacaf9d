"""An alert table that grows with the events.

Time is cut into ranges. A range's alerts need its events, those of the longest window
before it, and the last hit that each key kept before it: no older event is read and no
older alert is searched for again. The table has a folder for each range; a range that
runs again, after a failure or for late events, gives its alerts anew, and so must the
ranges behind it, whose cooldowns go on from its hits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from watchwell.operators import store
from watchwell.operators.detect import Resume, detect
from watchwell.operators.rules import Exclusions, Rule, RuleSet
from watchwell.streaming.parts import drop, there

#: What hits are kept by; a rule has some of them.
_ENTITY = ("user_key", "client_ip_key", "authorized")
_LAST = StructType([StructField("rule_id", StringType()), StructField("user_key", StringType()), StructField("client_ip_key", StringType()), StructField("authorized", BooleanType()), StructField("last_us", LongType())])


class GrowingAlerts:
    """Alerts under ``folder``, one folder for each range of time."""

    def __init__(self, folder: str, rules: RuleSet, baseline: tuple[DataFrame, DataFrame, str] | None = None, exclusions: Exclusions | None = None):
        self.folder, self.rules, self.baseline, self.exclusions = folder, rules, baseline, exclusions

    def _last(self, spark: SparkSession, part: str | None) -> DataFrame:
        path = f"{self.folder}/last/part={part}"
        return spark.read.schema(_LAST).parquet(path) if part and there(spark, path) else spark.createDataFrame([], _LAST)

    def add(self, events: DataFrame, start: str, stop: str, before: str | None = None) -> None:
        """Alerts of the range [start, stop) of instants; ``before``: the start of the range that it follows."""
        spark, part, work = events.sparkSession, _name(start), f"{self.folder}/work"
        last = self._last(spark, before and _name(before))

        def known(rule: Rule, keys: list[str]) -> DataFrame:
            return last.filter(F.col("rule_id") == rule.rule_id).select(*keys, "last_us")

        def keep(rule: Rule, keys: list[str], hits: DataFrame) -> DataFrame:
            """Hits are few; written, they are found once."""
            hits.write.mode("overwrite").parquet(f"{work}/{rule.rule_id}")
            kept[rule.rule_id] = spark.read.schema(hits.schema).parquet(f"{work}/{rule.rule_id}")
            return kept[rule.rule_id]

        kept: dict[str, DataFrame] = {}
        scope = store.with_lookback(events, start, stop, self.rules.longest_window())
        found = detect(scope, self.rules, self.baseline, self.exclusions, Resume(F.lit(start).cast("timestamp"), known, keep))
        found.write.mode("overwrite").parquet(f"{self.folder}/alerts/part={part}")

        parts = [last]
        for rule_id, hits in kept.items():
            columns = [F.col(c) if c in hits.columns else F.lit(None).cast(_LAST[c].dataType).alias(c) for c in _ENTITY]
            parts.append(hits.select(F.lit(rule_id).alias("rule_id"), *columns, F.col("us").alias("last_us")))
        newest = reduce(DataFrame.unionByName, parts).groupBy("rule_id", *_ENTITY).agg(F.max("last_us").alias("last_us"))
        # A hit whose cooldown ends with the range holds nothing back after it.
        waits = F.create_map(*(F.lit(x) for r in self.rules.all() for x in (r.rule_id, r.cooldown_minutes * 60_000_000)))
        end = F.unix_micros(F.lit(stop).cast("timestamp")) - F.unix_micros(F.lit("2020-01-01").cast("timestamp"))
        newest.filter(F.col("last_us") + F.try_element_at(waits, F.col("rule_id")) > end).write.mode("overwrite").parquet(f"{self.folder}/last/part={part}")
        drop(spark, work)

    def refresh(self, events: DataFrame, bounds: Sequence[str], since: str | None = None) -> None:
        """The ranges between neighbouring ``bounds`` (instants, in order), from the one that holds ``since`` on."""
        for i, (start, stop) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if since is None or stop > since:
                self.add(events, start, stop, bounds[i - 1] if i else None)

    def alerts(self, spark: SparkSession) -> DataFrame:
        """All alerts, with the range (part) that they are of."""
        return spark.read.parquet(f"{self.folder}/alerts")


def _name(instant: str) -> str:
    """A folder's name for an instant."""
    return "".join(c if c.isalnum() else "-" for c in instant)
