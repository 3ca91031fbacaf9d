"""Hour and day buckets that follow every change of the events (T4 with A4).

A batch holds changes of events, in any order of their times. It becomes signed
events, what the store held less and what it holds now more, and these are added to
the parts of the mart (a UTC day of buckets and a slot of services) that they touch.
There is no watermark: a row counts however late it comes, and takes itself back when
it is changed or deleted. A batch that comes again gives the same parts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from watchwell.operators import mart, store
from watchwell.sources.auth import EVENT_COLUMNS, ZONE
from watchwell.streaming.keyed import KeyedLog
from watchwell.streaming.parts import Parts, drop

_KINDS = {"ts": TimestampType(), "weight": LongType(), "is_consistent": BooleanType()}
_EVENT = [StructField(c, _KINDS.get(c, StringType())) for c in EVENT_COLUMNS]
_STATE = StructType([StructField("event_key", StringType()), StructField("alive", BooleanType()), *_EVENT])
_KEYS = [StructField("source_name", StringType()), StructField("grain", StringType()), StructField("bucket", TimestampType()), StructField("relying_party", StringType())]
_COUNTS = [StructField(c, LongType()) for c in (*mart.COUNTS, "distinct_users", "distinct_ips")]
_BUCKETS = StructType([*_KEYS, *_COUNTS, StructField("service_key", StringType())])
_REFS = StructType([*_KEYS, StructField("kind", StringType()), StructField("entity_key", StringType()), StructField("refs", LongType())])
_MINUTES = StructType([_KEYS[0], StructField("minute", TimestampType()), _KEYS[3], *(StructField(c, LongType()) for c in (*mart.COUNTS, "other_count"))])
_PART = StructType([StructField("day", DateType()), StructField("slot", IntegerType())])


def settled(changes: DataFrame, held: DataFrame) -> DataFrame:
    """What a batch of changes makes of the events it names: (event_key, old, new), structs of event columns or null.

    changes: event columns, op (insert, update or delete) and seq, their order. As in a
    database, an insert of an event that is there does nothing, nor does an update or
    a delete of one that isn't. held: (event_key, event columns) of the events that
    are there. Ops are folded by their last delete, first insert after it and last
    update, so an event with any number of changes is no list in one task.
    """
    order = F.struct("seq", F.xxhash64(*changes.columns))
    keyed = changes.select(store.event_key(F.col("source_name"), F.col("event_id")).alias("event_key"), "op", order.alias("order"), F.struct(*EVENT_COLUMNS).alias("row"))
    deleted = keyed.groupBy("event_key").agg(F.max(F.when(F.col("op") == "delete", F.col("order"))).alias("deleted"))
    after = keyed.join(deleted, "event_key").filter("op <> 'delete' AND (deleted IS NULL OR order > deleted)")
    placed = F.struct("order", "row")
    ends = after.groupBy("event_key").agg(F.min_by(F.when(F.col("op") == "insert", placed), F.when(F.col("op") == "insert", F.col("order"))).alias("first"), F.max_by(F.when(F.col("op") == "update", placed), F.when(F.col("op") == "update", F.col("order"))).alias("last"))
    rows = deleted.join(ends, "event_key", "left").join(held.select("event_key", F.struct(*EVENT_COLUMNS).alias("old")), "event_key", "left")
    stays = F.col("old").isNotNull() & F.col("deleted").isNull()
    put = F.when(F.col("last.order") > F.col("first.order"), F.col("last.row")).otherwise(F.col("first.row"))
    new = F.when(stays, F.coalesce("last.row", "old")).when(F.col("first").isNotNull(), put)
    return rows.select("event_key", "old", new.alias("new"))


def signed(made: DataFrame) -> DataFrame:
    """Events with sign: -1 as they were, 1 as they are, where that differs."""
    changed = made.filter(~F.col("old").eqNullSafe(F.col("new")))
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")))
    return changed.select(F.explode(both).alias("x")).filter("x.row IS NOT NULL").select("x.row.*", "x.sign")


def _placed(rows: DataFrame, at: str, slots: int) -> DataFrame:
    """Rows with their part: the UTC day of a time and a slot of the service."""
    return rows.withColumns({"day": F.to_date(at), "slot": F.pmod(F.xxhash64("source_name", "relying_party"), F.lit(slots)).cast("int")})


class LiveMart:
    """The mart of a stream of changes, under ``folder``: minutes, hour and day buckets, entities of buckets."""

    def __init__(self, folder: str, zone: str = ZONE, slots: int = 8, key_slots: int = 16):
        self.folder, self.zone, self.slots = folder, zone, slots
        self.events = KeyedLog(f"{folder}/events", _STATE, "event_key", key_slots)
        self.kept = {name: Parts(f"{folder}/{name}", schema, _PART) for name, schema in (("minutes", _MINUTES), ("buckets", _BUCKETS), ("refs", _REFS))}

    def step(self) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function over changes (event columns, op, seq)."""

        def run(batch: DataFrame, number: int) -> None:
            work = f"{self.folder}/work"

            def once(df: DataFrame, name: str) -> DataFrame:
                """Written, as a stream's batch is computed anew each time that it is used."""
                df.write.mode("overwrite").parquet(f"{work}/{name}")
                return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")

            changes = once(batch.select(*EVENT_COLUMNS, "op", "seq"), "changes")
            keys = changes.select(store.event_key(F.col("source_name"), F.col("event_id")).alias("event_key"))
            held = self.events.find(keys, number).filter("alive").select("event_key", *EVENT_COLUMNS)
            made = once(settled(changes, held), "made")
            self.add(once(signed(made), "signed"), number)
            now = made.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("row", F.coalesce("new", "old"))
            self.events.append(now.select("event_key", F.col("new").isNotNull().alias("alive"), "row.*"), number)
            drop(batch.sparkSession, work)

        return run

    def add(self, changes: DataFrame, number: int) -> None:
        """Signed events into the parts that they touch, as batch ``number``."""
        rows = mart.usable(changes)
        self._replace({"minutes": "minute"}, rows.withColumn("minute", F.date_trunc("minute", "ts")), number, lambda old: [mart.apply_to_minutes(old[0], changes)])
        self._replace({"buckets": "bucket", "refs": "bucket"}, mart.grained(rows, self.zone), number, lambda old: mart.apply_changes(*old, changes, self.zone))

    def _replace(self, tables: dict[str, str], marked: DataFrame, number: int, made: Callable[[list[DataFrame]], Sequence[DataFrame]]) -> None:
        """The parts of tables that rows (with the table's time) touch, read as they are before the batch and written as ``made`` gives them."""
        spark, at = marked.sparkSession, next(iter(tables.values()))
        # One row a part: days times slots that the batch touches.
        touched = spark.createDataFrame(_placed(marked, at, self.slots).select("day", "slot").distinct().collect(), _PART)
        before = [self.kept[name].live(spark, number) for name in tables]
        old = [self.kept[name].read(spark, live.join(F.broadcast(touched), ["day", "slot"], "left_semi").collect()) for name, live in zip(tables, before, strict=True)]
        for name, live, rows in zip(tables, before, made(old), strict=True):
            parts = self.kept[name]
            parts.write(_placed(rows, at, self.slots), number)
            written = parts.read(spark, [{**t.asDict(), "batch": number} for t in touched.collect()]).select(*parts.listed.names).distinct()
            parts.commit(live.join(F.broadcast(touched), ["day", "slot"], "left_anti").unionByName(written), number)

    def minutes(self, spark: SparkSession) -> DataFrame:
        """Minutes after all finished batches, as mart.minutes() gives them."""
        return self.kept["minutes"].read(spark).select(*_MINUTES.names)

    def buckets(self, spark: SparkSession) -> DataFrame:
        """Buckets after all finished batches, as mart.buckets() gives them."""
        return self.kept["buckets"].read(spark).select(*_BUCKETS.names)

    def entities(self, spark: SparkSession) -> DataFrame:
        """Rows of each user and address in each bucket, as mart.entities() gives them."""
        return self.kept["refs"].read(spark).select(*_REFS.names)


def as_changes(events: DataFrame, op: str = "insert", seq: str | None = None) -> DataFrame:
    """Events as changes of one kind, in the order of ``seq`` (else of their times)."""
    return events.select(*EVENT_COLUMNS, F.lit(op).alias("op"), (F.col(seq) if seq else F.unix_micros("ts")).cast("long").alias("seq"))
