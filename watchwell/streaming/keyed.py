"""A log of keyed rows that a batch looks into without reading it.

Keys are dealt into slots by their hash. The rows that a batch adds to a slot are one
part, with a Bloom filter of their keys beside it. A batch reads the filters of its own
slots (``_BITS`` bits for each key that the log holds there) and opens only the parts
that may hold one of its keys: for new keys next to none, for a batch that comes a second
time the parts of its first time. So what a batch reads of the rows grows with the
batch, not with the age of the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from watchwell.streaming.parts import Parts

#: Bits of a filter for each key, and places that a key sets: 6 keys of 10,000 are taken for others.
_BITS, _PLACES = 16, 8
_SLOT = StructType([StructField("slot", IntegerType())])
_FILTER = StructType([StructField("bits", BinaryType())])


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of each 64-bit hash in a filter of ``size`` (a power of two) bits."""
    h = hashes.view(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(_PLACES, dtype=np.uint64)[None, :]) & np.uint64(size - 1)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    """A Bloom filter of hashes."""
    size = max(1024, 1 << int(np.ceil(np.log2(max(1, len(hashes)) * _BITS))))
    bits = np.zeros(size, dtype=bool)
    bits[_places(hashes, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> bool:
    """Whether a filter may hold one of the hashes."""
    raw = np.frombuffer(filter_, np.uint8)
    at = _places(hashes, 8 * len(raw))
    return bool(((raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1).any())


def _filters(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bits": [bloom(rows["h"].to_numpy(np.int64))], "slot": rows["slot"].iloc[:1].to_numpy(np.int32)})


class KeyedLog:
    """Rows (key, columns of ``schema``) under ``folder``; of a key the last batch's row counts.

    slots: so many that the keys which one batch, or merge(), adds to a slot fit a task
    (8 bytes each).
    """

    def __init__(self, folder: str, schema: StructType, key: str, slots: int = 16):
        self.key, self.slots = key, slots
        self.rows = Parts(f"{folder}/log", schema, _SLOT)
        self.filters = Parts(f"{folder}/filters", _FILTER, _SLOT)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64(self.key)
        return rows.withColumn("h", h).withColumn("slot", F.pmod(h, F.lit(self.slots)).cast("int"))

    def opened(self, keys: DataFrame, number: int) -> list:
        """The parts (slot, batch) that may hold one of the keys, from batches before ``number``."""
        spark = keys.sparkSession
        asked = self._dealt(keys.select(self.key)).groupBy("slot").agg(F.collect_set("h").alias("asked"))
        slots = [r.slot for r in asked.select("slot").collect()]
        live = self.filters.live(spark, number).filter(F.col("slot").isin(slots)).collect()
        if not live:
            return []

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.loc[[may_hold(f, np.asarray(h, np.int64)) for f, h in zip(b["bits"], b["asked"], strict=True)], ["slot", "batch"]]

        return self.filters.read(spark, live).join(asked, "slot").select("slot", "batch", "bits", "asked").mapInPandas(test, "slot int, batch long").collect()

    def find(self, keys: DataFrame, number: int) -> DataFrame:
        """The newest row of each of the keys (a DataFrame with the key column) from batches before ``number``; none of a key that isn't there."""
        found = self.rows.read(keys.sparkSession, self.opened(keys, number)).join(keys.select(self.key).distinct(), self.key, "left_semi")
        columns = self.rows.schema.names
        newest = found.groupBy(self.key).agg(F.max_by(F.struct(*columns), "batch").alias("r"))
        return newest.select("r.*")

    def append(self, rows: DataFrame, number: int) -> None:
        """Rows of a batch, one of a key; the batch counts from then on. Comes it again, its rows are replaced."""
        spark, dealt = rows.sparkSession, self._dealt(rows)
        self.rows.write(dealt, number)
        written = self.rows.read(spark, [{"slot": s, "batch": number} for s in range(self.slots)])
        self._list(written, number, lambda live: live)

    def merge(self, spark: SparkSession, number: int) -> None:
        """All parts up to batch ``number``, the last done, become one a slot; rows of a key but the newest go."""
        columns = self.rows.schema.names
        newest = self.rows.read(spark, before=number + 1).groupBy("slot", self.key).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("slot", "r.*")
        # Written beside the batch's own part, under a number of its own below all batches'.
        merged = -number - 1
        self.rows.write(newest, merged)
        written = self.rows.read(spark, [{"slot": s, "batch": merged} for s in range(self.slots)])
        self._list(written, number, lambda live: live.limit(0), merged)

    def _list(self, written: DataFrame, number: int, before, name: int | None = None) -> None:
        """Filters of the written parts, then the listings: the filters' first, as they name what is opened."""
        spark, name = written.sparkSession, number if name is None else name
        keys = written.select("slot", F.xxhash64(self.key).alias("h"))
        self.filters.write(keys.groupBy("slot").applyInPandas(_filters, "bits binary, slot int"), name)
        fresh = self.filters.read(spark, [{"slot": s, "batch": name} for s in range(self.slots)]).select("slot", "batch")
        live = before(self.filters.live(spark, number)).union(fresh)
        live = spark.createDataFrame(live.collect(), self.filters.listed)  # one row a part
        self.rows.commit(live, number)
        self.filters.commit(live, number)
