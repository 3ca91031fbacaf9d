"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from watchwell.sources.tables import shared_dir, stored

__all__ = ["appended", "bucket_of", "bucket_of_py", "shared_dir", "stored", "table"]

#: Rows of an Arrow batch that are Python objects at one time.
_SLICE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null: as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def bucket_of_py(key, n: int) -> int:
    """bucket_of() for a Python value."""
    return zlib.crc32(("" if key is None else str(key)).encode()) % n


def appended(df: DataFrame, column: str, schema: str, compute: Callable[[list], list[list]]) -> DataFrame:
    """``df`` with new columns that ``compute`` makes from the values of ``column``, batch by batch.

    schema: the new columns ("a long, b string"); compute: from the values to one
    list per new column. A column of ``df`` with a new column's name is replaced.
    """
    new = StructType.fromDDL(schema)
    df = df.drop(*(f.name for f in new if f.name != column))
    whole = StructType([*df.schema.fields, *new.fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(new)]
        for whole in batches:
            at = whole.schema.get_field_index(column)
            for a in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(a, _SLICE)
                lists = compute(batch.column(at).to_pylist())
                made = [pa.array(x, type=k) for x, k in zip(lists, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, whole)
