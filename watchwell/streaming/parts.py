"""Tables of a stream that are changed part by part, and repeated batches that change nothing.

A part is a folder named by partition columns and by the batch that wrote it; it is
never changed. After each batch a listing says which parts are live, so a reader sees
whole batches only, and a batch that comes again after a failure starts from the
listing before it and writes the same folders anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Listings that are kept, for batches that come again.
_KEPT = 8


def there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Parts:
    """One table under ``folder``: rows of ``schema``, split by the ``by`` columns."""

    def __init__(self, folder: str, schema: StructType, by: StructType):
        self.folder, self.schema, self.by = folder, schema, by
        self.listed = StructType([*by.fields, StructField("batch", LongType())])

    def _listings(self, spark: SparkSession) -> list[int]:
        """Batches with a finished listing."""
        names = [n for n in _names(spark, f"{self.folder}/live") if n.startswith("batch=")]
        return sorted(int(n.removeprefix("batch=")) for n in names if there(spark, f"{self.folder}/live/{n}/_SUCCESS"))

    def live(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The live parts (by columns, batch) after all batches, or after those before a number."""
        done = [n for n in self._listings(spark) if before is None or n < before]
        return spark.read.schema(self.listed).parquet(f"{self.folder}/live/batch={done[-1]}") if done else spark.createDataFrame([], self.listed)

    def read(self, spark: SparkSession, parts: list | None = None, before: int | None = None) -> DataFrame:
        """Rows (schema, by columns, batch) of the given live parts, or of all.

        Given parts are opened by name, without a look at any other.
        """
        whole = StructType([*self.schema.fields, *self.listed.fields])
        if parts is not None:
            paths = [p for p in (self._path(x) for x in parts) if there(spark, p)]
            return spark.read.schema(whole).option("basePath", f"{self.folder}/rows").parquet(*paths) if paths else spark.createDataFrame([], whole)
        if not there(spark, f"{self.folder}/rows"):
            return spark.createDataFrame([], whole)
        # The listing has one row a part; parts are folders, so it prunes the scan.
        return spark.read.schema(whole).parquet(f"{self.folder}/rows").join(F.broadcast(self.live(spark, before)), self.listed.names, "left_semi")

    def _path(self, part) -> str:
        return "/".join([f"{self.folder}/rows", *(f"{c}={part[c]}" for c in self.listed.names)])

    def write(self, rows: DataFrame, number: int) -> None:
        """Rows (schema, by columns) as parts of a batch; parts that it wrote before are replaced."""
        named = rows.select(*self.schema.names, *self.by.names, F.lit(number).cast("long").alias("batch"))
        # A part's rows come to one file, or to several where they are many.
        named.hint("rebalance", *self.by.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.listed.names).parquet(f"{self.folder}/rows")

    def commit(self, live: DataFrame, number: int) -> None:
        """The listing after a batch; listings long before it go."""
        live.select(*self.listed.names).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/live/batch={number}")
        for old in self._listings(live.sparkSession)[:-_KEPT]:
            if old < number:
                drop(live.sparkSession, f"{self.folder}/live/batch={old}")

    def sweep(self, spark: SparkSession) -> int:
        """Deletes parts that no kept listing names; how many. Not while a batch runs."""
        kept = None
        for n in self._listings(spark):
            one = spark.read.schema(self.listed).parquet(f"{self.folder}/live/batch={n}")
            kept = one if kept is None else kept.union(one)
        if kept is None or not there(spark, f"{self.folder}/rows"):
            return 0
        all_ = spark.read.schema(self.listed).parquet(f"{self.folder}/rows").distinct()
        gone = all_.join(kept.distinct(), self.listed.names, "left_anti").collect()
        for part in gone:
            drop(spark, self._path(part))
        return len(gone)
