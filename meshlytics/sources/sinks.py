"""Sinks: K1 - K3."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import trailing, trailing_months


def with_month(df: DataFrame, ts: str = "ts_bucket") -> DataFrame:
    """K3: the partition column, an int like 202401."""
    return df.withColumn("month", F.date_format(ts, "yyyyMM").cast("int"))


def append_monthly(df: DataFrame, path: str, ts: str = "ts_bucket", mode: str = "append") -> None:
    """K1 and K3: appended to its months. Rows are brought together by month; Spark splits a large month into as many tasks as
    its size asks for, so each month gets few files, but not just one."""
    with_month(df, ts).hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(path)


def read_months(spark: SparkSession, path: str, as_of: Column, minutes: int, ts: str = "ts_bucket") -> DataFrame:
    """K3: the rows of a trailing window; months outside it are not read."""
    return spark.read.parquet(path).where(trailing_months(as_of, minutes) & trailing(ts, as_of, minutes))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], merge: dict[str, Callable] | None = None) -> DataFrame:
    """K2: rows of ``new`` over those of ``existing`` by ``key``. ``merge`` gives (old, new) -> value for columns that are
    not just replaced; both have the same columns."""
    rest = [c for c in existing.columns if c not in key]
    a, b = existing.select(*key, F.struct(*rest).alias("_a")), new.select(*key, F.struct(*rest).alias("_b"))
    both = a.join(b, key, "full_outer")
    out = []
    for c in rest:
        old, fresh = F.col("_a")[c], F.col("_b")[c]
        joint = (merge or {}).get(c, lambda x, y: y)(old, fresh)
        out.append(F.when(F.col("_b").isNull(), old).when(F.col("_a").isNull(), fresh).otherwise(joint).alias(c))
    return both.select(*key, *out)


class BucketedTable:
    """K2 without a rewrite: a keyed table in ``parts`` (folders) of ``buckets`` sorted files each, both by hash of the key.

    An upsert reads the parts that its keys fall into and joins them bucket by bucket, so the stored side is not shuffled
    (a task sorts its bucket, which is one sorted file, once more unless ``spark.sql.legacy.bucketedTableScan.outputOrdering``
    is set); it replaces just these parts, at the commit of the write. Files of other parts stay as they are. Null keys are keys like others and are kept in a part of their own
    by hash, but never match."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], parts: int = 64, buckets: int = 32):
        self.spark, self.path, self.key, self.parts, self.buckets = spark, path, key, parts, buckets
        self.name = f"bucketed_{uuid.uuid4().hex}"

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """The first rows; one of each key."""
        dealt = rows.withColumn("part", self._part()).repartition(self.buckets, *self.key)
        dealt.write.partitionBy("part").bucketBy(self.buckets, *self.key).sortBy(*self.key).option("path", self.path).format("parquet").saveAsTable(self.name)

    def stored(self, parts: list[int] | None = None) -> DataFrame:
        table = self.spark.table(self.name)
        return table if parts is None else table.where(F.col("part").isin(parts))

    def read(self) -> DataFrame:
        return self.stored().drop("part")

    def merged(self, new: DataFrame, merge: dict[str, Callable] | None = None) -> DataFrame:
        """The rows of the touched parts after the upsert."""
        touched = [r[0] for r in new.select(self._part()).distinct().collect()]  # at most as many as there are parts
        rows = upsert(self.stored(touched).drop("part"), new.select(*self.read().columns), self.key, merge)
        return rows.withColumn("part", self._part())

    def upsert(self, new: DataFrame, merge: dict[str, Callable] | None = None) -> None:
        """``new`` (one row of a key) over what is stored; see ``upsert`` for ``merge``."""
        setting, before = "spark.sql.sources.partitionOverwriteMode", self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set(setting, "dynamic")
        try:
            self.merged(new, merge).select(*self.spark.table(self.name).columns).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(setting, before)
