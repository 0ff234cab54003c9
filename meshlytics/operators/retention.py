"""Retention by month: Q18."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import delete, matching

#: Days kept. Fixed values.
RETENTION_DAYS = {"flow_summary_minute": 90, "interface_utilization_minute": 180, "queue_stats_minute": 30}


def oldest_kept(as_of: Column, days: int) -> Column:
    """The first month kept, as yyyyMM."""
    return F.date_format(F.date_trunc("month", as_of - F.make_dt_interval(days=F.lit(days))), "yyyyMM").cast("int")


def keep(table: DataFrame, as_of: Column, days: int, ts: str = "ts_bucket") -> DataFrame:
    """Q18: what stays. On a table laid out by month the filter on ``month`` skips whole folders."""
    month = F.col("month").cast("int") if "month" in table.columns else F.date_format(ts, "yyyyMM").cast("int")
    return table.where(month >= oldest_kept(as_of, days))


def dropped_months(table: DataFrame, as_of: Column, days: int, ts: str = "ts_bucket") -> DataFrame:
    """Q18: months to drop and their rows."""
    month = F.date_format(ts, "yyyyMM").cast("int")
    return table.where(month < oldest_kept(as_of, days)).groupBy(month.alias("month")).agg(F.count("*").alias("n_rows"))


def drop_months(spark: SparkSession, path: str, as_of: Column, days: int) -> DataFrame:
    """Q18: deletes the old months of a table laid out by month (K3, also below the batch folders of ST3) and returns them with
    their ``n_rows``. Months are folders, so none of their rows is read (they are counted by the files' footers) and files of
    months that stay are not touched. Run again, or after a run that was cut short, it deletes what is left to delete."""
    first = spark.range(1).select(oldest_kept(as_of, days)).first()[0]
    found = {
        x: int(m[1]) for p in (
            f"{path}/month=*", f"{path}/batch=*/month=*"
        ) for x in matching(spark, p) if (m := re.search(r"month=(\d{6})$", x))
    }
    old = {x: month for x, month in found.items() if month < first}
    counts: dict[int, int] = {}
    for folder, month in sorted(old.items()):
        counts[month] = counts.get(month, 0) + spark.read.parquet(folder).count()
    for folder in old:
        delete(spark, folder)
    return spark.createDataFrame(sorted(counts.items()), "month int, n_rows long")


def prune(spark: SparkSession, tables: dict[str, str], as_of: Column) -> DataFrame:
    """Q18: ``drop_months`` of each table (name: path) by its ``RETENTION_DAYS``; a row per table and month dropped."""
    out = spark.createDataFrame([], "table string, month int, n_rows long")
    for name, path in tables.items():
        out = out.unionByName(drop_months(spark, path, as_of, RETENTION_DAYS[name]).select(F.lit(name).alias("table"), "month", "n_rows"))
    return out
