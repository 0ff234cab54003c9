"""Inventory listings: Q8, Q9, Q11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trailing

DAY = 1440


def list_devices(utilization: DataFrame, as_of: Column, window_minutes: int = DAY) -> DataFrame:
    """Q8."""
    rows = utilization.where(trailing("ts_bucket", as_of, window_minutes))
    return rows.groupBy("tenant_id", "device").agg(
        F.max("ts_bucket").alias("last_seen"), F.countDistinct("interface").alias("interface_count")
    )


def list_interfaces(utilization: DataFrame, flows: DataFrame, as_of: Column, window_minutes: int = DAY) -> DataFrame:
    """Q9: interfaces with counters, and those that only flows name."""
    key = ["tenant_id", "device", "interface"]
    seen = utilization.where(trailing("ts_bucket", as_of, window_minutes)).groupBy(*key).agg(
        F.max("in_util_pct").alias("peak_in_util_pct"), F.max("out_util_pct").alias("peak_out_util_pct"),
        F.max("ts_bucket").alias("last_seen")
    )
    only = flows.where(trailing("ts_bucket", as_of, window_minutes)).select(*key).distinct().join(seen, key, "left_anti")
    none = {c: F.lit(None).cast(seen.schema[c].dataType) for c in ("peak_in_util_pct", "peak_out_util_pct", "last_seen")}
    return seen.withColumn("source", F.lit("counters")).unionByName(only.withColumns(none).withColumn("source", F.lit("flows_only")))


def list_state_sources(state: DataFrame, as_of: Column, window_minutes: int = DAY) -> DataFrame:
    """Q11."""
    return state.where(trailing("ts_bucket", as_of, window_minutes)).select("tenant_id", "device").distinct()
