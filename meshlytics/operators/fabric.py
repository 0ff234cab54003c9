"""Fabric balance: Q12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import peak, trailing

#: Fixed values.
MIN_MEAN_PCT, CV_LIMIT, RATIO_LIMIT = 5.0, 0.30, 1.5
SPEEDS = [(400_000_000_000, "400G"), (100_000_000_000, "100G"), (25_000_000_000, "25G"), (10_000_000_000, "10G"), (1_000_000_000, "1G")]


def member_utilization(utilization: DataFrame, as_of: Column, window_minutes: int) -> DataFrame:
    """The average of each interface, rounded to two places as further figures are made of it."""
    rows = utilization.where(trailing("ts_bucket", as_of, window_minutes))
    return rows.groupBy("tenant_id", "device", "interface").agg(F.round(F.avg(peak()), 2).alias("avg_util_pct"))


def speed_name(bps: Column) -> Column:
    out = F.concat(bps.cast("string"), F.lit("bps"))
    for least, name in reversed(SPEEDS):
        out = F.when(bps >= least, name).otherwise(out)
    return out


def infer_groups(state: DataFrame, as_of: Column, window_minutes: int = 60) -> DataFrame:
    """Interfaces of a device that are up and of one speed, two at least."""
    up = state.where(trailing("ts_bucket", as_of, window_minutes) & (F.col("oper_status") == "UP")).select(
        "tenant_id", "device", "interface", F.coalesce("speed_bps", F.lit(0)).alias("speed")
    ).distinct()
    groups = up.groupBy("tenant_id", "device", "speed").agg(
        F.sort_array(F.collect_list("interface")).alias("members")
    ).where(F.size("members") >= 2)
    return groups.select(
        "tenant_id", "device", F.concat(F.lit("auto-"), speed_name(F.col("speed"))).alias("group_name"), "members",
        F.lit("inferred_by_speed").alias("source")
    )


def resolve_groups(configured: DataFrame, inferred: DataFrame) -> DataFrame:
    """A device's configured groups if it has any, else those inferred."""
    own = configured.select("tenant_id", "device", "group_name", "members", F.lit("configured").alias("source"))
    return own.unionByName(inferred.join(own.select("tenant_id", "device").distinct(), ["tenant_id", "device"], "left_anti"))


def group_imbalance(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Q12d: spread and ratio of each group's members that have a utilisation, two at least."""
    rows = groups.withColumn("interface", F.explode("members")).join(members, ["tenant_id", "device", "interface"])
    u = F.col("avg_util_pct")
    sums = rows.groupBy("tenant_id", "device", "group_name", "source").agg(
        F.count("*").alias("n_members"), F.avg(u).alias("mean_util_pct"), F.max(u).alias("max_util_pct"), F.stddev_pop(u).alias("_sd"),
        F.sort_array(F.collect_list(F.struct("interface", "avg_util_pct"))).alias("members"),
    ).where("n_members >= 2")
    low = F.col("mean_util_pct") < MIN_MEAN_PCT
    out = sums.withColumns(
        {
            "cv": F.when(low, 0.0).otherwise(F.col("_sd") / F.col("mean_util_pct")),
            "max_mean_ratio": F.when(low, 1.0).otherwise(F.col("max_util_pct") / F.col("mean_util_pct"))
        }
    )
    flagged = ~low & ((F.col("cv") > CV_LIMIT) | (F.col("max_mean_ratio") > RATIO_LIMIT))
    return out.withColumns(
        {"is_imbalanced": flagged, "reason": F.when(low, "below_min_util").when(flagged, "imbalanced").otherwise("balanced")}
    ).drop("_sd")


def overall_severity(groups: DataFrame) -> DataFrame:
    """Q12e: per tenant, by the worst rounded ratio of flagged groups."""
    worst = F.max(F.when(F.col("is_imbalanced"), F.round("max_mean_ratio", 2)))
    rows = groups.groupBy("tenant_id").agg(worst.alias("_w"), F.sum(F.col("is_imbalanced").cast("int")).alias("n_imbalanced"))
    return rows.select(
        "tenant_id", "n_imbalanced", F.when(F.col("_w") >= 3, "high").when(F.col("_w") >= 2, "medium").otherwise("low").alias("severity")
    )
