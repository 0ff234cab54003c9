"""Rolling baselines: Q14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trailing

WEEK_MINUTES, MIN_SAMPLES = 7 * 24 * 60, 3


def compute_baselines(flows: DataFrame, as_of: Column, window_minutes: int = WEEK_MINUTES, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Mean and population deviation of the bytes a minute of each interface and hour of the day."""
    minutes = flows.where(trailing("ts_bucket", as_of, window_minutes)).groupBy(
        "tenant_id", "device", "interface", "ts_bucket"
    ).agg(F.sum("bytes_estimated").alias("b"))
    hours = minutes.groupBy("tenant_id", "device", "interface", F.hour("ts_bucket").alias("hour_of_day"))
    out = hours.agg(
        F.avg("b").alias("mean_value"), F.stddev_pop("b").alias("stddev_value"), F.count("*").alias("sample_count")
    ).where(F.col("sample_count") >= min_samples)
    return out.withColumns({"metric": F.lit("bytes"), "computed_at": as_of})


def latest_baseline(baselines: DataFrame) -> DataFrame:
    """Of snapshots of one key the last one computed."""
    key = ["tenant_id", "device", "interface", "hour_of_day"]
    last = F.max_by(F.struct("mean_value", "stddev_value", "sample_count"), "computed_at").alias("b")
    return baselines.groupBy(*key).agg(last).select(*key, "b.mean_value", "b.stddev_value", "b.sample_count")


# Q14 by parts: a table of moments an hour, which merge ----------------------------------------------------------------
LINK = ["tenant_id", "device", "interface"]


def hourly_moments(flows: DataFrame) -> DataFrame:
    """``n``, ``mean`` and ``m2`` (sum of squared deviations) of the bytes a minute of each interface and ``hour``."""
    minutes = flows.groupBy(*LINK, "ts_bucket").agg(F.sum("bytes_estimated").alias("b"))
    return minutes.groupBy(*LINK, F.date_trunc("hour", "ts_bucket").alias("hour")).agg(
        F.count("b").alias("n"), F.avg("b").alias("mean"), (F.var_pop("b") * F.count("b")).alias("m2")
    )


def refresh_moments(flows: DataFrame, path: str, days: list[str]) -> None:
    """Recomputes the moments of whole days (yyyy-MM-dd) and replaces just these in the table at ``path``: the current day, and
    days for which late rows have come. Only their rows are read."""
    wanted = F.lit(False)
    for day in days:
        wanted |= (F.col("ts_bucket") >= F.lit(day).cast("timestamp")) & (
            F.col("ts_bucket") < F.lit(day).cast("timestamp") + F.make_dt_interval(days=F.lit(1))
        )
    rows = hourly_moments(flows.where(wanted)).withColumn("day", F.to_date("hour"))
    rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged_moments(parts):
    """The moments of all together, from an array of them (n, mean, m2), by Chan's formula."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a, x):
        n, d = a["n"] + x["n"], x["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + d * x["n"] / n).alias("mean"), (a["m2"] + x["m2"] + d * d * a["n"] * x["n"] / n).alias("m2")
        )

    return F.aggregate(F.filter(parts, lambda x: x["n"] > 0), start, step)


def baselines_from_moments(
    moments: DataFrame, flows: DataFrame, as_of: Column, window_minutes: int = WEEK_MINUTES, min_samples: int = MIN_SAMPLES
) -> DataFrame:
    """``compute_baselines`` from the table of moments: the hours that the window holds whole are merged (as many rows of an
    interface and hour of the day as the window has days); of ``flows`` only the two hours at its ends are read."""
    start = as_of - F.make_dt_interval(mins=F.lit(window_minutes))
    whole = lambda hour: (hour >= start) & (hour + F.make_dt_interval(mins=F.lit(59)) <= as_of)
    ends = (
        F.col("ts_bucket") < F.date_trunc("hour", start) + F.make_dt_interval(hours=F.lit(1))
    ) | (F.col("ts_bucket") >= F.date_trunc("hour", as_of))
    rest = flows.where(trailing("ts_bucket", as_of, window_minutes) & ends & ~whole(F.date_trunc("hour", "ts_bucket")))
    day = F.col("day").between(F.to_date(start), F.to_date(as_of))
    kept = moments.where(day & whole(F.col("hour"))).drop("day")
    hours = kept.unionByName(hourly_moments(rest)).groupBy(*LINK, F.hour("hour").alias("hour_of_day"))
    all_ = hours.agg(merged_moments(F.collect_list(F.struct("n", "mean", "m2"))).alias("x"))
    out = all_.select(
        *LINK, "hour_of_day", F.col("x.mean").alias("mean_value"), F.sqrt(F.col("x.m2") / F.col("x.n")).alias("stddev_value"),
        F.col("x.n").alias("sample_count")
    )
    return out.where(F.col("sample_count") >= min_samples).withColumns({"metric": F.lit("bytes"), "computed_at": as_of})
