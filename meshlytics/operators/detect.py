"""Anomaly detectors: Q15. Each returns tenant_id, ts, scope, anomaly_type, severity, summary, metadata_json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.columns import direction, either_at_least, peak, trailing
from .baselines import latest_baseline
from .state import latest, queue_sums

#: Fixed values.
UTIL_LOW, UTIL_HIGH, UTIL_CRITICAL = 60.0, 80.0, 95.0
SPIKE_MINUTES, Z_MEDIUM, Z_HIGH, Z_CRITICAL, MIN_BASELINE = 5, 3.0, 5.0, 6.0, 3
STRESS_MINUTES, PFC_STORM, ECN_SPIKE = 5, 1000, 500
EVENT = ["tenant_id", "ts", "scope", "anomaly_type", "severity", "summary", "metadata_json"]


def threshold_breaches(utilization: DataFrame, as_of: Column, order: tuple[str, ...] = ("ts_bucket",)) -> DataFrame:
    """Interfaces whose last sample, however old, is at 60 % or more."""
    rows = latest(
        utilization.where(F.col("ts_bucket") <= as_of), ["tenant_id", "device", "interface"], list(order)
    ).where(either_at_least(UTIL_LOW))
    u = peak()
    severity = F.when(u >= UTIL_CRITICAL, "critical").when(u >= UTIL_HIGH, "high").otherwise("medium")
    return rows.select(
        "tenant_id", as_of.alias("ts"), F.concat(F.lit("device:"), "device", F.lit("/interface:"), "interface").alias("scope"),
        F.lit("threshold_breach").alias("anomaly_type"), severity.alias("severity"),
        F.format_string(texts.BREACH, F.col("interface"), F.col("device"), u, direction()).alias("summary"),
        F.to_json(
            F.struct("in_util_pct", "out_util_pct", F.date_format("ts_bucket", "yyyy-MM-dd'T'HH:mm:ss").alias("sample_ts"))
        ).alias("metadata_json"),
    )


def spike_scores(
    flows: DataFrame, baselines: DataFrame, as_of: Column, lookback_minutes: int = SPIKE_MINUTES, normalize_minutes: bool = False
) -> DataFrame:
    """The sums of the last minutes beside the baseline of the hour, and z. The baseline is of single minutes; with
    ``normalize_minutes`` the sum is divided by the minutes it spans."""
    current = flows.where(trailing("ts_bucket", as_of, lookback_minutes)).groupBy("tenant_id", "device", "interface").agg(
        F.sum("bytes_estimated").alias("current_bytes")
    )
    known = latest_baseline(baselines).where(
        (F.col("hour_of_day") == F.hour(as_of)) & (F.col("sample_count") >= MIN_BASELINE) & (F.col("stddev_value") != 0)
    )
    value = F.col("current_bytes") / (lookback_minutes if normalize_minutes else 1)
    return current.join(known, ["tenant_id", "device", "interface"]).withColumn(
        "z_score", (value - F.col("mean_value")) / F.col("stddev_value")
    )


def spikes(
    flows: DataFrame, baselines: DataFrame, as_of: Column, lookback_minutes: int = SPIKE_MINUTES, normalize_minutes: bool = False
) -> DataFrame:
    """Q15b."""
    z = F.col("z_score")
    rows = spike_scores(flows, baselines, as_of, lookback_minutes, normalize_minutes).where(z >= Z_MEDIUM)
    text = F.format_string(
        texts.SPIKE.replace("{minutes}", str(lookback_minutes)), F.col("interface"), F.col("device"), F.col("current_bytes") / 1e9,
        F.col("mean_value") / 1e9, z
    )
    return rows.select(
        "tenant_id", as_of.alias("ts"), F.concat(F.lit("device:"), "device", F.lit("/interface:"), "interface").alias("scope"),
        F.lit("spike").alias("anomaly_type"),
        F.when(z >= Z_CRITICAL, "critical").when(z >= Z_HIGH, "high").otherwise("medium").alias("severity"), text.alias("summary"),
        F.to_json(
            F.struct(
                F.round(z, 2).alias("z_score"), "current_bytes", F.col("mean_value").alias("baseline_mean"),
                F.col("stddev_value").alias("baseline_stddev"), F.col("sample_count").alias("baseline_sample_count")
            )
        ).alias("metadata_json"),
    )


def rdma_stress(queues: DataFrame, as_of: Column, lookback_minutes: int = STRESS_MINUTES) -> DataFrame:
    """A queue is lossless_drop and nothing else, or pfc_storm and/or ecn_spike."""
    rows = queue_sums(queues, as_of, lookback_minutes).withColumn("pfc", F.col("pfc_pause_rx") + F.col("pfc_pause_tx"))
    pfc, ecn, drops = F.col("pfc"), F.col("ecn_marked_packets"), F.col("dropped_packets")
    lossless = (drops > 0) & (pfc > 0)

    def event(kind, severity, text, *data):
        return F.struct(
            F.lit(kind).alias("anomaly_type"), F.lit(severity).alias("severity"), text.alias("summary"),
            F.to_json(F.struct(*data)).alias("metadata_json")
        )

    drop = event(
        "lossless_drop", "critical",
        F.format_string(texts.QUEUE_DROP.replace("{minutes}", str(lookback_minutes)), "queue_id", "interface", "device", drops, pfc),
        drops.alias("drops"), pfc.alias("pfc_total"), ecn.alias("ecn_marks")
    )
    storm = event(
        "pfc_storm", "high",
        F.format_string(texts.QUEUE_STORM.replace("{minutes}", str(lookback_minutes)), "queue_id", "interface", "device", pfc),
        F.col("pfc_pause_rx").alias("pfc_rx"), F.col("pfc_pause_tx").alias("pfc_tx"), F.lit(PFC_STORM).alias("threshold")
    )
    spike = event(
        "ecn_spike", "medium",
        F.format_string(texts.QUEUE_ECN.replace("{minutes}", str(lookback_minutes)), "queue_id", "interface", "device", ecn),
        ecn.alias("ecn_marks"), F.lit(ECN_SPIKE).alias("threshold")
    )
    found = F.filter(
        F.array(F.when(lossless, drop), F.when(~lossless & (pfc >= PFC_STORM), storm), F.when(~lossless & (ecn >= ECN_SPIKE), spike)),
        lambda e: e.isNotNull()
    )
    scope = F.format_string("device:%s/interface:%s/queue:%d", "device", "interface", "queue_id")
    return rows.withColumn("e", F.explode(found)).select("tenant_id", as_of.alias("ts"), scope.alias("scope"), "e.*").select(*EVENT)


def run_all(
    utilization: DataFrame, flows: DataFrame, queues: DataFrame, baselines: DataFrame, tenants: DataFrame, as_of: Column,
    lookback_minutes: int = SPIKE_MINUTES, order: tuple[str, ...] = ("ts_bucket",)
) -> DataFrame:
    """Q15d: all detectors for active tenants."""
    events = threshold_breaches(utilization, as_of, order).unionByName(
        spikes(flows, baselines, as_of, lookback_minutes)
    ).unionByName(rdma_stress(queues, as_of, lookback_minutes))
    return events.join(tenants.where("is_active").select(F.col("id").alias("tenant_id")), "tenant_id", "left_semi")


def event_counts(events: DataFrame) -> DataFrame:
    """Q15e."""
    return events.groupBy("tenant_id", "anomaly_type", "severity").agg(F.count("*").alias("n"))
