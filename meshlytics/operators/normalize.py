"""From raw records to minute tables: E2 - E7, E11 - E13."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DEFAULT_TENANT, admin_state, bgp_state, minute_bucket, oper_state

#: Seconds that one counter sample stands for, and the speed of links that report none. Fixed values.
COUNTER_SECONDS, DEFAULT_SPEED = 30, 1_000_000_000
FLOW_KEY = ["ts_bucket", "device", "interface", "src_ip", "dst_ip", "protocol"]


def route(df: DataFrame, sources: DataFrame, kind: str, identifier: str = "device") -> DataFrame:
    """The tenant of the active mapping of (kind, identifier), else the default one. ``sources`` has one active row
    per identifier; Spark broadcasts it while it is small and sorts and merges beyond."""
    active = sources.where(
        F.col("is_active") & (F.col("source_kind") == kind)
    ).groupBy("source_identifier").agg(F.min("tenant_id").alias("_t"))
    return df.join(
        active, df[identifier] == active["source_identifier"], "left"
    ).withColumn("tenant_id", F.coalesce("_t", F.lit(DEFAULT_TENANT))).drop("_t", "source_identifier")


def normalize_flows(records: DataFrame, order: str = "timestamp") -> DataFrame:
    """Sampling-corrected sums per minute and key; the sampling rate is that of the last record by ``order``."""
    rows = records.select(
        minute_bucket("timestamp").alias("ts_bucket"), F.col("agent").alias("device"),
        F.col("input_if_index").cast("string").alias("interface"), "src_ip", "dst_ip", "protocol", "bytes", "packets", "sampling_rate",
        F.col(order).alias("_o")
    )
    return rows.groupBy(*FLOW_KEY).agg(
        F.sum(F.col("bytes") * F.col("sampling_rate")).alias("bytes_estimated"),
        F.sum(F.col("packets") * F.col("sampling_rate")).alias("packets_estimated"),
        F.max_by("sampling_rate", F.struct("_o", "sampling_rate")).alias("sampling_rate"),
    )


def normalize_counters(counters: DataFrame, delta: bool = False) -> DataFrame:
    """Bits a second and utilisation. Octets count as one sample's worth; with ``delta`` they are running totals."""
    rows = counters
    if delta:
        w = Window.partitionBy("agent", "if_name").orderBy("timestamp")
        rows = rows.withColumns(
            {c: F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0)) for c in ("if_in_octets", "if_out_octets")}
        ).where(F.col("if_in_octets").isNotNull())
    speed = F.when(F.col("if_speed") > 0, F.col("if_speed")).otherwise(F.lit(DEFAULT_SPEED))
    bps = lambda c: (F.col(c) * 8 / COUNTER_SECONDS).cast("bigint")
    util = lambda c: F.least(F.lit(100.0), bps(c) / speed * 100)
    return rows.select(
        minute_bucket("timestamp").alias("ts_bucket"), F.col("agent").alias("device"), F.col("if_name").alias("interface"),
        bps("if_in_octets").alias("in_bps"), bps("if_out_octets").alias("out_bps"), util("if_in_octets").alias("in_util_pct"),
        util("if_out_octets").alias("out_util_pct"),
        (F.col("if_in_errors") + F.col("if_out_errors")).alias("error_count"),
        *[c for c in ("event_id",) if c in counters.columns],
    )


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts_bucket", minute_bucket("timestamp")).drop("timestamp")


def normalize_interface_state(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """E5."""
    rows = rows.withColumns({"admin_status": admin_state("admin_status"), "oper_status": oper_state("oper_status")})
    return route(_bucketed(rows), sources, "gnmi")


def normalize_bgp_neighbors(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """E6."""
    return route(_bucketed(rows.withColumn("session_state", bgp_state("session_state"))), sources, "gnmi")


def normalize_queue_stats(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """E7."""
    return route(_bucketed(rows), sources, "gnmi")


def backfill_tenant(df: DataFrame) -> DataFrame:
    """E11."""
    return df.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(DEFAULT_TENANT)))


def backfill_fingerprint(events: DataFrame) -> DataFrame:
    """Old events get an MD5 fingerprint and count as seen and resolved at their time."""
    old = F.col("fingerprint").isNull()
    key = F.md5(F.concat_ws("|", F.coalesce("tenant_id", F.lit("")), F.coalesce("anomaly_type", F.lit("")), F.coalesce("scope", F.lit(""))))
    return events.withColumns(
        {
            "fingerprint": F.coalesce("fingerprint", key),
            **{c: F.when(old, F.col("ts")).otherwise(F.col(c)) for c in ("first_seen_at", "last_seen_at", "resolved_at")}
        }
    )


def list_sources(sources: DataFrame, tenants: DataFrame) -> DataFrame:
    """E13."""
    named = tenants.select(F.col("id").alias("tenant_id"), F.col("slug").alias("tenant_slug"))
    return sources.join(named, "tenant_id").select(
        "source_kind", "source_identifier", "tenant_slug", "is_active"
    ).orderBy("source_kind", "source_identifier")
