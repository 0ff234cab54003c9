"""Source freshness: Q17."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fingerprint

#: Seconds after which a source is stale, and how many times that makes it silent. Fixed values.
STALE_SECONDS, OTHER_SECONDS, SILENT_TIMES = {"sflow": 180, "gnmi": 90}, 300, 5
KEY = ["tenant_id", "source_kind", "device"]


def heartbeats(ingested: DataFrame) -> DataFrame:
    """The last ingest of each source and its sample count; ties of time go to the larger count."""
    return ingested.groupBy(*KEY).agg(
        F.max("ts").alias("last_ingest_ts"), F.max_by("sample_count", F.struct("ts", "sample_count")).alias("last_sample_count")
    ).withColumn("status", F.lit("fresh"))


def merge_heartbeats(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The upsert; the newer heartbeat of a source stands."""
    both = stored.unionByName(new)
    last = F.max_by(F.struct("last_ingest_ts", "last_sample_count", "status"), F.struct("last_ingest_ts", "last_sample_count")).alias("r")
    return both.groupBy(*KEY).agg(last).select(*KEY, "r.*")


def classify(as_of: Column, last: Column, kind: Column, scale: int = 1) -> Column:
    """Q17b; ``scale`` stretches the thresholds."""
    limit = F.lit(OTHER_SECONDS * scale)
    for name, seconds in STALE_SECONDS.items():
        limit = F.when(kind == name, seconds * scale).otherwise(limit)
    age = F.unix_micros(as_of) - F.unix_micros(last)
    limit = limit.cast("bigint") * 1_000_000
    return F.when(age >= limit * SILENT_TIMES, "silent").when(age >= limit, "stale").otherwise("fresh")


def scan(sources: DataFrame, as_of: Column, scale: int = 1) -> DataFrame:
    """All sources with their status now."""
    return sources.withColumn("status", classify(as_of, F.col("last_ingest_ts"), F.col("source_kind"), scale))


def silent_events(scanned: DataFrame, as_of: Column) -> DataFrame:
    """A critical event per silent source, ready for Q16b."""
    when = F.date_format("last_ingest_ts", "yyyy-MM-dd'T'HH:mm:ss")
    cause = F.to_json(F.struct("device", "source_kind"))
    rows = scanned.where(F.col("status") == "silent").withColumns({
        "ts": as_of, "anomaly_type": F.lit("collector_silent"), "severity": F.lit("critical"),
        "scope": F.concat(F.lit("device:"), "device"),
        "summary": F.format_string("%s collector for %s has not ingested since %s", F.col("source_kind"), F.col("device"), when),
        "metadata_json": F.to_json(F.struct(when.alias("last_ingest_ts"), "last_sample_count")), "_cause": cause,
    })
    return rows.withColumn("fingerprint", fingerprint("tenant_id", "anomaly_type", "scope", F.col("_cause"))).select(
        "tenant_id", "ts", "anomaly_type", "severity", "scope", "summary", "metadata_json", "fingerprint"
    )


def listing(sources: DataFrame, status_in: str | None = None) -> DataFrame:
    """Q17d: ``status_in`` is a comma list."""
    wanted = [x.strip() for x in (status_in or "").split(",") if x.strip()]
    return sources.where(F.col("status").isin(wanted)) if wanted else sources
