"""Device state: Q10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.columns import trailing, within


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by ``order``; an aggregate, so each task sends one row of a key. ``order`` should leave no tie."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(last.alias("_last")).select(*[F.col(c) if c in key else F.col("_last")[c].alias(c) for c in rows.columns])


def latest_interfaces(state: DataFrame, as_of: Column, window_minutes: int = 15, order: tuple[str, ...] = ("ts_bucket",)) -> DataFrame:
    """Q10a."""
    return latest(state.where(trailing("ts_bucket", as_of, window_minutes)), ["tenant_id", "device", "interface"], list(order))


def interfaces_down(latest_rows: DataFrame) -> DataFrame:
    """Q10b."""
    return latest_rows.where((F.col("admin_status") == "UP") & (F.col("oper_status") != "UP"))


def latest_bgp(sessions: DataFrame, as_of: Column, window_minutes: int = 15, order: tuple[str, ...] = ("ts_bucket",)) -> DataFrame:
    """Q10c, with ``is_down``."""
    rows = latest(sessions.where(trailing("ts_bucket", as_of, window_minutes)), ["tenant_id", "device", "peer_address"], list(order))
    return rows.withColumn("is_down", F.col("session_state") != "ESTABLISHED")


def queue_sums(queues: DataFrame, as_of: Column, window_minutes: int) -> DataFrame:
    rows = queues.where(trailing("ts_bucket", as_of, window_minutes))
    return rows.groupBy("tenant_id", "device", "interface", "queue_id").agg(
        F.max("max_depth_bytes").alias("peak_depth_bytes"), F.sum("pfc_pause_rx").alias("pfc_pause_rx"),
        F.sum("pfc_pause_tx").alias("pfc_pause_tx"),
        F.sum("ecn_marked_packets").alias("ecn_marked_packets"), F.sum("dropped_packets").alias("dropped_packets"),
    )


def device_queues(queues: DataFrame, as_of: Column, window_minutes: int = 15, limit: int = 20) -> DataFrame:
    """Q10d: of each device the queues of largest depth."""
    within("limit", limit, 1, 1000)
    w = Window.partitionBy("tenant_id", "device").orderBy(F.desc("peak_depth_bytes"), "interface", "queue_id")
    return queue_sums(queues, as_of, window_minutes).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def state_note(devices: DataFrame, tables: list[DataFrame], as_of: Column, window_minutes: int) -> DataFrame:
    """Q10e: a note for each (tenant_id, device) of ``devices``."""
    key = ["tenant_id", "device"]
    seen = None
    for t in tables:
        own = t.where(trailing("ts_bucket", as_of, window_minutes)).select(*key)
        seen = own if seen is None else seen.unionByName(own)
    rows = devices.select(*key).distinct().join(seen.distinct().withColumn("_seen", F.lit(True)), key, "left")
    none = F.format_string(
        f"No gNMI samples for %s in last {window_minutes} min — the device sends none, or it is not among the devices that are asked.",
        "device"
    )
    return rows.select(*key, F.when(F.col("_seen"), F.lit(texts.EXACT_STATE)).otherwise(none).alias("confidence_note"))
