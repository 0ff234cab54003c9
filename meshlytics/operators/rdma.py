"""RDMA health: Q13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.columns import share, trailing
from .state import queue_sums

UDP, SUSTAINED_PFC, HIGH_SHARE = 17, 1000, 0.5


def udp_share(flows: DataFrame, as_of: Column, window_minutes: int) -> DataFrame:
    """Both sums in one pass."""
    rows = flows.where(trailing("ts_bucket", as_of, window_minutes))
    sums = rows.groupBy("tenant_id").agg(
        F.coalesce(F.sum(F.when(F.col("protocol") == UDP, F.col("bytes_estimated"))), F.lit(0)).cast("bigint").alias("udp_bytes"),
        F.sum("bytes_estimated").alias("total_bytes")
    )
    return sums.withColumn("roce_share", share(F.col("udp_bytes"), F.col("total_bytes"), 1.0))


def top_udp_pairs(flows: DataFrame, as_of: Column, window_minutes: int, limit: int = 10) -> DataFrame:
    """Q13b."""
    rows = flows.where(trailing("ts_bucket", as_of, window_minutes) & (F.col("protocol") == UDP))
    groups = rows.groupBy("tenant_id", "src_ip", "dst_ip").agg(F.sum("bytes_estimated").alias("bytes_estimated"))
    w = Window.partitionBy("tenant_id").orderBy(F.desc("bytes_estimated"), "src_ip", "dst_ip")
    return groups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def queues_with_signals(queues: DataFrame, as_of: Column, window_minutes: int, device: str | None = None) -> DataFrame:
    """Q13c."""
    sums = queue_sums(queues if device is None else queues.where(F.col("device") == device), as_of, window_minutes)
    return sums.where(
        (F.col("pfc_pause_rx") != 0) | (F.col("pfc_pause_tx") != 0) | (F.col("ecn_marked_packets") != 0) | (F.col("dropped_packets") != 0)
    )


def assess(shares: DataFrame, signals: DataFrame) -> DataFrame:
    """Q13d: severity and drivers per tenant of ``shares`` (Q13a), by the first rule that holds."""
    pfc, drops = F.col("pfc_pause_rx") + F.col("pfc_pause_tx"), F.col("dropped_packets") > 0
    count = lambda c: F.sum(c.cast("int"))
    counts = signals.groupBy("tenant_id").agg(
        F.count("*").alias("q"), count(drops & ((F.col("pfc_pause_rx") != 0) | (F.col("pfc_pause_tx") != 0))).alias("lossless"),
        count(drops).alias("lossy"), count(pfc > SUSTAINED_PFC).alias("sustained"), count(F.col("ecn_marked_packets") > 0).alias("ecn"),
    )
    rows = shares.join(counts, "tenant_id", "left").fillna(0, ["q", "lossless", "lossy", "sustained", "ecn"])
    n = lambda c: F.col(c) > 0
    severity = F.when(n("lossless"), "critical").when(n("sustained"), "high").when(n("ecn"), "medium").otherwise("low")
    main = (
        F.when(n("lossless"), F.format_string(texts.LOSSLESS_DROP, "lossless"))
        .when(n("sustained"), F.format_string(texts.SUSTAINED_PAUSES, "sustained"))
        .when(n("ecn"), F.format_string(texts.ECN_ACTIVE, "ecn"))
        .when(n("q"), F.lit(texts.BELOW_THRESHOLDS))
        .when(F.col("roce_share") > HIGH_SHARE, F.format_string(texts.HIGH_UDP_SHARE, F.col("roce_share") * 100))
        .otherwise(F.lit(texts.NO_STRESS))
    )
    lossy = F.when(~n("lossless") & n("lossy"), F.format_string(texts.LOSSY_DROPS, "lossy"))
    return rows.select(
        "tenant_id", "roce_share", severity.alias("severity"), F.filter(F.array(lossy, main), lambda x: x.isNotNull()).alias("drivers")
    )
