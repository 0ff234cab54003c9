"""Flow questions: Q1, Q3, Q4, Q5. All tenants at once; a tenant or scope is a filter before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.columns import flow_scope, half_open, peak, protocol_name, share, trailing

PAIR = ["src_ip", "dst_ip", "protocol"]


def _top(groups: DataFrame, by: list[str], k: int, value: str = "bytes_estimated") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(value), *PAIR)
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_talkers(flows: DataFrame, as_of: Column, window_minutes: int, scope: str = "global", limit: int = 10) -> DataFrame:
    """tenant_id, rank, pair, bytes_estimated, avg_sampling_rate, protocol_name, pct_of_total (of the rows returned)."""
    rows = flow_scope(flows.where(trailing("ts_bucket", as_of, window_minutes)), scope)
    groups = rows.groupBy("tenant_id", *PAIR).agg(
        F.sum("bytes_estimated").alias("bytes_estimated"), F.avg("sampling_rate").alias("avg_sampling_rate")
    )
    total = F.sum("bytes_estimated").over(Window.partitionBy("tenant_id"))
    return _top(groups, ["tenant_id"], limit).withColumns(
        {"protocol_name": protocol_name(), "pct_of_total": share(F.col("bytes_estimated"), total)}
    )


def protocol_breakdown(talkers: DataFrame) -> DataFrame:
    """The share of each protocol name in the rows of Q1a."""
    total = F.sum("bytes_estimated").over(Window.partitionBy("tenant_id"))
    rows = talkers.groupBy("tenant_id", "protocol_name").agg(F.sum("bytes_estimated").alias("bytes_estimated"))
    return rows.withColumn("fraction", share(F.col("bytes_estimated"), total, 1.0))


def talkers_note(talkers: DataFrame, tenants: DataFrame) -> DataFrame:
    """A note per tenant of ``tenants`` (column tenant_id)."""
    rate = F.avg("avg_sampling_rate").cast("bigint")
    notes = talkers.groupBy("tenant_id").agg(rate.alias("avg_sr"))
    text = F.format_string(
        "Avg sampling rate 1:%d. Volume estimates carry ~±%d%% uncertainty.", F.col("avg_sr"),
        F.least(F.lit(50), F.floor(F.col("avg_sr") / 20).cast("int"))
    )
    return tenants.select("tenant_id").join(notes, "tenant_id", "left").select(
        "tenant_id",
        F.coalesce(F.when(F.col("avg_sr").isNotNull(), text), F.lit("No flow data in requested window.")).alias("confidence_note")
    )


def protocol_mix(flows: DataFrame, as_of: Column, window_minutes: int, scope: str = "global") -> DataFrame:
    """Q3: bytes, packets and share of the window by protocol."""
    rows = flow_scope(flows.where(trailing("ts_bucket", as_of, window_minutes)), scope)
    groups = rows.groupBy("tenant_id", "protocol").agg(
        F.sum("bytes_estimated").alias("bytes_estimated"), F.sum("packets_estimated").alias("packets_estimated")
    )
    total = F.sum("bytes_estimated").over(Window.partitionBy("tenant_id"))
    return groups.withColumns({"protocol_name": protocol_name(), "pct_of_bytes": share(F.col("bytes_estimated"), total)})


def protocol_headline(mix: DataFrame, window_minutes: int) -> DataFrame:
    """Q3: one sentence per tenant; ties of the largest go to the smaller protocol number."""
    first = F.max_by(F.struct("protocol_name", "pct_of_bytes"), F.struct("bytes_estimated", -F.col("protocol"))).alias("top")
    rows = mix.groupBy("tenant_id").agg(first, F.count("*").alias("n"))
    return rows.select(
        "tenant_id",
        F.format_string(
            f"%s dominates at %.1f%% of traffic over the last {window_minutes} min across %d protocols.", "top.protocol_name",
            "top.pct_of_bytes", "n"
        ).alias("plain_summary")
    )


def link_peak(utilization: DataFrame, as_of: Column, window_minutes: int) -> DataFrame:
    """Of each link the first sample of largest utilisation, and how many samples there were."""
    rows = utilization.where(trailing("ts_bucket", as_of, window_minutes)).withColumn("u", peak())
    first = F.max_by("ts_bucket", F.struct("u", -F.unix_micros("ts_bucket"))).alias("peak_ts")
    return rows.groupBy("tenant_id", "device", "interface").agg(F.max("u").alias("peak_util_pct"), first, F.count("*").alias("n_samples"))


def link_contributors(flows: DataFrame, as_of: Column, window_minutes: int, limit: int = 5) -> DataFrame:
    """Of each link its largest pairs and their share of the pairs returned."""
    link = ["tenant_id", "device", "interface"]
    groups = flows.where(trailing("ts_bucket", as_of, window_minutes)).groupBy(*link, *PAIR).agg(
        F.sum("bytes_estimated").alias("bytes_estimated")
    )
    total = F.sum("bytes_estimated").over(Window.partitionBy(*link))
    return _top(groups, link, limit).withColumns({"protocol_name": protocol_name(), "pct_of_link": share(F.col("bytes_estimated"), total)})


def hot_links(peaks: DataFrame, contributors: DataFrame) -> DataFrame:
    """Peak, narrative and note of each link that has samples or flows."""
    link = ["tenant_id", "device", "interface"]
    top = contributors.groupBy(*link).agg(
        F.min_by(F.struct("src_ip", "dst_ip", "protocol_name", "pct_of_link"), "rank").alias("top"), F.count("*").alias("n_flows")
    )
    rows = peaks.join(top, link, "full_outer").withColumns(
        {
            "peak_util_pct": F.coalesce("peak_util_pct", F.lit(0.0)), "n_samples": F.coalesce("n_samples", F.lit(0)),
            "n_flows": F.coalesce("n_flows", F.lit(0))
        }
    )
    seen = F.format_string(
        texts.LINK_PEAK, "interface", "device", "peak_util_pct", "top.src_ip", "top.dst_ip", "top.protocol_name", "top.pct_of_link"
    )
    none = F.format_string(texts.NO_FLOWS, "device", "interface")
    note = F.format_string(texts.DERIVED_FROM, "n_samples", "n_flows")
    return rows.select(
        *link, "peak_util_pct", "peak_ts", F.when(F.col("n_flows") > 0, seen).otherwise(none).alias("narrative"),
        note.alias("confidence_note")
    )


def compare_windows(flows: DataFrame, baseline: tuple[Column, Column], current: tuple[Column, Column], scope: str = "global") -> DataFrame:
    """Q5: the bytes of two half-open windows in one pass, their change in per cent (of the rounded figure: direction)."""
    in_b, in_c = half_open("ts_bucket", *baseline), half_open("ts_bucket", *current)
    rows = flow_scope(flows.where(in_b | in_c), scope)
    of = lambda which: F.coalesce(F.sum(F.when(which, F.col("bytes_estimated"))), F.lit(0)).cast("bigint")
    sums = rows.groupBy("tenant_id").agg(of(in_b).alias("baseline_bytes"), of(in_c).alias("current_bytes"))
    delta = F.when(
        F.col("baseline_bytes") > 0, (F.col("current_bytes") - F.col("baseline_bytes")) / F.col("baseline_bytes") * 100
    ).otherwise(F.lit(0.0))
    rounded = F.round(delta, 1)
    return sums.withColumns(
        {"delta_bytes_pct": delta, "direction": F.when(rounded > 5, "increase").when(rounded < -5, "decrease").otherwise("stable")}
    )
