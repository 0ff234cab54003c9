"""Interface questions: Q2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import direction, peak, trailing

LINK = ["tenant_id", "device", "interface"]
BREACH_PCT, TREND_PCT = 80.0, 5.0


#: Seconds of a block of samples; a link's samples are ranked by block.
BLOCK_SECONDS = 3600


def interface_utilization(
    utilization: DataFrame, as_of: Column, window_minutes: int, order: str = "ts_bucket", trend: bool = True
) -> DataFrame:
    """Averages, maxima and trend of every interface; ``order`` tells rows of one minute apart.

    The trend compares the later half of a link's samples with the earlier one. Samples are counted by blocks of time, whose
    running counts tell which blocks are of which half; only the block in which the halves meet is ranked row by row, so no
    task sorts all samples of a link."""
    u = peak()
    rows = utilization.where(trailing("ts_bucket", as_of, window_minutes)).withColumns(
        {"_u": u, "_b": F.floor(F.unix_seconds("ts_bucket") / BLOCK_SECONDS)}
    )
    blocks = rows.groupBy(*LINK, "_b").agg(
        F.count("*").alias("_n"), F.sum("_u").alias("_s"), F.count("_u").alias("_k"),
        *[f(c).alias(f"_{n}_{c}") for c in ("in_util_pct", "out_util_pct") for n, f in (("sum", F.sum), ("count", F.count), ("max", F.max))],
    )
    stats = [
        x for c in ("in", "out") for x in (
            (F.sum(f"_sum_{c}_util_pct") / F.sum(f"_count_{c}_util_pct")).alias(f"avg_{c}_util_pct"),
            F.max(f"_max_{c}_util_pct").alias(f"max_{c}_util_pct")
        )
    ]
    stats.append(F.sum("_n").alias("n_samples"))
    if not trend:
        return blocks.groupBy(*LINK).agg(*stats)
    link = Window.partitionBy(*LINK)
    before = F.coalesce(F.sum("_n").over(link.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"_before": before, "_half": F.floor(F.sum("_n").over(link) / 2)})
    early, late = F.col("_before") + F.col("_n") <= F.col("_half"), F.col("_before") >= F.col("_half")
    halves = lambda of, s, k: [
        F.sum(F.when(c, x)).alias(f"{of}_{h}_{n}") for h, c in (
            ("early", early), ("late", late)
        ) for n, x in (("s", F.col(s)), ("k", F.col(k)))
    ]
    out = blocks.groupBy(*LINK).agg(*stats, *halves("_whole", "_s", "_k"))
    middle = blocks.where(~early & ~late).select(
        *[F.col(c).alias(f"_m_{c}") for c in [*LINK, "_b"]], (F.col("_half") - F.col("_before")).alias("_take")
    )
    meet = rows.join(middle, [rows[c].eqNullSafe(middle[f"_m_{c}"]) for c in [*LINK, "_b"]])
    place = F.row_number().over(Window.partitionBy(*LINK, "_b").orderBy("ts_bucket", order))
    early = F.col("_place") <= F.col("_take")
    late = ~early
    met = meet.withColumns({"_place": place, "_one": F.when(F.col("_u").isNotNull(), 1)}).groupBy(*LINK).agg(*halves("_part", "_u", "_one"))
    met = met.select(*[F.col(c).alias(f"_p_{c}") for c in LINK], *[c for c in met.columns if c not in LINK])
    out = out.join(met, [out[c].eqNullSafe(met[f"_p_{c}"]) for c in LINK], "left")
    total = lambda half, n: F.coalesce(f"_whole_{half}_{n}", F.lit(0)) + F.coalesce(f"_part_{half}_{n}", F.lit(0))
    mean = lambda half: F.try_divide(total(half, "s"), total(half, "k"))
    change = mean("late") - mean("early")
    word = F.when(change > TREND_PCT, "increasing").when(change < -TREND_PCT, "decreasing").otherwise("stable")
    return out.withColumn("trend", word).select(
        *LINK, "avg_in_util_pct", "max_in_util_pct", "avg_out_util_pct", "max_out_util_pct", "n_samples", "trend"
    )


def threshold_breaches(utilization: DataFrame, as_of: Column, window_minutes: int) -> DataFrame:
    """Q2c."""
    rows = utilization.where(trailing("ts_bucket", as_of, window_minutes) & (peak() >= BREACH_PCT))
    return rows.select(*LINK, "ts_bucket", direction().alias("direction"), peak().alias("util_pct"))
