"""Tool-call log, quotas and rate limits: Q19, Q20."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_json, shortened_json, within

#: Fixed values.
TRUNCATE, WINDOW_SECONDS = 512, 60
CALL_LIMITS = {"get_top_talkers": 30, "get_rdma_health": 20, "explain_hot_link": 10}


def args_hash(args: Column) -> Column:
    """Of the arguments as canonical JSON; null for what is no JSON."""
    return F.sha2(canonical_json(args), 256)


def truncate_args(args: Column) -> Column:
    """The object with long strings among its values cut, keys sorted; null if it is empty or none."""
    return shortened_json(args, TRUNCATE, "…")


def confidence_band(note: Column | str) -> Column:
    """The first word that occurs decides."""
    low = F.lower(F.col(note) if isinstance(note, str) else note)
    return F.when(low.contains("exact"), "exact").when(
        low.contains("degrad") | low.contains("stale"), "degraded"
    ).when(low.contains("sampl"), "sampled")


def enrich(calls: DataFrame) -> DataFrame:
    """Q19a."""
    return calls.withColumns(
        {
            "args_hash": args_hash(F.col("args_json")), "args_truncated": truncate_args(F.col("args_json")),
            "confidence_band": confidence_band("confidence_note")
        }
    )


def recent_calls(calls: DataFrame, tool: str | None = None, limit: int = 100, tie: str = "event_id") -> DataFrame:
    """Per tenant the newest calls."""
    within("limit", limit, 1, 1000)
    rows = calls if tool is None else calls.where(F.col("tool_name") == tool)
    w = Window.partitionBy("tenant_id").orderBy(F.desc("ts"), F.desc(tie))
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def quota_usage(attempts: DataFrame) -> DataFrame:
    """Calls and bytes per tenant, tool and day; refused attempts count."""
    return attempts.groupBy("tenant_id", "tool_name", F.date_trunc("day", F.col("ts")).alias("period_start")).agg(
        F.count("*").alias("calls_this_period"), F.sum("response_bytes").alias("bytes_out_this_period")
    )


def quota_decisions(attempts: DataFrame, limits: DataFrame, tie: str = "event_id") -> DataFrame:
    """Q19d: each attempt allowed or not by the counts up to it; ``limits``: tenant_id, tool_name, call_limit, byte_limit.

    Running counts are those within a minute and, before them, the sums of the day's minutes, at most 1,440 rows, so that a
    busy tool's day is no one task.
    """
    key = ["tenant_id", "tool_name", "_minute"]
    rows = attempts.withColumn("_minute", F.date_trunc("minute", F.col("ts")))
    minutes = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("response_bytes").alias("_b"))
    before = Window.partitionBy(
        "tenant_id", "tool_name", F.date_trunc("day", "_minute")
    ).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.select(
        *[F.col(c).alias(f"{c}_") for c in key], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        F.sum("_b").over(before).alias("_b")
    )
    w = Window.partitionBy(*key).orderBy("ts", tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(minutes, [rows[c].eqNullSafe(minutes[f"{c}_"]) for c in key])
    own = F.sum("response_bytes").over(w)
    size = F.when(own.isNotNull() | F.col("_b").isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce("_b", F.lit(0)))
    rows = rows.withColumns(
        {"calls_so_far": F.count("*").over(w) + F.col("_n"), "bytes_so_far": size}
    ).drop("_n", "_b", "_minute", *[f"{c}_" for c in key])
    rows = rows.join(limits, ["tenant_id", "tool_name"], "left")
    calls, size = F.coalesce(
        F.col("calls_so_far") > F.col("call_limit"), F.lit(False)
    ), F.coalesce(F.col("bytes_so_far") > F.col("byte_limit"), F.lit(False))
    return rows.withColumns(
        {"allowed": ~(calls | size), "reason": F.when(calls, "call_limit_exceeded").when(size, "byte_limit_exceeded").otherwise("ok")}
    )


def set_limits(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Q19e: upsert of limits by tenant and tool."""
    key = ["tenant_id", "tool_name"]
    a, b = stored.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1))
    return a.unionByName(b).groupBy(*key).agg(F.max_by(F.struct("call_limit", "byte_limit"), "_new").alias("r")).select(*key, "r.*")


def current_period(usage: DataFrame, limits: DataFrame, as_of: Column) -> DataFrame:
    """Q19e: the day of ``as_of``."""
    return usage.where(F.col("period_start") == F.date_trunc("day", as_of)).join(limits, ["tenant_id", "tool_name"], "left")


#: Seconds of a block of calls; a tool's calls are dealt to tasks by block, not all to one.
BLOCK_SECONDS = 3600


def _blocks(calls: DataFrame, seconds: int) -> tuple[DataFrame, int]:
    size = max(BLOCK_SECONDS, seconds) * 1_000_000
    us = F.unix_micros("ts")
    return calls.withColumns({"_us": us, "_block": F.call_function("div", us, F.lit(size))}), size


def rate_report(calls: DataFrame, limits: dict[str, int] = CALL_LIMITS, other: int = 30, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Q20, rolling: calls that have as many or more others of the same tool in the seconds before.

    Each call counts up right after its time and down when it leaves the window, and calls read the sum so far: a sum from a
    block's start is carried on from row to row, where a sliding frame is summed anew for each. A call that leaves in the next
    block counts up there too. Steps other than the call's own hold no other columns."""
    most = F.lit(other)
    for tool, n in limits.items():
        most = F.when(F.col("tool_name") == tool, n).otherwise(most)
    rows, size = _blocks(calls, seconds)
    leaves = F.col("_us") + seconds * 1_000_000
    after = F.call_function("div", leaves, F.lit(size))
    step = lambda own, block, at, n: F.struct(
        F.lit(own).alias("own"), block.alias("block"), at.alias("at"), F.lit(n).cast("long").alias("n")
    )
    up, down = F.col("_us") * 2 + 1, leaves * 2  # at the same time, leaving comes first and the others' steps up don't count
    steps = F.array(
        step(True, F.col("_block"), up, 1), F.when(after > F.col("_block"), step(False, after, up, 1)),
        F.when(after.isNotNull(), step(False, after, down, -1))
    )
    rows = rows.withColumn("_step", F.explode(F.filter(steps, lambda x: x.isNotNull())))
    rows = rows.select("tool_name", "_step", *[F.when(F.col("_step.own"), F.col(c)).alias(c) for c in calls.columns if c != "tool_name"])
    w = Window.partitionBy("tool_name", "_step.block").orderBy("_step.at").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"calls_before": F.coalesce(F.sum("_step.n").over(w), F.lit(0)), "max_calls": most}).where("_step.own")
    return rows.withColumn("over", F.col("calls_before") >= F.col("max_calls")).select(*calls.columns, "calls_before", "max_calls", "over")


def rate_decisions(
    calls: DataFrame, limits: dict[str, int] = CALL_LIMITS, other: int = 30, seconds: int = WINDOW_SECONDS, tie: str = "event_id"
) -> DataFrame:
    """Q20, exact: a call counts against later ones only if it was accepted itself, so calls are taken in turn."""
    return decided(calls, None, limits, other, seconds, tie).drop("us")


def decided(calls: DataFrame, accepted: DataFrame | None, limits: dict[str, int], other: int, seconds: int, tie: str) -> DataFrame:
    """The decisions on ``calls`` after those on earlier ones, of which the ``accepted`` are given (``tool_name``, ``us``).

    Calls of a tool that are the window or more apart can't touch each other, so stretches between such pauses are independent.
    Stretches are numbered within blocks, and blocks by a table of one row per tool and block. A stretch is worked through
    in order by one task, which keeps no more of it than the accepted calls of a window; a stream (``streams.rate_batches``)
    bounds it by its batches."""
    rows, size = _blocks(calls, seconds)
    rows = rows.select("tool_name", "_block", "_us", tie, F.lit(False).alias("_given"))
    if accepted is not None:
        rows = rows.unionByName(
            accepted.select(
                "tool_name", F.call_function("div", F.col("us"), F.lit(size)).alias("_block"), F.col("us").alias("_us"),
                F.lit(0).cast(rows.schema[tie].dataType).alias(tie), F.lit(True).alias("_given")
            )
        )
    apart = seconds * 1_000_000
    w = Window.partitionBy("tool_name", "_block").orderBy("_us", tie)
    rows = rows.withColumn("_start", F.coalesce((F.col("_us") - F.lag("_us").over(w) >= apart).cast("long"), F.lit(0)))
    ends = rows.groupBy("tool_name", "_block").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.sum("_start").alias("_n"))
    by_tool = Window.partitionBy("tool_name").orderBy("_block")
    ends = ends.withColumn("_own", F.col("_n") + F.coalesce((F.col("_lo") - F.lag("_hi").over(by_tool) >= apart).cast("long"), F.lit(1)))
    ends = ends.withColumn(
        "_base", F.sum("_own").over(by_tool.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ).select("tool_name", "_block", "_base")
    inside = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_in", inside).join(ends, ["tool_name", "_block"]).select(
        "tool_name", (F.col("_base") + F.col("_in")).alias("_stretch"), tie, "_us", "_given"
    )

    def decide(batches):
        """Rows come by tool, stretch and time; all that is kept of them is the accepted calls of the window."""
        at, kept = None, []
        for pdf in batches:
            out = []
            for tool, stretch, t, given in zip(
                pdf["tool_name"].tolist(), pdf["_stretch"].tolist(), pdf["_us"].tolist(), pdf["_given"].tolist()
            ):
                if (tool, stretch) != at:
                    at, kept, most = (tool, stretch), [], limits.get(tool, other)
                kept = [k for k in kept if t - k < apart]
                ok = given or len(kept) < most
                out.append((ok, None if ok else int(seconds - (t - kept[0]) / 1e6)))
                if ok:
                    kept.append(t)
            done = pd.DataFrame(
                {
                    tie: pdf[tie], "tool_name": pdf["tool_name"], "us": pdf["_us"], "accepted": [x[0] for x in out],
                    "retry_after_seconds": pd.array([x[1] for x in out], dtype="Int64")
                }
            )
            yield done[~pdf["_given"]]

    ordered = rows.repartition("tool_name", "_stretch").sortWithinPartitions("tool_name", "_stretch", F.desc("_given"), "_us", tie)
    return ordered.mapInPandas(decide, f"{tie} long, tool_name string, us long, accepted boolean, retry_after_seconds long")


def still_counting(accepted: DataFrame, done: DataFrame, seconds: int) -> DataFrame:
    """``tool_name`` and ``us`` of the accepted calls, of before and of ``done``, that are in the window of the tool's last call."""
    both = accepted.select("tool_name", "us").unionByName(done.where("accepted").select("tool_name", "us"))
    last = accepted.select("tool_name", "us").unionByName(
        done.select("tool_name", "us")
    ).groupBy("tool_name").agg(F.max("us").alias("last"))
    return both.join(last, "tool_name").where(F.col("last") - F.col("us") < seconds * 1_000_000).select("tool_name", "us")
