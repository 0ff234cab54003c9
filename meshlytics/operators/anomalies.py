"""Stored anomalies: Q6, Q7, Q16."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.columns import SEVERITY_RANK, anomaly_scope, fingerprint, is_open, is_unacknowledged, severity_at_least, severity_rank, trailing, within


def recent(
    events: DataFrame, as_of: Column, since_minutes: int, scope: str = "global", severity_min: str = "medium", limit: int = 50,
    tie: str = "id"
) -> DataFrame:
    """Q6a, per tenant: filtered first, then the newest; ``position`` from 1."""
    if severity_min not in SEVERITY_RANK:
        raise ValueError(f"severity_min must be one of {', '.join(SEVERITY_RANK)}")
    within("limit", limit, 1, 1000)
    rows = anomaly_scope(events.where(trailing("ts", as_of, since_minutes) & severity_at_least(severity_min)), scope)
    w = Window.partitionBy("tenant_id").orderBy(F.desc("ts"), tie)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def rollup(events: DataFrame) -> DataFrame:
    """Of the rows of Q6a."""
    count = lambda s: F.sum((F.col("severity") == s).cast("int"))
    rows = events.groupBy("tenant_id").agg(
        F.count("*").alias("total_count"), F.max_by("severity", severity_rank()).alias("most_severe"), count("critical").alias("c"),
        count("high").alias("h")
    )
    parts = F.concat_ws(
        ", ", F.when(F.col("c") > 0, F.format_string("%d critical", "c")), F.when(F.col("h") > 0, F.format_string("%d high-severity", "h")),
        F.when((F.col("c") == 0) & (F.col("h") == 0), F.lit("all medium-severity"))
    )
    noun = F.when(F.col("total_count") == 1, "event").otherwise("events")
    return rows.select(
        "tenant_id", "total_count", "most_severe",
        F.format_string("%d anomaly %s detected (%s requiring attention).", F.col("total_count"), noun, parts).alias("plain_summary")
    )


def facts(events: DataFrame) -> DataFrame:
    """Q7a as rows: tenant_id, kind (severity, type or scope), value, n, first_position. ``events``: Q6a with limit 25."""
    named = F.explode(
        F.array(
            *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("severity", "severity"), ("type", "anomaly_type"), ("scope", "scope"))]
        )
    ).alias("f")
    return events.select("tenant_id", "position", named).groupBy("tenant_id", "f.kind", "f.value").agg(
        F.count("*").alias("n"), F.min("position").alias("first_position")
    )


def samples(events: DataFrame, limit: int = 5) -> DataFrame:
    return events.where(F.col("position") <= limit)


def narrative(fact_rows: DataFrame, tenants: DataFrame, window_minutes: int) -> DataFrame:
    """A sentence per tenant of ``tenants``; types and scopes by count, then by where they come first."""
    def listed(kind, order, text):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*order, text.alias("text")))))

    by_rank = listed("severity", [(-severity_rank("value")).alias("a"), F.col("value").alias("b")], F.format_string("%d %s", "n", "value"))
    by_count = [(-F.col("n")).alias("a"), F.col("first_position").alias("b")]
    rows = fact_rows.groupBy("tenant_id").agg(
        F.sum(F.when(F.col("kind") == "severity", F.col("n"))).alias("total"), by_rank.alias("s"),
        listed("type", by_count, F.format_string("%d× %s", "n", "value")).alias("t"), listed("scope", by_count, F.col("value")).alias("c")
    )
    joined = lambda c, k: F.array_join(F.transform(F.slice(c, 1, k), lambda x: x["text"]), ", ")
    noun = F.when(F.col("total") == 1, "event").otherwise("events")
    text = F.format_string(
        f"%d anomaly %s in the last {window_minutes} minutes — %s. Dominant types: %s. Most activity on %s.", F.col("total"), noun,
        joined("s", 9), joined("t", 3), F.get("c", F.lit(0))["text"]
    )
    return tenants.select("tenant_id").join(rows, "tenant_id", "left").select(
        "tenant_id", F.when(F.col("total").isNull(), texts.NO_ANOMALIES).otherwise(text).alias("narrative")
    )


def escalate(current: Column, new: Column) -> Column:
    """The severity of higher rank, the current one on ties."""
    return F.when(severity_rank(current) >= severity_rank(new), current).otherwise(new)


def with_fingerprint(events: DataFrame, cause: Column | None = None) -> DataFrame:
    return events.withColumn("fingerprint", fingerprint("tenant_id", "anomaly_type", "scope", cause))


STORED = [
    "tenant_id", "fingerprint", "anomaly_type", "scope", "severity", "summary", "metadata_json", "first_seen_at", "last_seen_at",
    "occurrence_count", "acknowledged_at", "resolved_at"
]


def condense(events: DataFrame, order: str = "ts") -> DataFrame:
    """New events as one row per condition: counted, the worst severity, the last summary and metadata."""
    last = F.struct("ts", order)
    text = lambda c: F.max_by(c, last) if c in events.columns else F.lit(None).cast("string")
    rows = events.groupBy("tenant_id", "fingerprint").agg(
        F.first("anomaly_type").alias("anomaly_type"), F.first("scope").alias("scope"),
        F.max_by("severity", severity_rank()).alias("severity"), text("summary").alias("summary"),
        text("metadata_json").alias("metadata_json"),
        F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("occurrence_count"),
    )
    none = F.lit(None).cast("timestamp")
    return rows.withColumns({"acknowledged_at": none, "resolved_at": none}).select(*STORED)


def record(stored: DataFrame, events: DataFrame, order: str = "ts") -> DataFrame:
    """The stored table after ``events``. An open row of the same condition is counted up, its severity only rises,
    its summary and metadata are the new ones; other conditions open new rows; resolved rows stay."""
    new = condense(events, order)
    opened, closed = stored.where(F.col("resolved_at").isNull()), stored.where(F.col("resolved_at").isNotNull())
    a, b = opened.alias("a"), new.alias("b")
    both = a.join(b, [F.col("a.tenant_id") == F.col("b.tenant_id"), F.col("a.fingerprint") == F.col("b.fingerprint")], "full_outer")
    old = F.col("a.fingerprint").isNotNull()
    pick = {c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in STORED}
    pick |= {
        "severity": F.when(
            old & F.col("b.fingerprint").isNotNull(), escalate(F.col("a.severity"), F.col("b.severity"))
        ).otherwise(pick["severity"]),
        "summary": F.coalesce("b.summary", "a.summary"), "metadata_json": F.coalesce(  # batches may come out of order
            "b.metadata_json", "a.metadata_json"
        ),
        "first_seen_at": F.least("a.first_seen_at", "b.first_seen_at"), "last_seen_at": F.greatest("a.last_seen_at", "b.last_seen_at"),
        "occurrence_count": F.coalesce("a.occurrence_count", F.lit(0)) + F.coalesce("b.occurrence_count", F.lit(0)),
    }
    return both.select(*[v.alias(k) for k, v in pick.items()]).unionByName(closed.select(*STORED))


def apply_commands(stored: DataFrame, commands: DataFrame) -> DataFrame:
    """Q16d: ``commands`` (tenant_id, fingerprint, action ``ack`` or ``resolve``, at) set times that are still null;
    ``changed`` tells the rows that did change."""
    times = commands.groupBy("tenant_id", "fingerprint").agg(
        F.min(F.when(F.col("action") == "ack", F.col("at"))).alias("_ack"),
        F.min(F.when(F.col("action") == "resolve", F.col("at"))).alias("_res")
    )
    rows = stored.join(times, ["tenant_id", "fingerprint"], "left")
    changed = (is_unacknowledged() & F.col("_ack").isNotNull()) | (is_open() & F.col("_res").isNotNull())
    times = {"acknowledged_at": F.coalesce("acknowledged_at", "_ack"), "resolved_at": F.coalesce("resolved_at", "_res")}
    return rows.withColumn("changed", changed).withColumns(times).drop("_ack", "_res")
