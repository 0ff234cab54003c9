"""Column expressions that the operators share: predicates, clean-up, ranks, names."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TENANT = "00000000-0000-0000-0000-000000000001"
#: Ranks, names and states as the telemetry schema defines them.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP", 112: "VRRP", 89: "OSPF"}
ADMIN_STATES = ["UP", "DOWN", "TESTING"]
OPER_STATES = ["UP", "DOWN", "TESTING", "UNKNOWN", "DORMANT", "NOT_PRESENT", "LOWER_LAYER_DOWN"]
BGP_STATES = ["IDLE", "CONNECT", "ACTIVE", "OPENSENT", "OPENCONFIRM", "ESTABLISHED"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at(text: str) -> Column:
    """A time in the session's zone (UTC is meant)."""
    return F.lit(text).cast("timestamp")


def minutes_before(as_of: Column, minutes: int) -> Column:
    return as_of - F.make_dt_interval(mins=F.lit(minutes))


def within(name: str, value: int, low: int, high: int) -> int:
    """Argument bounds: ``value``, or an error if it is not between ``low`` and ``high``."""
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")
    return value


# P1 - P9 -------------------------------------------------------------------------------------------------------------
def tenant_scope(df: DataFrame, tenant: str | None) -> DataFrame:
    """One tenant's rows; all tenants for None."""
    return df if tenant is None else df.where(F.col("tenant_id") == tenant)


def trailing(ts: Column | str, as_of: Column, minutes: int) -> Column:
    """From ``minutes`` before ``as_of`` up to it, both ends included."""
    return col(ts).between(minutes_before(as_of, minutes), as_of)


def trailing_months(as_of: Column, minutes: int) -> Column:
    """The month partitions (yyyyMM as int) that P2 can touch; ANDed to it where a table is laid out by month."""
    month = lambda x: F.date_format(x, "yyyyMM").cast("int")
    return F.col("month").between(month(minutes_before(as_of, minutes)), month(as_of))


def half_open(ts: Column | str, start: Column, end: Column) -> Column:
    """P3."""
    return (col(ts) >= start) & (col(ts) < end)


def flow_scope(df: DataFrame, scope: str) -> DataFrame:
    """``device:x`` is a filter; ``global`` and any other text is none."""
    return df.where(F.col("device") == scope.split(":", 1)[1]) if scope.startswith("device:") else df


def anomaly_scope(df: DataFrame, scope: str) -> DataFrame:
    """P5: the scope holds the text, unless it is ``global``. The text is literal, without wildcards."""
    return df if scope == "global" else df.where(F.col("scope").contains(scope))


def severity_at_least(least: str, severity: Column | str = "severity") -> Column:
    """An unknown bound counts as medium."""
    rank = SEVERITY_RANK.get(least, 2)
    return col(severity).isin([s for s, r in SEVERITY_RANK.items() if r >= rank])


def either_at_least(limit: float, a: str = "in_util_pct", b: str = "out_util_pct") -> Column:
    """P7."""
    return (F.col(a) >= limit) | (F.col(b) >= limit)


def peak(a: str = "in_util_pct", b: str = "out_util_pct") -> Column:
    """P8."""
    return F.greatest(a, b)


def direction(a: str = "in_util_pct", b: str = "out_util_pct") -> Column:
    """Ties are outbound."""
    return F.when(F.col(a) > F.col(b), "inbound").otherwise("outbound")


def is_open() -> Column:
    """P9."""
    return F.col("resolved_at").isNull()


def is_unacknowledged() -> Column:
    """P9."""
    return F.col("acknowledged_at").isNull()


# E1, E8 - E10 ----------------------------------------------------------------------------------------------------------
def minute_bucket(ts: Column | str) -> Column:
    """E1."""
    return F.date_trunc("minute", col(ts))


def _state(raw: Column | str, known: list[str], other: str) -> Column:
    last = F.element_at(F.split(F.upper(F.coalesce(col(raw), F.lit(""))), ":"), -1)
    return F.when(last.isin(known), last).otherwise(other)


def admin_state(raw: Column | str) -> Column:
    """E8."""
    return _state(raw, ADMIN_STATES, "UNKNOWN")


def oper_state(raw: Column | str) -> Column:
    return _state(raw, OPER_STATES, "UNKNOWN")


def bgp_state(raw: Column | str) -> Column:
    return _state(raw, BGP_STATES, "IDLE")


def safe_int(raw: Column | str) -> Column:
    """E9."""
    return col(raw).try_cast("bigint")


def safe_str(raw: Column | str) -> Column:
    return F.nullif(F.trim(col(raw)), F.lit(""))


def parse_time(raw: Column | str) -> Column:
    """Nanoseconds since 1970 if all digits, else ISO 8601; null if neither."""
    raw = col(raw)
    return F.when(
        raw.rlike("^[0-9]+$"), F.timestamp_micros(F.call_function("div", raw.try_cast("bigint"), F.lit(1000)))
    ).otherwise(F.try_to_timestamp(raw))


# Names and ranks -------------------------------------------------------------------------------------------------------
def protocol_name(protocol: Column | str = "protocol") -> Column:
    out = F.concat(F.lit("PROTO_"), col(protocol).cast("string"))
    for number, name in PROTOCOL_NAMES.items():
        out = F.when(col(protocol) == number, name).otherwise(out)
    return out


def severity_rank(severity: Column | str = "severity") -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(col(severity) == name, rank).otherwise(out)
    return out


def share(part: Column, whole: Column, times: float = 100.0) -> Column:
    """``times`` * part / whole, 0 where the whole is 0."""
    return F.when(whole != 0, part / whole * times).otherwise(F.lit(0.0))


def canonical_json(text: Column | str) -> Column:
    """JSON text as Python's ``json`` writes it with sorted keys at every depth, without spaces and in ASCII: numbers by their
    shortest form (``1.0``, ``1e-07``), whole numbers of any length up to 4,300 digits, of repeated keys the last. What is no
    JSON gives null. In Arrow batches, since no built-in function writes numbers so."""

    def rewrite(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"))
            except (ValueError, RecursionError):
                return None

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(rewrite, "string")(col(text))


def shortened_json(text: Column | str, longest: int, mark: str) -> Column:
    """The object with the long strings among its values cut and marked, keys sorted; null if it is empty or none."""

    def rewrite(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = None if t is None else json.loads(t)
            except (ValueError, RecursionError):
                return None
            if not isinstance(value, dict) or not value:
                return None
            cut = {k: v[:longest] + mark if isinstance(v, str) and len(v) > longest else v for k, v in value.items()}
            out = json.dumps(cut, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            return out.encode("utf-8", "replace").decode()  # half a surrogate pair is no text

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(rewrite, "string")(col(text))


#: Causes that count as none. Fixed values.
NO_CAUSE = ["{}", "[]", "null", "false", "0", "0.0", "-0.0", '""']


def fingerprint(tenant: Column | str, kind: Column | str, scope: Column | str, cause: Column | None = None) -> Column:
    """SHA-256 of tenant, type, scope and cause (JSON text, made canonical, or null), with pipes between. An empty
    cause counts as none."""
    cause = F.lit("") if cause is None else canonical_json(cause)
    cause = F.when(cause.isNull() | cause.isin(NO_CAUSE), F.lit("")).otherwise(cause)
    return F.sha2(
        F.concat_ws("|", F.coalesce(col(tenant), F.lit("")), F.coalesce(col(kind), F.lit("")), F.coalesce(col(scope), F.lit("")), cause),
        256
    )


def presented(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Rounded for people; results that feed further work stay unrounded."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})
