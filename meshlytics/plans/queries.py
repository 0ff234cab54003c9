"""The queries by name: each loads its views, applies one operator and returns flat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import anomalies, baselines, detect, fabric, flows, freshness, interfaces, inventory, normalize, rdma, retention, state, usage
from ..sources import feeds, sinks
from .fixtures import AS_OF, DAY, WEEK, folder, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    """Registers ``f(tables)``; times are returned as text, so that no zone matters."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(Tables(spark, sf_dir))
        return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, kind in df.dtypes if kind == "timestamp"})

    QUERIES[f.__name__] = run
    return f


#: Arguments of calls with keys in no order, an object among the values and some long texts; the SQL has them too.
CALL_ARGS = """concat('{"zone": "', repeat('z', CAST(event_id % 3 AS INT) * 300), '", "call": ', args_json, ', "device": "sw', CAST(event_id % 5 AS STRING), '"}')"""


def as_of():
    return C.at(AS_OF)


class Tables:
    """Minute tables of the views, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, last_minutes: int | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.view = lambda name: view(spark, sf_dir, name, last_minutes)

    def last(self, minutes: int) -> Tables:
        """The same of the events of a trailing window only."""
        return Tables(self.spark, self.sf_dir, minutes)

    @property
    def flows(self) -> DataFrame:
        return normalize.route(normalize.normalize_flows(self.view("flow_raw"), "event_id"), self.view("collector_sources"), "sflow")

    @property
    def utilization(self) -> DataFrame:
        return normalize.route(normalize.normalize_counters(self.view("counter_raw")), self.view("collector_sources"), "sflow")

    @property
    def states(self) -> DataFrame:
        return normalize.normalize_interface_state(self.view("iface_raw"), self.view("collector_sources"))

    @property
    def bgp(self) -> DataFrame:
        return normalize.normalize_bgp_neighbors(self.view("bgp_raw"), self.view("collector_sources"))

    @property
    def queues(self) -> DataFrame:
        return normalize.normalize_queue_stats(self.view("queue_raw"), self.view("collector_sources"))

    @property
    def tenants(self) -> DataFrame:
        return self.view("tenants").withColumn("tenant_id", F.col("id"))

    @property
    def anomalies(self) -> DataFrame:
        return self.view("anomaly_raw")

    @property
    def groups(self) -> DataFrame:
        configured = normalize.route(
            self.view("ecmp_groups").withColumn("members", F.split("members_csv", ",")), self.view("collector_sources"), "gnmi"
        )
        return fabric.resolve_groups(configured, fabric.infer_groups(self.last(DAY).states, as_of(), DAY))

    @property
    def imbalance(self) -> DataFrame:
        return fabric.group_imbalance(self.groups, fabric.member_utilization(self.last(WEEK).utilization, as_of(), WEEK))

    @property
    def calls(self) -> DataFrame:
        return self.view("tool_call_raw")

    @property
    def limits(self) -> DataFrame:
        """Limits that follow from the calls: the mean calls and bytes of a tenant's tool a day, bytes only for some."""
        daily = usage.quota_usage(self.calls)
        return daily.groupBy("tenant_id", "tool_name").agg(
            F.floor(F.avg("calls_this_period")).alias("call_limit"),
            F.when(F.max("calls_this_period") % 2 == 0, F.max("bytes_out_this_period") - 1).alias("byte_limit")
        )


# Sources and sinks -----------------------------------------------------------------------------------------------------
@query
def s1_flow_feed(t):
    """Flow rows to feed documents of a minute and a part of 64, as polls are, and back; every 13th value unreadable and every
    7th rate absent."""
    raw = t.view("flow_raw")
    bad = F.when(F.col("event_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("bytes").cast("string"))
    rate = F.when(F.col("event_id") % 7 != 0, F.col("sampling_rate").cast("string"))
    record = F.struct(
        "agent", F.col("input_if_index").cast("string").alias("inputifindex"), F.col("src_ip").alias("srcip"),
        F.col("dst_ip").alias("dstip"), F.col("protocol").cast("string").alias("protocol"), bad.alias("bytes"),
        F.col("packets").cast("string").alias("packets"), rate.alias("samplingrate")
    )
    text = raw.groupBy(
        F.date_trunc("minute", "timestamp").alias("h"), F.pmod(F.xxhash64("event_id"), F.lit(64)).alias("part")
    ).agg(F.to_json(F.struct(F.collect_list(record).alias("flows"))).alias("doc"))
    feed = text.select("h", F.from_json("doc", feeds.FLOW_FEED).alias("d")).select("h", "d.flows")
    rows = feeds.flow_records(feed, F.lit(None).cast("timestamp"))
    return rows.groupBy("agent", "protocol", "sampling_rate").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"),
        F.max("output_if_index").alias("max_output")
    )


@query
def s2_counter_feed(t):
    raw = t.view("counter_raw")
    record = F.struct(
        "agent", F.col("if_index").cast("string").alias("ifindex"), F.when(F.col("event_id") % 3 > 0, F.col("if_name")).alias("ifname"),
        F.when(F.col("event_id") % 11 > 0, F.col("if_speed").cast("string")).alias("ifspeed"),
        F.when(F.col("event_id") % 17 > 0, F.col("if_in_octets").cast("string")).otherwise("bad").alias("ifinoctets"),
        F.col("if_out_octets").cast("string").alias("ifoutoctets")
    )
    feed = raw.select(F.from_json(F.to_json(record), feeds.COUNTER_FEED).alias("c")).select("c.*")
    good, aside = feeds.counter_records(feed, F.lit(None).cast("timestamp"))
    rows = good.groupBy("agent", "if_name").agg(
        F.count("*").alias("n"), F.sum("if_speed").alias("speed"), F.sum("if_in_octets").alias("in_octets"),
        F.sum(F.col("if_in_errors") + F.col("if_out_errors")).cast("long").alias("errors")
    )
    return rows.unionByName(
        aside.groupBy("agent").agg(F.count("*").alias("n")).withColumns(
            {
                "if_name": F.lit("(aside)"), "speed": F.lit(None).cast("long"), "in_octets": F.lit(None).cast("long"),
                "errors": F.lit(None).cast("long")
            }
        )
    )


def _notified(rows: DataFrame, path, leaves: dict[str, str]) -> DataFrame:
    """Rows as notification documents, and flattened again."""
    updates = F.array(
        *[F.struct(F.concat(path, F.lit(f"/state/{leaf}")).alias("path"), F.col(c).cast("string").alias("val")) for leaf, c in leaves.items()]
    )
    text = rows.select(
        "device", "timestamp", F.to_json(F.struct(F.array(F.struct(updates.alias("update"))).alias("notification"))).alias("doc")
    )
    kind = feeds.NOTIFICATIONS["notification"].dataType.simpleString()
    feed = text.select(
        "device", "timestamp", F.from_json("doc", f"notification {kind}").alias("d")
    ).select("device", "timestamp", "d.notification")
    return feeds.flatten_notifications(feed)


@query
def s3_notifications(t):
    updates = _notified(
        t.view("iface_raw"), F.concat(F.lit("interfaces/interface[name="), F.col("interface"), F.lit("]")),
        {"oper-status": "oper_status", "mtu": "mtu"}
    )
    return updates.groupBy("device", "path", "val").agg(F.count("*").alias("n"))


@query
def s3a_interface_states(t):
    rows = t.view("iface_raw").withColumn("oper_raw", F.concat(F.lit("oc:"), F.lower("oper_status")))
    updates = _notified(
        rows, F.concat(F.lit("interfaces/interface[name="), F.col("interface"), F.lit("]")),
        {"admin-status": "admin_status", "oper-status": "oper_raw", "speed": "speed_bps", "mtu": "mtu"}
    )
    return feeds.interface_states(updates).select("device", "interface", "timestamp", "admin_status", "oper_status", "speed_bps", "mtu")


@query
def s3b_bgp_neighbors(t):
    updates = _notified(
        t.view("bgp_raw"), F.concat(F.lit("bgp/neighbors/neighbor[neighbor-address="), F.col("peer_address"), F.lit("]")),
        {"session-state": "session_state", "peer-as": "peer_as", "uptime": "uptime_seconds", "received-prefixes": "prefixes_received"}
    )
    return feeds.bgp_neighbors(updates).select(
        "device", "peer_address", "timestamp", "session_state", "peer_as", "uptime_seconds", "prefixes_received"
    )


@query
def s3c_queue_stats(t):
    path = F.concat(
        F.lit("qos/interfaces/interface[interface-id="), F.col("interface"), F.lit("]/output/queues/queue[name="),
        F.col("queue_id").cast("string"), F.lit("]")
    )
    updates = _notified(
        t.view("queue_raw"), path, {"max-queue-len": "max_depth_bytes", "pfc-pause-rx": "pfc_pause_rx", "dropped-pkts": "dropped_packets"}
    )
    return feeds.queue_stats(updates).select(
        "device", "interface", "queue_id", "timestamp", "max_depth_bytes", "pfc_pause_rx", "ecn_marked_packets", "dropped_packets"
    )


@query
def s4_scan(t):
    return t.last(WEEK).utilization.where(
        C.trailing("ts_bucket", as_of(), WEEK) & (F.col("device") == "sw1")
    ).select("tenant_id", "ts_bucket", "interface", "in_bps", "error_count")


@query
def k1_append(t):
    """What a monthly table holds after two appends, of the rows before mid-month and of those after."""
    at, early = folder(t.spark), F.col("ts_bucket") < C.at("2024-01-16 00:00:00")
    for half in (early, ~early):
        sinks.append_monthly(t.utilization.where(half), f"{at}/utilization")
    return t.spark.read.parquet(f"{at}/utilization").groupBy("month", "device").agg(F.count("*").alias("n"))


@query
def k2_upsert(t):
    """Sample counts of sources to mid-month, upserted by those after: summed counts, the later time."""
    rows = t.view("heartbeat_raw")
    cut = C.at("2024-01-16 00:00:00")
    per = lambda df: df.groupBy("tenant_id", "source_kind", "device").agg(
        F.max("ts").alias("last_ts"), F.sum("sample_count").alias("samples")
    )
    return sinks.upsert(
        per(rows.where(F.col("ts") < cut)), per(rows.where(F.col("ts") >= cut)), ["tenant_id", "source_kind", "device"],
        {"samples": lambda a, b: a + b}
    )


@query
def k2_bucketed_upsert(t):
    """The same by a table in sorted buckets, of which a batch replaces the parts that it touches."""
    rows = t.view("heartbeat_raw").groupBy(
        "tenant_id", "source_kind", "device", (F.dayofmonth("ts") > 15).alias("late")
    ).agg(F.max("ts").alias("last_ts"), F.sum("sample_count").alias("samples"))
    key = ["tenant_id", "source_kind", "device"]
    table = sinks.BucketedTable(t.spark, f"{folder(t.spark)}/heartbeats", key, parts=8, buckets=4)
    table.create(rows.where("not late").drop("late"))
    table.upsert(rows.where("late").drop("late"), {"last_ts": F.greatest, "samples": lambda a, b: a + b})
    return table.read()


@query
def k3_month_layout(t):
    """A trailing window of flows laid out by month; times of odd rows are moved back by 40 days, so that there are months to
    be left out."""
    at = folder(t.spark)
    moved = F.when(F.minute("ts_bucket") % 2 == 1, F.col("ts_bucket") - F.make_dt_interval(days=F.lit(40))).otherwise(F.col("ts_bucket"))
    sinks.append_monthly(t.flows.withColumn("ts_bucket", moved), f"{at}/flows")
    rows = sinks.read_months(t.spark, f"{at}/flows", as_of(), WEEK)
    return rows.groupBy("month", "tenant_id").agg(F.count("*").alias("n"), F.sum("bytes_estimated").alias("bytes_estimated"))


@query
def p1_tenant_scope(t):
    """The rows of one tenant, and of all."""
    one = C.tenant_scope(t.utilization, "00000000-0000-0000-0000-000000000002").withColumn("scope", F.lit("one"))
    every = C.tenant_scope(t.utilization, None).withColumn("scope", F.lit("all"))
    return one.unionByName(every).groupBy("scope", "tenant_id", "device").agg(F.count("*").alias("n"))


@query
def p_predicates(t):
    """P2 - P4, P7, P8 as counts."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    rows = t.utilization
    return rows.groupBy("tenant_id").agg(
        n(C.trailing("ts_bucket", as_of(), WEEK)).alias("p2"),
        n(C.half_open("ts_bucket", C.minutes_before(as_of(), WEEK), C.minutes_before(as_of(), DAY))).alias("p3"),
        n(F.col("device") == "sw1").alias("p4"),
        n(C.either_at_least(60.0)).alias("p7"), n(C.direction() == "inbound").alias("p8"), F.max(C.peak()).alias("peak"),
    )


@query
def p_anomaly_predicates(t):
    """P1, P5, P6, P9 as counts."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    times = {c: F.when(F.col("event_id") % k > 0, F.col("ts")) for c, k in (("resolved_at", 3), ("acknowledged_at", 4))}
    return t.anomalies.withColumns(times).groupBy("tenant_id").agg(
        F.count("*").alias("p1"), n(F.col("scope").contains("interface:1")).alias("p5"), n(C.severity_at_least("high")).alias("p6"),
        n(C.severity_at_least("odd")).alias("p6_unknown"), n(C.is_open()).alias("p9"), n(C.is_unacknowledged()).alias("p9_unacknowledged"),
    )


# Transforms --------------------------------------------------------------------------------------------------------------
@query
def e1_minute_bucket(t):
    return t.view("flow_raw").select("event_id", C.minute_bucket("timestamp").alias("ts_bucket"))


@query
def e2_normalize_flows(t):
    return normalize.normalize_flows(t.view("flow_raw"), "event_id")


@query
def e3_normalize_counters(t):
    return normalize.normalize_counters(t.view("counter_raw"))


@query
def e4_tenant_routing(t):
    return t.flows.groupBy("tenant_id", "device").agg(F.count("*").alias("n"))


@query
def e5_interface_state(t):
    return t.states.select("event_id", "tenant_id", "ts_bucket", "device", "interface", "admin_status", "oper_status", "speed_bps")


@query
def e6_bgp_neighbors(t):
    return t.bgp.select("event_id", "tenant_id", "ts_bucket", "device", "peer_address", "session_state", "peer_as")


@query
def e7_queue_stats(t):
    return t.queues.select("event_id", "tenant_id", "ts_bucket", "device", "interface", "queue_id", "pfc_pause_rx", "dropped_packets")


@query
def e8_status_cleanup(t):
    raw = t.view("iface_raw").withColumn(
        "raw",
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(
            F.col("event_id") % 5 == 1, F.concat(F.lit("oc-if:"), F.lower("oper_status"))
        ).when(F.col("event_id") % 5 == 2, F.lit("weird")).otherwise(F.col("oper_status"))
    )
    return raw.groupBy(
        C.admin_state("raw").alias("admin"), C.oper_state("raw").alias("oper"), C.bgp_state("raw").alias("bgp")
    ).agg(F.count("*").alias("n"))


@query
def e9_number_text_cleanup(t):
    raw = t.view("flow_raw").withColumn(
        "raw",
        F.when(F.col("event_id") % 4 == 0, F.lit("  ")).when(
            F.col("event_id") % 4 == 1, F.concat(F.lit(" x"), F.col("agent"), F.lit(" "))
        ).otherwise(F.col("bytes").cast("string"))
    )
    return raw.select("event_id", C.safe_int("raw").alias("as_int"), C.safe_str("raw").alias("as_str"))


@query
def e10_time_cleanup(t):
    nanos = F.concat(F.unix_seconds("timestamp").cast("string"), F.lit("123456789"))
    raw = t.view("flow_raw").withColumn(
        "raw",
        F.when(F.col("event_id") % 3 == 0, nanos).when(
            F.col("event_id") % 3 == 1, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
        ).otherwise("never")
    )
    return raw.select("event_id", C.parse_time("raw").alias("parsed"))


@query
def e11_tenant_backfill(t):
    rows = t.anomalies.withColumn("tenant_id", F.when(F.col("event_id") % 3 > 0, F.col("tenant_id")))
    return normalize.backfill_tenant(rows).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query
def e12_fingerprint_backfill(t):
    none = F.lit(None).cast("timestamp")
    rows = t.anomalies.withColumns(
        {
            "fingerprint": F.when(F.col("event_id") % 2 == 0, F.lit("known")), "first_seen_at": none, "last_seen_at": none,
            "resolved_at": none
        }
    )
    return normalize.backfill_fingerprint(rows).select("event_id", "fingerprint", "first_seen_at", "resolved_at")


@query
def e13_source_listing(t):
    return normalize.list_sources(t.view("collector_sources"), t.view("tenants"))


# Flow questions ------------------------------------------------------------------------------------------------------------
@query
def q1a_top_talkers(t):
    return flows.top_talkers(t.last(WEEK).flows, as_of(), WEEK)


@query
def q1a_top_talkers_device(t):
    return flows.top_talkers(t.last(WEEK).flows, as_of(), WEEK, "device:sw1", 5).select(
        "tenant_id", "rank", "src_ip", "dst_ip", "protocol_name", "bytes_estimated"
    )


@query
def q1b_protocol_breakdown(t):
    return flows.protocol_breakdown(flows.top_talkers(t.last(WEEK).flows, as_of(), WEEK))


@query
def q1c_confidence_note(t):
    return flows.talkers_note(flows.top_talkers(t.last(WEEK).flows, as_of(), WEEK), t.tenants)


@query
def q3_protocol_mix(t):
    return flows.protocol_mix(t.last(WEEK).flows, as_of(), WEEK)


@query
def q3_protocol_headline(t):
    return flows.protocol_headline(flows.protocol_mix(t.last(WEEK).flows, as_of(), WEEK), WEEK)


@query
def q4a_link_peak(t):
    return flows.link_peak(t.last(WEEK).utilization, as_of(), WEEK)


@query
def q4b_link_contributors(t):
    return flows.link_contributors(t.last(WEEK).flows, as_of(), WEEK)


@query
def q4c_hot_links(t):
    return flows.hot_links(
        flows.link_peak(t.last(WEEK).utilization, as_of(), WEEK), flows.link_contributors(t.last(WEEK).flows, as_of(), WEEK)
    ).select("tenant_id", "device", "interface", "peak_ts", "narrative", "confidence_note")


@query
def q5_compare_windows(t):
    return flows.compare_windows(
        t.flows, (C.at("2024-01-16 00:00:00"), C.at("2024-01-23 00:00:00")), (C.at("2024-01-23 00:00:00"), C.at("2024-01-30 00:00:00"))
    )


@query
def q2a_interface_utilization(t):
    return interfaces.interface_utilization(t.last(WEEK).utilization, as_of(), WEEK, "event_id", trend=False)


@query
def q2b_trend(t):
    return interfaces.interface_utilization(
        t.last(WEEK).utilization, as_of(), WEEK, "event_id"
    ).select("tenant_id", "device", "interface", "trend")


@query
def q2c_threshold_breaches(t):
    return interfaces.threshold_breaches(t.last(WEEK).utilization, as_of(), WEEK)


# Stored anomalies ------------------------------------------------------------------------------------------------------------
@query
def q6a_recent_anomalies(t):
    return anomalies.recent(t.last(WEEK).anomalies, as_of(), WEEK, "device:sw1", "high", tie="event_id")


@query
def q6b_anomaly_rollup(t):
    return anomalies.rollup(anomalies.recent(t.last(WEEK).anomalies, as_of(), WEEK, severity_min="medium", tie="event_id"))


@query
def q7a_anomaly_facts(t):
    return anomalies.facts(anomalies.recent(t.last(WEEK).anomalies, as_of(), WEEK, severity_min="low", limit=25, tie="event_id"))


@query
def q7b_anomaly_narrative(t):
    return anomalies.narrative(
        anomalies.facts(anomalies.recent(t.last(WEEK).anomalies, as_of(), WEEK, severity_min="low", limit=25, tie="event_id")), t.tenants,
        WEEK
    )


# Inventory and state -----------------------------------------------------------------------------------------------------------
@query
def q8_list_devices(t):
    return inventory.list_devices(t.last(DAY).utilization, as_of())


@query
def q9_list_interfaces(t):
    return inventory.list_interfaces(t.last(DAY).utilization, t.last(DAY).flows, as_of())


@query
def q10a_latest_interfaces(t):
    return state.latest_interfaces(t.last(DAY).states, as_of(), DAY, ("ts_bucket", "event_id")).select(
        "tenant_id", "device", "interface", "ts_bucket", "admin_status", "oper_status", "speed_bps"
    )


@query
def q10b_interfaces_down(t):
    return state.interfaces_down(
        state.latest_interfaces(t.last(DAY).states, as_of(), DAY, ("ts_bucket", "event_id"))
    ).select("tenant_id", "device", "interface")


@query
def q10c_bgp_state(t):
    return state.latest_bgp(t.last(DAY).bgp, as_of(), DAY, ("ts_bucket", "event_id")).select(
        "tenant_id", "device", "peer_address", "ts_bucket", "session_state", "is_down"
    )


@query
def q10d_device_queues(t):
    return state.device_queues(t.last(DAY).queues, as_of(), DAY)


@query
def q10e_state_note(t):
    named = t.states.select("tenant_id", "device").unionByName(t.anomalies.select("tenant_id", F.lit("sw9").alias("device")))
    return state.state_note(named, [t.last(DAY).states, t.last(DAY).bgp, t.last(DAY).queues], as_of(), DAY)


@query
def q11_state_sources(t):
    return inventory.list_state_sources(t.last(DAY).states, as_of())


# Fabric and RDMA -----------------------------------------------------------------------------------------------------------------
@query
def q12a_member_utilization(t):
    return fabric.member_utilization(t.last(WEEK).utilization, as_of(), WEEK)


@query
def q12b_ecmp_groups(t):
    return t.groups.select("tenant_id", "device", "group_name", "source", F.array_join("members", ",").alias("members"))


@query
def q12c_speed_groups(t):
    return fabric.infer_groups(t.last(DAY).states, as_of(), DAY).select(
        "tenant_id", "device", "group_name", F.array_join("members", ",").alias("members")
    )


@query
def q12d_imbalance(t):
    return t.imbalance.withColumn("members", F.array_join(F.transform("members", lambda m: m["interface"]), ","))


@query
def q12e_fabric_severity(t):
    return fabric.overall_severity(t.imbalance)


@query
def q13a_udp_share(t):
    return rdma.udp_share(t.last(DAY).flows, as_of(), DAY)


@query
def q13b_top_udp_pairs(t):
    return rdma.top_udp_pairs(t.last(WEEK).flows, as_of(), WEEK)


@query
def q13c_queue_signals(t):
    return rdma.queues_with_signals(t.last(DAY).queues, as_of(), DAY)


@query
def q13d_rdma_assessment(t):
    rows = rdma.assess(rdma.udp_share(t.last(DAY).flows, as_of(), DAY), rdma.queues_with_signals(t.last(DAY).queues, as_of(), DAY))
    return rows.select(
        "tenant_id", "severity", F.array_join("drivers", " | ").alias("drivers"), F.round("roce_share", 6).alias("roce_share")
    )


# Baselines and detectors -----------------------------------------------------------------------------------------------------------
@query
def q14_baselines(t):
    return baselines.compute_baselines(t.last(WEEK).flows, as_of())


@query
def q14_moments(t):
    """The baselines from a table of moments of each hour: first without a tenth of two days' rows, which come late, then with
    these days refreshed."""
    at, rows = f"{folder(t.spark)}/moments", t.last(WEEK).flows
    late = F.to_date("ts_bucket").isin("2024-01-26", "2024-01-29") & (F.pmod(F.xxhash64("src_ip", "dst_ip", "ts_bucket"), F.lit(10)) == 0)
    baselines.refresh_moments(rows.where(~late), at, [f"2024-01-{d}" for d in range(24, 32)])
    baselines.refresh_moments(rows, at, ["2024-01-26", "2024-01-29"])
    found = baselines.baselines_from_moments(t.spark.read.parquet(at), rows, as_of())
    return found.withColumns({c: F.round(c, 3) for c in ("mean_value", "stddev_value")})


@query
def q15a_threshold_detector(t):
    data = F.from_json("metadata_json", "in_util_pct double, out_util_pct double, sample_ts string")
    rows = detect.threshold_breaches(t.utilization, as_of(), ("ts_bucket", "event_id")).withColumn("d", data)
    return rows.withColumns(
        {"in_util_pct": F.round("d.in_util_pct", 6), "out_util_pct": F.round("d.out_util_pct", 6), "sample_ts": F.col("d.sample_ts")}
    ).drop("metadata_json", "d")


@query
def q15b_spike_detector(t):
    data = F.from_json(
        "metadata_json", "z_score double, current_bytes long, baseline_mean double, baseline_stddev double, baseline_sample_count long"
    )
    rows = detect.spikes(t.flows, baselines.compute_baselines(t.last(WEEK).flows, as_of()), as_of(), DAY).withColumn("d", data)
    return rows.select("*", "d.*").withColumns(
        {"baseline_mean": F.round("baseline_mean", 3), "baseline_stddev": F.round("baseline_stddev", 3)}
    ).drop("metadata_json", "d")


@query
def q15b_spike_scores(t):
    return detect.spike_scores(
        t.flows, baselines.compute_baselines(t.last(WEEK).flows, as_of()), as_of(), DAY
    ).select("tenant_id", "device", "interface", "current_bytes", "sample_count", "z_score")


@query
def q15c_rdma_stress(t):
    return detect.rdma_stress(t.last(DAY).queues, as_of(), DAY)


def _events(t):
    return detect.run_all(
        t.utilization, t.last(DAY).flows, t.last(DAY).queues, baselines.compute_baselines(t.last(WEEK).flows, as_of()), t.tenants, as_of(),
        DAY, ("ts_bucket", "event_id")
    )


@query
def q15d_run_all(t):
    return _events(t).select("tenant_id", "scope", "anomaly_type", "severity")


@query
def q15e_event_counts(t):
    return detect.event_counts(_events(t))


@query
def q16a_fingerprint(t):
    cause = F.when(F.col("event_id") % 2 == 0, F.format_string('{"queue_id": %d, "in": {"b": "\u00e9", "a": [1, 2]}}', "event_id"))
    return t.anomalies.select("event_id", C.fingerprint("tenant_id", "anomaly_type", "scope", cause).alias("fingerprint"))


def _halves(t):
    rows = anomalies.with_fingerprint(t.anomalies)
    cut = C.at("2024-01-16 00:00:00")
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)


@query
def q16b_record_anomalies(t):
    before, after = _halves(t)
    rows = anomalies.record(anomalies.condense(before, "event_id"), after, "event_id")
    return rows.select("tenant_id", "fingerprint", "severity", "occurrence_count", "first_seen_at", "last_seen_at")


@query
def q16c_escalation(t):
    before, after = _halves(t)
    a, b = anomalies.condense(before, "event_id").select(
        "fingerprint", F.col("severity").alias("old")
    ), anomalies.condense(after, "event_id").select("fingerprint", F.col("severity").alias("new"))
    return a.join(b, "fingerprint").select("fingerprint", anomalies.escalate(F.col("old"), F.col("new")).alias("severity"))


@query
def q16d_ack_resolve(t):
    stored = anomalies.condense(anomalies.with_fingerprint(t.anomalies), "event_id")
    commands = stored.where("occurrence_count % 2 = 0").select(
        "tenant_id", "fingerprint", F.lit("ack").alias("action"), F.col("last_seen_at").alias("at")
    )
    commands = commands.unionByName(
        stored.where("occurrence_count % 3 = 0").select(
            "tenant_id", "fingerprint", F.lit("resolve").alias("action"), F.col("first_seen_at").alias("at")
        )
    )
    return anomalies.apply_commands(stored, commands).select("tenant_id", "fingerprint", "acknowledged_at", "resolved_at", "changed")


# Freshness, retention, usage --------------------------------------------------------------------------------------------------------
def _sources(t):
    return freshness.heartbeats(t.view("heartbeat_raw"))


@query
def q17a_heartbeats(t):
    rows = t.view("heartbeat_raw")
    cut = C.at("2024-01-16 00:00:00")
    return freshness.merge_heartbeats(
        freshness.heartbeats(rows.where(F.col("ts") < cut)), freshness.heartbeats(rows.where(F.col("ts") >= cut))
    )


@query
def q17b_classify(t):
    return freshness.scan(_sources(t), as_of(), 60).select("tenant_id", "source_kind", "device", "status")


@query
def q17c_silent_sources(t):
    return freshness.silent_events(freshness.scan(_sources(t), as_of()), as_of()).select(
        "tenant_id", "scope", "severity", "summary", "fingerprint"
    )


@query
def q17d_freshness_listing(t):
    return freshness.listing(freshness.scan(_sources(t), as_of(), 60), "stale, silent")


@query
def q18_retention(t):
    return retention.keep(t.flows, C.at("2024-04-20 00:00:00"), 90).select("tenant_id", "ts_bucket", "device", "bytes_estimated")


@query
def q18_drop_months(t):
    """Flows and queues laid out by month, times of odd minutes 100 days earlier; old months dropped, and what is left then."""
    at = folder(t.spark)
    tables = {"flow_summary_minute": t.flows.select("ts_bucket", "device"), "queue_stats_minute": t.queues.select("ts_bucket", "device")}
    for name, rows in tables.items():
        moved = F.when(
            F.minute("ts_bucket") % 2 == 1, F.col("ts_bucket") - F.make_dt_interval(days=F.lit(100))
        ).otherwise(F.col("ts_bucket"))
        sinks.append_monthly(rows.withColumn("ts_bucket", moved), f"{at}/{name}")
    dropped = retention.prune(t.spark, {name: f"{at}/{name}" for name in tables}, as_of()).withColumn("state", F.lit("dropped"))
    for name in tables:
        kept = t.spark.read.parquet(f"{at}/{name}").groupBy(F.col("month").cast("int").alias("month")).agg(F.count("*").alias("n_rows"))
        dropped = dropped.unionByName(kept.withColumns({"table": F.lit(name), "state": F.lit("kept")}))
    return dropped.withColumnRenamed("table", "table_name")


@query
def q18_dropped_months(t):
    return retention.dropped_months(t.queues, C.at("2024-03-05 00:00:00"), 30)


@query
def q19a_call_enrichment(t):
    calls = t.calls.withColumn("args_json", F.expr(CALL_ARGS))
    return usage.enrich(calls).select("event_id", "args_hash", "args_truncated", "confidence_band")


#: Arguments with numbers as people write them, a control character and a key that occurs twice; the SQL has what is hashed.
NUMBER_ARGS = """concat('{"v": 1.0, "e": 1E20, "s": 1e-7, "i": 12345678901234567890123456789012345678901234, "d": "\\u007F", "k": 3, "n": ', CAST(event_id AS STRING), '.50, "k": ', CAST(event_id % 7 AS STRING), '}')"""


@query
def q19a_number_texts(t):
    calls = t.calls.withColumn("args_json", F.expr(NUMBER_ARGS))
    return usage.enrich(calls).select("event_id", "args_hash")


@query
def q19b_recent_calls(t):
    return usage.recent_calls(t.calls, "get_device_state").select("tenant_id", "position", "event_id", "status")


@query
def q19c_quota_usage(t):
    return usage.quota_usage(t.calls)


@query
def q19d_quota_decisions(t):
    return usage.quota_decisions(t.calls, t.limits).select("event_id", "calls_so_far", "bytes_so_far", "allowed", "reason")


@query
def q19e_quota_listing(t):
    lower = t.limits.withColumn("call_limit", F.col("call_limit") - 1).where(F.col("tool_name") == "get_device_state")
    return usage.current_period(usage.quota_usage(t.calls), usage.set_limits(t.limits, lower), C.at("2024-01-20 08:00:00"))


@query
def q20_rate_report(t):
    return usage.rate_report(t.calls, dict.fromkeys(usage.CALL_LIMITS, 1), 2, 3600).select("event_id", "calls_before", "over")


@query
def q20_rate_decisions(t):
    return usage.rate_decisions(t.calls, dict.fromkeys(usage.CALL_LIMITS, 1), 2, 3600)
