"""Fixed expectations of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meshlytics.functions import columns as C
from meshlytics.operators import anomalies, baselines, detect, fabric, flows, freshness, normalize, rdma, usage
from meshlytics.sources import feeds, sinks

T = "t1"
NOW = "2026-01-10 12:00:00"


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize(
    ("utils", "reason"), [([40, 41, 39, 42], "balanced"), ([80, 10, 10, 10], "imbalanced"), ([1, 0, 0, 0], "below_min_util")]
)
def test_imbalance(spark, utils, reason):
    members = spark.createDataFrame(
        [(T, "d", str(i), float(u)) for i, u in enumerate(utils)], "tenant_id string, device string, interface string, avg_util_pct double"
    )
    groups = spark.createDataFrame(
        [(T, "d", "g", ["0", "1", "2", "3", "9"], "configured")],
        "tenant_id string, device string, group_name string, members array<string>, source string"
    )
    row = fabric.group_imbalance(groups, members).first()
    assert row["reason"] == reason and row["n_members"] == 4


def test_single_member_is_no_group(spark):
    members = spark.createDataFrame([(T, "d", "0", 50.0)], "tenant_id string, device string, interface string, avg_util_pct double")
    groups = spark.createDataFrame(
        [(T, "d", "g", ["0", "1"], "configured")],
        "tenant_id string, device string, group_name string, members array<string>, source string"
    )
    assert fabric.group_imbalance(groups, members).count() == 0


QUEUE = "tenant_id string, device string, interface string, queue_id int, pfc_pause_rx long, pfc_pause_tx long, ecn_marked_packets long, dropped_packets long, peak_depth_bytes long"


@pytest.mark.parametrize(("queues", "share", "severity", "n"), [
    ([(10, 0, 0, 5)], 0.0, "critical", 1), ([(2000, 0, 0, 0)], 0.0, "high", 1), ([(1000, 0, 0, 0)], 0.0, "low", 1),
    ([(0, 0, 7, 0)], 0.0, "medium", 1),
    ([(0, 0, 0, 3), (0, 0, 7, 0)], 0.0, "medium", 2), ([], 0.9, "low", 1), ([], 0.1, "low", 1),
])
def test_rdma_severity(spark, queues, share, severity, n):
    rows = spark.createDataFrame([(T, "d", "i", k, *q, 0) for k, q in enumerate(queues)], QUEUE)
    shares = spark.createDataFrame([(T, share)], "tenant_id string, roce_share double")
    row = rdma.assess(shares, rows).first()
    assert row["severity"] == severity and len(row["drivers"]) == n


@pytest.mark.parametrize(
    ("kind", "seconds", "status"),
    [
        ("sflow", 170, "fresh"), ("sflow", 180, "stale"), ("sflow", 900, "silent"), ("gnmi", 90, "stale"), ("gnmi", 540, "silent"),
        ("other", 299, "fresh"), ("other", 301, "stale")
    ]
)
def test_freshness(spark, kind, seconds, status):
    last = at(NOW) - dt.timedelta(seconds=seconds)
    row = spark.createDataFrame([(kind, last)], "k string, t timestamp").select(
        freshness.classify(C.at(NOW), F.col("t"), F.col("k")).alias("s")
    ).first()
    assert row["s"] == status


def test_fingerprint_tells_causes_apart(spark):
    df = spark.createDataFrame(
        [
            ("t", "pfc_storm", "device:s", '{"queue":3}'), ("t", "pfc_storm", "device:s", '{"queue":4}'),
            ("t", "pfc_storm", "device:s", None)
        ],
        "a string, b string, c string, d string"
    )
    found = [r[0] for r in df.select(C.fingerprint("a", "b", "c", F.col("d"))).collect()]
    import hashlib

    assert len(set(found)) == 3 and found[2] == hashlib.sha256(b"t|pfc_storm|device:s|").hexdigest()


def test_status_time_and_text_clean_up(spark):
    df = spark.createDataFrame(
        [("oc:up", "1767225600123456789", " x "), (None, "2026-01-01T00:00:00Z", " "), ("odd", "never", None)],
        "s string, t string, x string"
    )
    rows = df.select(
        C.admin_state("s").alias("a"), C.oper_state("s").alias("o"), C.bgp_state("s").alias("b"), C.parse_time("t").alias("t"),
        C.safe_str("x").alias("x")
    ).collect()
    assert [(r.a, r.o, r.b) for r in rows] == [("UP", "UP", "IDLE"), ("UNKNOWN", "UNKNOWN", "IDLE"), ("UNKNOWN", "UNKNOWN", "IDLE")]
    assert rows[0].t.microsecond == 123456 and rows[1].t is not None and rows[2].t is None
    assert [r.x for r in rows] == ["x", None, None]


def test_parsers_keep_last_leaf_and_drop_incomplete(spark):
    def up(path, val):
        return {"path": path, "val": val}

    i = "interfaces/interface[name=Ethernet0]/state/"
    feed = spark.createDataFrame(
        [("leaf1", at(NOW), [{"update": [up(i + "oper-status", "DOWN"), up(i + "oper-status", "UP"), up(i + "admin-status", "UP"), up(i + "mtu", "x")]}, {"update": [up("interfaces/interface[name=Ethernet9]/state/mtu", "9000")]}])],
        feeds.NOTIFICATIONS
    )
    rows = feeds.interface_states(feeds.flatten_notifications(feed)).collect()
    assert len(rows) == 1 and rows[0].oper_status == "UP" and rows[0].mtu is None
    q = "qos/interfaces/interface[interface-id=Ethernet0]/output/queues/queue[name=%s]/state/dropped-pkts"
    feed = spark.createDataFrame([("leaf1", at(NOW), [{"update": [up(q % "3", "7"), up(q % "gold", "1")]}])], feeds.NOTIFICATIONS)
    rows = {r.queue_id: r.dropped_packets for r in feeds.queue_stats(feeds.flatten_notifications(feed)).collect()}
    assert rows[3] == 7 and len(rows) == 2 and all(0 <= k < 1024 for k in rows)


def test_flow_feed_defaults_and_bad_rows(spark):
    doc = '{"flows":[{"agent":"a","bytes":"5","samplingrate":"10"},{"bytes":"5"},{"agent":"b","bytes":"x"}]}'
    feed = spark.createDataFrame([(doc,)], "d string").select(F.from_json("d", feeds.FLOW_FEED).alias("f")).select("f.*")
    rows = feeds.flow_records(feed, C.at(NOW)).collect()
    assert len(rows) == 1 and (rows[0].src_ip, rows[0].bytes, rows[0].packets, rows[0].sampling_rate) == ("0.0.0.0", 5, 0, 10)


def test_compare_windows_directions(spark):
    rows = [(T, at("2026-01-01 00:00:00"), "d", 100), (T, at("2026-01-02 00:00:00"), "d", 106), ("t2", at("2026-01-02 00:00:00"), "d", 5)]
    df = spark.createDataFrame(rows, "tenant_id string, ts_bucket timestamp, device string, bytes_estimated long")
    w = lambda a, b: (C.at(f"2026-01-0{a} 00:00:00"), C.at(f"2026-01-0{b} 00:00:00"))
    got = {r.tenant_id: (r.direction, r.delta_bytes_pct) for r in flows.compare_windows(df, w(1, 2), w(2, 3)).collect()}
    assert got[T][0] == "increase" and got["t2"] == ("stable", 0.0)


def test_record_counts_up_escalates_and_reopens(spark):
    base = [(T, "k", "s", "medium", "one", None, at("2026-01-01 00:00:00"), "f")]
    schema = "tenant_id string, anomaly_type string, scope string, severity string, summary string, metadata_json string, ts timestamp, fingerprint string"
    stored = anomalies.condense(spark.createDataFrame(base, schema))
    worse = spark.createDataFrame(
        [
            (T, "k", "s", "critical", "two", None, at("2026-01-02 00:00:00"), "f"),
            (T, "k", "s", "low", "three", None, at("2026-01-03 00:00:00"), "f")
        ],
        schema
    )
    row = anomalies.record(stored, worse).first()
    assert (row.occurrence_count, row.severity, row.summary) == (3, "critical", "three")
    resolved = stored.withColumn("resolved_at", C.at(NOW))
    assert sorted(r.occurrence_count for r in anomalies.record(resolved, worse).collect()) == [1, 2]


def test_spike_needs_samples_and_spread(spark):
    flow = spark.createDataFrame(
        [(T, at(NOW), "d", "i", 1000)], "tenant_id string, ts_bucket timestamp, device string, interface string, bytes_estimated long"
    )
    schema = "tenant_id string, device string, interface string, hour_of_day int, mean_value double, stddev_value double, sample_count long, computed_at timestamp"
    for base, n in (((100.0, 10.0, 3), 1), ((100.0, 0.0, 3), 0), ((100.0, 10.0, 2), 0)):
        known = spark.createDataFrame(
            [(T, "d", "i", 12, *base, at(NOW)), (T, "d", "i", 12, 0.0, 1e9, 9, at("2026-01-01 00:00:00"))], schema
        )
        assert detect.spikes(flow, known, C.at(NOW)).count() == n


def test_baseline_uses_population_deviation(spark):
    rows = [(T, at(f"2026-01-0{d} 05:00:00"), "d", "i", b) for d, b in ((4, 10), (5, 20), (6, 30))]
    df = spark.createDataFrame(rows, "tenant_id string, ts_bucket timestamp, device string, interface string, bytes_estimated long")
    row = baselines.compute_baselines(df, C.at(NOW)).first()
    assert (row.hour_of_day, row.mean_value, row.sample_count) == (5, 20.0, 3) and abs(row.stddev_value - (200 / 3) ** 0.5) < 1e-9


def test_counter_speed_and_cap(spark):
    df = spark.createDataFrame(
        [("a", 1, "e", 0, 10**12, 30, 1, 2, at(NOW))],
        "agent string, if_index int, if_name string, if_speed long, if_in_octets long, if_out_octets long, if_in_errors int, if_out_errors int, timestamp timestamp"
    )
    row = normalize.normalize_counters(df).first()
    assert (row.in_util_pct, row.out_bps, row.error_count) == (100.0, 8, 3)


def test_rate_decisions_match_a_plain_limiter(spark):
    import random

    random.seed(4)
    times = sorted(random.choice(range(0, 40_000_000_000, 7_000_000)) for _ in range(700))
    rows = [(k, "tool", at("2026-01-01 00:00:00") + dt.timedelta(microseconds=t)) for k, t in enumerate(times)]
    got = {
        r.event_id: r.accepted for r in usage.rate_decisions(
            spark.createDataFrame(rows, "event_id long, tool_name string, ts timestamp"), {"tool": 1}
        ).collect()
    }
    kept, want = [], {}
    for k, t in enumerate(times):
        kept = [x for x in kept if t - x < 60_000_000]
        want[k] = len(kept) < 1
        kept += [t] * want[k]
    assert got == want and not all(want.values())


def test_truncated_args(spark):
    df = spark.createDataFrame([('{"a":"' + "x" * 600 + '","b":"y"}', "EXACT, sampled")], "args_json string, confidence_note string")
    row = usage.enrich(df).first()
    assert row.args_truncated == '{"a":"' + "x" * 512 + '…","b":"y"}' and row.confidence_band == "exact"


def test_canonical_json(spark):
    """As Python's json with sorted keys, the least separators and ASCII only; also of what is kept in order or nested."""
    import hashlib
    import json

    texts = [
        '{"k": 87}', '{"b": 1, "a": {"d": [1, 2, {"z": null, "y": true}], "c": "x y"}}', '{"é": "ü 日本 😀", "a": -1.5}', "{}", '[3, "a"]',
        '"t\\n"'
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "no json", None])], "k long, t string")
    got = {r.k: (r.c, r.h) for r in df.select("k", C.canonical_json("t").alias("c"), usage.args_hash(F.col("t")).alias("h")).collect()}
    for k, t in enumerate(texts):
        want = json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"))
        assert got[k] == (want, hashlib.sha256(want.encode()).hexdigest())
    assert got[len(texts)] == got[len(texts) + 1] == (None, None)


def test_truncation_keeps_other_values(spark):
    args = '{"n": 87, "long": "' + "y" * 513 + '", "o": {"b": 1, "a": "x"}, "q": "a\\"b", "none": null}'
    df = spark.createDataFrame([(1, args, "x"), (2, "{}", "x"), (3, None, "x")], "k long, args_json string, confidence_note string")
    got = {r.k: r.args_truncated for r in usage.enrich(df).collect()}
    assert got[1] == '{"long":"' + "y" * 512 + '…","n":87,"none":null,"o":{"a":"x","b":1},"q":"a\\"b"}' and got[2] is None and got[3] is None


def test_argument_bounds(spark):
    events = spark.createDataFrame([], "id long, tenant_id string, ts timestamp, severity string, scope string")
    for wrong in ({"limit": 0}, {"limit": 1001}, {"severity_min": "odd"}):
        with pytest.raises(ValueError):
            anomalies.recent(events, C.at(NOW), 30, **wrong)
    with pytest.raises(ValueError):
        usage.recent_calls(events, limit=5000)


def test_quota_decisions_by_minutes_are_those_of_one_window(spark):
    rows = [(k, T, "tool", at(f"2026-01-05 {k // 120:02d}:{k % 60:02d}:{(k * 7) % 60:02d}"), None if k % 5 == 0 else k) for k in range(600)]
    calls = spark.createDataFrame(rows, "event_id long, tenant_id string, tool_name string, ts timestamp, response_bytes long")
    limits = spark.createDataFrame([(T, "tool", 400, 60_000)], "tenant_id string, tool_name string, call_limit long, byte_limit long")
    got = {r.event_id: (r.calls_so_far, r.bytes_so_far, r.allowed, r.reason) for r in usage.quota_decisions(calls, limits).collect()}
    n = size = 0
    for k, _, _, ts, b in sorted(rows, key=lambda r: (r[3], r[0])):
        n, size = n + 1, size + (b or 0)
        seen = None if got[k][1] is None else size
        assert got[k] == (
            n, seen, n <= 400 and size <= 60_000, "call_limit_exceeded" if n > 400 else "byte_limit_exceeded" if size > 60_000 else "ok"
        )


def test_month_layout_prunes(spark, tmp_path):
    df = spark.createDataFrame(
        [(T, at("2026-01-05 00:00:00"), "d"), (T, at("2025-11-05 00:00:00"), "d")], "tenant_id string, ts_bucket timestamp, device string"
    )
    path = str(tmp_path / "t")
    sinks.append_monthly(df, path)
    sinks.append_monthly(df, path)
    back = spark.read.parquet(path).where(C.trailing_months(C.at(NOW), 10_080) & C.trailing("ts_bucket", C.at(NOW), 10_080))
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(month" in back._jdf.queryExecution().toString()


def test_upsert(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, n int")
    b = spark.createDataFrame([(2, 1), (3, None)], "k int, n int")
    assert {(r.k, r.n) for r in sinks.upsert(a, b, ["k"], {"n": lambda x, y: x + y}).collect()} == {(1, 5), (2, 7), (3, None)}


def test_notifications_of_one_time_stay_apart(spark):
    """Messages of the same device, time and key, alike or not, are as many rows."""
    def message(path, **leaves):
        return ("leaf1", at(NOW), [{"update": [{"path": path + leaf.replace("_", "-"), "val": v} for leaf, v in leaves.items()]}])

    i, n = "interfaces/interface[name=Ethernet0]/state/", "bgp/neighbors/neighbor[neighbor-address=10.0.0.1]/state/"
    q = "qos/interfaces/interface[interface-id=Ethernet0]/output/queues/queue[name=3]/state/"
    feed = spark.createDataFrame(
        [
            *[message(i, oper_status=s, admin_status="UP") for s in ("UP", "UP", "DOWN")],
            *[message(n, session_state=s, peer_as="65001") for s in ("IDLE", "ACTIVE", "IDLE")], *[message(q, dropped_pkts="7")] * 2
        ], feeds.NOTIFICATIONS
    ).repartition(3)
    updates = feeds.flatten_notifications(feed)
    assert sorted(r.oper_status for r in feeds.interface_states(updates).collect()) == ["DOWN", "UP", "UP"]
    assert sorted(r.session_state for r in feeds.bgp_neighbors(updates).collect()) == ["ACTIVE", "IDLE", "IDLE"]
    assert [r.dropped_packets for r in feeds.queue_stats(updates).collect()] == [7, 7]


def test_rate_report_counts_as_a_range_does(spark):
    """Equal times, the window's very ends, times before 1970, null times and tools; windows as long as a block and short ones."""
    hour = 3_600_000_000
    us = [0, 0, 1, hour - 1, hour, hour, hour + 1, 2 * hour - 1, 2 * hour, 5 * hour, -1, -hour, -hour - 1, -2 * hour, 90_000_000, None, None]
    rows = [(k, tool, t) for tool in ("a", None) for k, t in enumerate(us)]
    calls = spark.createDataFrame(rows, "event_id int, tool_name string, us long").select(
        "event_id", F.timestamp_micros("us").alias("ts"), "tool_name"
    )
    for seconds in (3600, 60, 7200):
        got = usage.rate_report(calls, {"a": 2}, 1, seconds)
        assert got.columns == ["event_id", "ts", "tool_name", "calls_before", "max_calls", "over"]
        for r in got.select("*", F.unix_micros("ts").alias("us")).collect():
            n = sum(u is None for u in us) if r.us is None else sum(r.us - seconds * 1_000_000 < u < r.us for u in us if u is not None)
            assert (r.calls_before, r.over) == (n, n >= (2 if r.tool_name else 1))
        assert got.count() == len(rows)


def test_rate_report_takes_dense_calls(spark):
    """A tool's busy hour is summed once, not anew for each call."""
    import time

    calls = spark.range(400_000).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 9000).alias("ts"), F.lit("a").alias("tool_name"))
    begun = time.time()
    assert usage.rate_report(calls, {"a": 2}, 1, 3600).agg(F.max("calls_before"), F.count("*")).first()[:] == (399_999, 400_000)
    assert time.time() - begun < 40
