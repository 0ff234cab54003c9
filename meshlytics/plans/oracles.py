"""The queries once more, as SQL for an independent engine."""

from __future__ import annotations

from .fixtures import VIEWS
from .queries import CALL_ARGS

END, WEEK_AGO, DAY_AGO = "TIMESTAMP '2024-01-31 00:00:00'", "TIMESTAMP '2024-01-24 00:00:00'", "TIMESTAMP '2024-01-30 00:00:00'"
CUT = "TIMESTAMP '2024-01-16 00:00:00'"
DEFAULT = "'00000000-0000-0000-0000-000000000001'"
RANK = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END"


def text(x: str, name: str | None = None) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {name or x}"


def name_of(p: str = "protocol") -> str:
    return f"CASE {p} WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' WHEN 112 THEN 'VRRP' WHEN 89 THEN 'OSPF' ELSE 'PROTO_' || {p} END"


def week(ts: str = "ts_bucket") -> str:
    return f"{ts} BETWEEN {WEEK_AGO} AND {END}"


def day(ts: str = "ts_bucket") -> str:
    return f"{ts} BETWEEN {DAY_AGO} AND {END}"


def routed(columns: str, table: str, kind: str, by: str) -> str:
    return f"SELECT {columns}, coalesce(c.tenant_id, {DEFAULT}) AS tenant_id FROM {table} r LEFT JOIN collector_sources c ON c.is_active AND c.source_kind = '{kind}' AND c.source_identifier = r.{by}"


def bps(c: str) -> str:
    return f"CAST(trunc({c} * 8 / 30) AS BIGINT)"


SPEED = "CASE WHEN if_speed > 0 THEN if_speed ELSE 1000000000 END"
MINUTE = "date_trunc('minute', timestamp)"
BASE = dict(VIEWS) | {
    "flow_sums": f"""SELECT {MINUTE} AS ts_bucket, agent AS device, CAST(input_if_index AS VARCHAR) AS interface, src_ip, dst_ip, protocol,
      CAST(sum(bytes * sampling_rate) AS BIGINT) AS bytes_estimated, CAST(sum(packets * sampling_rate) AS BIGINT) AS packets_estimated, arg_max(sampling_rate, event_id) AS sampling_rate
      FROM flow_raw GROUP BY ALL""",
    "flows": routed("r.*", "flow_sums", "sflow", "device"),
    "counters": f"""SELECT event_id, {MINUTE} AS ts_bucket, agent AS device, if_name AS interface, {bps("if_in_octets")} AS in_bps, {bps("if_out_octets")} AS out_bps,
      least(100.0, {bps("if_in_octets")} / ({SPEED}) * 100) AS in_util_pct, least(100.0, {bps("if_out_octets")} / ({SPEED}) * 100) AS out_util_pct, if_in_errors + if_out_errors AS error_count FROM counter_raw""",
    "utilization": routed("r.*, greatest(in_util_pct, out_util_pct) AS u", "counters", "sflow", "device"),
    "states": routed(f"r.*, {MINUTE} AS ts_bucket", "iface_raw", "gnmi", "device"),
    "bgp": routed(f"r.*, {MINUTE} AS ts_bucket", "bgp_raw", "gnmi", "device"),
    "queues": routed(f"r.*, {MINUTE} AS ts_bucket", "queue_raw", "gnmi", "device"),
}
#: What later parts of several queries start from.
PARTS = {
    "talkers": f"""SELECT *, {name_of()} AS protocol_name, CASE WHEN t <> 0 THEN bytes_estimated / t * 100 ELSE 0 END AS pct_of_total FROM (
      SELECT *, sum(bytes_estimated) OVER (PARTITION BY tenant_id) AS t FROM (
        SELECT tenant_id, src_ip, dst_ip, protocol, CAST(sum(bytes_estimated) AS BIGINT) AS bytes_estimated, avg(sampling_rate) AS avg_sampling_rate,
          row_number() OVER (PARTITION BY tenant_id ORDER BY sum(bytes_estimated) DESC, src_ip, dst_ip, protocol) AS rank FROM flows WHERE {week()} GROUP BY 1, 2, 3, 4) WHERE rank <= 10)""",
    "mix": f"""SELECT *, {name_of()} AS protocol_name, bytes_estimated / sum(bytes_estimated) OVER (PARTITION BY tenant_id) * 100 AS pct_of_bytes FROM (
      SELECT tenant_id, protocol, CAST(sum(bytes_estimated) AS BIGINT) AS bytes_estimated, CAST(sum(packets_estimated) AS BIGINT) AS packets_estimated FROM flows WHERE {week()} GROUP BY 1, 2)""",
    "peaks": f"""SELECT tenant_id, device, interface, max(u) AS peak_util_pct, first(ts_bucket ORDER BY u DESC, ts_bucket) AS peak_ts, count(*) AS n_samples FROM utilization WHERE {week()} GROUP BY 1, 2, 3""",
    "contributors": f"""SELECT *, {name_of()} AS protocol_name, bytes_estimated / sum(bytes_estimated) OVER (PARTITION BY tenant_id, device, interface) * 100 AS pct_of_link FROM (
      SELECT tenant_id, device, interface, src_ip, dst_ip, protocol, CAST(sum(bytes_estimated) AS BIGINT) AS bytes_estimated,
        row_number() OVER (PARTITION BY tenant_id, device, interface ORDER BY sum(bytes_estimated) DESC, src_ip, dst_ip, protocol) AS rank FROM flows WHERE {week()} GROUP BY 1, 2, 3, 4, 5, 6) WHERE rank <= 5""",
    "recent50": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id) AS position FROM anomaly_raw WHERE {week("ts")} AND severity IN ('medium', 'high', 'critical')) WHERE position <= 50""",
    "recent25": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id) AS position FROM anomaly_raw WHERE {week("ts")}) WHERE position <= 25""",
    "facts": """SELECT tenant_id, 'severity' AS kind, severity AS value, count(*) AS n, min(position) AS first_position FROM recent25 GROUP BY ALL
      UNION ALL SELECT tenant_id, 'type', anomaly_type, count(*), min(position) FROM recent25 GROUP BY ALL UNION ALL SELECT tenant_id, 'scope', scope, count(*), min(position) FROM recent25 GROUP BY ALL""",
    "last_iface": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, device, interface ORDER BY ts_bucket DESC, event_id DESC) AS k FROM states WHERE {day()}) WHERE k = 1""",
    "qsums": f"""SELECT tenant_id, device, interface, queue_id, max(max_depth_bytes) AS peak_depth_bytes, CAST(sum(pfc_pause_rx) AS BIGINT) AS pfc_pause_rx, CAST(sum(pfc_pause_tx) AS BIGINT) AS pfc_pause_tx,
      CAST(sum(ecn_marked_packets) AS BIGINT) AS ecn_marked_packets, CAST(sum(dropped_packets) AS BIGINT) AS dropped_packets FROM queues WHERE {day()} GROUP BY 1, 2, 3, 4""",
    "members": f"SELECT tenant_id, device, interface, round(avg(u), 2) AS avg_util_pct FROM utilization WHERE {week()} GROUP BY 1, 2, 3",
    "by_speed": f"""SELECT tenant_id, device, 'auto-' || CASE WHEN s >= 400000000000 THEN '400G' WHEN s >= 100000000000 THEN '100G' WHEN s >= 25000000000 THEN '25G' WHEN s >= 10000000000 THEN '10G' WHEN s >= 1000000000 THEN '1G' ELSE s || 'bps' END AS group_name,
      list(interface ORDER BY interface) AS ms FROM (SELECT DISTINCT tenant_id, device, interface, coalesce(speed_bps, 0) AS s FROM states WHERE {day()} AND oper_status = 'UP') GROUP BY tenant_id, device, s HAVING count(*) >= 2""",
    "configured": routed("r.device, group_name, string_split(members_csv, ',') AS ms", "ecmp_groups", "gnmi", "device"),
    "resolved": """SELECT tenant_id, device, group_name, ms, 'configured' AS source FROM configured UNION ALL
      SELECT tenant_id, device, group_name, ms, 'inferred_by_speed' FROM by_speed b WHERE NOT EXISTS (SELECT 1 FROM configured c WHERE c.tenant_id = b.tenant_id AND c.device = b.device)""",
    "imbalance": """SELECT *, NOT low AND (cv > 0.3 OR max_mean_ratio > 1.5) AS is_imbalanced FROM (
      SELECT *, mean_util_pct < 5 AS low, CASE WHEN mean_util_pct < 5 THEN 0 ELSE sd / mean_util_pct END AS cv, CASE WHEN mean_util_pct < 5 THEN 1 ELSE max_util_pct / mean_util_pct END AS max_mean_ratio FROM (
        SELECT r.tenant_id, r.device, group_name, source, count(*) AS n_members, avg(avg_util_pct) AS mean_util_pct, max(avg_util_pct) AS max_util_pct, stddev_pop(avg_util_pct) AS sd, string_agg(m.interface, ',' ORDER BY m.interface) AS members
        FROM (SELECT tenant_id, device, group_name, source, unnest(ms) AS interface FROM resolved) r JOIN members m ON m.tenant_id = r.tenant_id AND m.device = r.device AND m.interface = r.interface GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2))""",
    "shares": f"""SELECT tenant_id, CAST(coalesce(sum(bytes_estimated) FILTER (protocol = 17), 0) AS BIGINT) AS udp_bytes, CAST(sum(bytes_estimated) AS BIGINT) AS total_bytes FROM flows WHERE {day()} GROUP BY 1""",
    "signals": "SELECT * FROM qsums WHERE pfc_pause_rx <> 0 OR pfc_pause_tx <> 0 OR ecn_marked_packets <> 0 OR dropped_packets <> 0",
    "baselines": f"""SELECT tenant_id, device, interface, hour(ts_bucket) AS hour_of_day, avg(b) AS mean_value, stddev_pop(b) AS stddev_value, count(*) AS sample_count FROM (
      SELECT tenant_id, device, interface, ts_bucket, CAST(sum(bytes_estimated) AS BIGINT) AS b FROM flows WHERE {week()} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""",
    "scores": f"""SELECT c.*, mean_value, stddev_value, sample_count, (current_bytes - mean_value) / stddev_value AS z_score FROM (
      SELECT tenant_id, device, interface, CAST(sum(bytes_estimated) AS BIGINT) AS current_bytes FROM flows WHERE {day()} GROUP BY 1, 2, 3) c
      JOIN baselines b ON b.tenant_id = c.tenant_id AND b.device = c.device AND b.interface = c.interface AND hour_of_day = 0 AND stddev_value <> 0""",
    "breaches": f"""SELECT *, CASE WHEN in_util_pct > out_util_pct THEN 'inbound' ELSE 'outbound' END AS direction FROM (
      SELECT *, row_number() OVER (PARTITION BY tenant_id, device, interface ORDER BY ts_bucket DESC, event_id DESC) AS k FROM utilization WHERE ts_bucket <= {END}) WHERE k = 1 AND u >= 60""",
    "stress": """SELECT *, pfc_pause_rx + pfc_pause_tx AS pfc, dropped_packets > 0 AND pfc_pause_rx + pfc_pause_tx > 0 AS lossless, 'device:' || device || '/interface:' || interface || '/queue:' || queue_id AS scope FROM qsums""",
    "stress_events": """SELECT tenant_id, scope, 'lossless_drop' AS anomaly_type, 'critical' AS severity, printf('Lossless drop: queue %d on %s@%s has %d drops AND %d PFC pauses in last 1440 min — RDMA transport will retransmit and stall.', queue_id, interface, device, dropped_packets, pfc) AS summary,
        printf('{"drops":%d,"pfc_total":%d,"ecn_marks":%d}', dropped_packets, pfc, ecn_marked_packets) AS metadata_json FROM stress WHERE lossless
      UNION ALL SELECT tenant_id, scope, 'pfc_storm', 'high', printf('PFC pause storm on queue %d (%s@%s): %d pause frames in last 1440 min — sustained receiver-side congestion.', queue_id, interface, device, pfc), printf('{"pfc_rx":%d,"pfc_tx":%d,"threshold":1000}', pfc_pause_rx, pfc_pause_tx) FROM stress WHERE NOT lossless AND pfc >= 1000
      UNION ALL SELECT tenant_id, scope, 'ecn_spike', 'medium', printf('ECN marking spike on queue %d (%s@%s): %d marked packets in last 1440 min — DCQCN is throttling senders.', queue_id, interface, device, ecn_marked_packets), printf('{"ecn_marks":%d,"threshold":500}', ecn_marked_packets) FROM stress WHERE NOT lossless AND ecn_marked_packets >= 500""",
    "all_events": """SELECT tenant_id, 'device:' || device || '/interface:' || interface AS scope, 'threshold_breach' AS anomaly_type, CASE WHEN u >= 95 THEN 'critical' WHEN u >= 80 THEN 'high' ELSE 'medium' END AS severity FROM breaches
      UNION ALL SELECT tenant_id, 'device:' || device || '/interface:' || interface, 'spike', CASE WHEN z_score >= 6 THEN 'critical' WHEN z_score >= 5 THEN 'high' ELSE 'medium' END FROM scores WHERE z_score >= 3
      UNION ALL SELECT tenant_id, scope, anomaly_type, severity FROM stress_events""",
    "active_events": "SELECT * FROM all_events WHERE tenant_id IN (SELECT id FROM tenants WHERE is_active)",
    "printed": "SELECT *, sha256(tenant_id || '|' || anomaly_type || '|' || scope || '|') AS fingerprint FROM anomaly_raw",
    "conditions": f"""SELECT tenant_id, fingerprint, count(*) AS n, min(ts) AS lo, max(ts) AS hi, arg_max(severity, {RANK}) AS severity FROM printed GROUP BY 1, 2""",
    "beats": """SELECT tenant_id, source_kind, device, max(ts) AS last_ingest_ts, first(sample_count ORDER BY ts DESC, sample_count DESC) AS last_sample_count FROM heartbeat_raw GROUP BY 1, 2, 3""",
    "aged": f"""SELECT *, date_diff('microsecond', last_ingest_ts, {END}) / 1000000.0 / CASE source_kind WHEN 'sflow' THEN 180 WHEN 'gnmi' THEN 90 ELSE 300 END AS age FROM beats""",
    "classified": "SELECT *, CASE WHEN age / 60 >= 5 THEN 'silent' WHEN age / 60 >= 1 THEN 'stale' ELSE 'fresh' END AS status FROM aged",
    "daily": """SELECT tenant_id, tool_name, date_trunc('day', ts) AS period_start, count(*) AS calls_this_period, CAST(sum(response_bytes) AS BIGINT) AS bytes_out_this_period FROM tool_call_raw GROUP BY 1, 2, 3""",
    "limits": """SELECT tenant_id, tool_name, CAST(floor(avg(calls_this_period)) AS BIGINT) AS call_limit, CASE WHEN max(calls_this_period) % 2 = 0 THEN max(bytes_out_this_period) - 1 END AS byte_limit FROM daily GROUP BY 1, 2""",
}


def with_parts(sql: str) -> str:
    """The query and, before it, the parts that it needs, each once and in order."""
    import re

    every = BASE | PARTS
    needed, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in every.keys() & words - needed:
            needed.add(name)
            todo.append(every[name])
    parts = ",\n".join(f"{name} AS ({body})" for name, body in every.items() if name in needed)
    return f"WITH {parts}\n{sql}" if parts else sql


#: ``args_json`` with its keys sorted, without spaces.
SORTED = """'{' || list_aggregate(list_transform(list_sort(json_keys(args_json)), lambda k: '"' || k || '":' || CAST(json_extract(args_json, '$.' || k) AS VARCHAR)), 'string_agg', ',') || '}'"""
ORACLES = {k: with_parts(v) for k, v in {
    "s1_flow_feed": """SELECT agent, protocol, r AS sampling_rate, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, 0 AS max_output
      FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 1 ELSE sampling_rate END AS r FROM flow_raw WHERE event_id % 13 <> 0) GROUP BY 1, 2, 3""",
    "s2_counter_feed": """SELECT agent, CASE WHEN event_id % 3 > 0 THEN if_name ELSE 'if' || if_index END AS if_name, count(*) AS n, CAST(sum(CASE WHEN event_id % 11 > 0 THEN if_speed ELSE 1000000000 END) AS BIGINT) AS speed, CAST(sum(if_in_octets) AS BIGINT) AS in_octets, 0 AS errors
      FROM counter_raw WHERE event_id % 17 > 0 GROUP BY 1, 2 UNION ALL SELECT agent, '(aside)', count(*), NULL, NULL, NULL FROM counter_raw WHERE event_id % 17 = 0 GROUP BY 1""",
    "s3_notifications": """SELECT device, 'interfaces/interface[name=' || interface || ']/state/' || leaf AS path, val, count(*) AS n FROM (
      SELECT device, interface, 'oper-status' AS leaf, oper_status AS val FROM iface_raw UNION ALL SELECT device, interface, 'mtu', CAST(mtu AS VARCHAR) FROM iface_raw) GROUP BY 1, 2, 3""",
    "s3a_interface_states": f"SELECT device, interface, {text('timestamp')}, admin_status, oper_status, speed_bps, mtu FROM iface_raw",
    "s3b_bgp_neighbors": f"SELECT device, peer_address, {text('timestamp')}, session_state, peer_as, uptime_seconds, prefixes_received FROM bgp_raw",
    "s3c_queue_stats": f"SELECT device, interface, queue_id, {text('timestamp')}, max_depth_bytes, pfc_pause_rx, 0 AS ecn_marked_packets, dropped_packets FROM queue_raw",
    "s4_scan": f"SELECT tenant_id, {text('ts_bucket')}, interface, in_bps, error_count FROM utilization WHERE {week()} AND device = 'sw1'",
    "k1_append": "SELECT CAST(strftime(ts_bucket, '%Y%m') AS INT) AS month, device, count(*) AS n FROM utilization GROUP BY 1, 2",
    "k2_upsert": f"SELECT tenant_id, source_kind, device, {text('max(ts)', 'last_ts')}, CAST(sum(sample_count) AS BIGINT) AS samples FROM heartbeat_raw GROUP BY 1, 2, 3",
    "k3_month_layout": f"""SELECT CAST(strftime(m, '%Y%m') AS INT) AS month, tenant_id, count(*) AS n, CAST(sum(bytes_estimated) AS BIGINT) AS bytes_estimated
      FROM (SELECT *, CASE WHEN minute(ts_bucket) % 2 = 1 THEN ts_bucket - INTERVAL 40 DAY ELSE ts_bucket END AS m FROM flows) WHERE {week("m")} GROUP BY 1, 2""",
    "p1_tenant_scope": """SELECT 'all' AS scope, tenant_id, device, count(*) AS n FROM utilization GROUP BY 2, 3
      UNION ALL SELECT 'one', tenant_id, device, count(*) FROM utilization WHERE tenant_id = '00000000-0000-0000-0000-000000000002' GROUP BY 2, 3""",
    "e1_minute_bucket": f"SELECT event_id, {text(MINUTE, 'ts_bucket')} FROM flow_raw",
    "e2_normalize_flows": f"SELECT * EXCLUDE (ts_bucket), {text('ts_bucket')} FROM flow_sums",
    "e3_normalize_counters": f"SELECT * EXCLUDE (ts_bucket), {text('ts_bucket')} FROM counters",
    "e4_tenant_routing": "SELECT tenant_id, device, count(*) AS n FROM flows GROUP BY 1, 2",
    "e5_interface_state": f"SELECT event_id, tenant_id, {text('ts_bucket')}, device, interface, admin_status, oper_status, speed_bps FROM states",
    "e6_bgp_neighbors": f"SELECT event_id, tenant_id, {text('ts_bucket')}, device, peer_address, session_state, peer_as FROM bgp",
    "e7_queue_stats": f"SELECT event_id, tenant_id, {text('ts_bucket')}, device, interface, queue_id, pfc_pause_rx, dropped_packets FROM queues",
    "e8_status_cleanup": """SELECT CASE WHEN s IN ('UP', 'DOWN', 'TESTING') THEN s ELSE 'UNKNOWN' END AS admin, CASE WHEN s IN ('UP', 'DOWN', 'TESTING', 'DORMANT', 'NOT_PRESENT', 'LOWER_LAYER_DOWN') THEN s ELSE 'UNKNOWN' END AS oper,
      CASE WHEN s IN ('CONNECT', 'ACTIVE', 'OPENSENT', 'OPENCONFIRM', 'ESTABLISHED') THEN s ELSE 'IDLE' END AS bgp, count(*) AS n
      FROM (SELECT CASE event_id % 5 WHEN 0 THEN '' WHEN 2 THEN 'WEIRD' ELSE oper_status END AS s FROM iface_raw) GROUP BY 1, 2, 3""",
    "e9_number_text_cleanup": """SELECT event_id, CASE WHEN event_id % 4 > 1 THEN bytes END AS as_int, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' || agent ELSE CAST(bytes AS VARCHAR) END AS as_str FROM flow_raw""",
    "e10_time_cleanup": f"SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strftime(timestamp, '%Y-%m-%d %H:%M:%S') END AS parsed FROM flow_raw",
    "e11_tenant_backfill": f"SELECT CASE WHEN event_id % 3 > 0 THEN tenant_id ELSE {DEFAULT} END AS tenant_id, count(*) AS n FROM anomaly_raw GROUP BY 1",
    "e12_fingerprint_backfill": f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'known' ELSE md5(tenant_id || '|' || anomaly_type || '|' || scope) END AS fingerprint,
      CASE WHEN event_id % 2 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS first_seen_at, CASE WHEN event_id % 2 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS resolved_at FROM anomaly_raw""",
    "e13_source_listing": "SELECT source_kind, source_identifier, slug AS tenant_slug, c.is_active FROM collector_sources c JOIN tenants t ON t.id = c.tenant_id ORDER BY 1, 2",
    "q1a_top_talkers": "SELECT tenant_id, src_ip, dst_ip, protocol, bytes_estimated, avg_sampling_rate, rank, protocol_name, pct_of_total FROM talkers",
    "q1a_top_talkers_device": f"""SELECT tenant_id, rank, src_ip, dst_ip, {name_of()} AS protocol_name, bytes_estimated FROM (
      SELECT tenant_id, src_ip, dst_ip, protocol, CAST(sum(bytes_estimated) AS BIGINT) AS bytes_estimated, row_number() OVER (PARTITION BY tenant_id ORDER BY sum(bytes_estimated) DESC, src_ip, dst_ip, protocol) AS rank
      FROM flows WHERE {week()} AND device = 'sw1' GROUP BY 1, 2, 3, 4) WHERE rank <= 5""",
    "q1b_protocol_breakdown": "SELECT tenant_id, protocol_name, CAST(sum(bytes_estimated) AS BIGINT) AS bytes_estimated, sum(bytes_estimated) / any_value(t) AS fraction FROM talkers GROUP BY 1, 2",
    "q1c_confidence_note": """SELECT t.id AS tenant_id, coalesce(printf('Avg sampling rate 1:%d. Volume estimates carry ~±%d%% uncertainty.', sr, least(50, sr // 20)), 'No flow data in requested window.') AS confidence_note
      FROM tenants t LEFT JOIN (SELECT tenant_id, CAST(trunc(avg(avg_sampling_rate)) AS BIGINT) AS sr FROM talkers GROUP BY 1) a ON a.tenant_id = t.id""",
    "q3_protocol_mix": "SELECT * FROM mix",
    "q3_protocol_headline": """SELECT tenant_id, printf('%s dominates at %.1f%% of traffic over the last 10080 min across %d protocols.', first(protocol_name ORDER BY bytes_estimated DESC, protocol), first(pct_of_bytes ORDER BY bytes_estimated DESC, protocol), count(*)) AS plain_summary FROM mix GROUP BY 1""",
    "q4a_link_peak": f"SELECT * EXCLUDE (peak_ts), {text('peak_ts')} FROM peaks",
    "q4b_link_contributors": "SELECT * FROM contributors",
    "q4c_hot_links": """SELECT tenant_id, device, interface, strftime(peak_ts, '%Y-%m-%d %H:%M:%S') AS peak_ts, CASE WHEN c.src_ip IS NULL THEN printf('No flow activity visible on %s:%s in the requested window. This usually means no sampled traffic reached the collector.', device, interface)
      ELSE printf('%s on %s peaked at %.1f%% utilization. The dominant conversation is %s -> %s (%s), accounting for %.1f%% of flow bytes.', interface, device, coalesce(peak_util_pct, 0), c.src_ip, c.dst_ip, c.protocol_name, c.pct_of_link) END AS narrative,
      printf('Derived from %d util samples and %d flow groupings.', coalesce(n_samples, 0), coalesce(n_flows, 0)) AS confidence_note
      FROM peaks FULL JOIN (SELECT *, count(*) OVER (PARTITION BY tenant_id, device, interface) AS n_flows FROM contributors QUALIFY rank = 1) c USING (tenant_id, device, interface)""",
    "q5_compare_windows": """SELECT tenant_id, b AS baseline_bytes, c AS current_bytes, d AS delta_bytes_pct, CASE WHEN round(d, 1) > 5 THEN 'increase' WHEN round(d, 1) < -5 THEN 'decrease' ELSE 'stable' END AS direction
      FROM (SELECT *, CASE WHEN b > 0 THEN (c - b) / b * 100 ELSE 0 END AS d FROM (SELECT tenant_id, CAST(coalesce(sum(bytes_estimated) FILTER (ts_bucket < TIMESTAMP '2024-01-23 00:00:00'), 0) AS BIGINT) AS b, CAST(coalesce(sum(bytes_estimated) FILTER (ts_bucket >= TIMESTAMP '2024-01-23 00:00:00'), 0) AS BIGINT) AS c
      FROM flows WHERE ts_bucket >= TIMESTAMP '2024-01-16 00:00:00' AND ts_bucket < TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1))""",
    "q2a_interface_utilization": f"SELECT tenant_id, device, interface, avg(in_util_pct) AS avg_in_util_pct, max(in_util_pct) AS max_in_util_pct, avg(out_util_pct) AS avg_out_util_pct, max(out_util_pct) AS max_out_util_pct, count(*) AS n_samples FROM utilization WHERE {week()} GROUP BY 1, 2, 3",
    "q2b_trend": f"""SELECT tenant_id, device, interface, CASE WHEN d > 5 THEN 'increasing' WHEN d < -5 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT tenant_id, device, interface, avg(u) FILTER (k > n // 2) - avg(u) FILTER (k <= n // 2) AS d FROM (
      SELECT *, row_number() OVER (PARTITION BY tenant_id, device, interface ORDER BY ts_bucket, event_id) AS k, count(*) OVER (PARTITION BY tenant_id, device, interface) AS n FROM utilization WHERE {week()}) GROUP BY 1, 2, 3)""",
    "q2c_threshold_breaches": f"SELECT tenant_id, device, interface, {text('ts_bucket')}, CASE WHEN in_util_pct > out_util_pct THEN 'inbound' ELSE 'outbound' END AS direction, u AS util_pct FROM utilization WHERE {week()} AND u >= 80",
    "q6a_recent_anomalies": f"""SELECT event_id, tenant_id, {text('ts')}, scope, anomaly_type, severity, position FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id) AS position FROM anomaly_raw
      WHERE {week('ts')} AND severity IN ('high', 'critical') AND contains(scope, 'device:sw1')) WHERE position <= 50""",
    "q6b_anomaly_rollup": f"""SELECT tenant_id, n AS total_count, most_severe, printf('%d anomaly %s detected (%s requiring attention).', n, CASE n WHEN 1 THEN 'event' ELSE 'events' END, CASE WHEN c + h = 0 THEN 'all medium-severity' ELSE concat_ws(', ', CASE WHEN c > 0 THEN c || ' critical' END, CASE WHEN h > 0 THEN h || ' high-severity' END) END) AS plain_summary
      FROM (SELECT tenant_id, count(*) AS n, arg_max(severity, {RANK}) AS most_severe, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM recent50 GROUP BY 1)""",
    "q7a_anomaly_facts": "SELECT * FROM facts",
    "q7b_anomaly_narrative": f"""SELECT id AS tenant_id, coalesce(t, 'No anomalies detected in the requested window.') AS narrative FROM tenants LEFT JOIN (
      SELECT tenant_id, printf('%d anomaly %s in the last 10080 minutes — %s. Dominant types: %s. Most activity on %s.', sum(n) FILTER (kind = 'severity'), CASE WHEN sum(n) FILTER (kind = 'severity') = 1 THEN 'event' ELSE 'events' END,
        string_agg(n || ' ' || value, ', ' ORDER BY {RANK.replace('severity', 'value')} DESC) FILTER (kind = 'severity'), string_agg(n || '× ' || value, ', ' ORDER BY k) FILTER (kind = 'type' AND k <= 3), min(value) FILTER (kind = 'scope' AND k = 1)) AS t
      FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, kind ORDER BY n DESC, first_position) AS k FROM facts) GROUP BY 1) ON tenant_id = id""",
    "q8_list_devices": f"SELECT tenant_id, device, {text('max(ts_bucket)', 'last_seen')}, count(DISTINCT interface) AS interface_count FROM utilization WHERE {day()} GROUP BY 1, 2",
    "q9_list_interfaces": f"""SELECT tenant_id, device, interface, max(in_util_pct) AS peak_in_util_pct, max(out_util_pct) AS peak_out_util_pct, {text('max(ts_bucket)', 'last_seen')}, 'counters' AS source FROM utilization WHERE {day()} GROUP BY 1, 2, 3
      UNION ALL SELECT DISTINCT tenant_id, device, interface, NULL, NULL, NULL, 'flows_only' FROM flows f WHERE {day()} AND NOT EXISTS (SELECT 1 FROM utilization u WHERE u.{day()} AND u.tenant_id = f.tenant_id AND u.device = f.device AND u.interface = f.interface)""",
    "q10a_latest_interfaces": f"SELECT tenant_id, device, interface, {text('ts_bucket')}, admin_status, oper_status, speed_bps FROM last_iface",
    "q10b_interfaces_down": "SELECT tenant_id, device, interface FROM last_iface WHERE admin_status = 'UP' AND oper_status <> 'UP'",
    "q10c_bgp_state": f"""SELECT tenant_id, device, peer_address, {text('ts_bucket')}, session_state, session_state <> 'ESTABLISHED' AS is_down FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, device, peer_address ORDER BY ts_bucket DESC, event_id DESC) AS k FROM bgp WHERE {day()}) WHERE k = 1""",
    "q10d_device_queues": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, device ORDER BY peak_depth_bytes DESC, interface, queue_id) AS rank FROM qsums) WHERE rank <= 20",
    "q10e_state_note": f"""SELECT DISTINCT n.tenant_id, n.device, CASE WHEN s.device IS NOT NULL THEN 'Exact (non-sampled) gNMI/OpenConfig snapshots.' ELSE printf('No gNMI samples for %s in last 1440 min — the device sends none, or it is not among the devices that are asked.', n.device) END AS confidence_note
      FROM (SELECT tenant_id, device FROM states UNION SELECT tenant_id, 'sw9' FROM anomaly_raw) n LEFT JOIN (SELECT tenant_id, device FROM states WHERE {day()} UNION SELECT tenant_id, device FROM bgp WHERE {day()} UNION SELECT tenant_id, device FROM queues WHERE {day()}) s ON s.tenant_id = n.tenant_id AND s.device = n.device""",
    "q11_state_sources": f"SELECT DISTINCT tenant_id, device FROM states WHERE {day()}",
    "q12a_member_utilization": "SELECT * FROM members",
    "q12b_ecmp_groups": "SELECT tenant_id, device, group_name, source, array_to_string(ms, ',') AS members FROM resolved",
    "q12c_speed_groups": "SELECT tenant_id, device, group_name, array_to_string(ms, ',') AS members FROM by_speed",
    "q12d_imbalance": "SELECT * EXCLUDE (low, sd), CASE WHEN low THEN 'below_min_util' WHEN is_imbalanced THEN 'imbalanced' ELSE 'balanced' END AS reason FROM imbalance",
    "q12e_fabric_severity": """SELECT tenant_id, count(*) FILTER (is_imbalanced) AS n_imbalanced, CASE WHEN max(round(max_mean_ratio, 2)) FILTER (is_imbalanced) >= 3 THEN 'high' WHEN max(round(max_mean_ratio, 2)) FILTER (is_imbalanced) >= 2 THEN 'medium' ELSE 'low' END AS severity FROM imbalance GROUP BY 1""",
    "q13a_udp_share": "SELECT *, CASE WHEN total_bytes <> 0 THEN udp_bytes / total_bytes ELSE 0 END AS roce_share FROM shares",
    "q13b_top_udp_pairs": f"""SELECT * FROM (SELECT tenant_id, src_ip, dst_ip, CAST(sum(bytes_estimated) AS BIGINT) AS bytes_estimated, row_number() OVER (PARTITION BY tenant_id ORDER BY sum(bytes_estimated) DESC, src_ip, dst_ip) AS rank FROM flows WHERE {week()} AND protocol = 17 GROUP BY 1, 2, 3) WHERE rank <= 10""",
    "q13c_queue_signals": "SELECT * FROM signals",
    "q13d_rdma_assessment": """SELECT tenant_id, CASE WHEN ll > 0 THEN 'critical' WHEN su > 0 THEN 'high' WHEN ec > 0 THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN ll > 0 THEN printf('Lossless drop detected on %d queue(s): PFC pauses present AND drops > 0 on the same queue. RDMA transport will retransmit and stall.', ll) ELSE
      CASE WHEN lo > 0 THEN printf('Drops observed on %d queue(s) without PFC — lossy classes are dropping but the lossless plane appears intact. Verify QoS class mapping for RoCE traffic. | ', lo) ELSE '' END ||
      CASE WHEN su > 0 THEN printf('Sustained PFC pause activity on %d queue(s) (>1000 frames in window). Receiver-side congestion is applying backpressure — investigate ECMP imbalance or incast at the sink.', su)
      WHEN ec > 0 THEN printf('ECN marking active on %d queue(s). DCQCN is throttling senders — fabric is healthy but congested.', ec) WHEN q > 0 THEN 'PFC/ECN counters present but below thresholds; fabric is signaling normally.'
      WHEN sh > 0.5 THEN printf('High UDP share (%.0f%%) consistent with RoCE traffic, but no gNMI queue samples to confirm fabric health.', sh * 100) ELSE 'No RoCE/RDMA stress signals in window.' END END AS drivers, round(sh, 6) AS roce_share
      FROM (SELECT s.tenant_id, any_value(CASE WHEN total_bytes <> 0 THEN udp_bytes / total_bytes ELSE 0 END) AS sh, count(g.tenant_id) AS q, count(*) FILTER (dropped_packets > 0 AND (pfc_pause_rx <> 0 OR pfc_pause_tx <> 0)) AS ll, count(*) FILTER (dropped_packets > 0) AS lo,
      count(*) FILTER (pfc_pause_rx + pfc_pause_tx > 1000) AS su, count(*) FILTER (ecn_marked_packets > 0) AS ec FROM shares s LEFT JOIN signals g ON g.tenant_id = s.tenant_id GROUP BY 1)""",
    "q14_baselines": f"SELECT *, 'bytes' AS metric, {text(END, 'computed_at')} FROM baselines",
    "q15a_threshold_detector": f"""SELECT tenant_id, {text(END, 'ts')}, 'device:' || device || '/interface:' || interface AS scope, 'threshold_breach' AS anomaly_type, CASE WHEN u >= 95 THEN 'critical' WHEN u >= 80 THEN 'high' ELSE 'medium' END AS severity,
      printf('%s on %s is at %.1f%% %s utilization.', interface, device, u, direction) AS summary, round(in_util_pct, 6) AS in_util_pct, round(out_util_pct, 6) AS out_util_pct, strftime(ts_bucket, '%Y-%m-%dT%H:%M:%S') AS sample_ts FROM breaches""",
    "q15b_spike_detector": f"""SELECT tenant_id, {text(END, 'ts')}, 'device:' || device || '/interface:' || interface AS scope, 'spike' AS anomaly_type, CASE WHEN z_score >= 6 THEN 'critical' WHEN z_score >= 5 THEN 'high' ELSE 'medium' END AS severity,
      printf('Traffic spike on %s (%s): %.2f GB in last 1440 min vs baseline %.2f GB (Z=%.1f).', interface, device, current_bytes / 1e9, mean_value / 1e9, z_score) AS summary, round(z_score, 2) AS z_score, current_bytes, round(mean_value, 3) AS baseline_mean, round(stddev_value, 3) AS baseline_stddev, sample_count AS baseline_sample_count FROM scores WHERE z_score >= 3""",
    "q15b_spike_scores": "SELECT tenant_id, device, interface, current_bytes, sample_count, z_score FROM scores",
    "q15c_rdma_stress": f"SELECT *, {text(END, 'ts')} FROM stress_events",
    "q15d_run_all": "SELECT * FROM active_events",
    "q15e_event_counts": "SELECT tenant_id, anomaly_type, severity, count(*) AS n FROM active_events GROUP BY 1, 2, 3",
    "q16a_fingerprint": """SELECT event_id, sha256(tenant_id || '|' || anomaly_type || '|' || scope || '|' || CASE WHEN event_id % 2 = 0 THEN '{"in":{"a":[1,2],"b":"\\u00e9"},"queue_id":' || event_id || '}' ELSE '' END) AS fingerprint FROM anomaly_raw""",
    "q16b_record_anomalies": f"SELECT tenant_id, fingerprint, severity, n AS occurrence_count, {text('lo', 'first_seen_at')}, {text('hi', 'last_seen_at')} FROM conditions",
    "q16c_escalation": f"SELECT fingerprint, severity FROM conditions WHERE lo < {CUT} AND hi >= {CUT}",
    "q16d_ack_resolve": """SELECT tenant_id, fingerprint, CASE WHEN n % 2 = 0 THEN strftime(hi, '%Y-%m-%d %H:%M:%S') END AS acknowledged_at, CASE WHEN n % 3 = 0 THEN strftime(lo, '%Y-%m-%d %H:%M:%S') END AS resolved_at, n % 2 = 0 OR n % 3 = 0 AS changed FROM conditions""",
    "q17a_heartbeats": f"SELECT tenant_id, source_kind, device, {text('last_ingest_ts')}, last_sample_count, 'fresh' AS status FROM beats",
    "q17b_classify": "SELECT tenant_id, source_kind, device, status FROM classified",
    "q17c_silent_sources": """SELECT tenant_id, 'device:' || device AS scope, 'critical' AS severity, printf('%s collector for %s has not ingested since %s', source_kind, device, strftime(last_ingest_ts, '%Y-%m-%dT%H:%M:%S')) AS summary,
      sha256(tenant_id || '|collector_silent|device:' || device || '|{"device":"' || device || '","source_kind":"' || source_kind || '"}') AS fingerprint FROM aged WHERE age >= 5""",
    "q17d_freshness_listing": f"SELECT tenant_id, source_kind, device, {text('last_ingest_ts')}, last_sample_count, status FROM classified WHERE status IN ('stale', 'silent')",
    "q18_retention": f"SELECT tenant_id, {text('ts_bucket')}, device, bytes_estimated FROM flows WHERE ts_bucket >= TIMESTAMP '2024-01-01 00:00:00'",
    "q18_dropped_months": "SELECT CAST(strftime(ts_bucket, '%Y%m') AS INT) AS month, count(*) AS n_rows FROM queues WHERE ts_bucket < TIMESTAMP '2024-02-01 00:00:00' GROUP BY 1",
    "q19a_call_enrichment": f"""SELECT event_id, sha256({SORTED}) AS args_hash, replace({SORTED}, repeat('z', 600), repeat('z', 512) || '…') AS args_truncated, CASE WHEN contains(lower(confidence_note), 'exact') THEN 'exact' WHEN contains(lower(confidence_note), 'degrad') OR contains(lower(confidence_note), 'stale') THEN 'degraded' WHEN contains(lower(confidence_note), 'sampl') THEN 'sampled' END AS confidence_band FROM (SELECT * REPLACE ({CALL_ARGS} AS args_json) FROM tool_call_raw)""",
    "q19a_number_texts": """SELECT event_id, sha256('{"d":"\\u007f","e":1e+20,"i":12345678901234567890123456789012345678901234,"k":' || event_id % 7 || ',"n":' || event_id || '.5,"s":1e-07,"v":1.0}') AS args_hash FROM tool_call_raw""",
    "q19b_recent_calls": "SELECT tenant_id, position, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id DESC) AS position FROM tool_call_raw WHERE tool_name = 'get_device_state') WHERE position <= 100",
    "q19c_quota_usage": f"SELECT * EXCLUDE (period_start), {text('period_start')} FROM daily",
    "q19d_quota_decisions": """SELECT event_id, c AS calls_so_far, b AS bytes_so_far, NOT (coalesce(c > call_limit, false) OR coalesce(b > byte_limit, false)) AS allowed, CASE WHEN c > call_limit THEN 'call_limit_exceeded' WHEN b > byte_limit THEN 'byte_limit_exceeded' ELSE 'ok' END AS reason
      FROM (SELECT event_id, tenant_id, tool_name, count(*) OVER w AS c, CAST(sum(response_bytes) OVER w AS BIGINT) AS b FROM tool_call_raw WINDOW w AS (PARTITION BY tenant_id, tool_name, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) LEFT JOIN limits USING (tenant_id, tool_name)""",
    "q19e_quota_listing": f"""SELECT d.tenant_id, d.tool_name, {text('period_start')}, calls_this_period, bytes_out_this_period, call_limit - CASE WHEN d.tool_name = 'get_device_state' THEN 1 ELSE 0 END AS call_limit, byte_limit
      FROM daily d LEFT JOIN limits l ON l.tenant_id = d.tenant_id AND l.tool_name = d.tool_name WHERE period_start = TIMESTAMP '2024-01-20 00:00:00'""",
    "p_predicates": f"""SELECT tenant_id, count(*) FILTER ({week()}) AS p2, count(*) FILTER (ts_bucket >= {WEEK_AGO} AND ts_bucket < {DAY_AGO}) AS p3, count(*) FILTER (device = 'sw1') AS p4, count(*) FILTER (in_util_pct >= 60 OR out_util_pct >= 60) AS p7,
      count(*) FILTER (in_util_pct > out_util_pct) AS p8, max(u) AS peak FROM utilization GROUP BY 1""",
    "p_anomaly_predicates": """SELECT tenant_id, count(*) AS p1, count(*) FILTER (contains(scope, 'interface:1')) AS p5, count(*) FILTER (severity IN ('high', 'critical')) AS p6, count(*) FILTER (severity IN ('medium', 'high', 'critical')) AS p6_unknown, count(*) FILTER (event_id % 3 = 0) AS p9,
      count(*) FILTER (event_id % 4 = 0) AS p9_unacknowledged FROM anomaly_raw GROUP BY 1""",
    "st1_flow_stream": f"SELECT * EXCLUDE (ts_bucket), {text('ts_bucket')} FROM flows WHERE ts_bucket + INTERVAL 1 MINUTE <= (SELECT max(timestamp) FROM flow_raw) - INTERVAL 2 MINUTE",
    "st2_counter_stream": f"SELECT event_id, tenant_id, {text('ts_bucket')}, device, interface, in_bps, out_bps, error_count, round(in_util_pct, 6) AS in_util_pct, round(out_util_pct, 6) AS out_util_pct FROM utilization",
    "st3_state_stream": f"""SELECT kind, tenant_id, device, part, {text('ts_bucket')}, state, CAST(strftime(ts_bucket, '%Y%m') AS INT) AS month FROM (SELECT 'interface' AS kind, tenant_id, device, interface AS part, ts_bucket, oper_status || ' ' || admin_status AS state FROM states
      UNION ALL SELECT 'bgp', tenant_id, device, peer_address, ts_bucket, session_state || ' ' || peer_as FROM bgp
      UNION ALL SELECT 'queue', tenant_id, device, CAST(queue_id AS VARCHAR), ts_bucket, dropped_packets || ' ' || pfc_pause_rx FROM queues)""",
    "st9_routing_stream": """SELECT kind, tenant_id, count(*) AS n, true AS readings_failed FROM (SELECT 'interface' AS kind, tenant_id, device, interface AS part, ts_bucket, oper_status || ' ' || admin_status AS state FROM states
      UNION ALL SELECT 'bgp', tenant_id, device, peer_address, ts_bucket, session_state || ' ' || peer_as FROM bgp
      UNION ALL SELECT 'queue', tenant_id, device, CAST(queue_id AS VARCHAR), ts_bucket, dropped_packets || ' ' || pfc_pause_rx FROM queues) GROUP BY 1, 2""",
    "st4_spike_stream": f"""SELECT {text('e', 'ts')}, c.tenant_id, c.device, c.interface, c.current_bytes, round((current_bytes - mean_value) / stddev_value, 6) AS z_score FROM (
      SELECT e, tenant_id, device, interface, CAST(sum(bytes_estimated) AS BIGINT) AS current_bytes FROM (SELECT *, unnest(generate_series(ts_bucket + INTERVAL 30 SECOND, ts_bucket + INTERVAL 5 MINUTE, INTERVAL 30 SECOND)) AS e FROM flows) GROUP BY ALL) c
      JOIN baselines b ON b.tenant_id = c.tenant_id AND b.device = c.device AND b.interface = c.interface AND b.hour_of_day = hour(e) AND stddev_value <> 0
      WHERE (current_bytes - mean_value) / stddev_value >= 3 AND e <= (SELECT max(ts_bucket) FROM flows) - INTERVAL 2 MINUTE""",
    "st5_stress_stream": f"""SELECT {text('e', 'ts')}, tenant_id, device, interface, queue_id, unnest(kinds) AS anomaly_type, pfc, ecn, drops FROM (
      SELECT *, CASE WHEN drops > 0 AND pfc > 0 THEN ['lossless_drop'] ELSE list_filter([CASE WHEN pfc >= 1000 THEN 'pfc_storm' END, CASE WHEN ecn >= 500 THEN 'ecn_spike' END], lambda k: k IS NOT NULL) END AS kinds FROM (
        SELECT e, tenant_id, device, interface, queue_id, CAST(sum(pfc_pause_rx + pfc_pause_tx) AS BIGINT) AS pfc, CAST(sum(ecn_marked_packets) AS BIGINT) AS ecn, CAST(sum(dropped_packets) AS BIGINT) AS drops
        FROM (SELECT *, unnest(generate_series(ts_bucket + INTERVAL 30 SECOND, ts_bucket + INTERVAL 5 MINUTE, INTERVAL 30 SECOND)) AS e FROM queues) GROUP BY ALL)) WHERE e <= (SELECT max(ts_bucket) FROM queues) - INTERVAL 2 MINUTE""",
    "st6_breach_stream": "SELECT tenant_id, 'device:' || device || '/interface:' || interface AS scope, 'threshold_breach' AS anomaly_type FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, device, interface ORDER BY ts_bucket DESC) AS k FROM utilization) WHERE k = 1 AND u >= 60",
    "st7_dedup_stream": f"SELECT tenant_id, fingerprint, severity, n AS occurrence_count, {text('lo', 'first_seen_at')}, {text('hi', 'last_seen_at')} FROM conditions",
    "st8_freshness_stream": f"SELECT tenant_id, source_kind, device, {text('last_ingest_ts')}, last_sample_count, 'fresh' AS status FROM beats",
    "q14_moments": f"SELECT * REPLACE (round(mean_value, 3) AS mean_value, round(stddev_value, 3) AS stddev_value), 'bytes' AS metric, {text(END, 'computed_at')} FROM baselines",
    "q18_drop_months": """SELECT table_name, CAST(strftime(ts, '%Y%m') AS INT) AS month, count(*) AS n_rows, CASE WHEN ts < oldest THEN 'dropped' ELSE 'kept' END AS state FROM (
      SELECT table_name, oldest, CASE WHEN minute(ts_bucket) % 2 = 1 THEN ts_bucket - INTERVAL 100 DAY ELSE ts_bucket END AS ts FROM (
        SELECT 'flow_summary_minute' AS table_name, TIMESTAMP '2023-11-01 00:00:00' AS oldest, ts_bucket FROM flows UNION ALL SELECT 'queue_stats_minute', TIMESTAMP '2024-01-01 00:00:00', ts_bucket FROM queues)) GROUP BY 1, 2, 4""",
    "st8_silence_stream": f"""SELECT tenant_id, source_kind, device, status, {text('changed_at')}, {text('since')} FROM (
      WITH beats AS (SELECT DISTINCT tenant_id, source_kind, device, ts, CASE source_kind WHEN 'sflow' THEN 7200 ELSE 3600 END AS s FROM heartbeat_raw WHERE ts IS NOT NULL),
      gaps AS (SELECT *, lead(ts) OVER (PARTITION BY tenant_id, source_kind, device ORDER BY ts) AS nx, (SELECT max(ts) FROM beats) AS last_ts FROM beats)
      SELECT tenant_id, source_kind, device, 'stale' AS status, ts + to_seconds(s) AS changed_at, ts AS since FROM gaps WHERE ts + to_seconds(s) <= coalesce(nx, last_ts)
      UNION ALL SELECT tenant_id, source_kind, device, 'silent', ts + to_seconds(5 * s), ts FROM gaps WHERE ts + to_seconds(5 * s) <= coalesce(nx, last_ts)
      UNION ALL SELECT tenant_id, source_kind, device, 'recovered', nx, ts FROM gaps WHERE ts + to_seconds(s) <= nx)""",
    "st1_late_stream": """SELECT kind, tenant_id, device, protocol, count(*) AS n, CAST(sum(bytes_estimated) AS BIGINT) AS bytes_estimated, CAST(sum(packets_estimated) AS BIGINT) AS packets_estimated FROM (
      WITH parts AS (SELECT *, least(least((day(timestamp) - 1) // 8, 3) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, 3) AS part FROM flow_raw),
      seen AS (SELECT p.part, (SELECT max(timestamp) FROM parts q WHERE q.part < p.part) AS seen FROM (SELECT DISTINCT part FROM parts) p),
      placed AS (SELECT p.*, CASE WHEN coalesce(date_trunc('minute', timestamp) + INTERVAL 1 MINUTE <= seen - INTERVAL 2 MINUTE, false) THEN 'late' ELSE 'minute' END AS kind FROM parts p JOIN seen USING (part)),
      sums AS (SELECT kind, date_trunc('minute', timestamp) AS ts, agent AS device, input_if_index, src_ip, dst_ip, protocol, sum(bytes * sampling_rate) AS bytes_estimated, sum(packets * sampling_rate) AS packets_estimated FROM placed GROUP BY ALL)
      SELECT sums.*, coalesce(s.tenant_id, '00000000-0000-0000-0000-000000000001') AS tenant_id FROM sums LEFT JOIN collector_sources s ON s.source_kind = 'sflow' AND s.is_active AND s.source_identifier = device
      WHERE kind = 'late' OR ts + INTERVAL 1 MINUTE <= (SELECT max(timestamp) FROM placed WHERE kind = 'minute') - INTERVAL 2 MINUTE) GROUP BY 1, 2, 3, 4""",
    "s1_json_stream": """SELECT 'minutes' AS kind, tenant_id, device, count(*) AS n, CAST(sum(bytes_estimated) AS BIGINT) AS bytes_estimated FROM flows WHERE minute(ts_bucket) % 10 > 0
        AND ts_bucket + INTERVAL 1 MINUTE <= (SELECT max(ts_bucket) FROM flows WHERE minute(ts_bucket) % 10 > 0) - INTERVAL 2 MINUTE GROUP BY 2, 3
      UNION ALL SELECT 'document', NULL, NULL, count(DISTINCT (date_trunc('minute', timestamp), event_id % 64)), NULL FROM flow_raw WHERE minute(timestamp) % 10 = 0""",
    "s2_json_stream": """SELECT 'utilization' AS kind, coalesce(tenant_id, '00000000-0000-0000-0000-000000000001') AS tenant_id, device, interface, n, in_bps FROM (
        SELECT device, interface, count(*) AS n, CAST(sum(in_bps) AS BIGINT) AS in_bps FROM utilization WHERE event_id % 10 > 0 AND event_id % 17 > 0 GROUP BY 1, 2)
        LEFT JOIN (SELECT tenant_id, source_identifier FROM collector_sources WHERE source_kind = 'sflow' AND is_active) ON source_identifier = device
      UNION ALL SELECT 'document', NULL, NULL, NULL, count(*), NULL FROM counter_raw WHERE event_id % 10 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'value', NULL, NULL, NULL, count(*), NULL FROM counter_raw WHERE event_id % 10 > 0 AND event_id % 17 = 0 HAVING count(*) > 0""",
    "s3_json_stream": """SELECT 'state' AS kind, tenant_id, device, interface, oper_status, admin_status, count(*) AS n FROM states WHERE event_id % 10 > 0 GROUP BY ALL
      UNION ALL SELECT 'document', NULL, NULL, NULL, NULL, NULL, count(*) FROM iface_raw WHERE event_id % 10 = 0 HAVING count(*) > 0""",
    "q20_rate_decisions": """SELECT * FROM (
      WITH RECURSIVE calls AS (
        SELECT event_id, tool_name, epoch_us(ts) AS us, row_number() OVER (PARTITION BY tool_name ORDER BY ts, event_id) AS n, CASE WHEN tool_name IN ('get_top_talkers', 'get_rdma_health', 'explain_hot_link') THEN 1 ELSE 2 END AS most FROM tool_call_raw
      ), steps AS (
        SELECT event_id, tool_name, n, true AS accepted, CAST(NULL AS BIGINT) AS retry_after_seconds, [us] AS kept FROM calls WHERE n = 1
        UNION ALL
        SELECT event_id, tool_name, n, len(f) < most, CASE WHEN len(f) >= most THEN CAST(trunc(3600 - (us - f[1]) / 1e6) AS BIGINT) END, CASE WHEN len(f) < most THEN list_append(f, us) ELSE f END
        FROM (SELECT c.*, list_filter(s.kept, lambda k: c.us - k < 3600000000) AS f FROM steps s JOIN calls c ON c.tool_name = s.tool_name AND c.n = s.n + 1)
      ) SELECT event_id, tool_name, accepted, retry_after_seconds FROM steps)""",
    "q20_rate_report": """SELECT event_id, n AS calls_before, n >= CASE WHEN tool_name IN ('get_top_talkers', 'get_rdma_health', 'explain_hot_link') THEN 1 ELSE 2 END AS over
      FROM (SELECT event_id, tool_name, count(*) OVER (PARTITION BY tool_name ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS n FROM tool_call_raw)""",
}.items()}

#: Columns whose types differ between the engines' functions (row numbers, hours).
TYPES = {
    "s2_counter_feed": "CAST(errors AS BIGINT) AS errors", "s3c_queue_stats": "CAST(ecn_marked_packets AS BIGINT) AS ecn_marked_packets",
    "q7a_anomaly_facts": "CAST(first_position AS INT) AS first_position", "q14_baselines": "CAST(hour_of_day AS INT) AS hour_of_day",
    **dict.fromkeys(
        ("q1a_top_talkers", "q1a_top_talkers_device", "q4b_link_contributors", "q10d_device_queues", "q13b_top_udp_pairs"),
        "CAST(rank AS INT) AS rank"
    ),
    **dict.fromkeys(("q6a_recent_anomalies", "q19b_recent_calls"), "CAST(position AS INT) AS position"),
}
ORACLES |= {k: f"SELECT * REPLACE ({cast}) FROM (\n{ORACLES[k]})" for k, cast in TYPES.items()}
ORACLES["q20_rate_stream"] = ORACLES["q20_rate_decisions"]
ORACLES["k2_bucketed_upsert"] = ORACLES["k2_upsert"]
