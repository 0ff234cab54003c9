"""Views of the given tables in the shapes of network telemetry; the same SQL text runs in Spark and in the oracle."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "tenants": """
SELECT concat('00000000-0000-0000-0000-00000000000', CAST(r_regionkey + 1 AS STRING)) AS id,
       lower(r_name) AS slug,
       r_name AS name,
       r_regionkey < 4 AS is_active
FROM region
""",
    "collector_sources": """
SELECT k.source_kind,
       concat('sw', CAST(n_nationkey AS STRING)) AS source_identifier,
       concat('00000000-0000-0000-0000-00000000000', CAST(n_regionkey + 1 AS STRING)) AS tenant_id,
       n_nationkey <> 3 AS is_active FROM nation CROSS JOIN (SELECT 'sflow' AS source_kind UNION ALL SELECT 'gnmi') k
WHERE n_nationkey < 4
""",
    "flow_raw": """
SELECT event_id,
       concat('sw', CAST(user_id % 5 AS STRING)) AS agent,
       CAST(user_id % 3 AS INT) AS input_if_index,
       CAST((user_id + 1) % 3 AS INT) AS output_if_index,
       concat('10.0.0.', CAST(user_id % 8 AS STRING)) AS src_ip,
       concat('10.0.1.', CAST(event_id % 4 AS STRING)) AS dst_ip,
       CASE event_type WHEN 'view' THEN 6 WHEN 'click' THEN 17 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 112 ELSE 47 END AS protocol,
       CAST(floor(value * 1000) AS BIGINT) AS bytes,
       CAST(floor(value) AS BIGINT) + 1 AS packets,
       CAST(100 * (1 + event_id % 3) AS INT) AS sampling_rate,
       ts AS timestamp
FROM events
""",
    "counter_raw": """
SELECT event_id,
       concat('sw', CAST(user_id % 5 AS STRING)) AS agent,
       CAST(user_id % 3 AS INT) AS if_index,
       CAST(user_id % 3 AS STRING) AS if_name,
       CASE WHEN user_id % 10 = 7 THEN 0 ELSE 1000000000 END AS if_speed,
       CAST(floor(value * CASE WHEN user_id % 5 = 1 THEN 2000000 ELSE 10000000 END) AS BIGINT) AS if_in_octets,
       (event_id * 7919 % 1000) * CASE WHEN user_id % 15 = 6 THEN 3600000 WHEN user_id % 5 = 1 THEN 300000
         WHEN user_id % 15 = 12 AND ts >= TIMESTAMP '2024-01-28 00:00:00' THEN 3600000 WHEN user_id % 15 = 12 THEN 300000
         WHEN user_id % 15 = 7 AND ts >= TIMESTAMP '2024-01-28 00:00:00' THEN 300000 ELSE 3000000 END AS if_out_octets,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS if_in_errors,
       CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END AS if_out_errors,
       ts AS timestamp
FROM events
WHERE user_id % 5 < 4
""",
    "iface_raw": """
SELECT event_id,
       concat('sw', CAST(user_id % 5 AS STRING)) AS device,
       CAST(user_id % 3 AS STRING) AS interface,
       CASE WHEN event_id % 20 = 0 THEN 'DOWN' ELSE 'UP' END AS admin_status,
       CASE event_type WHEN 'error' THEN 'DOWN' WHEN 'signup' THEN 'LOWER_LAYER_DOWN' ELSE 'UP' END AS oper_status,
       CASE WHEN user_id % 3 < 2 THEN 100000000000 ELSE 25000000000 END AS speed_bps, 9000 AS mtu,
       ts AS timestamp
FROM events
""",
    "bgp_raw": """
SELECT event_id,
       concat('sw', CAST(user_id % 5 AS STRING)) AS device,
       concat('10.1.0.', CAST(user_id % 4 AS STRING)) AS peer_address,
       CAST(65000 + user_id % 4 AS INT) AS peer_as,
       CASE event_type WHEN 'error' THEN 'ACTIVE' WHEN 'view' THEN 'IDLE' ELSE 'ESTABLISHED' END AS session_state, event_id * 60 AS uptime_seconds,
       CAST(floor(value) AS BIGINT) AS prefixes_received,
       ts AS timestamp
FROM events
""",
    "queue_raw": """
SELECT event_id,
       concat('sw', CAST(user_id % 5 AS STRING)) AS device,
       CAST(user_id % 3 AS STRING) AS interface,
       CAST(event_id % 4 AS INT) AS queue_id,
       CAST(floor(value * 1000) AS BIGINT) AS max_depth_bytes,
       CAST(floor(value * 400) AS BIGINT) AS avg_depth_bytes,
       CASE WHEN event_type = 'click' THEN CAST(floor(value * 40) AS BIGINT) ELSE 0 END AS pfc_pause_rx,
       CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS pfc_pause_tx,
       CASE WHEN event_type = 'signup' THEN CAST(floor(value * 20) AS BIGINT) ELSE 0 END AS ecn_marked_packets,
       CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN 1 + event_id % 3 ELSE 0 END AS dropped_packets,
       ts AS timestamp
FROM events
""",
    "ecmp_groups": """
SELECT concat('sw', CAST(n_nationkey AS STRING)) AS device, 'uplinks' AS group_name,
       CASE n_nationkey WHEN 0 THEN '0,1,2' ELSE '0,2,9' END AS members_csv
FROM nation
WHERE n_nationkey < 2
""",
    "anomaly_raw": """
SELECT event_id,
       concat('00000000-0000-0000-0000-00000000000', CAST(user_id % 5 + 1 AS STRING)) AS tenant_id, ts,
       concat('device:sw', CAST(user_id % 5 AS STRING), '/interface:',
       CAST(user_id % 3 AS STRING)) AS scope,
       CASE event_type WHEN 'error' THEN 'lossless_drop' WHEN 'click' THEN 'pfc_storm' WHEN 'view' THEN 'ecn_spike' WHEN 'signup' THEN 'spike' ELSE 'threshold_breach' END AS anomaly_type,
       CASE WHEN value >= 150 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS severity
FROM events
""",
    "tool_call_raw": """
SELECT event_id, ts,
       concat('00000000-0000-0000-0000-00000000000', CAST(user_id % 5 + 1 AS STRING)) AS tenant_id,
       CAST(user_id AS STRING) AS api_key_id,
       CASE event_type WHEN 'view' THEN 'get_top_talkers' WHEN 'click' THEN 'get_device_state' WHEN 'purchase' THEN 'get_rdma_health' WHEN 'signup' THEN 'explain_hot_link' ELSE 'summarize_anomalies' END AS tool_name, props AS args_json,
       CAST(floor(value * 100) AS BIGINT) AS response_bytes,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
       CASE event_id % 4 WHEN 0 THEN 'Exact (non-sampled) snapshots.' WHEN 1 THEN 'Avg sampling rate 1:100.' WHEN 2 THEN 'Feed is stale.' ELSE 'No flow data in requested window.' END AS confidence_note
FROM events
""",
    "heartbeat_raw": """
SELECT concat('00000000-0000-0000-0000-00000000000', CAST(user_id % 5 + 1 AS STRING)) AS tenant_id,
       CASE WHEN event_id % 2 = 0 THEN 'sflow' ELSE 'gnmi' END AS source_kind,
       concat('sw', CAST(user_id % 5 AS STRING), '-', event_type) AS device, ts,
       CAST(event_id % 100 AS INT) AS sample_count
FROM events
""",
}
TABLES = {"tenants": ["region"], "collector_sources": ["nation"], "ecmp_groups": ["nation"]}

#: Only used by local masters, where ``spark.checkpoint.dir`` is unset (tests).
LOCAL_DIR = "/tmp/checkpoints/meshlytics-tables"


def folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``), which only local masters may leave unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or LOCAL_DIR).rstrip('/')}/tables-{uuid.uuid4().hex}"


AS_OF, WEEK, DAY = "2024-01-31 00:00:00", 10_080, 1440


def view(spark: SparkSession, sf_dir: str, name: str, last_minutes: int | None = None) -> DataFrame:
    """A view as a DataFrame; times become timestamps of the session's zone. With ``last_minutes`` only events that can
    be in minutes of that window before ``AS_OF`` are read: a filter on the stored column, which reaches the files."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES.get(name, ["events"])}
    if last_minutes is not None and "events" in tables:
        kind, end = tables["events"].schema["ts"].dataType, datetime.fromisoformat(AS_OF)
        time = lambda x: F.lit(str(x)).cast(kind)
        tables["events"] = tables["events"].where(
            (F.col("ts") >= time(end - timedelta(minutes=last_minutes))) & (F.col("ts") < time(end + timedelta(minutes=1)))
        )
    sql = reduce(lambda s, t: s.replace(f"FROM {t}", f"FROM {{{t}}}"), tables, VIEWS[name])
    df = spark.sql(sql, **tables)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})
