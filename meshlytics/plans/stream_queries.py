"""Streams over the given tables, each run until all files are read; the query returns what the sink holds then."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import anomalies, baselines, normalize, usage
from ..sources import feeds
from ..streaming import streams, timers
from .fixtures import AS_OF, VIEWS, folder, view
from .queries import QUERIES, Tables

def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of ``events`` as a stream."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(table.schema)
    if table.inputFiles()[0].endswith("/events.parquet"):  # one file: streams read folders
        events = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        events = reader.parquet(f"{sf_dir}/events.parquet")
    df = spark.sql(reduce(lambda s, t: s.replace(f"FROM {t}", f"FROM {{{t}}}"), ["events"], VIEWS[name]), events=events)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def finish(writer, at: str) -> int:
    """Runs a writer to its end; the last batch's number."""
    q = writer.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if error := q.exception():
        raise error
    return q.lastProgress["batchId"] if q.lastProgress else -1


def in_parts(spark: SparkSession, rows: DataFrame, part, parts: int, writer: Callable, at: str) -> int:
    """Rows that arrive part by part; the stream is started again for each, from its checkpoint. The last batch's number."""
    last = -1
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(f"{at}/in")
        last = finish(writer(spark.readStream.schema(rows.schema).parquet(f"{at}/in")), at)
    return last


def part_of_month():
    """The days of the table in four parts, one after the other."""
    return F.least(F.floor((F.dayofmonth("timestamp") - 1) / 8), F.lit(3))


def appended(df: DataFrame, spark: SparkSession) -> DataFrame:
    at = folder(spark)
    finish(df.writeStream.format("parquet").option("path", f"{at}/out").outputMode("append"), at)
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def query(f: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, kind in df.dtypes if kind == "timestamp"})

    QUERIES[f.__name__] = run
    return f


@query
def st1_flow_stream(spark, sf_dir):
    rows = streams.flow_minutes(stream(spark, sf_dir, "flow_raw"), view(spark, sf_dir, "collector_sources"), "2 minutes", "event_id")
    return appended(rows, spark)


@query
def st2_counter_stream(spark, sf_dir):
    return appended(
        streams.utilization(stream(spark, sf_dir, "counter_raw"), view(spark, sf_dir, "collector_sources")), spark
    ).withColumns({c: F.round(c, 6) for c in ("in_util_pct", "out_util_pct")})


def state_feed(spark, sf_dir):
    """Notifications of interface states, BGP neighbours and queues as one stream."""

    def notified(name: str, path, leaves: dict[str, str]) -> DataFrame:
        updates = F.array(
            *[F.struct(F.concat(path, F.lit(f"/state/{leaf}")).alias("path"), F.col(c).cast("string").alias("val")) for leaf, c in leaves.items()]
        )
        return stream(spark, sf_dir, name).select("device", "timestamp", F.array(F.struct(updates.alias("update"))).alias("notification"))

    keyed = lambda *parts: F.concat(*[F.lit(p) if k % 2 == 0 else F.col(p).cast("string") for k, p in enumerate(parts)])
    interfaces = notified(
        "iface_raw", keyed("interfaces/interface[name=", "interface", "]"), {"oper-status": "oper_status", "admin-status": "admin_status"}
    )
    neighbors = notified(
        "bgp_raw", keyed("bgp/neighbors/neighbor[neighbor-address=", "peer_address", "]"),
        {"session-state": "session_state", "peer-as": "peer_as"}
    )
    queues = notified(
        "queue_raw", keyed("qos/interfaces/interface[interface-id=", "interface", "]/output/queues/queue[name=", "queue_id", "]"),
        {"pfc-pause-rx": "pfc_pause_rx", "dropped-pkts": "dropped_packets"}
    )
    return interfaces.unionByName(neighbors).unionByName(queues)


def state_tables(spark, sf_dir, routing, at: str) -> DataFrame:
    """The three state tables after the stream as rows of one shape, by kind."""
    paths = {k: f"{at}/{k}" for k in ("interface", "bgp", "queue")}
    finish(streams.state_batches(state_feed(spark, sf_dir), routing, paths), at)
    shapes = {
        "interface": ("interface", "oper_status", "admin_status"), "bgp": ("peer_address", "session_state", "peer_as"),
        "queue": ("queue_id", "dropped_packets", "pfc_pause_rx")
    }
    read = lambda kind, part, a, b: spark.read.parquet(paths[kind]).select(
        F.lit(kind).alias("kind"), "tenant_id", "device", F.col(part).cast("string").alias("part"), "ts_bucket",
        F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string")).alias("state"), "month"
    )
    return reduce(DataFrame.unionByName, [read(k, *x) for k, x in shapes.items()])


@query
def st3_state_stream(spark, sf_dir):
    """Notifications to the three state tables."""
    at = folder(spark)
    return state_tables(spark, sf_dir, lambda: view(spark, sf_dir, "collector_sources"), at)


@query
def st9_routing_stream(spark, sf_dir):
    """The same with mappings that are read again for each batch and cannot be read from the second time on: the last good
    reading stays in use."""
    at, times = folder(spark), []

    def read():
        times.append(1)
        if len(times) > 1:
            raise OSError("the mappings can't be read")
        return view(spark, sf_dir, "collector_sources")

    routing = streams.Routing(read, f"{at}/routing")
    routing()
    rows = state_tables(spark, sf_dir, routing, at)
    return rows.groupBy("kind", "tenant_id").agg(F.count("*").alias("n")).withColumn("readings_failed", F.lit(routing.failures > 0))


@query
def st4_spike_stream(spark, sf_dir):
    sources = view(spark, sf_dir, "collector_sources")
    rows = stream(spark, sf_dir, "flow_raw").select(
        C.minute_bucket("timestamp").alias("ts_bucket"), F.col("agent").alias("device"),
        F.col("input_if_index").cast("string").alias("interface"), (F.col("bytes") * F.col("sampling_rate")).alias("bytes_estimated")
    )
    known = baselines.compute_baselines(Tables(spark, sf_dir).flows, C.at(AS_OF))
    with timers.with_rocksdb(spark):
        return appended(
            streams.sliding_spikes(normalize.route(rows, sources, "sflow"), known, panes=True), spark
        ).withColumn("z_score", F.round("z_score", 6))


@query
def st5_stress_stream(spark, sf_dir):
    rows = normalize.normalize_queue_stats(stream(spark, sf_dir, "queue_raw"), view(spark, sf_dir, "collector_sources"))
    with timers.with_rocksdb(spark):
        return appended(streams.sliding_stress(rows, panes=True), spark)


@query
def st6_breach_stream(spark, sf_dir):
    rows = streams.utilization(stream(spark, sf_dir, "counter_raw"), view(spark, sf_dir, "collector_sources"))
    at = folder(spark)
    finish(streams.breach_batches(rows, lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")), at)
    return spark.read.parquet(f"{at}/out").select("tenant_id", "scope", "anomaly_type")


@query
def st7_dedup_stream(spark, sf_dir):
    events = anomalies.with_fingerprint(stream(spark, sf_dir, "anomaly_raw"))
    at = folder(spark)
    store = streams.Versions(spark, f"{at}/store", streams.STORED, ["tenant_id", "fingerprint"])
    return store.at(finish(streams.dedup_batches(events, store), at)).select(
        "tenant_id", "fingerprint", "severity", "occurrence_count", "first_seen_at", "last_seen_at"
    )


@query
def st8_freshness_stream(spark, sf_dir):
    at = folder(spark)
    store = streams.Versions(spark, f"{at}/store", streams.HEARTBEATS, ["tenant_id", "source_kind", "device"])
    return store.at(finish(streams.freshness_batches(stream(spark, sf_dir, "heartbeat_raw"), store), at))


@query
def st8_silence_stream(spark, sf_dir):
    """All changes of status of all sources, thresholds stretched; the last ones by timers, after the last row of a source."""
    with timers.with_rocksdb(spark):
        return appended(timers.watch_freshness(stream(spark, sf_dir, "heartbeat_raw"), 40), spark)


@query
def q20_rate_stream(spark, sf_dir):
    """The decisions of q20_rate_decisions by a stream that is stopped and started again between four parts of the calls."""
    at = folder(spark)
    calls = view(spark, sf_dir, "tool_call_raw").select("event_id", "ts", "tool_name").withColumn("timestamp", F.col("ts"))
    store = streams.Versions(spark, f"{at}/store", streams.ACCEPTED, ["tool_name"])
    in_parts(
        spark, calls, part_of_month(), 4,
        lambda rows: streams.rate_batches(rows, store, f"{at}/out", dict.fromkeys(usage.CALL_LIMITS, 1), 2, 3600), at
    )
    return spark.read.parquet(f"{at}/out").select("event_id", "tool_name", "accepted", "retry_after_seconds")


@query
def st1_late_stream(spark, sf_dir):
    """Flow records in four parts, a tenth of them a part too late: the minutes that the stream closes, and the late rows beside them."""
    at = folder(spark)
    records = view(spark, sf_dir, "flow_raw")
    part = F.least(part_of_month() + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0), F.lit(3))
    in_parts(spark, records, part, 4, lambda rows: streams.split_late(rows, f"{at}/split", 120), at)
    ontime = spark.readStream.schema(records.schema).parquet(f"{at}/split/ontime/batch=*")
    minutes = appended(streams.flow_minutes(ontime, view(spark, sf_dir, "collector_sources"), "2 minutes", "event_id"), spark)
    late = normalize.route(
        normalize.normalize_flows(spark.read.parquet(f"{at}/split/late"), "event_id"), view(spark, sf_dir, "collector_sources"), "sflow"
    )
    both = minutes.withColumn("kind", F.lit("minute")).unionByName(late.withColumn("kind", F.lit("late")))
    return both.groupBy("kind", "tenant_id", "device", "protocol").agg(
        F.count("*").alias("n"), F.sum("bytes_estimated").alias("bytes_estimated"), F.sum("packets_estimated").alias("packets_estimated")
    )


def fed(spark: SparkSession, docs: DataFrame, schema, at: str, **kind) -> str:
    """Documents (``doc``, JSON text) as files, read as a stream two files at a time; where records and quarantine are."""
    docs.select("doc").repartition(4).write.text(f"{at}/feed")
    finish(streams.feed_batches(feeds.json_stream(spark, f"{at}/feed", schema, 2), at, **kind), at)
    return at


def quarantined(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(f"{at}/quarantine").groupBy("kind").agg(F.count("*").alias("n"))


def cut_off(bad, doc):
    """JSON text that ends too early where ``bad``."""
    return F.when(bad, F.substr(doc, F.lit(1), F.length(doc) - 3)).otherwise(doc).alias("doc")


@query
def s1_json_stream(spark, sf_dir):
    """S1 as files: polls of a minute and a part of 64 as JSON documents, those of each tenth minute cut off; the minutes of
    ST1 from the records, and the documents in quarantine."""
    raw, at = view(spark, sf_dir, "flow_raw"), folder(spark)
    record = F.struct(
        "agent", F.col("input_if_index").alias("inputifindex"), F.col("src_ip").alias("srcip"), F.col("dst_ip").alias("dstip"), "protocol",
        "bytes", "packets", F.col("sampling_rate").alias("samplingrate")
    )
    polls = raw.groupBy(
        F.date_trunc("minute", "timestamp").alias("fetched_at"), (F.col("event_id") % 64).alias("part")
    ).agg(F.collect_list(record).alias("flows"))
    docs = polls.select(cut_off(F.minute("fetched_at") % 10 == 0, F.to_json(F.struct("fetched_at", "flows"))))
    fed(spark, docs, feeds.FLOW_FEED, at, flows=True)
    records = spark.read.parquet(f"{at}/records").drop("batch")
    rows = spark.readStream.schema(records.schema).parquet(f"{at}/records/batch=*")
    minutes = appended(streams.flow_minutes(rows, view(spark, sf_dir, "collector_sources")), spark)
    out = minutes.groupBy("tenant_id", "device").agg(
        F.count("*").alias("n"), F.sum("bytes_estimated").alias("bytes_estimated")
    ).withColumn("kind", F.lit("minutes"))
    return out.unionByName(
        quarantined(spark, at).withColumns(
            {"tenant_id": F.lit(None).cast("string"), "device": F.lit(None).cast("string"), "bytes_estimated": F.lit(None).cast("long")}
        )
    )


@query
def s2_json_stream(spark, sf_dir):
    """S2 as files: a counter a document, each tenth cut off and each 17th with an unreadable speed."""
    raw, at = view(spark, sf_dir, "counter_raw"), folder(spark)
    speed = F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.col("if_speed").cast("string"))
    record = F.struct(
        F.col("timestamp").alias("fetched_at"), "agent", F.col("if_index").alias("ifindex"), F.col("if_name").alias("ifname"),
        speed.alias("ifspeed"), F.col("if_in_octets").alias("ifinoctets"), F.col("if_out_octets").alias("ifoutoctets")
    )
    fed(spark, raw.select(cut_off(F.col("event_id") % 10 == 0, F.to_json(record))), feeds.COUNTER_FEED, at, counters=True)
    rows = streams.utilization(spark.read.parquet(f"{at}/records"), view(spark, sf_dir, "collector_sources"))
    out = rows.groupBy("tenant_id", "device", "interface").agg(
        F.count("*").alias("n"), F.sum("in_bps").alias("in_bps")
    ).withColumn("kind", F.lit("utilization"))
    return out.unionByName(
        quarantined(spark, at).withColumns(
            {"in_bps": F.lit(None).cast("long"), **{c: F.lit(None).cast("string") for c in ("tenant_id", "device", "interface")}}
        )
    )


@query
def s3_json_stream(spark, sf_dir):
    """S3 as files: a notification of an interface a document, each tenth cut off; the state table of ST3 from the records."""
    raw, at = view(spark, sf_dir, "iface_raw"), folder(spark)
    path = F.concat(F.lit("interfaces/interface[name="), F.col("interface"), F.lit("]/state/"))
    update = lambda leaf, c: F.struct(F.concat(path, F.lit(leaf)).alias("path"), F.col(c).alias("val"))
    notification = F.array(F.struct(F.array(update("oper-status", "oper_status"), update("admin-status", "admin_status")).alias("update")))
    fed(
        spark,
        raw.select(cut_off(F.col("event_id") % 10 == 0, F.to_json(F.struct("device", "timestamp", notification.alias("notification"))))),
        feeds.NOTIFICATIONS, at
    )
    paths = {k: f"{at}/{k}" for k in ("interface", "bgp", "queue")}
    rows = spark.readStream.schema(spark.read.parquet(f"{at}/records").drop("batch").schema).parquet(f"{at}/records/batch=*")
    finish(streams.state_batches(rows, lambda: view(spark, sf_dir, "collector_sources"), paths), f"{at}/states")
    out = spark.read.parquet(paths["interface"]).groupBy(
        "tenant_id", "device", "interface", "oper_status", "admin_status"
    ).agg(F.count("*").alias("n")).withColumn("kind", F.lit("state"))
    return out.unionByName(
        quarantined(spark, at).withColumns(
            {c: F.lit(None).cast("string") for c in ("tenant_id", "device", "interface", "oper_status", "admin_status")}
        )
    )
