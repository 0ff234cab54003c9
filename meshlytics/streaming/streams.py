"""The operators over streams: ST1 - ST9, Q20. Transformations are those of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators import anomalies, detect, freshness, normalize, usage
from ..operators.state import latest
from ..sources import feeds
from ..sources.files import delete, exists, names_in
from ..sources.sinks import append_monthly
from .timers import windows_from_panes


def flow_minutes(records: DataFrame, sources: DataFrame, delay: str = "2 minutes", order: str = "timestamp") -> DataFrame:
    """ST1: records to minutes; a minute is emitted once the watermark has passed it, later rows are dropped."""
    rows = records.withWatermark("timestamp", delay).withColumns(
        {"device": F.col("agent"), "interface": F.col("input_if_index").cast("string"), "_o": F.col(order)}
    )
    keys = ["device", "interface", "src_ip", "dst_ip", "protocol"]
    sums = rows.groupBy(F.window("timestamp", "1 minute").alias("w"), *keys).agg(
        F.sum(F.col("bytes") * F.col("sampling_rate")).alias("bytes_estimated"),
        F.sum(F.col("packets") * F.col("sampling_rate")).alias("packets_estimated"),
        F.max_by("sampling_rate", F.struct("_o", "sampling_rate")).alias("sampling_rate"),
    )
    return normalize.route(
        sums.select(F.col("w.start").alias("ts_bucket"), *keys, "bytes_estimated", "packets_estimated", "sampling_rate"), sources, "sflow"
    )


def utilization(counters: DataFrame, sources: DataFrame) -> DataFrame:
    """ST2: stateless."""
    return normalize.route(normalize.normalize_counters(counters), sources, "sflow")


def state_batches(feed: DataFrame, sources: Callable[[], DataFrame], paths: dict[str, str]) -> DataStreamWriter:
    """ST3: notifications to the three state tables. ``paths``: interface, bgp, queue. Each batch has a folder of its own in
    each table, so a batch that is run again after a failure writes the same rows once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        updates, now = feeds.flatten_notifications(batch), sources()
        tables = {
            "interface": normalize.normalize_interface_state(feeds.interface_states(updates), now),
            "bgp": normalize.normalize_bgp_neighbors(feeds.bgp_neighbors(updates), now),
            "queue": normalize.normalize_queue_stats(feeds.queue_stats(updates), now),
        }
        for kind, rows in tables.items():
            append_monthly(rows, f"{paths[kind]}/batch={number}", mode="overwrite")
        batch.unpersist()

    return feed.writeStream.foreachBatch(write)


def window_sums(rows: DataFrame, keys: list[str], sums: dict[str, Column], lookback: int, every: int, delay: str, panes: bool) -> DataFrame:
    """``ts`` (end), ``keys`` and ``sums`` of each sliding window of ``lookback`` seconds. ``panes`` needs RocksDB (``timers``); without, each
    row is counted in every window that it is in, as the same rows a number of times. Both give the same but for rows
    behind the watermark, which panes leave out of all windows."""
    if panes:
        return windows_from_panes(rows, keys, {k: F.coalesce(v, F.lit(0)) for k, v in sums.items()}, lookback, every, delay)
    windows = rows.withWatermark("ts_bucket", delay).groupBy(
        F.window("ts_bucket", f"{lookback} seconds", f"{every} seconds").alias("w"), *keys
    ).agg(*[v.alias(k) for k, v in sums.items()])
    return windows.withColumn("ts", F.col("w.end")).drop("w")


def sliding_spikes(
    flows: DataFrame, baselines: DataFrame, lookback: int = 300, every: int = 30, delay: str = "2 minutes", panes: bool = False
) -> DataFrame:
    """ST4: spike scores of each sliding window, against the baseline of the hour of its end (a static table). The join sorts and
    merges: Spark knows no size of the windows, and would send all of them through the driver if it took them for the smaller side."""
    rows = window_sums(
        flows, ["tenant_id", "device", "interface"], {"current_bytes": F.sum("bytes_estimated")}, lookback, every, delay, panes
    )
    known = baselines.where((F.col("sample_count") >= detect.MIN_BASELINE) & (F.col("stddev_value") != 0)).select(
        "tenant_id", "device", "interface", "hour_of_day", "mean_value", "stddev_value"
    ).hint("merge")
    scored = rows.withColumn("hour_of_day", F.hour("ts")).join(known, ["tenant_id", "device", "interface", "hour_of_day"]).withColumn(
        "z_score", (F.col("current_bytes") - F.col("mean_value")) / F.col("stddev_value")
    )
    return scored.where(F.col("z_score") >= detect.Z_MEDIUM).select("ts", "tenant_id", "device", "interface", "current_bytes", "z_score")


def sliding_stress(queues: DataFrame, lookback: int = 300, every: int = 30, delay: str = "2 minutes", panes: bool = False) -> DataFrame:
    """ST5: queue sums of each sliding window and the event type, as the batch detector has it."""
    sums = {
        "pfc": F.sum(F.col("pfc_pause_rx") + F.col("pfc_pause_tx")), "ecn": F.sum("ecn_marked_packets"), "drops": F.sum("dropped_packets")
    }
    rows = window_sums(queues, ["tenant_id", "device", "interface", "queue_id"], sums, lookback, every, delay, panes)
    lossless = (F.col("drops") > 0) & (F.col("pfc") > 0)
    kinds = F.filter(
        F.array(
            F.when(lossless, "lossless_drop"), F.when(~lossless & (F.col("pfc") >= detect.PFC_STORM), "pfc_storm"),
            F.when(~lossless & (F.col("ecn") >= detect.ECN_SPIKE), "ecn_spike")
        ),
        lambda k: k.isNotNull()
    )
    return rows.withColumn("anomaly_type", F.explode(kinds)).select(
        "ts", "tenant_id", "device", "interface", "queue_id", "anomaly_type", "pfc", "ecn", "drops"
    )


def breach_batches(rows: DataFrame, emit: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """ST6: the last sample of each interface of a batch, if it is over the limit. Of a minute's samples it is that of the largest
    ``event_id``, or the busiest where there is none, so that every run gives the same."""
    order = ["ts_bucket", *[c for c in ("event_id", "in_util_pct", "out_util_pct") if c in rows.columns]]

    def check(batch: DataFrame, number: int) -> None:
        last = latest(batch, ["tenant_id", "device", "interface"], order)
        emit(detect.threshold_breaches(last, F.lit("9999-12-31").cast("timestamp")), number)

    return rows.writeStream.foreachBatch(check)


class Versions:
    """A keyed table in buckets, of which a batch reads and writes those it touches. A batch writes new folders and then a
    list of the folder in use of each bucket; it reads by the list of the batch before it, so a batch that is run again
    after a failure gives the same. Folders that neither the last two lists name are deleted."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: list[str], buckets: int = 32):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, number: int) -> dict[int, int]:
        """The version in use of each bucket after a batch; one row per bucket."""
        if number < 0:
            return {}
        return {
            r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(
                f"{self.root}/list/v={number}"
            ).collect()
        }

    def _read(self, folders: dict[int, int]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/v={v}/bucket={b}" for b, v in folders.items()])

    def put(self, number: int, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``merge`` of the stored rows of the batch's buckets and the batch."""
        before = self._folders(number - 1)
        touched = {r[0] for r in batch.select(self._bucket()).distinct().collect()}  # at most as many as there are buckets
        out = merge(self._read({b: v for b, v in before.items() if b in touched}), batch).select(*self.schema.fieldNames())
        out.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.root}/data/v={number}"
        )
        now = before | dict.fromkeys(touched, number)
        self.spark.createDataFrame(
            list(now.items()), "bucket int, version long"
        ).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/list/v={number}")
        for bucket, version in self._folders(number - 2).items():
            if before.get(bucket) != version and now.get(bucket) != version:
                delete(self.spark, f"{self.root}/data/v={version}/bucket={bucket}")

    def at(self, number: int) -> DataFrame:
        return self._read(self._folders(number))


STORED = T.StructType(
    [T.StructField(c, T.TimestampType() if c.endswith("_at") else T.LongType() if c == "occurrence_count" else T.StringType()) for c in anomalies.STORED]
)
HEARTBEATS = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()), T.StructField("source_kind", T.StringType()), T.StructField("device", T.StringType()),
        T.StructField("last_ingest_ts", T.TimestampType()), T.StructField("last_sample_count", T.IntegerType()),
        T.StructField("status", T.StringType())
    ]
)


def dedup_batches(events: DataFrame, store: Versions) -> DataStreamWriter:
    """ST7: each batch of events (with fingerprint) recorded in the stored table."""
    return events.writeStream.foreachBatch(lambda batch, n: store.put(n, batch, anomalies.record))


def freshness_batches(ingested: DataFrame, store: Versions) -> DataStreamWriter:
    """ST8: each batch of ingested rows as heartbeats; ``freshness.scan`` classifies a version at any time, and
    ``timers.watch_freshness`` tells by itself when a source falls silent."""
    return ingested.writeStream.foreachBatch(
        lambda batch, n: store.put(n, batch, lambda old, new: freshness.merge_heartbeats(old, freshness.heartbeats(new)))
    )


class Routing:
    """ST9: mappings that are read again for each batch, each good reading kept as a version below ``root``. If a reading
    fails (files, tables or the cluster; other errors are raised), the last whole version stays in use: that of this
    process, or after a restart the last one found below ``root`` that was written to its end."""

    def __init__(self, read: Callable[[], DataFrame], root: str):
        self.read, self.root, self.failures = read, root.rstrip("/"), 0
        spark = SparkSession.active()
        whole = [
            int(x.removeprefix("v=")) for x in names_in(spark, self.root) if x.startswith("v=") and exists(
                spark, f"{self.root}/{x}/_SUCCESS"
            )
        ]
        self.version = max(whole, default=-1)
        self.last = spark.read.parquet(f"{self.root}/v={self.version}") if whole else None

    def __call__(self) -> DataFrame:
        path = f"{self.root}/v={self.version + 1}"
        try:
            rows = self.read()
            rows.write.mode("overwrite").parquet(path)
        except (OSError, PySparkException, Py4JJavaError):
            self.failures += 1
            if self.last is None:
                raise
            return self.last
        self.last, self.version = rows.sparkSession.read.schema(rows.schema).parquet(path), self.version + 1
        return self.last


ACCEPTED = T.StructType([T.StructField("tool_name", T.StringType()), T.StructField("us", T.LongType())])


def rate_batches(
    calls: DataFrame, store: Versions, path: str, limits: dict[str, int] = usage.CALL_LIMITS, other: int = 30,
    seconds: int = usage.WINDOW_SECONDS, tie: str = "event_id"
) -> DataStreamWriter:
    """Q20, exact, over a stream: each batch's calls are decided in order of time after those of the batches before. The decisions
    are written below ``path``, a folder a batch; ``store`` (``ACCEPTED``, by tool) keeps the accepted calls that still count, at most
    a tool's limit of them, and forgets those a window before the tool's last call."""

    def decide(batch: DataFrame, number: int) -> None:
        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            usage.decided(new, old, limits, other, seconds, tie).write.mode("overwrite").parquet(f"{path}/batch={number}")
            return usage.still_counting(old, batch.sparkSession.read.parquet(f"{path}/batch={number}"), seconds)

        store.put(number, batch, merge)

    return calls.writeStream.foreachBatch(decide)


def split_late(records: DataFrame, path: str, delay: int, ts: str = "timestamp", bucket: int = 60) -> DataStreamWriter:
    """ST1: rows that come after their minute was closed go to ``path``/late, others to ``path``/ontime, a folder a batch. A minute is
    closed once ``delay`` seconds have passed behind it by the latest time of the batches before, which is kept with each
    batch. ``flow_minutes`` over ``ontime`` with the same delay drops nothing, so both together are all rows. A batch that is run
    again leaves what it has written whole."""

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/seen/batch={number - 1}").first()["us"] if number else None
        closed = (
            F.unix_seconds(ts) - F.pmod(F.unix_seconds(ts), F.lit(bucket)) + bucket
        ) * 1_000_000 <= F.lit(before).cast("long") - delay * 1_000_000
        late = F.coalesce(closed, F.lit(False))
        batch.persist()
        last = batch.agg(F.max(F.unix_micros(ts)).alias("us")).select(F.greatest(F.col("us"), F.lit(before).cast("long")).alias("us"))
        for name, rows in (("late", batch.where(late)), ("ontime", batch.where(~late)), ("seen", last.coalesce(1))):
            if not exists(spark, f"{path}/{name}/batch={number}/_SUCCESS"):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return records.writeStream.foreachBatch(split)


def feed_batches(feed: DataFrame, path: str, flows: bool = False, counters: bool = False) -> DataStreamWriter:
    """S1 - S3 as files of JSON documents (``feeds.json_stream``): each batch's readable documents as records below ``path``/records,
    what can't be read below ``path``/quarantine (``kind``, ``document``). Notifications are the default: their records are updates."""

    def take(batch: DataFrame, number: int) -> None:
        batch.persist()
        bad = batch.where(F.col(feeds.BAD).isNotNull()).select(F.lit("document").alias("kind"), F.col(feeds.BAD).alias("document"))
        docs = batch.where(F.col(feeds.BAD).isNull()).drop(feeds.BAD)
        if flows:
            rows = feeds.flow_records(docs, F.col("fetched_at"))
        elif counters:
            rows, aside = feeds.counter_records(docs, F.col("fetched_at"))
            bad = bad.unionByName(aside.select(F.lit("value").alias("kind"), F.to_json(F.struct("*")).alias("document")))
        else:
            rows = docs
        rows.write.mode("overwrite").parquet(f"{path}/records/batch={number}")
        bad.write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")
        batch.unpersist()

    return feed.writeStream.foreachBatch(take)
