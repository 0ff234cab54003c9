"""Streams with timers and stored state, JSON feeds, and tables that are kept up to date by parts."""

import datetime as dt
import json
import os
import time
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from meshlytics.functions import columns as C
from meshlytics.operators import baselines, freshness, interfaces, normalize, retention, usage
from meshlytics.plans.fixtures import view
from meshlytics.sources import feeds, sinks
from meshlytics.streaming import streams, timers

SF = "/root/testdata/sf0.001"
START = dt.datetime(2026, 1, 1, 10, 0)


def run(writer, at, name="cp", **trigger):
    q = writer.option("checkpointLocation", f"{at}/{name}").trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return q


def folder_stream(spark, at, schema, batches):
    """Rows as one file a batch, in order, read one file at a time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


BEATS = "tenant_id string, source_kind string, device string, ts timestamp, sample_count int"


def test_silence_by_event_time_in_batches(spark, tmp_path):
    """The same changes however the rows are dealt to batches, and the statuses of the batch classification at the end."""
    beat = lambda kind, device, second: ("t", kind, device, START + dt.timedelta(seconds=second), 1)
    rows = [beat("sflow", "a", s) for s in (0, 60, 100, 400, 2000, 2010)] + [
        beat("gnmi", "a", 0), beat("gnmi", "b", 3000), beat("other", "c", 100), beat("other", "c", 100), beat("other", "c", 3100)
    ]
    rows.sort(key=lambda r: r[3])
    rows.append(("t", "sflow", "nulltime", None, 1))
    seen = []
    with timers.with_rocksdb(spark):
        for n, batches in enumerate([[rows], [rows[:3], rows[3:6], rows[6:8], rows[8:]], [[r] for r in rows]]):
            feed = folder_stream(spark, tmp_path / f"b{n}", BEATS, batches)
            out = str(tmp_path / f"out{n}")
            run(timers.watch_freshness(feed).writeStream.format("parquet").option("path", out).outputMode("append"), tmp_path, f"cp{n}")
            changes = spark.read.parquet(out)
            seen.append(
                {(r.source_kind, r.device, r.status, (r.changed_at - START).seconds, (r.since - START).seconds) for r in changes.collect()}
            )
            now = F.lit(str(START + dt.timedelta(seconds=3100))).cast("timestamp")
            known = freshness.scan(freshness.heartbeats(spark.createDataFrame(rows, BEATS).where("ts is not null")), now)
            want = {(r.source_kind, r.device, r.status) for r in known.collect()}
            status = {(r.source_kind, r.device): r.status for r in timers.status_from_changes(changes).collect()}
            assert {(k, d, status.get((k, d), "fresh")) for k, d, _ in want} == want
    assert seen[0] == seen[1] == seen[2]
    a = sorted(x[2:] for x in seen[0] if x[:2] == ("sflow", "a"))
    assert a == sorted(
        [
            ("stale", 280, 100), ("recovered", 400, 100), ("stale", 580, 400), ("silent", 1300, 400), ("recovered", 2000, 400),
            ("stale", 2190, 2010), ("silent", 2910, 2010)
        ]
    )


def test_silence_by_the_clock_without_rows(spark, tmp_path):
    """No row arrives after the first batch; the source turns stale and silent all the same, and recovers with the next row."""
    scale = 0.02  # stale after 3.6 s, silent after 18
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = lambda t: [("t", "gnmi", "d", t, 1)]
    feed = folder_stream(spark, tmp_path, BEATS, [row(now)])
    out, deadline = str(tmp_path / "out"), time.time() + 60
    with timers.with_rocksdb(spark):
        q = timers.watch_freshness(feed, scale, clock=True).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")
        ).trigger(processingTime="1 second").start()
        try:
            found = lambda: {
                r.status for r in spark.read.schema("status string").parquet(out).collect()
            } if os.path.exists(out) else set()
            while time.time() < deadline and not {"stale", "silent"} <= found():
                time.sleep(1)
            assert found() == {"stale", "silent"}
            spark.createDataFrame(
                row(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)), BEATS
            ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            while time.time() < deadline and "recovered" not in found():
                time.sleep(1)
            assert "recovered" in found()
        finally:
            q.stop()


QUEUES = "tenant_id string, ts_bucket timestamp, device string, interface string, queue_id int, pfc_pause_rx long, pfc_pause_tx long, ecn_marked_packets long, dropped_packets long"


def test_windows_from_panes_are_the_sliding_ones(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = []
    for d in range(8):
        m = 0
        while m < 300:
            m += rng.choice([0, 0, 1, 1, 2, 40])
            rows.append(
                (
                    "t", START + dt.timedelta(minutes=m), f"d{d}", "i", d % 2, rng.choice([0, 700]), rng.choice([0, 700]),
                    rng.choice([0, 300]), rng.choice([0, 0, 3])
                )
            )
    rows.sort(key=lambda r: r[1])
    batches = [rows[k : k + len(rows) // 5 + 1] for k in range(0, len(rows), len(rows) // 5 + 1)]
    got, state = {}, {}
    for panes in (True, False):
        at = tmp_path / str(panes)
        feed = folder_stream(spark, at, QUEUES, batches)
        with timers.with_rocksdb(spark):
            q = run(
                streams.sliding_stress(feed, panes=panes).writeStream.format("parquet").option("path", f"{at}/out").outputMode("append"), at
            )
        got[panes] = Counter(tuple(r) for r in spark.read.parquet(f"{at}/out").collect())
        state[panes] = max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress)
    assert got[True] == got[False] and len(got[True]) > 50
    assert state[True] * 3 < state[False]


CALLS = "event_id long, ts timestamp, tool_name string"


def decisions(calls, limits, other, seconds):
    kept, out = {}, {}
    for i, t, tool in sorted(calls, key=lambda c: (c[1], c[0])):
        own = [k for k in kept.get(tool, []) if (t - k).total_seconds() < seconds]
        ok = len(own) < limits.get(tool, other)
        out[i] = (ok, None if ok else int(seconds - (t - own[0]).total_seconds()))
        kept[tool] = own + [t] * ok
    return out


def test_rate_stream_over_batches_and_a_restart(spark, tmp_path):
    import random

    rng = random.Random(3)
    calls, t = [], START
    for i in range(600):
        t += dt.timedelta(seconds=rng.choice([0, 0, 1, 2, 5, 90]))
        calls.append((i, t, rng.choice(["get_rdma_health", "explain_hot_link", "hot", "hot", "hot"])))
    calls.append((600, t + dt.timedelta(seconds=1), "rare"))
    store = streams.Versions(spark, str(tmp_path / "store"), streams.ACCEPTED, ["tool_name"], 4)
    limits = {"get_rdma_health": 2, "explain_hot_link": 1}
    cut = [0, 150, 151, 400, 601]
    schema = spark.createDataFrame([], CALLS).schema
    for k in range(4):  # a start for each part: the stream finds its place and its state again
        spark.createDataFrame(calls[cut[k] : cut[k + 1]], CALLS).write.mode("append").parquet(str(tmp_path / "in"))
        q = run(
            streams.rate_batches(
                spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "out"), limits, 5, 60
            ),
            tmp_path
        )
        held = store.at(q.lastProgress["batchId"]).groupBy("tool_name").count().collect()
        assert all(r["count"] <= limits.get(r.tool_name, 5) for r in held)
    got = {r.event_id: (r.accepted, r.retry_after_seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == decisions(calls, limits, 5, 60)
    assert got == {
        r.event_id: (r.accepted, r.retry_after_seconds) for r in usage.rate_decisions(
            spark.createDataFrame(calls, CALLS), limits, 5, 60
        ).collect()
    }
    # The same batch once more, as after a lost driver: nothing changes.
    before = store.at(3).orderBy("tool_name", "us").collect()
    spark.createDataFrame(calls[cut[3] :], CALLS).write.parquet(str(tmp_path / "again"))
    last = spark.read.parquet(str(tmp_path / "again"))
    store.put(3, last, lambda old, new: usage.still_counting(old, usage.decided(new, old, limits, 5, 60, "event_id"), 60))
    assert store.at(3).orderBy("tool_name", "us").collect() == before


def test_late_rows_beside_the_minutes(spark, tmp_path):
    """Closed minutes and late rows together are all rows."""
    raw = view(spark, SF, "flow_raw")
    records = raw.withColumn(
        "k", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("timestamp", "event_id"))
    ).cache()
    n = records.count()
    schema = raw.schema
    for part in range(3):
        own = records.where(
            (F.col("k") * 3 > n * part) & (
                F.col("k") * 3 <= n * (part + 1)
            ) & (F.col("event_id") % 7 != 0) if part < 2 else (F.col("k") * 3 > n * 2) | (F.col("event_id") % 7 == 0)
        )
        own.drop("k").write.mode("append").parquet(str(tmp_path / "in"))
        run(streams.split_late(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "split"), 120), tmp_path)
    late, ontime = spark.read.parquet(str(tmp_path / "split/late")), spark.read.parquet(str(tmp_path / "split/ontime"))
    assert late.count() > 0 and late.count() + ontime.count() == n and late.select("event_id").union(ontime.select("event_id")).distinct().count() == n
    sources = view(spark, SF, "collector_sources")
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "split/ontime/batch=*"))
    run(
        streams.flow_minutes(
            rows, sources, "2 minutes", "event_id"
        ).writeStream.format("parquet").option("path", str(tmp_path / "minutes")).outputMode("append"),
        tmp_path, "cp2"
    )
    minutes = spark.read.parquet(str(tmp_path / "minutes"))
    last = minutes.agg(F.max("ts_bucket")).first()[0]
    total = lambda df, c="bytes_estimated": df.where(F.col("ts_bucket") <= F.lit(last)).agg(F.sum(c)).first()[0] or 0
    of_late = normalize.normalize_flows(late, "event_id")
    assert total(minutes) + total(of_late) == total(normalize.normalize_flows(raw, "event_id"))
    # A batch that is run again leaves its folders as they are.
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "split").rglob("*.parquet")}
    run(
        streams.split_late(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "split"), 120), tmp_path,
        "cp_again"
    )
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "split").rglob("*.parquet")} == before


def test_routing_after_a_restart(spark, tmp_path):
    sources, root = view(spark, SF, "collector_sources"), str(tmp_path / "routing")

    def gone():
        raise AnalysisException(message="the mappings can't be read")

    first = streams.Routing(lambda: sources, root)
    first(), first()
    (tmp_path / "routing" / "v=2").mkdir()  # written in part only: no marker
    (tmp_path / "routing" / "v=2" / "part-0.parquet").write_bytes(b"PAR1")
    again = streams.Routing(gone, root)
    assert again.version == 1 and again().count() == sources.count() and again.failures == 1
    again.read = lambda: sources.limit(1)
    assert again().count() == 1 and again.version == 2
    assert streams.Routing(gone, root)().count() == 1
    with pytest.raises(AnalysisException):
        streams.Routing(gone, str(tmp_path / "none"))()
    with pytest.raises(TypeError):  # a programming error is no failed reading
        streams.Routing(lambda: sources + 1, root)()


def test_dropping_months_leaves_the_others_alone(spark, tmp_path):
    day = lambda y, m, d: dt.datetime(y, m, d)
    rows = [(day(2023, 11, 5), 1), (day(2023, 11, 6), 2), (day(2023, 12, 31), 3), (day(2024, 1, 1), 4), (day(2024, 2, 3), 5), (None, 6)]
    table = spark.createDataFrame(rows, "ts_bucket timestamp, x int")
    flat, nested = str(tmp_path / "flat"), str(tmp_path / "nested")
    sinks.append_monthly(table, flat)
    sinks.append_monthly(table, flat)
    for n in range(2):
        sinks.append_monthly(table, f"{nested}/batch={n}", mode="overwrite")
    files = lambda p: {f: f.stat().st_mtime_ns for f in (tmp_path / p).rglob("*.parquet")}
    before = {p: files(p) for p in ("flat", "nested")}
    for p in ("flat", "nested"):
        got = retention.drop_months(spark, str(tmp_path / p), C.at("2024-02-10 00:00:00"), 30)
        assert sorted(map(tuple, got.collect())) == [(202311, 4), (202312, 2)]
        stay = {f: t for f, t in before[p].items() if "month=2023" not in str(f)}
        assert files(p) == stay and not list((tmp_path / p).rglob("month=2023*"))
        assert retention.drop_months(spark, str(tmp_path / p), C.at("2024-02-10 00:00:00"), 30).count() == 0 and files(p) == stay
    left = spark.read.parquet(flat)
    assert sorted(r.x for r in left.collect()) == [4, 4, 5, 5, 6, 6]
    out = retention.prune(spark, {"queue_stats_minute": flat, "flow_summary_minute": nested}, C.at("2024-03-10 00:00:00"))
    assert {tuple(r) for r in out.collect()} == {("queue_stats_minute", 202401, 2)}
    assert retention.drop_months(spark, str(tmp_path / "nothing"), C.at("2024-02-10 00:00:00"), 30).count() == 0


def test_moments_merge_to_the_full_recompute(spark, tmp_path):
    flows = normalize.route(
        normalize.normalize_flows(view(spark, SF, "flow_raw"), "event_id"), view(spark, SF, "collector_sources"), "sflow"
    ).cache()
    at = str(tmp_path / "moments")
    late = F.pmod(F.xxhash64("src_ip", "ts_bucket"), F.lit(5)) == 0
    baselines.refresh_moments(flows.where(~late), at, [f"2024-01-{d:02d}" for d in range(1, 32)])
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "moments" / "day=2024-01-20").glob("*.parquet")}
    baselines.refresh_moments(flows, at, [f"2024-01-{d:02d}" for d in range(1, 32) if d != 20])
    assert untouched == {f: f.stat().st_mtime_ns for f in (tmp_path / "moments" / "day=2024-01-20").glob("*.parquet")}
    baselines.refresh_moments(flows, at, ["2024-01-20"])
    moments, key = spark.read.parquet(at), ["tenant_id", "device", "interface", "hour_of_day"]
    for as_of in ("2024-01-25 00:00:00", "2024-01-24 13:27:00", "2024-01-23 09:59:00"):
        want = {tuple(r[c] for c in key): r for r in baselines.compute_baselines(flows, C.at(as_of)).collect()}
        plan = baselines.baselines_from_moments(moments, flows, C.at(as_of))
        got = {tuple(r[c] for c in key): r for r in plan.collect()}
        assert got.keys() == want.keys() and want
        for k, r in got.items():
            assert r.sample_count == want[k].sample_count
            assert r.mean_value == pytest.approx(want[k].mean_value, rel=1e-9) and r.stddev_value == pytest.approx(
                want[k].stddev_value, rel=1e-9, abs=1e-6
            )
    assert "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().toString()


def test_trend_without_sorting_a_link(spark):
    import random

    rng = random.Random(4)
    rows = []
    for link in range(12):
        slope = rng.choice([-40, 0, 40])
        for k in range(rng.choice([1, 2, 3, 50, 301])):
            u = None if rng.random() < 0.1 else 50 + slope * k / 300 + rng.random()
            rows.append(
                (
                    "t" if link else None, "d", str(link), START + dt.timedelta(minutes=rng.randrange(0, 600) if link % 2 else k // 4), u,
                    None if rng.random() < 0.1 else 10.0, k
                )
            )
    df = spark.createDataFrame(
        rows,
        "tenant_id string, device string, interface string, ts_bucket timestamp, in_util_pct double, out_util_pct double, event_id long"
    )
    out = interfaces.interface_utilization(df, C.at("2026-01-02 00:00:00"), 2000, "event_id")
    got = {r.interface: r for r in out.collect()}
    for link in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == link), key=lambda r: (r[3], r[6]))
        half = len(own) // 2
        peak = lambda r: max((x for x in r[4:6] if x is not None), default=None)
        mean = lambda part: (lambda v: sum(v) / len(v) if v else None)([peak(r) for r in part if peak(r) is not None])
        early, late = mean(own[:half]), mean(own[half:])
        want = "stable" if early is None or late is None or abs(late - early) <= 5 else "increasing" if late > early else "decreasing"
        assert got[link].trend == want and got[link].n_samples == len(own)
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert windows and all("_n#" in w or "_b#" in w.split("], [")[1] for w in windows)


def test_json_feeds_with_quarantine(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    flow = {"agent": "sw1", "inputifindex": 1, "bytes": 10, "packets": 2}
    docs = [
        {"fetched_at": "2026-01-01T10:00:00.000Z", "flows": [flow, flow | {"bytes": "n/a"}, {"bytes": 5}]},
        {"fetched_at": "2026-01-01T10:01:00.000Z", "flows": []}, {"flows": [flow]}
    ]
    lines = [json.dumps(d) for d in docs] + ['{"flows": [{"agent": "sw1", ', "no json at all", '{"flows": "nothing"}']
    for k, line in enumerate(lines):
        (tmp_path / "feed" / f"{k}.json").write_text(line + "\n")
    q = run(
        streams.feed_batches(feeds.json_stream(spark, str(tmp_path / "feed"), feeds.FLOW_FEED, 2), str(tmp_path / "out"), flows=True),
        tmp_path
    )
    assert q.lastProgress["batchId"] == 2
    rows = spark.read.parquet(str(tmp_path / "out/records")).collect()
    assert sorted(
        (r.agent, r.bytes, r.sampling_rate, str(r.timestamp)) for r in rows
    ) == [("sw1", 10, 1, "2026-01-01 10:00:00"), ("sw1", 10, 1, "None")]
    bad = [r.document for r in spark.read.parquet(str(tmp_path / "out/quarantine")).collect()]
    assert sorted(bad) == sorted(lines[3:])
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "a.json").write_text(json.dumps(docs[0], indent=2))
    (whole / "b.json").write_text('{\n"flows": [\n')
    run(
        streams.feed_batches(feeds.json_stream(spark, str(whole), feeds.FLOW_FEED, whole_files=True), str(tmp_path / "out2"), flows=True),
        tmp_path, "cp2"
    )
    assert spark.read.parquet(str(tmp_path / "out2/records")).count() == 1 and spark.read.parquet(
        str(tmp_path / "out2/quarantine")
    ).count() == 1


def test_upsert_by_buckets(spark, tmp_path):
    """The stored side is not shuffled, untouched parts keep their files, and the rows are those of ``upsert``."""
    rows = [(k, f"k{k % 7}", k) for k in range(200)]
    stored = spark.createDataFrame(rows, "id long, name string, n long")
    table = sinks.BucketedTable(spark, str(tmp_path / "t"), ["id", "name"], parts=8, buckets=4)
    table.create(stored)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    new = spark.createDataFrame([(3, "k3", 1000), (900, "new", 1)], "id long, name string, n long")
    touched = {r[0] for r in new.select(table._part()).collect()}
    add = {"n": lambda a, b: a + b}
    plan = table.merged(new, add)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[: text.find("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert final.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in final
    want = {tuple(r) for r in sinks.upsert(stored, new, ["id", "name"], add).collect()}
    table.upsert(new, add)
    assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == 201
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    part = lambda f: int(f.parent.name.removeprefix("part="))
    assert {f: t for f, t in before.items() if part(f) not in touched} == {f: t for f, t in after.items() if part(f) not in touched}
    table.upsert(new.limit(0), add)
    table.upsert(new, add)
    assert table.read().where("id = 3").first().n == 2003 and spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def test_json_as_python_writes_it(spark):
    import hashlib

    texts = [
        '{"a": 1.0}', '{"a": 1e20, "b": 1E-7, "c": 100.0, "d": -0.0, "e": 1e400}', '{"i": ' + "7" * 44 + "}",
        '{"d": "\x7f \\u007f \\ud800 /"}', '{"k": 1, "a": {"z": 2.50, "b": [1.10, 3]}, "k": 2}', "[NaN, -Infinity]", "1.5e3",
        '{"deep": ' + "[" * 300 + "]" * 300 + "}"
    ]
    df = spark.createDataFrame(
        [(k, t) for k, t in enumerate(texts)] + [(99, "{"), (98, None), (97, "[" * 200_000), (96, "9" * 5000)], "k long, t string"
    )
    got = {
        r.k: (r.c, r.h, r.s) for r in df.select(
            "k", C.canonical_json("t").alias("c"), usage.args_hash(F.col("t")).alias("h"), usage.truncate_args(F.col("t")).alias("s")
        ).collect()
    }
    for k, t in enumerate(texts):
        want = json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"))
        assert got[k][:2] == (want, hashlib.sha256(want.encode()).hexdigest()), t
    assert got[0][2] == '{"a":1.0}' and got[5][2] is None
    assert all(got[k] == (None, None, None) for k in (96, 97, 98, 99))
    same = spark.createDataFrame([("{}",), (None,), ("[]",)], "c string").select(
        C.fingerprint(F.lit("t"), F.lit("k"), F.lit("s"), F.col("c")).alias("f")
    ).distinct()
    assert [r.f for r in same.collect()] == [hashlib.sha256(b"t|k|s|").hexdigest()]


def test_many_panes_of_a_key_at_once(spark, tmp_path):
    """Weeks of one queue that arrive in one batch: the windows' work must grow with their number, not with its square."""
    n = 40_000
    rows = spark.range(n).select(
        F.lit("t").alias("tenant_id"), F.timestamp_seconds(F.lit(1_700_000_040) + F.col("id") * 60).alias("ts_bucket"),
        F.lit("d").alias("device"), F.lit("i").alias("interface"), F.lit(0).alias("queue_id"), F.lit(1000).cast("long").alias("pfc_pause_rx"),
        *[F.lit(0).cast("long").alias(c) for c in ("pfc_pause_tx", "ecn_marked_packets", "dropped_packets")]
    )
    rows.write.parquet(f"{tmp_path}/in")
    feed, begun = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), time.time()
    with timers.with_rocksdb(spark):
        run(streams.sliding_stress(feed, panes=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append"), tmp_path)
    assert time.time() - begun < 90
    out = spark.read.parquet(f"{tmp_path}/out")
    ends = out.agg(F.count("*"), F.countDistinct("ts"), F.sum("pfc"), F.max("pfc")).first()
    assert tuple(ends) == (2 * n - 6, 2 * n - 6, 1000 * sum(min(5, k // 2 + 1) for k in range(2 * n - 6)), 5000)


def test_windows_are_not_sent_through_the_driver(spark, tmp_path):
    """However small Spark takes a stream to be, its windows are no side of a join that is broadcast."""
    flows = "tenant_id string, ts_bucket timestamp, device string, interface string, bytes_estimated long"
    rows = [("t", START + dt.timedelta(minutes=m), "d", "i", 1000 if m == 10 else 100) for m in range(40)]
    known = spark.createDataFrame(
        [("t", "d", "i", 10, 500.0, 50.0, 5)] * 50,
        "tenant_id string, device string, interface string, hour_of_day int, mean_value double, stddev_value double, sample_count long"
    )
    feed = folder_stream(spark, tmp_path, flows, [rows])
    q = run(
        streams.sliding_spikes(feed, known).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append"), tmp_path
    )
    assert "Broadcast" not in q._jsq.explainInternal(False) and spark.read.parquet(f"{tmp_path}/out").count() > 0
