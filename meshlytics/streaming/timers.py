"""Streams with keyed state and timers: sources that fall silent (ST8), windows from panes (ST4, ST5).

State is kept by ``transformWithStateInPandas``, which needs the RocksDB state store (``with_rocksdb``). Timers fire by the
watermark (event time, the same in every run) or by the clock (processing time, while no row arrives). Spark hands
rows over as named tuples, so names of columns don't begin with an underscore here.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import freshness

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def with_rocksdb(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)


def watch_freshness(ingested: DataFrame, scale: float = 1, delay: str = "0 seconds", clock: bool = False) -> DataFrame:
    """ST8: the changes of each source's status at the time they are due: ``stale`` and ``silent`` when the time since the last
    ingest reaches the thresholds of the batch classification (stretched by ``scale``), whether rows arrive or not, and
    ``recovered`` with the next ingest; ``changed_at`` is that time, ``since`` the last ingest before.

    State: one row per source. A source's rows of a batch are reduced to the first and last of each stretch of the stale
    threshold's length (shorter pauses change nothing), so a hot source takes memory by time, not by rows. Rows behind the
    watermark are dropped; null times are no ingests. ``clock`` takes the time of the cluster instead of the watermark.
    """
    stale = {k: int(v * scale * 1_000_000) for k, v in freshness.STALE_SECONDS.items()}
    other, times = int(freshness.OTHER_SECONDS * scale * 1_000_000), freshness.SILENT_TIMES
    columns = [*freshness.KEY, "status", "changed_at", "since"]

    class Watch(StatefulProcessor):  # inside, so that it travels to the workers by value
        def init(self, handle) -> None:
            self.handle, self.state = handle, handle.getValueState("last", "last long, status string")

        def _advance(self, key: tuple, last: int, status: str, now: int, out: list) -> str:
            """The changes that are due by ``now`` while no row comes."""
            limit = stale.get(key[1], other)
            for name, before, due in (("stale", "fresh", last + limit), ("silent", "stale", last + limit * times)):
                if status == before and due <= now:
                    out.append((*key, name, due, last))
                    status = name
            return status

        def _keep(self, key: tuple, last: int, status: str) -> None:
            self.state.update((last, status))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if status != "silent":
                due = last + stale.get(key[1], other) * (times if status == "stale" else 1)
                self.handle.registerTimer(-(-due // 1000))

        def _now(self, timers) -> int:
            return (timers.getCurrentProcessingTimeInMs() if clock else timers.getCurrentWatermarkInMs()) * 1000

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            size, ends = max(stale.get(key[1], other), 1), None
            for pdf in rows:
                us = pdf["us"]
                part = us.groupby(us // size).agg(["min", "max"])
                ends = part if ends is None else pd.concat([ends, part]).groupby(level=0).agg({"min": "min", "max": "max"})
            out: list = []
            last, status = self.state.get() if self.state.exists() else (None, "fresh")
            for t in sorted(set(ends["min"]) | set(ends["max"])):
                t = int(t)
                if last is not None and t > last:
                    status = self._advance(key, last, status, t, out)
                    if status != "fresh":
                        out.append((*key, "recovered", t, last))
                        status = "fresh"
                last = t if last is None else max(last, t)
            status = self._advance(key, last, status, self._now(timerValues), out)
            self._keep(key, last, status)
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            out: list = []
            last, status = self.state.get()
            self._keep(key, last, self._advance(key, last, status, self._now(timerValues), out))
            yield pd.DataFrame(out, columns=columns)

        def close(self) -> None:
            pass

    rows = ingested.where(F.col("ts").isNotNull()).select(*freshness.KEY, "ts", F.unix_micros("ts").alias("us"))
    rows = rows if clock else rows.withWatermark("ts", delay)
    schema = "tenant_id string, source_kind string, device string, status string, changed_at long, since long"
    changes = rows.groupBy(*freshness.KEY).transformWithStateInPandas(Watch(), schema, "Append", "ProcessingTime" if clock else "EventTime")
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("changed_at", "since")})


def status_from_changes(changes: DataFrame) -> DataFrame:
    """The status of each source after its last change; sources without changes are fresh and not among them."""
    order = F.when(F.col("status") == "recovered", 0).when(F.col("status") == "stale", 1).otherwise(2)
    last = changes.groupBy(*freshness.KEY).agg(F.max_by("status", F.struct("changed_at", order)).alias("status"))
    return last.withColumn("status", F.when(F.col("status") == "recovered", "fresh").otherwise(F.col("status")))


def windows_from_panes(rows: DataFrame, keys: list[str], sums: dict[str, Column], lookback: int, every: int, delay: str) -> DataFrame:
    """The sums of each sliding window of ``lookback`` seconds, one ``every`` so many: ``ts`` (the window's end), ``keys`` and ``sums``.

    Rows are first summed to panes of ``every`` seconds (once each, before the shuffle as far as possible), of which a key
    keeps those of a ``lookback`` as one state row. A timer adds up the panes of each window that the watermark has passed,
    and so gives the rows of ``groupBy(window(...))``, which has a copy of each row, and a state row, for every window.
    """
    panes = rows.withWatermark("ts_bucket", delay).groupBy(
        F.window("ts_bucket", f"{every} seconds").alias("w"), *keys
    ).agg(*[v.alias(k) for k, v in sums.items()])
    panes = panes.select(F.window_time("w").alias("time"), F.unix_seconds("w.start").alias("pane"), *keys, *sums)
    names, kinds = list(sums), {f.name: f.dataType.simpleString() for f in panes.schema.fields}
    fields = [*keys, "_end", *names]

    class Panes(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.state = handle, handle.getValueState(
                "panes", "next long, starts array<bigint>, " + ", ".join(f"s{k} array<bigint>" for k in range(len(names)))
            )

        def _emit(self, key: tuple, end: int, held: dict, now: int) -> Iterator[pd.DataFrame]:
            """The windows up to ``now``; what may still be asked for stays. Panes come in order, and two marks move over them, so a
            pane is looked at once for each window that it is in, however many panes a batch has."""
            out, starts, values, low, high = [], list(held), list(held.values()), 0, 0
            while low < len(starts) and end <= now:
                while high < len(starts) and starts[high] < end:
                    high += 1
                while low < high and starts[low] + lookback < end:
                    low += 1
                if low < high:
                    out.append((*key, end, *map(sum, zip(*values[low:high]))))
                while low < len(starts) and starts[low] + lookback <= end:
                    low += 1
                end = max(end + every, starts[low] + every if low < len(starts) else 0)
            held = dict(zip(starts[low:], values[low:]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held:
                self.state.update((end, list(held), *([v[k] for v in held.values()] for k in range(len(names)))))
                self.handle.registerTimer(end * 1000)
            else:
                self.state.clear()
            yield pd.DataFrame(out, columns=fields)

        def _held(self) -> tuple[int | None, dict]:
            if not self.state.exists():
                return None, {}
            end, starts, *values = self.state.get()
            return end, dict(zip(starts, zip(*values)))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            end, held = self._held()
            for pdf in rows:
                for p, *v in zip(pdf["pane"].tolist(), *(pdf[c].tolist() for c in names)):
                    held[p] = tuple(a + b for a, b in zip(held[p], v)) if p in held else tuple(v)
                    end = p + every if end is None else min(end, p + every)
            held = dict(sorted(held.items()))
            yield from self._emit(key, end, held, timerValues.getCurrentWatermarkInMs() // 1000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            end, held = self._held()
            if held:
                yield from self._emit(key, end, held, timerValues.getCurrentWatermarkInMs() // 1000)

        def close(self) -> None:
            pass

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_end long", *(f"{n} {kinds[n]}" for n in names)])
    out = panes.groupBy(*keys).transformWithStateInPandas(Panes(), schema, "Append", "EventTime")
    return out.withColumn("ts", F.timestamp_seconds("_end")).drop("_end")
