"""Stateful behaviours as Structured Streaming jobs, with batch twins that give the same rows.

Event time is in a named column; the watermark is ten minutes unless said otherwise, rows later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "file_path string, status string, progress double, started timestamp, updated timestamp"


def monitor(events: DataFrame, max_age: int = 3600) -> DataFrame:
    """Live state of each file as updates: start, progress, end, error; a file without news for ``max_age`` seconds of event
    time becomes an error. Updates of files that haven't started are ignored."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, progress, started, updated = state.get
            state.remove()
            if status == "active":
                yield pd.DataFrame([(key[0], "timeout", progress, pd.Timestamp(started, unit="us"), pd.Timestamp(updated, unit="us"))], columns=["file_path", "status", "progress", "started", "updated"])
            return
        now = list(state.get) if state.exists else None
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            at = int(row.ts.value // 1000)
            if row.event_type == "start":
                now = ["active", 0.0, at, at]
            elif now and now[0] == "active" and row.event_type in ("progress", "end", "error"):
                now[0] = {"progress": "active", "end": "completed", "error": "error"}[row.event_type]
                now[1] = 1.0 if row.event_type == "end" else float(row.progress or now[1])
                now[3] = at
        if now:
            state.update(tuple(now))
            state.setTimeoutTimestamp(max(now[3] // 1000 + max_age * 1000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame([(key[0], now[0], now[1], pd.Timestamp(now[2], unit="us"), pd.Timestamp(now[3], unit="us"))], columns=["file_path", "status", "progress", "started", "updated"])

    timed = events.select("file_path", "event_type", "ts", "progress").withWatermark("ts", "10 minutes")
    return timed.groupBy("file_path").applyInPandasWithState(follow, STATE, "status string, progress double, started long, updated long", "update", GroupStateTimeout.EventTimeTimeout)


def monitor_batch(events: DataFrame, as_of: Column, max_age: int = 3600) -> DataFrame:
    """The state of each file at ``as_of``: its last event since it last started."""
    w = W.partitionBy("file_path").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    started = F.max(F.when(F.col("event_type") == "start", F.struct("ts", "event_id"))).over(w)
    known = events.withColumn("started", started).where("started is not null and event_type in ('start', 'progress', 'end', 'error')")
    # what follows an end or an error before the next start is ignored
    closed = F.count_if(F.col("event_type").isin("end", "error")).over(W.partitionBy("file_path", "started").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    last = known.withColumn("closed", closed).where("closed = 0").groupBy("file_path").agg(F.max_by(F.struct("event_type", "ts", F.col("started.ts").alias("started")), F.struct("ts", "event_id")).alias("l"))
    age = F.unix_seconds(as_of) - F.unix_seconds("l.ts")
    status = F.when(F.col("l.event_type") == "end", "completed").when(F.col("l.event_type") == "error", "error").when(age > max_age, "timeout").otherwise("active")
    return last.select("file_path", status.alias("status"), F.col("l.started").alias("started"), F.col("l.ts").alias("updated"))


def sessions(messages: DataFrame, key: str, gap: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n): sessions that end after ``gap`` without a message. Batch and stream."""
    source = messages.withWatermark("ts", watermark) if messages.isStreaming else messages
    out = source.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


class _InOrder(StatefulProcessor):
    """Rows of a key in order of event time, whatever order they come in: rows are held back until the watermark has passed
    them, which bounds what is held by the watermark's delay, and then given to ``fold`` once. ``fold`` gets
    rows (seconds, *columns) and the watermark in seconds, and returns rows of the result and when it wants to be called at the latest."""

    columns: tuple[str, ...] = ()
    held_schema = ""
    out: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"at long, {self.held_schema}")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def fold(self, key: tuple, rows: list[tuple], watermark: float) -> tuple[list[tuple], float | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at.value // 1000), *rest) for frame in rows for at, *rest in frame[["ts", *self.columns]].itertuples(index=False)]
        return self._step(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._step(key, [], timerValues)

    def _step(self, key, new, timers) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs() * 1000
        held = [*(self.held.get() if self.held.exists() else ()), *new]
        done = sorted((tuple(r) for r in held if r[0] <= mark), key=lambda r: tuple((x is not None, x) for x in r))
        wait = [tuple(r) for r in held if r[0] > mark]
        if wait:
            self.held.put(wait)
        else:
            self.held.clear()
        found, wake = self.fold(key, done, mark)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = [x for x in (min((r[0] for r in wait), default=None), wake) if x is not None]
        if due:
            self.handle.registerTimer(max(int(min(due)) // 1000, mark // 1000) + 1)
        if found:
            yield pd.DataFrame(found, columns=list(self.out))


class _LastMessages(_InOrder):
    columns, held_schema = ("content",), "content string"

    def __init__(self, key: str, gap: int, keep: int):
        self.gap, self.keep = gap * 1_000_000, keep
        self.out = (key, "session_start", "session_end", "n", "messages")

    def open(self, handle):
        self.session = handle.getValueState("session", "first long, last long, n long")
        self.tail = handle.getListState("tail", "at long, content string")

    def fold(self, key, rows, watermark):
        now = list(self.session.get()) if self.session.exists() else None
        tail = [tuple(r) for r in self.tail.get()] if self.tail.exists() else []
        found = []

        def close():
            # a session ends ``gap`` after its last message
            found.append((key[0], pd.Timestamp(now[0], unit="us"), pd.Timestamp(now[1] + self.gap, unit="us"), now[2], [c for _, c in tail]))

        for at, content in rows:
            if now and at - now[1] > self.gap:
                close()
                now, tail = None, []
            now = [now[0] if now else at, at, now[2] + 1 if now else 1]
            tail = [*tail, (at, content)][-self.keep :]
        if now and now[1] + self.gap < watermark:
            close()
            now = None
        if now:
            self.session.update(tuple(now))
            self.tail.put(tail)
        else:
            self.session.clear()
            self.tail.clear()
        return found, now and now[1] + self.gap


class _Hits(_InOrder):
    columns = ("no_id", "query_id")

    def __init__(self, key: str, ttl: int, id_kind: str):
        self.ttl, self.held_schema = ttl, f"no_id boolean, query_id {id_kind}"
        self.out = (key, "query_id", "hit")

    def open(self, handle):
        self.missed = handle.getValueState("missed", "at long")

    def fold(self, key, rows, watermark):
        last = self.missed.get()[0] if self.missed.exists() else None
        found = []
        for at, no_id, name in sorted((at // 1_000_000, no_id, name) for at, no_id, name in rows):
            hit = last is not None and at - last < self.ttl
            last = last if hit else at
            found.append((key[0], None if no_id else str(name), hit))
        # a miss that is older than any row to come is forgotten
        if last is not None and (last + self.ttl) * 1_000_000 > watermark:
            self.missed.update((last,))
        elif self.missed.exists():
            self.missed.clear()
        return found, None if last is None else (last + self.ttl) * 1_000_000


def last_messages(messages: DataFrame, key: str, gap: int = 3600, keep: int = 10, watermark: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n, messages) of ``messages`` (key, ts, content): sessions as in ``sessions``, with the
    contents of their last ``keep`` messages in order. A stream, whose state is the open session with ``keep`` messages
    and what the watermark hasn't passed; needs the RocksDB state store."""
    kind = messages.schema[key].dataType
    # as text, since pandas makes whole numbers beside a null inexact
    timed = messages.select(F.col(key).cast("string").alias(key), "ts", "content").withWatermark("ts", watermark)
    schema = f"{key} string, session_start timestamp, session_end timestamp, n long, messages array<string>"
    return timed.groupBy(key).transformWithStateInPandas(_LastMessages(key, gap, keep), schema, "append", "eventtime").withColumn(key, F.col(key).cast(kind))


def last_messages_batch(messages: DataFrame, key: str, gap: int = 3600, keep: int = 10) -> DataFrame:
    """The batch twin of ``last_messages``."""
    order = W.partitionBy(key).orderBy("ts", "content")
    starts = F.coalesce(F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order) > gap * 1_000_000, F.lit(True))
    numbered = messages.select(key, "ts", "content").where("ts is not null").withColumn("session", starts).withColumn("session", F.count_if("session").over(order.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(key, "session").orderBy(F.desc("ts"), F.desc("content"))
    placed = numbered.withColumn("back", F.row_number().over(inside))
    tail = F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("back") <= keep, F.struct("back", "content"))))), lambda x: x["content"])
    end = F.timestamp_micros(F.unix_micros(F.max("ts")) + gap * 1_000_000)
    return placed.groupBy(key, "session").agg(F.min("ts").alias("session_start"), end.alias("session_end"), F.count("*").alias("n"), tail.alias("messages")).drop("session")


class LateRows(StreamingQueryListener):
    """Counts the rows that queries dropped because the watermark had passed them: ``count`` by name of the query, and
    progress as it comes."""

    def __init__(self):
        self.count: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.count.setdefault(event.name, 0)

    def onQueryProgress(self, event):
        p = event.progress
        self.count[p.name] = self.count.get(p.name, 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def daily_counts(rows: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(day, n) by tumbling days. Batch and stream."""
    source = rows.withWatermark("ts", watermark) if rows.isStreaming else rows
    return source.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


def user_panes(rows: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(day, sketch) of rows (user_id, ts): a mergeable sketch of the users of each day. Batch and stream."""
    source = rows.withWatermark("ts", watermark) if rows.isStreaming else rows
    days = source.groupBy(F.window("ts", "1 day").alias("w")).agg(F.hll_sketch_agg("user_id").alias("sketch"))
    return days.select(F.col("w.start").cast("date").alias("day"), "sketch")


def exact_panes(rows: DataFrame) -> DataFrame:
    """(day, bucket, bits) of rows (user_id, ts) with whole numbers as users: bitmaps of 32 768 users each, for each day."""
    placed = rows.where("user_id is not null").select(F.col("ts").cast("date").alias("day"), F.bitmap_bucket_number("user_id").alias("bucket"), F.bitmap_bit_position("user_id").alias("place"))
    return placed.groupBy("day", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def _windows(panes: DataFrame, days: int) -> DataFrame:
    """Each pane once for each window of ``days`` days, named by the day after its last, that it is part of."""
    return panes.withColumn("until", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda i: F.date_add("day", i))))


def active_users(panes: DataFrame, days: int = 30) -> DataFrame:
    """(until, users): users of the ``days`` days before each day. Of ``user_panes`` within two hundredths or so, of
    ``exact_panes`` exactly. Rows are reduced to a pane a day before windows overlap."""
    if "bits" in panes.columns:
        merged = _windows(panes, days).groupBy("until", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        return merged.groupBy("until").agg(F.sum("n").alias("users"))
    return _windows(panes, days).groupBy("until").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))


def first_queries(queries: DataFrame, key: str, ttl: str = "30 minutes") -> DataFrame:
    """Queries whose key hasn't been seen within ``ttl`` of event time (stream)."""
    return queries.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def cache_hits_stream(queries: DataFrame, key: str, ttl: int = 1800, watermark: str = "10 minutes") -> DataFrame:
    """``cache_hits`` of a stream: (key, query_id, hit) once the watermark has passed a query. The state of a key is its last
    miss, for ``ttl`` seconds, and what the watermark hasn't passed; needs the RocksDB state store."""
    kind = lambda c: queries.schema[c].dataType.simpleString()
    # a key as text and an id beside a mark for null, since pandas makes whole numbers beside a null inexact
    known = F.coalesce("query_id", F.lit(0).cast(kind("query_id")))
    timed = queries.select(F.col(key).cast("string").alias(key), F.col("query_id").isNull().alias("no_id"), known.alias("query_id"), "ts").withWatermark("ts", watermark)
    hits = timed.groupBy(key).transformWithStateInPandas(_Hits(key, ttl, kind("query_id")), f"{key} string, query_id string, hit boolean", "append", "eventtime")
    return hits.withColumn(key, F.col(key).cast(kind(key))).withColumn("query_id", F.col("query_id").cast(kind("query_id")))


def cache_hits(queries: DataFrame, key: str, ttl: int = 1800) -> DataFrame:
    """``queries`` (query_id, key, ts) with ``hit``: whether the last miss of the key is less than ``ttl`` seconds old.

    Of the queries of a key in one second only the first (smallest id) can miss, so the rows are reduced to seconds
    before they are shuffled, wherever a hot key's rows lie. A key's seconds then pass in order through one task, batch
    by batch, with the last miss as the only state: at most as many as the time it spans has, however many its queries.
    Queries without a time miss and leave no trace. A null key is a key. Repeated rows have equal results.
    """
    key_kind = queries.schema[key].dataType.simpleString()
    rows = queries.select(F.col(key).alias("key"), "query_id", F.unix_seconds("ts").alias("t"))
    seconds = rows.where("t is not null").groupBy("key", "t").agg(F.min("query_id").alias("first"))

    def fold(batches):
        held, last = object(), 0
        for batch in batches:
            missed = []
            for i, (k, t) in enumerate(zip(batch["key"].to_pylist(), batch["t"].to_pylist())):
                if k != held or t - last >= ttl:
                    held, last = k, t
                    missed.append(i)
            yield batch.take(pa.array(missed, pa.int64()))

    id_kind = queries.schema["query_id"].dataType.simpleString()
    ordered = seconds.repartition("key").sortWithinPartitions("key", "t")
    misses = ordered.mapInArrow(fold, f"key {key_kind}, t long, first {id_kind}").alias("m")
    same = F.col("r.key").eqNullSafe(F.col("m.key")) & (F.col("r.t") == F.col("m.t")) & F.col("r.query_id").eqNullSafe(F.col("m.first"))
    hit = F.col("r.t").isNotNull() & F.col("m.t").isNull()
    return rows.alias("r").join(misses, same, "left").select(F.col("r.key").alias(key), "r.query_id", hit.alias("hit"))


def ingest(files: DataFrame, chunk: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """New files (document_id, text) to chunks: each batch is chunked and written under its own number, so a batch that
    runs again replaces itself. Returns the query, which ends when what is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        chunk(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def task_counters(tasks: DataFrame, width: str = "1 day", watermark: str = "10 minutes") -> DataFrame:
    """(window start, type, status, n, avg_seconds). Batch and stream."""
    source = tasks.withWatermark("ts", watermark) if tasks.isStreaming else tasks
    out = source.groupBy(F.window("ts", width).alias("w"), "type", "status").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("avg_seconds"))
    return out.select(F.col("w.start").alias("start"), "type", "status", "n", "avg_seconds")
