"""Stateful stream operators over events (key, ts, ...), and their batch equivalents by window functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mnemora.operators.recall import knn
from mnemora.sources.commits import CommitLog

TTL_SECONDS = 7200
DEDUP_SECONDS = 600
CAPS = {"ids": 100, "keywords": 30, "tools": 40}


class Expiring(StatefulProcessor):
    """A processor whose state of a key goes when the watermark has passed ``ttl`` seconds since the key's last event.

    Each batch of a key moves its one timer; the watermark, not the key's next
    event, ends a state, so keys that never come back leave nothing behind.
    Events that are later than the watermark are dropped before they come here.
    """

    ttl: int = TTL_SECONDS

    def keep_until(self, at: pd.Timestamp) -> None:
        """Put the key's timer at ``ttl`` seconds and a millisecond after an event; an earlier one goes."""
        due = int(at.timestamp() * 1000) + self.ttl * 1000 + 1
        old = [t[0] if isinstance(t, (list, tuple)) else t for t in self.handle.listTimers()]
        if any(t > due for t in old):
            return
        for t in old:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(due)

    def forget(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        yield from ()

    def close(self) -> None:
        pass


class DedupWithin(Expiring):
    """Passes an event on unless one of its key was passed on less than ``seconds`` before; skipped ones do not extend the time."""

    def __init__(self, seconds: int = DEDUP_SECONDS):
        self.seconds = self.ttl = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        kept = []
        for e in events.itertuples(index=False):
            if last is None or (e.ts - last).total_seconds() >= self.seconds:
                kept.append((key[0], e.ts, e.event_id))
                last = e.ts
        if last is not None:
            self.last.update((last.to_pydatetime(),))
            self.keep_until(last)
        yield pd.DataFrame(kept, columns=["key", "ts", "event_id"])

    def forget(self) -> None:
        self.last.clear()


class SessionState(Expiring):
    """A session's memory of what was shown: ids once a session, a running size under a cap, forgotten after inactivity or a reset (a compaction).

    Emits (session, ts, event_id, shown, total): whether the event's id is new
    within the session and still fits.
    """

    def __init__(self, ttl: int = TTL_SECONDS, cap: int = 3000, most: int = CAPS["ids"]):
        self.ttl, self.cap, self.most = ttl, cap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "ids array<string>, total long, ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        ids, total, at = ([], 0, None) if not self.state.exists() else (lambda s: (list(s[0]), int(s[1]), pd.Timestamp(s[2])))(self.state.get())
        out = []
        for e in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples(index=False):
            if e.reset or (at is not None and (e.ts - at).total_seconds() > self.ttl):
                ids, total = [], 0
            shown = not e.reset and e.item not in ids and total + e.size <= self.cap
            if shown:
                ids, total = [*ids, e.item][-self.most :], total + int(e.size)
            at = e.ts
            out.append((key[0], e.ts, e.event_id, shown, total))
        if at is not None:
            self.state.update((ids, total, at.to_pydatetime()))
            self.keep_until(at)
        yield pd.DataFrame(out, columns=["session", "ts", "event_id", "shown", "total"])

    def forget(self) -> None:
        self.state.clear()


class SinceReset(Expiring):
    """How many events a key had since its last reset (sessions since a consolidation), the reset itself being none of them."""

    def __init__(self, ttl: int = 30 * 86400):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, out = int(self.state.get()[0]) if self.state.exists() else 0, []
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for e in events.itertuples(index=False):
            n = 0 if e.reset else n + 1
            out.append((key[0], e.event_id, n))
        self.state.update((n,))
        self.keep_until(events["ts"].max())
        yield pd.DataFrame(out, columns=["key", "event_id", "since"])

    def forget(self) -> None:
        self.state.clear()


class Ring(Expiring):
    """The last ``size`` latencies of a key, with their 50th and 95th percentile after each batch; zeros are no samples."""

    def __init__(self, size: int = 100, ttl: int = 30 * 86400):
        self.size, self.ttl = size, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getValueState("samples", "xs array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        xs = list(self.samples.get()[0]) if self.samples.exists() else []
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        xs = (xs + [float(v) for v in new["value"] if v > 0])[-self.size :]
        self.samples.update((xs,))
        self.keep_until(new["ts"].max())
        s = pd.Series(xs, dtype="float64")
        yield pd.DataFrame([(key[0], len(xs), s.quantile(0.5), s.quantile(0.95))], columns=["key", "n", "p50", "p95"])

    def forget(self) -> None:
        self.samples.clear()


class Breaker(Expiring):
    """Failures in a row of a key; open from ``limit`` on, closed by a success."""

    def __init__(self, limit: int = 3, ttl: int = 30 * 86400):
        self.limit, self.ttl = limit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, out = int(self.failures.get()[0]) if self.failures.exists() else 0, []
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for e in events.itertuples(index=False):
            n = 0 if e.ok else n + 1
            out.append((key[0], e.event_id, n, n >= self.limit))
        self.failures.update((n,))
        self.keep_until(events["ts"].max())
        yield pd.DataFrame(out, columns=["key", "event_id", "failures", "open"])

    def forget(self) -> None:
        self.failures.clear()


def _run(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, late: str) -> DataFrame:
    """A processor over a stream by key, in event time; events over ``late`` behind the latest are dropped."""
    return events.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(processor, schema, mode, "EventTime")


def dedup_within(events: DataFrame, key: str, seconds: int = DEDUP_SECONDS, late: str = "10 minutes") -> DataFrame:
    """``DedupWithin`` over a stream with (key, ts, event_id)."""
    return _run(events.select(F.col(key).alias("key"), "ts", "event_id"), "key", DedupWithin(seconds), "key string, ts timestamp, event_id long", "Append", late)


def session_state(events: DataFrame, ttl: int = TTL_SECONDS, cap: int = 3000, late: str = "10 minutes") -> DataFrame:
    """``SessionState`` over a stream with (session, ts, event_id, item, size, reset)."""
    return _run(events, "session", SessionState(ttl, cap), "session string, ts timestamp, event_id long, shown boolean, total long", "Append", late)


def since_reset(events: DataFrame, ttl: int = 30 * 86400, late: str = "10 minutes") -> DataFrame:
    """``SinceReset`` over a stream with (key, ts, event_id, reset)."""
    return _run(events, "key", SinceReset(ttl), "key string, event_id long, since long", "Append", late)


def latency_ring(events: DataFrame, size: int = 100, late: str = "10 minutes") -> DataFrame:
    """``Ring`` over a stream with (key, ts, event_id, value)."""
    return _run(events, "key", Ring(size), "key string, n long, p50 double, p95 double", "Update", late)


def breaker(events: DataFrame, limit: int = 3, late: str = "10 minutes") -> DataFrame:
    """``Breaker`` over a stream with (key, ts, event_id, ok)."""
    return _run(events, "key", Breaker(limit), "key string, event_id long, failures long, open boolean", "Append", late)


def counted_since(events: DataFrame, key: str, reset: Column) -> DataFrame:
    """Batch form of ``SinceReset``: (event_id, since)."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    e = events.withColumn("_r", F.coalesce(reset, F.lit(False))).withColumn("_run", F.sum(F.col("_r").cast("int")).over(w))
    return e.select("event_id", F.sum((~F.col("_r")).cast("long")).over(Window.partitionBy(key, "_run").orderBy("ts", "event_id")).alias("since"))


def capped(events: DataFrame, session: str, item: str, size: str, cap: int = 3000, ttl: int = TTL_SECONDS, reset: Column | None = None) -> DataFrame:
    """Batch form of ``SessionState``: (event_id, shown, total) by the same processor, a task taking whole sessions.

    A session's sum depends on what was shown before, so it is a fold in the
    order of its events; sessions go through a task in sorted batches, and
    only the current one's ids and total are held.
    """
    r = F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)
    e = events.select(F.col(session).cast("string").alias("session"), "ts", "event_id", F.col(item).cast("string").alias("item"), F.col(size).cast("long").alias("size"), r.alias("reset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, total, at = object(), [], 0, None  # no session yet
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                if x.session != now or x.reset or (x.ts - at).total_seconds() > ttl:
                    now, ids, total = x.session, [], 0
                shown = not x.reset and x.item not in ids and total + x.size <= cap
                if shown:
                    ids, total = [*ids, x.item][-CAPS["ids"] :], total + int(x.size)
                at = x.ts
                out.append((x.event_id, shown, total))
            yield pd.DataFrame(out, columns=["event_id", "shown", "total"])

    return e.repartition("session").sortWithinPartitions("session", "ts", "event_id").mapInPandas(run, "event_id long, shown boolean, total long")


def daily_spend(events: DataFrame, limit: float, late: str | None = None) -> DataFrame:
    """Spend a day and whether it is at the limit; with a watermark on streams."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", "1 day").alias("w")).agg(F.round(F.sum("cost"), 6).alias("spent"), F.count("*").alias("calls")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "spent", "calls", (F.col("spent") >= limit).alias("closed"))


def unchanged(events: DataFrame, key: str, value: str) -> DataFrame:
    """Batch form of skip-if-unchanged: marks rows whose value equals the one before of their key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return events.withColumn("skip", F.coalesce(before == F.col(value), F.lit(False)))


def once(events: DataFrame, session: str, item: str) -> DataFrame:
    """Batch form of once-a-session: the first row of each item in a session."""
    w = Window.partitionBy(session, item).orderBy("ts", "event_id")
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def sessionized(events: DataFrame, key: str, seconds: int = TTL_SECONDS) -> DataFrame:
    """Batch form of the inactivity timeout: numbers each key's sessions from 1."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > seconds * 1_000_000
    return events.withColumn("session_no", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w) + 1)


def capture(events: DataFrame, tools: list[str], least: int = 80) -> DataFrame:
    """Tool results worth keeping (event_id, tool_name, content): of the tools named, long enough, their beginning."""
    body = F.trim("result")
    return events.filter(F.col("tool_name").isin(tools) & (F.length(body) >= least)).select("event_id", "tool_name", F.substring(body, 1, 2000).alias("content"))


def capture_stream(events: DataFrame, log: CommitLog, checkpoint: str, embed: Callable[[DataFrame], DataFrame], known: Callable[[], DataFrame], tools: list[str], least: int = 80, near: float = 0.75, neighbours: int = 3, name: str = "capture") -> StreamingQuery:
    """Capture tool results (event_id, tool_name, result, ts) into the table ``captures``, each once, until the source is read.

    A batch's captures are routed and clipped as ``capture`` does, embedded,
    and left out if one of the ``neighbours`` nearest of ``known`` (memory_id,
    embedding; read anew for each batch) is at ``near`` or closer.  The commit
    that holds them names the batch, so one that runs again after a failure
    finds itself done; of equal contents in a batch one is kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        fact = f"{name}:{number}"
        if fact in log.facts():
            return
        rows = capture(batch, tools, least).dropDuplicates(["content"])
        probes = embed(rows.withColumn("id", F.col("event_id")))
        close = knn(known(), probes.select(F.col("event_id").alias("query_id"), F.col("embedding").alias("vec")), neighbours).filter(F.col("sim") >= near)
        fresh = probes.join(close.select(F.col("query_id").alias("event_id")).distinct(), "event_id", "left_anti")
        with log.commit() as c:
            c.add("captures", fresh.select("event_id", "tool_name", "content", "embedding"))
            c.facts[fact] = 1

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
