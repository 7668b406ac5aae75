"""Sliding-window admission per key: a stateful stream and its batch twin.

A request is refused if the last minute holds per_minute admitted ones, or else
the last hour per_hour; refused ones are not recorded, so admission feeds back and
no window aggregate can tell it.  A request exactly a window old still counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.functions import constants as K

EXEMPT = ["/", "/health", "/docs", "/openapi.json"]
OUT = "key long, event_id long, at double, allowed boolean, reason string"


def admit(times: list[float], at: float, per_minute: int, per_hour: int) -> tuple[list[float], str]:
    """(admitted times to keep, reason of a refusal or "")."""
    times = [x for x in times if x >= at - 3600]
    if sum(x >= at - 60 for x in times) >= per_minute:
        return times, "minute"
    if len(times) >= per_hour:
        return times, "hour"
    return [*times, at], ""


def requests(events: DataFrame, key: str = "user_id", ts: str = "ts", path: Column | None = None) -> DataFrame:
    """key, event_id, at (seconds); exempt paths are left out before any state."""
    rows = events if path is None else events.filter(~path.isin(EXEMPT))
    return rows.select(F.col(key).alias("key"), "event_id", (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))


def _decide(key, rows: pd.DataFrame, times: list[float], per_minute: int, per_hour: int) -> tuple[pd.DataFrame, list[float]]:
    rows = rows.sort_values(["at", "event_id"])
    reasons = []
    for at in rows["at"]:
        times, why = admit(times, at, per_minute, per_hour)
        reasons.append(why)
    return pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "at": rows["at"], "allowed": [not r for r in reasons], "reason": reasons}), times


def limit_batch(reqs: DataFrame, per_minute: int = K.PER_MINUTE, per_hour: int = K.PER_HOUR) -> DataFrame:
    """Each key's requests in order of time, streamed: memory holds an hour of admitted ones, not a key's rows.

    A key is cut wherever a clock hour has no request of it: what came before is more
    than an hour old then, so the stretches are independent and a busy key's are
    dealt to several tasks.
    """
    hour = F.floor(F.col("at") / 3600)
    hours = reqs.groupBy("key", hour.alias("hour")).agg(F.count("*").alias("n"))  # a row for each key and hour
    fresh = F.coalesce(F.col("hour") - F.lag("hour").over(W.partitionBy("key").orderBy("hour")) > 1, F.lit(True))
    stretches = hours.withColumn("fresh", fresh.cast("int")).select("key", "hour", F.sum("fresh").over(W.partitionBy("key").orderBy("hour")).alias("stretch"))
    rows = reqs.withColumn("hour", hour).join(stretches.withColumnsRenamed({"key": "k", "hour": "h"}), F.col("key").eqNullSafe(F.col("k")) & F.col("hour").eqNullSafe(F.col("h")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_hand, times = None, []
        for b in batches:
            reasons = []
            for *stretch, at in zip(b["key"], b["stretch"], b["at"], strict=True):
                if stretch != at_hand:
                    at_hand, times = stretch, []
                times, why = admit(times, at, per_minute, per_hour)
                reasons.append(why)
            yield pd.DataFrame({"key": b["key"], "event_id": b["event_id"], "at": b["at"], "allowed": [not r for r in reasons], "reason": reasons})

    return rows.select("key", "stretch", "event_id", "at").repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at", "event_id").mapInPandas(run, OUT)


def limit_stream(reqs: DataFrame, per_minute: int = K.PER_MINUTE, per_hour: int = K.PER_HOUR) -> DataFrame:
    """The same over a stream; a key's state goes an hour after its last request."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches))
        out, times = _decide(key, rows, times, per_minute, per_hour)
        state.update((times,))
        state.setTimeoutDuration(3_600_000)
        yield out

    return reqs.groupBy("key").applyInPandasWithState(run, OUT, "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def limit_event_time(reqs: DataFrame, per_minute: int = K.PER_MINUTE, per_hour: int = K.PER_HOUR, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """limit_batch over a stream whose rows come in any order within delay: reqs has also the event time ts.

    A key's rows wait until the watermark is past them and are then decided in the order
    of their time, by a timer of the key; state goes when an hour without rows is past.
    Rows that come later than delay are left out by Spark.  Rows are decided with the
    batch that moves the watermark past them.  Needs the RocksDB state store.
    """
    rows = reqs.withWatermark(ts, delay).select("key", "event_id", "at", F.col(ts).alias("ts"))
    return rows.groupBy("key").transformWithStateInPandas(_Ordered(per_minute, per_hour), OUT, "append", "EventTime")


class _Ordered(StatefulProcessor):
    """Of each key the rows that the watermark has not passed, and the admitted ones of the last hour."""

    def __init__(self, per_minute: int, per_hour: int):
        self.per_minute, self.per_hour = per_minute, per_hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, at double")
        self.times = handle.getListState("times", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        self.waiting.appendList([(int(i), float(at)) for i, at in zip(new["event_id"], new["at"], strict=True)])
        self._wake(float(new["at"].min()))
        return iter(())

    def _wake(self, at: float) -> None:
        """A timer for when the watermark is past at."""
        self.handle.registerTimer(int(at * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() / 1000
        waiting = sorted((at, i) for i, at in self.waiting.get())
        ripe, rest = [x for x in waiting if x[0] < past], [x for x in waiting if x[0] >= past]
        times = [x[0] for x in self.times.get()]
        reasons = []
        for at, _ in ripe:
            times, why = admit(times, at, self.per_minute, self.per_hour)
            reasons.append(why)
        times = [x for x in times if x >= past - 3600 or rest and x >= rest[0][0] - 3600]
        for state, values in ((self.waiting, [(i, at) for at, i in rest]), (self.times, [(x,) for x in times])):
            state.put(values) if values else state.clear()
        if rest:
            self._wake(rest[0][0])
        elif times:
            self._wake(times[-1] + 3600)  # then nothing of it counts any more
        yield pd.DataFrame({"key": [key[0]] * len(ripe), "event_id": [i for _, i in ripe], "at": [at for at, _ in ripe], "allowed": [not r for r in reasons], "reason": pd.Series(reasons, dtype=object)})

    def close(self) -> None:
        pass


def request_latency(starts: DataFrame, ends: DataFrame, timeout: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """trace_id, started, ended, latency_ms, timed_out of each start; starts, ends: trace_id, ts, both streams or both tables.

    The first end of the trace within timeout counts; a start without one is reported as
    timed out once the watermarks say that none can come.
    """
    a = starts.select("trace_id", F.col("ts").alias("started")).withWatermark("started", delay)
    b = ends.select(F.col("trace_id").alias("of"), F.col("ts").alias("ended")).withWatermark("ended", delay)
    if ends.isStreaming:
        b = b.dropDuplicatesWithinWatermark(["of"])
    else:
        b = b.groupBy("of").agg(F.min("ended").alias("ended"))
    met = a.join(b, F.expr(f"trace_id = of and ended >= started and ended <= started + interval {timeout}"), "left")
    ms = (F.unix_micros("ended") - F.unix_micros("started")) / 1000
    return met.select("trace_id", "started", "ended", ms.alias("latency_ms"), F.col("ended").isNull().alias("timed_out"))


def sliding_count(reqs: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of the key within the last seconds, itself and ties included."""
    w = W.partitionBy("key").orderBy(F.round(F.col("at") * 1e6).cast("long")).rangeBetween(-seconds * 1_000_000, 0)
    return reqs.withColumn("n", F.count("*").over(w))


def traced(requests_: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream's first row of each trace id; ts is the event time."""
    return requests_.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["trace_id"])


def ingest_stream(docs: DataFrame, out: str, checkpoint: str):
    """Cleans and cuts a stream of documents and appends its chunks; a replayed batch overwrites itself."""
    from quillon.operators import chunking

    def write(batch: DataFrame, epoch: int) -> None:
        chunking.ingest(batch)[1].write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
