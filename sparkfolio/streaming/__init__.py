"""Structured Streaming forms of the log operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..shipping import ship

SLIDING = "id long, key string, ts timestamp, allowed boolean"


def windowed_stream(events: DataFrame, length: str, late: str) -> DataFrame:
    """Counts of event types in tumbling windows; rows later than the watermark are dropped, windows close after it."""
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def session_stream(events: DataFrame, gap: str, late: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "user_id", "events")


def sliding_log(pdf: pd.DataFrame, accepted: list[float], limit: int, seconds: float) -> tuple[pd.Series, list[float]]:
    """Which requests (sorted by ts) are allowed: fewer than limit accepted ones within the last seconds. Rejected ones don't count."""
    out = []
    for at in pdf["ts"].map(lambda t: t.timestamp()):
        accepted = [a for a in accepted if a >= at - seconds]
        ok = len(accepted) < limit
        if ok:
            accepted.append(at)
        out.append(ok)
    return pd.Series(out, index=pdf.index, dtype=bool), accepted


def sliding_limit(requests: DataFrame, limit: int, seconds: float) -> DataFrame:
    """The batch form of sliding_limit_stream(): id, key, ts, allowed. A key's requests stream through its task in order; what is
    held is the accepted ones of the last seconds, at most limit of them."""
    ship(requests.sparkSession)
    rows = requests.select("id", "key", F.col("ts").cast("timestamp").alias("ts"))
    ready = rows.select("*", F.unix_micros("ts").alias("_us")).repartition("key").sortWithinPartitions("key", "_us", "id")
    length = int(seconds * 1_000_000)

    def run(batches):
        key, accepted = None, deque()
        for batch in batches:
            out = []
            for k, at in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k != key:
                    key, accepted = k, deque()
                while accepted and accepted[0] < at - length:
                    accepted.popleft()
                out.append(len(accepted) < limit)
                if out[-1]:
                    accepted.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.bool_())], names=["id", "key", "ts", "allowed"])

    return ready.mapInArrow(run, SLIDING)


def sliding_limit_stream(requests: DataFrame, limit: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """id, key, ts, allowed of a stream of requests; those later than the watermark (late behind the newest) get no answer.

    A key's state is the times of accepted requests of the last seconds, at most limit of them. It goes by event time: it is
    dropped once the watermark has passed the last accepted request by the length of the log, however slowly a source
    delivers or however fast it is replayed.
    """
    ship(requests.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["ts", "id"])
        allowed, accepted = sliding_log(pdf, list(state.get[0]) if state.exists else [], limit, seconds)
        state.update((accepted,))
        state.setTimeoutTimestamp(max(int(1000 * (max(accepted) + seconds)) + 1, state.getCurrentWatermarkMs() + 1))
        yield pdf.assign(allowed=allowed)[["id", "key", "ts", "allowed"]]

    return requests.select("id", "key", "ts").withWatermark("ts", late).groupBy("key").applyInPandasWithState(run, SLIDING, "accepted array<double>", "append", GroupStateTimeout.EventTimeTimeout)


class _InOrder(StatefulProcessor):
    """A key's state: requests that wait for the watermark, times of accepted ones of the last seconds, one timer."""

    def __init__(self, decide: Callable, length: int):
        self.decide, self.length = decide, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, us long")
        self.accepted = handle.getListState("accepted", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        least = None
        for frame in rows:
            self.waiting.appendList(list(frame[["id", "us"]].itertuples(index=False, name=None)))
            least = min(int(frame["us"].min()), least) if least is not None else int(frame["us"].min())
        if least is not None:
            self._wake(min([-(-least // 1000), *self.handle.listTimers()]))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # what is not later than this can't get company any more
        waiting = {(int(us), int(i)) for i, us in self.waiting.get()}
        ready = sorted(w for w in waiting if w[0] <= now)
        allowed, accepted = self.decide([us for us, _ in ready], [int(a[0]) for a in self.accepted.get()])
        rest = [(i, us) for us, i in waiting if us > now]
        accepted = [a for a in accepted if a >= now - self.length]
        self.waiting.clear()
        self.accepted.clear()
        if rest:
            self.waiting.put(rest)
        if accepted:
            self.accepted.put([(a,) for a in accepted])
        if rest or accepted:  # the next request, or the time when the last accepted one counts no more
            self._wake(-(-min(us for _, us in rest) // 1000) if rest else (accepted[-1] + self.length) // 1000 + 1)
        yield pd.DataFrame({"id": [i for _, i in ready], "key": key[0], "us": [us for us, _ in ready], "allowed": allowed})

    def _wake(self, at: int) -> None:
        for other in list(self.handle.listTimers()):
            if other != at:
                self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def sliding_limit_in_order(requests: DataFrame, limit: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """id, key, ts, allowed as sliding_limit() gives them, however requests arrive: in any order within the watermark, or repeatedly
    (same id and ts: one answer). Those later than the watermark (late behind the newest) get none.

    A request is answered once the watermark has passed it, so nothing that comes before it can still arrive; sliding_limit_stream()
    answers at once, in the order of arrival. A key holds the requests that wait and at most limit accepted times, and nothing once the
    log has run out. Needs the RocksDB state store (sparkfolio.session names it).
    """
    ship(requests.sparkSession)
    length = int(seconds * 1_000_000)

    def decide(times: list[int], accepted: list[int]) -> tuple[list[bool], list[int]]:
        log, out = deque(accepted), []
        for at in times:
            while log and log[0] < at - length:
                log.popleft()
            out.append(len(log) < limit)
            if out[-1]:
                log.append(at)
        return out, list(log)

    ready = requests.select("id", "key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    grouped = ready.select("id", "key", "ts", F.unix_micros("ts").alias("us")).groupBy("key")
    out = grouped.transformWithStateInPandas(_InOrder(decide, length), "id long, key string, us long, allowed boolean", "append", "EventTime")
    return out.select("id", "key", F.timestamp_micros("us").alias("ts"), "allowed")


def append_batches(stream: DataFrame, path: str, checkpoint: str, key: str, late: str | None = None, time: str = "ts"):
    """Writes a stream so that a repeated batch changes nothing: each batch has its own folder, which is overwritten.

    A key is written once a batch; with late, the longest time between repetitions (by the column time), once in all batches.
    """
    if late is not None:
        stream = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
