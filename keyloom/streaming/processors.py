"""Stateful stream operators; state lives in the RocksDB store, by key."""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyloom.sources.shipping import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship(spark)


class Expiry(StatefulProcessor):
    """Keeps the deadline of a key; once event time passes it, a timer emits ``expired``.

    A later write replaces the deadline, and one without (-1) removes it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for batch in rows:
            top = batch.sort_values("seq").iloc[-1]
            if last is None or top["seq"] > last["seq"]:
                last = top
        if last is not None:
            if self.deadline.exists():
                self.handle.deleteTimer(int(self.deadline.get()[0]))
                self.deadline.clear()
            if last["expire_at"] >= 0:
                self.deadline.update((int(last["expire_at"]),))
                self.handle.registerTimer(int(last["expire_at"]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.deadline.clear()
        yield pd.DataFrame({"key": [key[0]], "event": ["expired"], "at": [at]})

    def close(self) -> None:
        pass


def expirations(writes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Stream of (key, event, at) from a stream of (key, seq, ts timestamp, expire_at ms or -1)."""
    prepare(writes.sparkSession)
    return (
        writes.withWatermark("ts", delay)
        .groupBy("key")
        .transformWithStateInPandas(Expiry(), "key string, event string, at bigint", "Append", "EventTime")
    )


class Waiters(StatefulProcessor):
    """Match of waiters and elements of a key, first come, first served: BLPOP and its kind.

    A ``push`` row puts ``value`` at ``place`` (the order in a list, or a score), a ``wait`` row (conn, deadline
    ms or -1) takes up to ``count`` from the front, or with ``last`` from the back; a waiter whose deadline is
    before the push has gone away and gets a null.  Only rows of a batch are sorted; what waits is kept in order.
    """

    def __init__(self, last: bool = False, count: int = 1):
        self.last, self.count = last, count

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "conn bigint, seq bigint, deadline bigint")
        self.ready = handle.getListState("ready", "place double, seq bigint, value string")

    def _serve(self, key, conn, ready, out) -> None:
        taken = ready[-self.count :][::-1] if self.last else ready[: self.count]
        if self.last:
            del ready[len(ready) - len(taken) :]
        else:
            del ready[: len(taken)]
        out.extend((key[0], int(conn), value) for _, _, value in taken)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, ready, out = deque(self.waiting.get()), list(self.ready.get()), []
        began = len(waiting), len(ready)
        arrived = sorted(r for batch in rows for r in zip(*(batch[c] for c in ("seq", "kind", "conn", "deadline", "place", "value", "at")), strict=True))
        for seq, kind, conn, deadline, place, value, at in arrived:
            if kind == "wait":
                if ready:
                    self._serve(key, conn, ready, out)
                else:
                    waiting.append((conn, seq, deadline))
                continue
            insort(ready, (float(place), int(seq), value))
            while waiting and ready:
                conn, _, deadline = waiting.popleft()
                if deadline >= 0 and at > deadline:
                    out.append((key[0], int(conn), None))
                else:
                    self._serve(key, conn, ready, out)
        for state, rest, n in ((self.waiting, waiting, began[0]), (self.ready, ready, began[1])):
            if rest:
                state.put([tuple(x) for x in rest])
            elif n:
                state.clear()
        yield pd.DataFrame(out, columns=["key", "conn", "value"])

    def close(self) -> None:
        pass


def blocking_pops(events: DataFrame, last: bool = False, count: int = 1) -> DataFrame:
    """Stream of (key, conn, value or null) from rows (key, kind, seq, conn, deadline, value, at): BLPOP, BRPOP, BLMPOP.

    With a column ``place`` (scores) it is BZPOPMIN, or BZPOPMAX with ``last``, and BZMPOP with a ``count``.
    """
    prepare(events.sparkSession)
    if "place" not in events.columns:
        events = events.withColumn("place", F.col("seq").cast("double"))
    return events.groupBy("key").transformWithStateInPandas(Waiters(last, count), "key string, conn bigint, value string", "Append", "None")


def blocking_moves(events: DataFrame, target: str, last: bool = False) -> DataFrame:
    """Stream of pushes (key, conn, value) onto ``target``: BLMOVE, and with ``last`` BRPOPLPUSH."""
    return blocking_pops(events, last).where("value is not null").select(F.lit(target).alias("key"), "conn", "value")


class Replica(StatefulProcessor):
    """Applies the operations of a shard in the order of their offsets and stops at a gap.

    Offsets at or below the last one are repeats.  A missing offset gives a row ``resync`` once; nothing more is
    applied until a ``snapshot`` row names the offset to go on from.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("applied", "off bigint, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        off, stopped = self.state.get() if self.state.exists() else (None, False)
        out = []
        arrived = sorted((int(o), kind != "snapshot", value) for batch in rows for o, kind, value in zip(batch["off"], batch["kind"], batch["value"], strict=True))
        for at, is_op, value in arrived:
            if not is_op:
                if off is None or at >= off:
                    off, stopped = at, False
            elif stopped or (off is not None and at <= off):
                continue
            elif off is not None and at > off + 1:
                stopped = True
                out.append((key[0], off + 1, "resync", None))
            else:
                off = at
                out.append((key[0], at, "apply", value))
        if off is not None:
            self.state.update((off, stopped))
        yield pd.DataFrame(out, columns=["shard", "off", "action", "value"])

    def close(self) -> None:
        pass


def replica_apply(log: DataFrame) -> DataFrame:
    """Stream of (shard, off, action, value) from rows (shard, off, kind, value), kind ``op`` or ``snapshot``."""
    prepare(log.sparkSession)
    return log.groupBy("shard").transformWithStateInPandas(Replica(), "shard int, off bigint, action string, value string", "Append", "None")


def notifications(ops: DataFrame, flags: str = "KEA") -> DataFrame:
    """Keyspace notifications of a stream of operations; stateless."""
    from keyloom.plans.stats import keyspace_events

    return keyspace_events(ops, flags)


def deliver(messages: DataFrame, subs: DataFrame, patterns: tuple[tuple[int, str], ...] = ()) -> DataFrame:
    """Pub/sub of a message stream to a static table of subscriptions and a list of patterns."""
    from keyloom.plans.stats import publish

    return publish(messages, subs, patterns).select("seq", "channel", "conn")


def replicated(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Replication stream without repeated offsets; the watermark bounds what is remembered."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["shard", "off"])


def rates(ops: DataFrame, every: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Commands in event-time windows, late rows within the watermark counted."""
    return ops.withWatermark("ts", delay).groupBy(F.window("ts", every), "cmd").agg(F.count(F.lit(1)).alias("n"))
