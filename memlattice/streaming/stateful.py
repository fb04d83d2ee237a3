"""Keyed state and timers by event time: a job queue with retries and dead letters, debounced bursts, co-retrieval.

Operators here depend on event time alone.  Messages wait in their key's state until the watermark has reached them, so
neither the order in which they come within the allowed lateness nor the cut into micro-batches changes a result, and
a restart from the checkpoint goes on with the same state.  Times are milliseconds.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .metrics import LATE

#: Slots that the keys are dealt to by hash; a checkpoint keeps its number.
SLOTS = 1024
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state and timers need; the setting is put back."""
    was = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was)


class InOrder(StatefulProcessor):
    """Feeds each key's messages (at, id, kind) to `message` in order, and deadlines that come between them to `deadline`.

    The state of a key is a tuple by STATE whose first field is the next deadline, -1 if there is none; both methods change
    self.now and yield rows.  A deadline at a message's own time comes first.

    Keys share a call, its frames and one timer by slots; each keeps a state of its own, written only when it has messages
    or is due.  The slot's timer is the earliest time any of its keys is due; an earlier one only looks again.
    """

    STATE, START, COLUMNS = "", (), ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", "key string", f"{self.STATE}, due long, waiting string")
        self.timer = handle.getValueState("timer", "at long")

    def message(self, at: int, kind: str) -> Iterator[tuple]:
        raise NotImplementedError

    def deadline(self, at: int) -> Iterator[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        come: dict[str, list[tuple]] = {}
        for part in rows:
            for k, *message in zip(*(part[c].tolist() for c in ("key", "at", "id", "kind"))):
                come.setdefault(k, []).append(tuple(message))
        out: list[tuple] = []
        due = [self._advance(k, self.keys.getValue((k,)), messages, watermark, out) for k, messages in come.items()]
        timer = self.timer.get() or (-1,)
        self._wake(min((t for t in due if t >= 0), default=-1), timer[0])
        yield from self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        out: list[tuple] = []
        following = -1
        for (k,), held in list(self.keys.iterator()):
            due = self._advance(k, held, [], watermark, out) if 0 <= held[-2] <= watermark else held[-2]
            following = due if following < 0 or 0 <= due < following else following
        self.timer.update((-1,))
        self._wake(following, -1)
        yield from self._frame(out)

    def _wake(self, following: int, timer: int) -> None:
        """Sets the slot's timer to `following` if that is earlier; one that the watermark has reached fires by itself."""
        if following >= 0 and not 0 <= timer <= following:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(following)
            self.timer.update((following,))

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["key", *self.COLUMNS])

    def _advance(self, key: str, held: tuple | None, come: list[tuple], watermark: int, out: list[tuple]) -> int:
        """Takes a key to the watermark and gives the time it is due next, -1 for never; its rows go to out."""
        *now, _, waiting = held or (*self.START, -1, "[]")
        self.now = tuple(now)
        messages = sorted([*map(tuple, json.loads(waiting)), *come])
        ready = bisect.bisect_right(messages, watermark, key=lambda m: m[0])
        for at, _, kind in messages[:ready]:
            while 0 <= self.now[0] <= at:
                out += [(key, *row) for row in self.deadline(self.now[0])]
            out += [(key, *row) for row in self.message(at, kind)]
        while 0 <= self.now[0] <= watermark:
            out += [(key, *row) for row in self.deadline(self.now[0])]
        left = messages[ready:]
        due = min((t for t in (self.now[0], left[0][0] if left else -1) if t >= 0), default=-1)
        self.keys.updateValue((key,), (*self.now, due, json.dumps(left)))
        return due

    def close(self) -> None:
        pass


def _by_key(messages: DataFrame, processor: InOrder, out: str, late: str) -> DataFrame:
    """Rows (key, and those of out) of the processor; keys of any type travel as JSON."""
    key = F.to_json(F.struct("key"), _JSON).alias("key")
    at = messages.select(key, F.col("at").cast("timestamp").alias("time"), F.col("id").cast("long").alias("id"), "kind").withWatermark("time", late)
    at = at.withColumn("at", F.unix_millis("time")).withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(SLOTS)))
    rows = at.groupBy("slot").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"key string, {out}", outputMode="Append", timeMode="eventTime")
    return rows.withColumn("key", F.from_json("key", StructType([messages.schema["key"]]), _JSON)["key"])


class _Queue(InOrder):
    STATE, START, COLUMNS = "deadline long, job long, attempt int", (-1, 0, 0), ("job", "attempt", "state", "reason", "at")

    def __init__(self, attempts: int, visible: int):
        self.attempts, self.visible = attempts, visible

    def message(self, at: int, kind: str) -> Iterator[tuple]:
        deadline, job, attempt = self.now
        if kind == "enqueue" and deadline < 0:
            self.now = (at + self.visible, job + 1, 1)
            yield job + 1, 1, "delivered", "enqueued", at
        elif kind == "ack" and deadline >= 0:
            self.now = (-1, job, attempt)
            yield job, attempt, "done", "acknowledged", at
        elif kind == "fail" and deadline >= 0:
            yield from self._again("error", at)

    def deadline(self, at: int) -> Iterator[tuple]:
        yield from self._again("timeout", at)

    def _again(self, reason: str, at: int) -> Iterator[tuple]:
        _, job, attempt = self.now
        if attempt < self.attempts:
            self.now = (at + self.visible, job, attempt + 1)
            yield job, attempt + 1, "delivered", reason, at
        else:
            self.now = (-1, job, attempt)
            yield job, attempt, "dead", reason, at


def job_queue(messages: DataFrame, attempts: int = 3, visible_ms: int = 60_000, late: str = LATE) -> DataFrame:
    """What becomes of the jobs of a stream of messages (key, at, id, kind): (key, job, attempt, state, reason, at).

    "enqueue" delivers a key's next job, unless one is open; "ack" ends the open job as done; "fail", or visible_ms
    without either, delivers it again, until it has been tried `attempts` times: then it is dead, with the last reason.
    Dead rows are the dead letters.  An acknowledgement without an open job, a second one, and one at or after the
    deadline of the last attempt change nothing; other kinds neither.  Each transition is given once, whatever restarts.

    A null key is a key; messages with null time or kind are ignored; equal times go by id; messages later than `late`
    are dropped by the watermark, as they may be; no messages give no rows.
    """
    tidy = messages.filter("at is not null and kind is not null and id is not null")
    return _by_key(tidy, _Queue(attempts, visible_ms), "job long, attempt int, state string, reason string, at long", late)


class _Debounce(InOrder):
    STATE, START, COLUMNS = "deadline long, first long, last long, n long", (-1, -1, -1, 0), ("action", "first", "last", "n", "at")

    def __init__(self, wait: int, idle: int):
        self.wait, self.idle = wait, idle

    def message(self, at: int, kind: str) -> Iterator[tuple]:
        _, first, _, n = self.now
        self.now = (at + self.wait, first if n else at, at, n + 1)
        return iter(())

    def deadline(self, at: int) -> Iterator[tuple]:
        _, first, last, n = self.now
        if n:
            self.now = (last + self.idle, -1, last, 0)
            yield "flush", first, last, n, at
        else:
            self.now = (-1, -1, last, 0)
            yield "full cycle", last, last, 0, at


def debounced(messages: DataFrame, wait_ms: int = 50, idle_ms: int = 60_000, late: str = LATE) -> DataFrame:
    """Work that bursts of messages (key, at, id, kind) start: (key, action, first, last, n, at).

    A burst is a key's messages that follow each other within wait_ms; wait_ms after the last one it is flushed, once.
    A key that then stays idle for idle_ms after its last message gets one full cycle, and the next only after another
    burst.  idle_ms is larger than wait_ms.

    A null key is a key; messages with null time or id are ignored; repeated messages count; no messages give no rows.
    """
    if idle_ms <= wait_ms:
        raise ValueError("a key is idle only after its burst")
    tidy = messages.filter("at is not null and id is not null").withColumn("kind", F.coalesce("kind", F.lit("")))
    return _by_key(tidy, _Debounce(wait_ms, idle_ms), "action string, first long, last long, n long, at long", late)


def co_retrieved(searches: DataFrame, gets: DataFrame, within: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Pairs of a search and a get of the same user up to `within` later: (user_id, search_id, get_id, searched_at, got_at).

    Both streams have (user_id, at, id).  Watermarks on either side and the interval bound what the join keeps: a search
    leaves its state when no get can follow it in time any more.  Null users and times match nothing; repeated rows
    match each by itself.
    """
    side = lambda df, p: df.select(F.col("user_id").alias(f"{p}_user"), F.col("id").alias(f"{p}_id"), F.col("at").cast("timestamp").alias(f"{p}_at")).withWatermark(f"{p}_at", late)
    s, g = side(searches, "s"), side(gets, "g")
    joined = s.join(g, F.expr(f"s_user = g_user AND g_at >= s_at AND g_at <= s_at + interval {within}"))
    return joined.select(F.col("s_user").alias("user_id"), F.col("s_id").alias("search_id"), F.col("g_id").alias("get_id"), F.col("s_at").alias("searched_at"), F.col("g_at").alias("got_at"))
