"""Alarms as keyed state with timers: a trigger opens one for a while, further triggers prolong it, and a timer closes it.

Keys are dealt to groups by a hash, and a group has one state. Rows wait in it until the watermark has passed them and are then taken in order of time, so that the
result doesn't depend on the order in which they come, nor on how they are cut into batches. Rows later than the watermark
are dropped by the engine, so that nothing can change a closed alarm; alarms that are open when the stream ends aren't given.

Defined results: rows with a null key are one key, those with a null time or id are left out, a null trigger is none; ties
in time go by id; a row at an alarm's very end still falls into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from pulseframe.shipping import ship

RESULT = "user_id long, opened long, closed long, triggers long, events long, quiet long"
#: Groups that keys are dealt to; state that is kept belongs to the number it was made with.
GROUPS = 1024
#: Columns of a row that waits and of a key that had an alarm, all longs; NONE stands for what a key doesn't have, and a null key is 0 with a mark.
ROW, KEY = ["unnamed", "user", "t", "id", "trigger"], ["unnamed", "user", "ended", "opened", "until", "triggers", "events", "quiet"]
NONE = -(1 << 63)


class Alarms(StatefulProcessor):
    """State of a group of keys: rows that wait, and of each key the open alarm and when the last one ended. Times are microseconds from 1970, timers milliseconds.

    A call for state costs as much as some hundred rows, so that a group's rows and keys are packed arrays, read and written at once.
    """

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        packed = StructType([StructField("packed", BinaryType())])
        self.handle = handle
        self.waiting = handle.getListState("waiting", packed)
        self.keys = handle.getValueState("keys", packed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            got = batch[ROW].to_numpy("int64")
            if len(got):
                self.waiting.appendValue((np.ascontiguousarray(got).tobytes(),))
                least = int(got[:, 2].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._at(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [np.frombuffer(p, "int64") for (p,) in self.waiting.get()] if self.waiting.exists() else []
        rows = np.concatenate([np.empty(0, "int64"), *parts]).reshape(-1, len(ROW))
        packed = self.keys.get() if self.keys.exists() else (b"",)
        keys = {(r[0], r[1]): r[2:] for r in np.frombuffer(packed[0], "int64").reshape(-1, len(KEY)).tolist()}
        is_ready = rows[:, 2] <= seen
        ready, rest = rows[is_ready], rows[~is_ready]
        if len(ready):
            if len(rest):
                self.waiting.put([(rest.tobytes(),)])
            else:
                self.waiting.clear()
        done = []

        for unnamed, user, t, _, trigger in ready[np.lexsort(ready.T[[4, 3, 2]])].tolist():
            k = keys.get((unnamed, user))
            if k and k[1] != NONE and t > k[2]:
                done.append(self._closed(unnamed, user, k))
            if trigger and k and k[1] != NONE:
                k[2], k[3] = t + self.length, k[3] + 1
            elif trigger:
                ended = k[0] if k else NONE
                keys[unnamed, user] = [ended, t, t + self.length, 1, 0, NONE if ended == NONE else t - ended]
            elif k and k[1] != NONE:
                k[4] += 1
        for (unnamed, user), k in keys.items():
            if k[1] != NONE and k[2] <= seen:
                done.append(self._closed(unnamed, user, k))

        if len(ready) or done:
            self.keys.update((np.array([[*of, *k] for of, k in keys.items()], "int64").tobytes(),))
        due = [k[2] for k in keys.values() if k[1] != NONE]
        if len(rest):
            due.append(int(rest[:, 2].min()))
        if due:
            self._at(min(due))
        if done:
            yield pd.DataFrame(done, columns=["user_id", "opened", "closed", "triggers", "events", "quiet"], dtype=object).astype("Int64")

    @staticmethod
    def _closed(unnamed: int, user: int, k: list[int]) -> tuple:
        """The open alarm of a key as a row of the result; from now on the key has none."""
        row = (None if unnamed else user, *k[1:5], None if k[5] == NONE else k[5])
        k[0], k[1] = k[2], NONE
        return row

    def _at(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


def alarms(events: DataFrame, hours: float, delay: str = "6 hours", groups: int = GROUPS) -> DataFrame:
    """events (user_id, ts, event_id, trigger) as closed alarms: (user_id, opened, closed, triggers, events in between, quiet: time since the last one ended).

    The session needs a state store with timers: see replay(.., timers=True).
    """
    ship(events.sparkSession)
    rows = events.where("ts is not null and event_id is not null").withWatermark("ts", delay)
    named = F.col("user_id")
    rows = rows.select(F.pmod(F.xxhash64(named.cast("long")), F.lit(groups)).cast("int").alias("part"), "ts", F.isnull(named).cast("long").alias("unnamed"), F.coalesce(named, F.lit(0)).cast("long").alias("user"), F.unix_micros("ts").alias("t"), F.col("event_id").cast("long").alias("id"), F.coalesce(F.col("trigger").cast("long"), F.lit(0)).alias("trigger"))
    return rows.groupBy("part").transformWithStateInPandas(Alarms(int(hours * 3_600_000_000)), RESULT, "append", "EventTime")
