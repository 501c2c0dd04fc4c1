"""Where each song of a run stands, from a stream of what happens to it, with a time limit.

An event says that a song is queued, running, done or failed. They may come late, out of order and
more than once: each is kept until the watermark has passed it, and then taken in order of its time
(by rank of its state on ties). A song of which nothing is heard for longer than the limit, and which is neither done
nor failed, has timed out at the end of that time; an event after that opens it again. States of
songs that are over are dropped, as are events that come after the watermark.

statuses() is the stream; statuses_of() is the same over a table, for runs that are over.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: States in the order in which a song goes through them; a song in the last two is over.
STATES = ("queued", "running", "done", "failed")
OVER = STATES[2:]
TIMED_OUT = "timed out"
#: Seconds without news after which a song has timed out.
LIMIT_S = 900
OUTPUT = "song long, at timestamp, status string"


class Follow(StatefulProcessor):
    """Events of a song that the watermark has not passed, by time; when the last one was and
    what it said. Times are milliseconds, as timers are."""

    def __init__(self, limit_s: int):
        self.limit = limit_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getMapState("ahead", "at long, rank int", "seen boolean")
        self.last = handle.getValueState("last", "at long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for x in rows:
            for at, status in zip(x["at_ms"], x["status"], strict=True):
                self.ahead.updateValue((int(at), STATES.index(status)), (True,))
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((at, rank) for (at, rank), _ in self.ahead.iterator() if at <= now)
        at, status = self.last.get() if self.last.exists() else (None, None)
        out = []
        for event in [*due, (now, None)]:
            # the limit may have passed before the event
            if status is not None and status not in OVER and event[0] > at + self.limit - (event[1] is None):
                at, status = at + self.limit, None
                out.append((key[0], at, TIMED_OUT))
            if event[1] is not None:
                self.ahead.removeKey(event)
                at, status = event[0], STATES[event[1]]
                out.append((key[0], at, status))
        if status is None or status in OVER:
            self.last.clear()
        else:
            self.last.update((at, status))
            self.handle.registerTimer(at + self.limit)
        rows = pd.DataFrame(out, columns=["song", "at", "status"])
        rows["at"] = pd.to_datetime(rows["at"], unit="ms")
        yield rows

    def close(self) -> None:
        pass


def statuses(events: DataFrame, late: str = "1 hour", limit_s: int = LIMIT_S) -> DataFrame:
    """(song, at, status) of a stream of events (song, at, status): what became of each song
    and when. Needs the state store that keeps several states
    (spark.sql.streaming.stateStore.providerClass)."""
    known = events.where(F.col("status").isin(*STATES) & F.col("song").isNotNull() & F.col("at").isNotNull())
    rows = known.select("song", "at", "status", F.unix_millis("at").alias("at_ms")).withWatermark("at", late)
    return rows.groupBy("song").transformWithStateInPandas(Follow(limit_s), OUTPUT, "Append", "EventTime")


def statuses_of(events: DataFrame, until: dt.datetime, limit_s: int = LIMIT_S) -> DataFrame:
    """The same of a table, as far as it is settled at a time."""
    known = events.where(F.col("status").isin(*STATES) & F.col("song").isNotNull() & (F.col("at") <= F.lit(until)))
    rows = known.select("song", F.timestamp_millis(F.unix_millis("at")).alias("at"), "status").distinct()
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    end = F.col("at") + F.make_dt_interval(secs=F.lit(limit_s))
    rows = rows.withColumns({"end": end, "next": F.lead("at").over(Window.partitionBy("song").orderBy("at", rank))})
    silent = ~F.col("status").isin(*OVER) & F.when(F.col("next").isNull(), F.col("end") <= F.lit(until)).otherwise(F.col("next") > F.col("end"))
    return rows.select("song", "at", "status").unionByName(rows.where(silent).select("song", F.col("end").alias("at"), F.lit(TIMED_OUT).alias("status")))
