"""What is due or pending, kept as a stream's state: one small state per key and scope that outlives batches and restarts.

The log says when a refresh of a scope was packed and when it was captured. A scope's period is the day, or the ISO week for
`weekly`. It is pending while the period's pack waits for its capture, and due where neither has happened; a timer at the end
of the period says so without an event. `state_of` is the batch form: both end in the same state in any order of events.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siltstone.operators.events import week_key

#: The provider that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WEEKLY = "weekly"
STATE = "captured_at timestamp, packed_at timestamp, next_period timestamp"
CHANGES = "owner string, scope string, at timestamp, exists boolean, captured_key string, pending_key string, key string, pending boolean, due boolean, cause string"


def period_key(scope: str, at: datetime) -> str:
    year, week, _ = at.isocalendar()
    return f"{year}-W{week:02d}" if scope == WEEKLY else at.strftime("%Y-%m-%d")


def next_period(scope: str, at: datetime) -> datetime:
    """Midnight after the period that holds `at`; weeks begin on Monday."""
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    return day + timedelta(days=7 - day.weekday() if scope == WEEKLY else 1)


class DueState(StatefulProcessor):
    """State of one (owner, scope): the latest capture and pack, and the end of the period that its timer waits for.

    A pack is pending until a capture at or after it. Events may come late or in any order: only newer ones change the state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("due", STATE)

    def held(self) -> list:
        return list(self.state.get()) if self.state.exists() else [None, None, None]

    def status(self, key: tuple, held: list, at: datetime, cause: str) -> pd.DataFrame:
        owner, scope = key
        captured, packed, _ = held
        waits = packed is not None and (captured is None or packed > captured)
        now, done = period_key(scope, at), captured and period_key(scope, captured)
        pending_key = period_key(scope, packed) if waits else None
        pending = pending_key == now
        row = (owner, scope, at, captured is not None, done, pending_key, now, pending, not pending and done != now, cause)
        return pd.DataFrame([row], columns=["owner", "scope", "at", "exists", "captured_key", "pending_key", "key", "pending", "due", "cause"])

    def wait(self, held: list, scope: str, at: datetime) -> None:
        """One timer a scope, at the end of the newest period seen."""
        ends = next_period(scope, at)
        if held[2] is None or ends > held[2]:
            if held[2] is not None:
                self.handle.deleteTimer(millis(held[2]))
            self.handle.registerTimer(millis(ends))
            held[2] = ends

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, latest, cause = self.held(), None, None
        for frame in rows:
            for at, action in zip(frame["at"].dt.to_pydatetime() if len(frame) else [], frame["action"]):
                at = plain(at)
                place = {"captured": 0, "packed": 1}.get(action)
                if place is not None and (held[place] is None or at > held[place]):
                    held[place] = at
                if latest is None or at > latest:
                    latest, cause = at, action
        if latest is None:
            return
        self.wait(held, key[1], latest)
        self.state.update(tuple(held))
        yield self.status(key, held, latest, cause)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        at = plain(datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc))
        # the next timer lies beyond the watermark, so that a long silence makes one row and not one a period
        now = plain(datetime.fromtimestamp(max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) / 1000, timezone.utc))
        held[2] = next_period(key[1], now)
        self.handle.registerTimer(millis(held[2]))
        self.state.update(tuple(held))
        yield self.status(key, held, max(at, now), "period over")

    def close(self) -> None:
        pass


def plain(at: datetime) -> datetime:
    """Times in UTC without a zone, as pandas and the state hand them over."""
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def millis(at: datetime) -> int:
    return int(at.replace(tzinfo=timezone.utc).timestamp() * 1000)


def due_stream(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Changes of the state of each (owner, scope) from a stream of (owner, scope, at, action), to be written in update mode.

    Each batch gives one row for a key that it touches, as of the key's newest event in it, and one for a key whose period is
    over by the watermark. The session's times must be in UTC; its state store provider is set to the one with timers.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = log.select("owner", "scope", F.col("at").cast("timestamp").alias("at"), "action").withWatermark("at", late)
    return timed.groupBy("owner", "scope").transformWithStateInPandas(statefulProcessor=DueState(), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def state_of(log: DataFrame) -> DataFrame:
    """(owner, scope, exists, captured_key, pending_key) from the whole log: what `events.due` reads."""
    at = lambda action: F.max(F.when(F.col("action") == action, F.col("at").cast("timestamp")))
    last = log.groupBy("owner", "scope").agg(at("captured").alias("captured_at"), at("packed").alias("packed_at"))
    key = lambda c: F.when(F.col("scope") == WEEKLY, week_key(F.col(c))).otherwise(F.date_format(c, "yyyy-MM-dd"))
    waits = F.col("packed_at").isNotNull() & (F.col("captured_at").isNull() | (F.col("packed_at") > F.col("captured_at")))
    return last.select("owner", "scope", F.col("captured_at").isNotNull().alias("exists"), key("captured_at").alias("captured_key"), F.when(waits, key("packed_at")).alias("pending_key"))


def current(changes: DataFrame) -> DataFrame:
    """The newest state of each (owner, scope) from the rows that the stream has written."""
    columns = [c for c in changes.columns if c not in ("owner", "scope")]
    return changes.groupBy("owner", "scope").agg(F.max_by(F.struct(*columns), F.struct("at", F.col("cause") == "period over")).alias("r")).select("owner", "scope", "r.*")


def read_log(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """The log as a stream of JSON lines files."""
    return spark.readStream.schema("owner string, scope string, at timestamp, action string").option("maxFilesPerTrigger", files_a_batch).json(path)
