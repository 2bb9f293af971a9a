"""The service's rules over time as streams: stale checks, retention, the daily limit of requests, reviews.

Each is a stateful processor with its state in maps and lists, and timers in event time, so a rule fires when the stream's
time has passed it, not when a machine's clock has. Sessions need Spark's RocksDB state store
(spark.sql.streaming.stateStore.providerClass). Rows of a batch are taken in order of time; a row older than what a key
already knows changes nothing, and with `late` rows that come later than that are dropped by the watermark. Functions of
the same names in `windows` give the same final rows from tables. Rows without a key or time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .windows import STALE_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _in_order(rows: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """The rows of a batch by the columns given, nulls as None."""
    held = pd.concat(list(rows)).sort_values([*columns], kind="stable", na_position="first")
    return list(held.astype(object).where(held.notna(), None).itertuples(index=False, name=None))


class _Stale(StatefulProcessor):
    """State: the last status and its time. A timer waits for a pending check."""

    def __init__(self, seconds: int):
        self.patience = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "status string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, at = self.last.get() if self.last.exists() else (None, None)
        for _, ts, wanted in _in_order(rows, "ts", "status"):
            if at is None or _ms(ts) >= at:
                status, at = wanted, _ms(ts)
        self.last.update((status, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "pending":
            self.handle.registerTimer(at + self.patience + 1)
        yield pd.DataFrame({"check_id": [key[0]], "status": [status]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, at = self.last.get()
        if status == "pending":
            self.last.update(("error", at))
            yield pd.DataFrame({"check_id": [key[0]], "status": ["error"]})

    def close(self) -> None:
        pass


class _Retention(StatefulProcessor):
    """State: when a check was made, at the earliest. A timer ends it."""

    def __init__(self, days: int):
        self.keep = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.made = handle, handle.getValueState("made", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = min(_ms(ts) for _, ts in _in_order(rows, "created_at"))
        if self.made.exists():
            first = min(first, self.made.get()[0])
        self.made.update((first,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(first + self.keep)
        yield pd.DataFrame({"check_id": [], "deleted_at": []}).astype({"check_id": "object", "deleted_at": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.made.get()[0] + self.keep
        self.made.clear()
        yield pd.DataFrame({"check_id": [key[0]], "deleted_at": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


class _Limit(StatefulProcessor):
    """State: times of the requests taken within a day, `most` at most."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getListState("taken", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = sorted(t[0] for t in self.taken.get()) if self.taken.exists() else []
        out = []
        for _, ts, request in _in_order(rows, "ts", "request"):
            now = _ms(ts)
            recent = [t for t in recent if t > now - DAY_MS]
            good = len(recent) < self.most
            if good:
                recent.append(now)
            out.append((key[0], request, good))
        self.taken.put([(t,) for t in recent])
        yield pd.DataFrame(out, columns=["email", "request", "taken"])

    def close(self) -> None:
        pass


class _Reviews(StatefulProcessor):
    """State: of each finding the last review and its time; an empty one stays as a mark, so an older one can't come back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.of = handle.getMapState("of", "finding long", "at long, verdict string, comment string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed = {}
        for _, ts, finding, verdict, comment in _in_order(rows, "ts", "verdict", "comment"):
            known = changed.get(finding) or (self.of.getValue((finding,)) if self.of.containsKey((finding,)) else None)
            if known is None or _ms(ts) >= known[0]:
                changed[finding] = (_ms(ts), verdict, comment or "")
        out = []
        for finding, (at, verdict, comment) in changed.items():
            self.of.updateValue((finding,), (at, verdict, comment))
            out.append((key[0], finding, verdict, comment, verdict is None and not comment))
        yield pd.DataFrame(out, columns=["check_id", "finding", "verdict", "comment", "deleted"])

    def close(self) -> None:
        pass


def _timely(rows: DataFrame, key: str, ts: str, late: str | None, columns: list[str]) -> DataFrame:
    picked = rows.select(*columns).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return picked.withWatermark(ts, late) if late and rows.isStreaming else picked


def stale(events: DataFrame, mode: str = "sync", late: str = "1 hour") -> DataFrame:
    """check_id, status as it changes: pending checks turn to error when the stream's time has passed their limit.

    events: check_id, ts, status.
    """
    timely = _timely(events, "check_id", "ts", late, ["check_id", "ts", "status"])
    return timely.groupBy("check_id").transformWithStateInPandas(_Stale(STALE_SECONDS[mode]), "check_id string, status string", "Update", "EventTime")


def retention(checks: DataFrame, days: int = 7, late: str = "1 hour") -> DataFrame:
    """check_id, deleted_at of checks whose days are over. checks: check_id, created_at."""
    timely = _timely(checks, "check_id", "created_at", late, ["check_id", "created_at"])
    return timely.groupBy("check_id").transformWithStateInPandas(_Retention(days), "check_id string, deleted_at timestamp", "Update", "EventTime")


def rate_limit(requests: DataFrame, most: int = 5, late: str | None = None) -> DataFrame:
    """email, request, taken: whether fewer than `most` requests of the address were taken in the day before it.

    requests: email, ts, request (a number that tells requests of one time apart). Works on tables as well.
    """
    timely = _timely(requests, "email", "ts", late, ["email", "ts", "request"])
    return timely.groupBy("email").transformWithStateInPandas(_Limit(most), "email string, request long, taken boolean", "Update", "None")


def reviews(said: DataFrame, late: str | None = None) -> DataFrame:
    """check_id, finding, verdict, comment, deleted as they change: the last review wins, an empty one takes it away.

    said: check_id, ts, finding, verdict, comment.
    """
    timely = _timely(said, "check_id", "ts", late, ["check_id", "ts", "finding", "verdict", "comment"])
    return timely.groupBy("check_id").transformWithStateInPandas(_Reviews(), "check_id string, finding long, verdict string, comment string, deleted boolean", "Update", "None")
