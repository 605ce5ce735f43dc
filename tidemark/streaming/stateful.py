"""Stateful operators on streams: state and timers of a key, in RocksDB.

Set spark.sql.streaming.stateStore.providerClass to the RocksDB provider (``use_rocksdb``). Input needs
a watermark for event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


def _out(columns: dict) -> pd.DataFrame:
    """Columns as plain objects: pandas' own string type does not convert."""
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})


class _Processor(StatefulProcessor):
    state_schema = ""
    #: State of a key that is not updated for so long is dropped (by processing time); None keeps it.
    retain_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema, self.retain_ms)

    def get(self, default: tuple) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else default

    def close(self) -> None:
        pass


class RiseAlert(_Processor):
    """A rise sets a timer if none is set; a fall deletes it; when it fires, the key is reported."""

    state_schema = "last double, timer long"

    def __init__(self, lasting_ms: int, ts: str = "ts", value: str = "value", event_time: bool = True) -> None:
        self.lasting, self.ts, self.value, self.event_time = lasting_ms, ts, value, event_time

    def handleInputRows(self, key, rows, timerValues):
        last, timer = self.get((None, 0))
        for at, x in _in_order(rows, self.ts)[[self.ts, self.value]].itertuples(index=False):
            if last is not None and x > last and not timer:
                now = int(at.timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                timer = now + self.lasting
                self.handle.registerTimer(timer)
            elif last is not None and x < last and timer:
                self.handle.deleteTimer(timer)
                timer = 0
            last = float(x)
        self.state.update((last, timer))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, timer = self.get((None, 0))
        self.state.update((last, 0))
        yield _out({"id": [key[0]], "alert_at": [expiredTimerInfo.getExpiryTimeInMs()]})


def rise_alerts(stream: DataFrame, key: str, ts: str, value: str, lasting_ms: int, event_time: bool = True) -> DataFrame:
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(RiseAlert(lasting_ms, ts, value, event_time), f"id {kind}, alert_at long", "Append", "EventTime" if event_time else "ProcessingTime")


class OrderMatch(_Processor):
    """Creation and payment of an order in any order of arrival, with a deadline on event time."""

    state_schema = "created long, payed long, timer long"

    def __init__(self, deadline_ms: int, ts: str, kind: str) -> None:
        self.deadline, self.ts, self.kind = deadline_ms, ts, kind

    def handleInputRows(self, key, rows, timerValues):
        created, payed, timer = self.get((None, None, 0))
        out = []
        for at, kind in _in_order(rows, self.ts)[[self.ts, self.kind]].itertuples(index=False):
            ms = int(at.timestamp() * 1000)
            if kind == "create":
                created = ms if created is None else created
            else:
                payed = ms if payed is None else payed
            if created is not None and payed is not None:
                out.append("payed successfully" if payed < created + self.deadline else "payed but already timeout")
                if timer:
                    self.handle.deleteTimer(timer)
                created, payed, timer = None, None, 0
            elif not timer:
                timer = ms + (self.deadline if kind == "create" else 0)
                self.handle.registerTimer(timer)
        self.state.update((created, payed, timer))
        yield _out({"id": [key[0]] * len(out), "outcome": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        created, payed, timer = self.get((None, None, 0))
        self.state.clear()
        yield _out({"id": [key[0]], "outcome": ["order timeout" if payed is None else "already payed but not found created log"]})


def order_matches(stream: DataFrame, key: str, ts: str, kind: str, deadline_ms: int = 900_000) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(OrderMatch(deadline_ms, ts, kind), f"id {dict(stream.dtypes)[key]}, outcome string", "Append", "EventTime")


class TwoStreamMatch(_Processor):
    """One pending row and one deadline for each side: a match takes both, a deadline reports the row alone."""

    state_schema = "side string, timer long"

    def __init__(self, ts: str, side: str, waits_ms: dict[str, int]) -> None:
        self.ts, self.side, self.waits = ts, side, waits_ms

    def handleInputRows(self, key, rows, timerValues):
        waiting, timer = self.get((None, 0))
        out = []
        for at, side in _in_order(rows, self.ts)[[self.ts, self.side]].itertuples(index=False):
            ms = int(at.timestamp() * 1000)
            if waiting is not None and waiting != side and ms <= timer:
                out.append("matched")
                self.handle.deleteTimer(timer)
                waiting, timer = None, 0
            elif waiting is None:
                waiting, timer = side, ms + self.waits[side]
                self.handle.registerTimer(timer)
            elif ms > timer:
                out.append(f"{waiting}_only")
                self.handle.deleteTimer(timer)
                waiting, timer = side, ms + self.waits[side]
                self.handle.registerTimer(timer)
        self.state.update((waiting, timer))
        yield _out({"id": [key[0]] * len(out), "outcome": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        waiting, _ = self.get((None, 0))
        self.state.clear()
        yield _out({"id": [key[0]], "outcome": [f"{waiting}_only"]} if waiting else {})


def two_stream_matches(tagged: DataFrame, key: str, ts: str, side: str, waits_ms: dict[str, int]) -> DataFrame:
    """``tagged``: both streams in one, with a column that names the side."""
    return tagged.groupBy(key).transformWithStateInPandas(TwoStreamMatch(ts, side, waits_ms), f"id {dict(tagged.dtypes)[key]}, outcome string", "Append", "EventTime")


class PairwiseAverage(_Processor):
    """Every two values of a key give their integer average; one left over waits."""

    state_schema = "waiting long"

    def __init__(self, order: str, value: str, retain_ms: int | None = None) -> None:
        self.order, self.value, self.retain_ms = order, value, retain_ms

    def handleInputRows(self, key, rows, timerValues):
        (waiting,) = self.get((None,))
        out = []
        for x in _in_order(rows, self.order)[self.value]:
            if waiting is None:
                waiting = int(x)
            else:
                out.append((waiting + int(x)) // 2)
                waiting = None
        self.state.update((waiting,))
        yield _out({"id": [key[0]] * len(out), "average": out})


def pairwise_averages(stream: DataFrame, key: str, order: str, value: str, retain_ms: int | None = None) -> DataFrame:
    """``retain_ms``: how long an idle key's state is kept, such as one day."""
    operator = PairwiseAverage(order, value, retain_ms)
    return stream.groupBy(key).transformWithStateInPandas(operator, f"id {dict(stream.dtypes)[key]}, average long", "Append", "ProcessingTime" if retain_ms else "None")


class LoginFailures(_Processor):
    """Failures since the last success; a timer after each, which warns at ``least`` or more and clears."""

    state_schema = "times array<long>"

    def __init__(self, ts: str, failed: str, wait_ms: int, least: int) -> None:
        self.ts, self.failed, self.wait, self.least = ts, failed, wait_ms, least

    def handleInputRows(self, key, rows, timerValues):
        (times,) = self.get(([],))
        times = list(times)
        for at, failed in _in_order(rows, self.ts)[[self.ts, self.failed]].itertuples(index=False):
            if failed:
                times.append(int(at.timestamp() * 1000))
                self.handle.registerTimer(times[-1] + self.wait)
            else:
                times = []
        if times:
            self.state.update((times,))
        else:
            self.state.clear()  # a key without failures holds nothing
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (times,) = self.get(([],))
        self.state.clear()
        yield _out({"id": [key[0]], "first_ms": [times[0]], "last_ms": [times[-1]], "times": [len(times)]} if len(times) >= self.least else {})


def login_failures(stream: DataFrame, key: str, ts: str, failed: str, wait_ms: int = 5000, least: int = 2) -> DataFrame:
    schema = f"id {dict(stream.dtypes)[key]}, first_ms long, last_ms long, times long"
    return stream.groupBy(key).transformWithStateInPandas(LoginFailures(ts, failed, wait_ms, least), schema, "Append", "EventTime")


class Blacklist(_Processor):
    """Counts of a key by event day: the first ``most`` rows pass, the next warns, others are dropped."""

    state_schema = "day long, count long"

    def __init__(self, ts: str, most: int, retain_ms: int | None = None) -> None:
        self.ts, self.most, self.retain_ms = ts, most, retain_ms

    def handleInputRows(self, key, rows, timerValues):
        day, count = self.get((-1, 0))
        found = []
        for at in _in_order(rows, self.ts)[self.ts]:
            today = int(at.timestamp() // 86_400)
            day, count = (day, count + 1) if today == day else (today, 1)
            if count <= self.most + 1:
                found.append((at, "pass" if count <= self.most else "warn"))
        self.state.update((day, count))
        yield _out({"key1": [key[0]] * len(found), "key2": [key[1]] * len(found), "ts": [f[0] for f in found], "verdict": [f[1] for f in found]})


def blacklisted(stream: DataFrame, keys: tuple[str, str], ts: str, most: int = 100, retain_ms: int | None = None) -> DataFrame:
    """``retain_ms``: how long an idle key's count is kept; a day is enough where rows come in time."""
    kinds = dict(stream.dtypes)
    schema = f"key1 {kinds[keys[0]]}, key2 {kinds[keys[1]]}, ts timestamp, verdict string"
    return stream.groupBy(*keys).transformWithStateInPandas(Blacklist(ts, most, retain_ms), schema, "Append", "ProcessingTime" if retain_ms else "None")
