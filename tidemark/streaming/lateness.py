"""Windows with allowed lateness and a choice of trigger, as a stateful operator.

A window fires when the watermark passes its end. For ``lateness`` longer it is kept, and each batch of late
rows fires it again with the updated result; rows later than that are dropped (``LateRouter`` can part them).
Spark itself drops rows older than its watermark, so the stream's watermark runs ``lateness`` and a window's
size behind the one that fires windows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import event_time_watermark, seconds
from .stateful import _in_order, _out

TRIGGERS = ("end", "every", "every_purging")


class LateWindows(StatefulProcessor):
    """Count, sum, minimum and maximum of a value by window of a key.

    ``trigger``: "end" fires at the window's end and again for each batch of late rows; "every" fires on every
    row with the result so far; "every_purging" fires on every row with that row's result only, and keeps nothing.
    """

    def __init__(self, ts: str, value: str, size_ms: int, slide_ms: int, lateness_ms: int, trigger: str) -> None:
        if trigger not in TRIGGERS:
            raise ValueError(f"trigger must be one of {TRIGGERS}")
        self.ts, self.value, self.size, self.slide, self.lateness, self.trigger = ts, value, size_ms, slide_ms, lateness_ms, trigger
        self.behind = size_ms + lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long", "n long, total double, low double, high double, fired boolean")

    def _row(self, key, start: int, w: tuple, firing: str) -> dict:
        return {"id": key[0], "window_start": pd.Timestamp(start, unit="ms"), "window_end": pd.Timestamp(start + self.size, unit="ms"), "n": w[0], "total": w[1], "low": w[2], "high": w[3], "firing": firing}

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        return _out({name: [r[name] for r in rows] for name in rows[0]}) if rows else pd.DataFrame()

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        passed = watermark + self.behind if watermark > 0 else 0
        out, again = self._passed(key, passed), set()  # what has ended before these rows came
        for at, x in _in_order(rows, self.ts)[[self.ts, self.value]].itertuples(index=False):
            ms, x = int(at.timestamp() * 1000), float(x)
            start = ms - ms % self.slide
            while start > ms - self.size:
                end = start + self.size
                if end + self.lateness > passed and self.trigger == "every_purging":
                    out.append(self._row(key, start, (1, x, x, x), "row"))
                elif end + self.lateness > passed:
                    old = tuple(self.windows.getValue((start,))) if self.windows.containsKey((start,)) else None
                    w = (1, x, x, x, end <= passed) if old is None else (old[0] + 1, old[1] + x, min(old[2], x), max(old[3], x), old[4])
                    self.windows.updateValue((start,), w)
                    if old is None:
                        for timer in {max(start - self.lateness, 1), max(start, 1)} if end > passed else {max(start, 1)}:
                            self.handle.registerTimer(timer)
                    if self.trigger == "every":
                        out.append(self._row(key, start, w, "row"))
                    elif w[4]:
                        again.add(start)
                start -= self.slide
        out += [self._row(key, s, tuple(self.windows.getValue((s,))), "late") for s in sorted(again)]
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._frame(self._passed(key, expiredTimerInfo.getExpiryTimeInMs() + self.behind))

    def _passed(self, key, passed: int) -> list[dict]:
        """Fires the windows that have ended and drops those whose lateness is over."""
        out = []
        for start in sorted(k[0] for k in list(self.windows.keys())):
            w, end = tuple(self.windows.getValue((start,))), start + self.size
            if not w[4] and end <= passed:
                if self.trigger == "end":
                    out.append(self._row(key, start, w, "end"))
                self.windows.updateValue((start,), (*w[:4], True))
            if end + self.lateness <= passed:
                self.windows.removeKey((start,))
        return out

    def close(self) -> None:
        pass


def late_windows(
    stream: DataFrame, key: str, ts: str, value: str, size: str, slide: str | None = None, delay: str = "0 seconds", lateness: str = "0 seconds", trigger: str = "end"
) -> DataFrame:
    """id, window_start, window_end, n, total, low, high, firing ("end", "late" or "row") of a stream without a watermark yet."""
    ms = lambda d: int(seconds(d) * 1000)
    marked = event_time_watermark(stream, ts, f"{ms(delay) + ms(lateness) + ms(size)} milliseconds")
    schema = f"id {dict(stream.dtypes)[key]}, window_start timestamp, window_end timestamp, n long, total double, low double, high double, firing string"
    operator = LateWindows(ts, value, ms(size), ms(slide or size), ms(lateness), trigger)
    return marked.groupBy(key).transformWithStateInPandas(operator, schema, "Append", "EventTime")
