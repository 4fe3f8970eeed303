"""Visits: a stateful stream that holds one open visit per user and closes it by a timer in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VISIT = "user_id long, visit_start timestamp, visit_end timestamp, events long, value double, last_type string"
_OPEN = "start_ms long, end_ms long, events long, value double, last_type string"


class Visits(StatefulProcessor):
    """Events of a user that are at most ``gap_ms`` apart make a visit; it ends when the watermark has passed that gap."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one row for each open visit of the user: events may come out of order within the allowed lateness
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        visits = [tuple(v) for v in self.open.get()] if self.open.exists() else []
        for f in rows:
            at = f["at"].astype("datetime64[ms]").astype("int64")
            visits += [(t, t, 1, float(v), str(k)) for t, v, k in zip(at, f["value"], f["event_type"], strict=True)]
        merged = self._merge(visits)
        self._keep(merged)
        return iter([])

    def _merge(self, visits: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for v in sorted(visits):
            if out and v[0] - out[-1][1] <= self.gap_ms:
                a = out[-1]
                out[-1] = (a[0], max(a[1], v[1]), a[2] + v[2], a[3] + v[3], v[4] if (v[1], v[4]) >= (a[1], a[4]) else a[4])
            else:
                out.append(v)
        return out

    def _keep(self, visits: list[tuple]) -> None:
        for t in [x for x in self.handle.listTimers()]:
            self.handle.deleteTimer(t)
        if visits:
            self.open.put(visits)
            self.handle.registerTimer(min(v[1] for v in visits) + self.gap_ms + 1)
        else:
            self.open.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        visits = [tuple(v) for v in self.open.get()]
        done = [v for v in visits if v[1] + self.gap_ms < now]
        self._keep([v for v in visits if v[1] + self.gap_ms >= now])
        at = lambda k: pd.to_datetime([v[k] for v in done], unit="ms")
        yield pd.DataFrame({"user_id": [key[0]] * len(done), "visit_start": at(0), "visit_end": at(1), "events": [v[2] for v in done], "value": [round(v[3], 4) for v in done], "last_type": [v[4] for v in done]})

    def close(self) -> None:
        pass


def visits_stream(events: DataFrame, gap_minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """Closed visits of a stream of events (user_id, ts, value, event_type); events later than ``late`` are dropped.

    Needs the RocksDB state store. State holds open visits only, a few numbers each.
    """
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("event_type", F.lit("")).alias("event_type"))
    grouped = rows.withWatermark("at", late).groupBy("user_id")
    return grouped.transformWithStateInPandas(Visits(gap_minutes * 60_000), VISIT, outputMode="Append", timeMode="EventTime")
