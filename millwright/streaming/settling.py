"""Adjustment events and their settling as a stateful stream.

Control changes and output means of a lot arrive in any order.  A lot's state keeps them until the watermark
has passed their time and then takes them one by one in order, as the batch form would; events leave as
soon as nothing later can change them, at their deadline at the latest.  A lot without rows for as long as
``idle`` says has ended, and the rest of its state goes.
"""

from __future__ import annotations

import bisect
import math
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "lot_id string, event_id string, worked_at timestamp, n_items long, settled_at timestamp, contaminated boolean, drop_reason string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the only store that has timers
CHANGE, MEAN = 0, 1


class Lot:
    """What is known of a lot up to a time; ``take`` moves on by one row, ``done`` gives what is settled.

    Kept: the open session, events without a verdict, and the last ``window`` - 1 means.  Times are
    microseconds.
    """

    timer: int | None = None  # milliseconds; what is read from an older state has none

    def __init__(self):
        self.n, self.last, self.seen, self.items, self.events, self.trail, self.waiting = 0, None, None, set(), [], [], []

    def take(self, at: int, kind: int, item: str | None, wet: float | None, merge: int, std_max: float, window: int) -> None:
        self.seen = at
        if kind == CHANGE:
            if self.last is None or at - self.last > merge:
                self.close()
                self.n += 1
                for e in self.events:
                    e["next"] = e["next"] or at
                self.events.append({"id": self.n, "at": at, "n_items": None, "next": None, "settled": None})
            self.last = at
            self.items.add(item)
            return
        self.trail = [*self.trail, (at, wet)][-window:]
        values = [v for _, v in self.trail]
        if len(values) == window and None not in values and _deviation(values) <= std_max:
            for e in self.events:
                if e["settled"] is None and self.trail[0][0] > e["at"]:
                    e["settled"] = at

    def close(self) -> None:
        for e in self.events:
            if e["n_items"] is None:
                e["n_items"] = len(self.items)
        self.items = set()

    def done(self, now: int, merge: int, wait: int) -> list[dict]:
        """Events that end: session closed, and settled or past the deadline."""
        if self.last is not None and now - self.last > merge:
            self.close()
        over = lambda e: e["n_items"] is not None and (e["settled"] is not None or now - e["at"] > wait)
        out = [e for e in self.events if over(e)]
        self.events = [e for e in self.events if not over(e)]
        return out

    def wake(self, merge: int, wait: int, idle: int) -> int:
        """Next time at which something can end or be taken."""
        times = [w[0] for w in self.waiting[:1]]
        for e in self.events:
            times.append((self.last + merge if e["n_items"] is None else e["at"] + wait) + 1)
        return min(times, default=(self.seen or 0) + idle + 1)


def _deviation(values: list[float]) -> float:
    """As the batch form's stddev_pop: updated value by value."""
    n, mean, square = 0.0, 0.0, 0.0
    for v in values:
        n += 1
        delta = v - mean
        by = delta / n
        mean += by
        square += delta * (delta - by)
    return math.sqrt(square / n)


class Settling(StatefulProcessor):
    """One state value for each lot; one timer at the next time that matters."""

    def __init__(self, merge: int, std_max: float, window: int, wait: int, idle: int):
        self.merge, self.std_max, self.window, self.wait, self.idle = merge, std_max, window, wait, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lot", "body binary")

    def _load(self) -> Lot:
        held = self.state.get()
        return pickle.loads(held[0]) if held else Lot()

    def _advance(self, lot: Lot, now: int) -> list[dict]:
        out = []
        due = bisect.bisect_right(lot.waiting, now, key=lambda r: r[0])
        rows, lot.waiting = lot.waiting[:due], lot.waiting[due:]
        for row in rows:
            out += lot.done(row[0] - 1, self.merge, self.wait)  # what ended before this row
            lot.take(*row, self.merge, self.std_max, self.window)
        return out + lot.done(now, self.merge, self.wait)

    def _close(self, key: tuple, lot: Lot, now: int, expired: int | None = None) -> Iterator[pd.DataFrame]:
        out = self._advance(lot, now)
        # every call of the handle is a round trip to the JVM, so a lot remembers its timer; one that ran has gone by itself
        held, lot.timer = lot.timer, None
        if not lot.waiting and not lot.events and lot.seen is not None and now > lot.seen + self.idle:
            self.state.clear()
        else:
            lot.timer = -(-lot.wake(self.merge, self.wait, self.idle) // 1000)
            self.state.update((pickle.dumps(lot),))
            if lot.timer != held:
                self.handle.registerTimer(lot.timer)
        if held is not None and held not in (expired, lot.timer):
            self.handle.deleteTimer(held)
        if out:
            late = lambda e: e["settled"] is None or e["settled"] - e["at"] > self.wait
            stamp = lambda t: pd.Timestamp(t, unit="us")
            rows = []
            for e in out:
                settled = None if late(e) else e["settled"]
                reason = "no_settle" if settled is None else "overlapped" if e["next"] is not None and e["next"] < settled else None
                rows.append((key[0], f"{key[0]}#{e['id']}", stamp(e["at"]), e["n_items"], pd.NaT if settled is None else stamp(settled), reason is not None, reason))
            yield pd.DataFrame(rows, columns=["lot_id", "event_id", "worked_at", "n_items", "settled_at", "contaminated", "drop_reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lot = self._load()
        for part in rows:
            wet = [None if pd.isna(v) else float(v) for v in part["wet_mean"]]
            lot.waiting += zip((int(t) for t in part["micros"]), (int(k) for k in part["kind"]), part["item_id"], wet)
        lot.waiting.sort(key=lambda r: (r[0], r[1], r[2] or ""))
        yield from self._close(key, lot, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lot = self._load()
        yield from self._close(key, lot, timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def signals(changes: DataFrame, means: DataFrame) -> DataFrame:
    """The stream's input: control changes (lot_id, worked_at, item_id) and means (lot_id, worked_at, wet_mean) in one table."""
    none = lambda kind: F.lit(None).cast(kind)
    a = changes.select("lot_id", "worked_at", F.lit(CHANGE).alias("kind"), "item_id", none("double").alias("wet_mean"))
    b = means.select("lot_id", "worked_at", F.lit(MEAN).alias("kind"), none("string").alias("item_id"), "wet_mean")
    return a.unionByName(b)


def stream_settling(rows: DataFrame, merge_minutes: float = 2, std_max: float = 0.02, window: int = 5, max_wait_minutes: float = 30, late: str = "10 minutes", idle_minutes: float = 10_080) -> DataFrame:
    """Streaming ``build_events`` and ``annotate_settling`` of ``signals`` rows: the same events with the same verdicts.

    Rows count whatever their order as long as they come before the watermark, ``late`` behind the newest row
    of all; later ones are dropped by Spark.  A change and a mean of one time: the change comes first.  A lot that
    comes back after ``idle_minutes`` without rows (by the watermark) starts anew with event 1.  The session needs
    RocksDB state (``STATE_STORE`` set to ``ROCKS``).
    """
    minute = 60_000_000
    seen = rows.withColumn("micros", F.unix_micros("worked_at")).withWatermark("worked_at", late)
    own = Settling(int(merge_minutes * minute), std_max, max(2, window), int(max_wait_minutes * minute), int(idle_minutes * minute))
    return seen.groupBy("lot_id").transformWithStateInPandas(own, OUT, "Append", "EventTime")
