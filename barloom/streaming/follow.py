"""Signals followed over a stream of bars: per security the last known close, the gate, and the open position.

Bars wait in state until the watermark has passed them, are then taken in order of time whatever order they came in, and
leave one row each: what frames.move_gate() and replay.orders() give of the same bars in batch. Bars later than the
watermark allows are dropped; of bars with the same time the last to come counts. State is a few numbers per security and
the bars that wait.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from barloom.operators.replay import COMMISSION

#: A row per bar: its number, whether it trades, and the order that it fills, if any.
FOLLOWED = "htsc_code string, time timestamp, close double, bar int, tradable boolean, side string, executed_size bigint, position_after bigint"
#: The state store that the operator needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Follower(StatefulProcessor):
    """The state of one security."""

    def __init__(self, budget: float, limit: float):
        self.budget, self.limit = budget, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", "close double, buy boolean, sell boolean")
        self.state = handle.getValueState("state", "close double, held bigint, bar int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            at = (some["time"] - pd.Timestamp(0, tz=some["time"].dt.tz)) // pd.Timedelta(milliseconds=1)
            for ms, close, buy, sell in zip(at, some["close"], some["buy"], some["sell"]):
                self.waiting.updateValue((int(ms),), (None if pd.isna(close) else float(close), bool(buy), bool(sell)))
                self.handle.registerTimer(int(ms))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], *v) for k, v in self.waiting.iterator() if k[0] <= until)
        last, held, bar = self.state.get() if self.state.exists() else (None, 0, 0)
        out = []
        for ms, close, buy, sell in due:
            bar += 1
            good = close is not None and math.isfinite(close) and close > 0
            tradable = not (last is not None and last > 0 and close is not None) or abs(close / last - 1) <= self.limit
            side, size = None, None
            if good and tradable and sell and held:
                side, size, held = "SELL", held, 0
            elif good and tradable and buy and not sell and not held and int(self.budget / (close * (1 + COMMISSION))) > 0:
                size = held = int(self.budget / (close * (1 + COMMISSION)))
                side = "BUY"
            out.append((key[0], pd.Timestamp(ms, unit="ms"), close, bar, tradable, side, size, held))
            last = close
            self.waiting.removeKey((ms,))
        if due:
            self.state.update((last, held, bar))
            found = pd.DataFrame(out, columns=[c.split()[0] for c in FOLLOWED.split(", ")])
            yield found.astype({"executed_size": "Int64"})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def follow(bars: DataFrame, budget: float, late: str = "3 days", limit: float = 0.098) -> DataFrame:
    """A stream of FOLLOWED rows of a stream of bars (htsc_code, time as timestamp, close, buy, sell).

    The session needs PROVIDER; a bar comes out once a bar later than it by more than `late` has been seen.
    """
    rows = bars.select("htsc_code", "time", "close", "buy", "sell").withWatermark("time", late)
    return rows.groupBy("htsc_code").transformWithStateInPandas(statefulProcessor=Follower(budget, limit), outputStructType=FOLLOWED, outputMode="Append", timeMode="EventTime")
