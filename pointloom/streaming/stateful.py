"""State of the streaming operators, by key: what waits for the watermark, the best so far, the posterior of an arm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.learn import Stop, beta_variance

#: The state store that these need, for ``spark.sql.streaming.stateStore.providerClass``.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(spark: SparkSession, interval: str) -> int:
    """Microseconds of an interval such as "10 minutes"."""
    return int(spark.sql(f"select unix_micros(timestamp '2000-01-01 00:00:00' + interval {interval}) - unix_micros(timestamp '2000-01-01 00:00:00')").head()[0])


def after(us: int) -> int:
    """The first whole millisecond not before a time in microseconds."""
    return -(-us // 1000)


class Gate(StatefulProcessor):
    """A source's events that the watermark hasn't passed, and after those that it has: the flag and the last event's time.

    Rows (us, frame_id, home); gives out (frame_id, us, source) of frames that come while the flag is home.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, kind int, frame_id long, home boolean")
        self.flag = handle.getValueState("flag", "home boolean, us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            for us, frame, home in zip(part["us"], part["frame_id"], part["home"], strict=True):
                state = pd.isna(frame)
                new.append((int(us), 0 if state else 1, 0 if state else int(frame), bool(home) if state and not pd.isna(home) else False))
        self.waiting.appendList(new)
        self.handle.registerTimer(after(min(r[0] for r in new)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted(r for r in waiting if r[0] <= mark)
        left = [r for r in waiting if r[0] > mark]
        home, last = self.flag.get() if self.flag.exists() else (False, None)
        out = []
        for us, kind, frame, said in ready:
            if last is not None and us > last + self.idle:
                home = False
            last = us
            if kind == 0:
                home = said
            elif home:
                out.append((frame, us, key[0]))
        if ready:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        if left:
            self.handle.registerTimer(after(min(r[0] for r in left)))
        if last is not None and mark > last + self.idle and not left:
            self.flag.clear()  # silent for too long
        elif ready:
            self.flag.update((home, last))
            self.handle.registerTimer(after(last + self.idle) + 1)
        if out:
            yield pd.DataFrame(out, columns=["frame_id", "us", "source"])

    def close(self) -> None:
        pass


class Best(StatefulProcessor):
    """The n best grasps of a frame that the watermark hasn't passed.

    Rows (us, grasp_id, score). A grasp that falls out of the n best can only come back with a better score, which comes
    with its row, so more than n needn't be kept.
    """

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", "grasp_id long, score double")
        self.time = handle.getValueState("time", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = {int(g): float(s) for g, s in self.best.get()} if self.best.exists() else {}
        us = self.time.get()[0] if self.time.exists() else None
        for part in rows:
            us = max(int(part["us"].max()), -(1 << 62) if us is None else us)
            for g, s in part.groupby("grasp_id")["score"].max().items():
                best[int(g)] = max(float(s), best.get(int(g), float("-inf")))
            best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[: self.n])
        self.best.put(list(best.items()))
        self.time.update((us,))
        self.handle.registerTimer(after(us))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.time.exists() and self.time.get()[0] <= timerValues.getCurrentWatermarkInMs() * 1000:
            us = self.time.get()[0]
            best = sorted(((float(s), int(g)) for g, s in self.best.get()), key=lambda x: (-x[0], x[1]))
            self.best.clear()
            self.time.clear()
            yield pd.DataFrame([(key[0], us, g, s, i + 1) for i, (s, g) in enumerate(best)], columns=["frame_id", "us", "grasp_id", "score", "place"])

    def close(self) -> None:
        pass


class Arm(StatefulProcessor):
    """The posterior of an arm, its last reward, and whether the arm has had enough."""

    def __init__(self, stop: Stop, a0: float, b0: float):
        self.stop, self.a0, self.b0 = stop, a0, b0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("posterior", "alpha double, beta double, n long, value double, stopped boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        a, b, n, value, stopped = self.state.get() if self.state.exists() else (self.a0, self.b0, 0, 0.0, False)
        parts = pd.concat(list(rows))  # an arm's rewards of one trigger
        if stopped:
            return
        v = parts.sort_values("seq")["v"].to_numpy(float)
        k, before = n + np.arange(1, len(v) + 1), np.concatenate(([value], v[:-1]))
        alpha, beta = a + np.cumsum(v), b + np.cumsum(1 - v)
        ends = np.flatnonzero(self.stop.test(k, v, before, beta_variance(alpha, beta)))
        at = int(ends[0]) if len(ends) else len(v) - 1
        now = (float(alpha[at]), float(beta[at]), int(k[at]), float(v[at]), bool(len(ends)))
        self.state.update(now)
        yield pd.DataFrame([(key[0], now[0], now[1], now[2], now[4])], columns=["arm", "alpha", "beta", "n", "stopped"])

    def close(self) -> None:
        pass
