"""The scoring path as a stream of states: windows, alarms, CUSUM and growing models, each with state of its key.

Windows count rows, which event-time windows can't express.  Steps may come out of
order over any number of micro-batches: a key's steps wait in a map until all
earlier ones have come, or until a timer gives those up.  State lies in the state
store, so a lost executor's keys go on elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detectors import KernCD
from ..operators.pairs import Kernel

#: The store that keyed state with maps, lists and timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A carried state and, for a step that yields one, the rest of its row.
Fold = Callable[[list[float], int, float], tuple[list[float], tuple | None]]


class InOrder(StatefulProcessor):
    """Folds the steps 0, 1, 2, ... of each key in order, whatever order they come in.

    State of a key: the next step and the carried values, and the steps that wait.
    With ``patience`` (milliseconds) steps that have waited so long give up the missing
    ones before the first of them: ``gap`` makes the carried values anew and the fold goes
    on.  Without, they wait for good, and the stream has no timers that keep it busy.
    A step that comes after it was given up, or again, is passed over.
    """

    def __init__(self, key: str, columns: list[str], start: list[float], fold: Fold, gap: Callable[[list[float]], list[float]], patience: int | None):
        self.key, self.columns, self.start, self.fold, self.gap, self.patience = key, columns, start, fold, gap, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reached = handle.getValueState("reached", "next long, carried array<double>")
        self.waiting = handle.getMapState("waiting", "t long", "x double")

    def _drained(self, key: tuple, held: dict[int, float], skip: bool) -> pd.DataFrame:
        """Folds what can be of ``held``, all that waits; with ``skip`` from its first step on."""
        row = self.reached.get() if self.reached.exists() else (0, self.start)
        at, carried = int(row[0]), list(row[1])
        if skip and held:
            at, carried = min(held), self.gap(carried)
        out = []
        while at in held:
            carried, value = self.fold(carried, at, held.pop(at))
            if self.waiting.containsKey((at,)):
                self.waiting.removeKey((at,))
            if value is not None:
                out.append((key[0], at, *value))
            at += 1
        self.reached.update((at, [float(v) for v in carried]))
        return pd.DataFrame(out, columns=[self.key, *self.columns])

    def _waiting(self) -> dict[int, float]:
        return {int(k[0]): float(v[0]) for k, v in self.waiting.iterator()}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        done = int(self.reached.get()[0]) if self.reached.exists() else 0
        held = self._waiting()
        for pdf in rows:
            held |= {int(t): float(x) for t, x in zip(pdf["t"], pdf["x"]) if t >= done and t not in held}
        known = set(self._waiting())
        out = self._drained(key, held, False)
        for t in held.keys() - known:
            self.waiting.updateValue((t,), (held[t],))
        if held and self.patience is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self._waiting()
        out = self._drained(key, held, True)
        if held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield out


def _in_order(states: DataFrame, columns: list[str], schema: str, start: list[float], fold: Fold, gap: Callable[[list[float]], list[float]], patience: int | None) -> DataFrame:
    states.sparkSession.conf.set(*PROVIDER)
    kind = dict(states.dtypes)["ep"]
    named = states.select("ep", F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x")).filter("t is not null and x is not null")
    return named.groupBy("ep").transformWithStateInPandas(InOrder("ep", columns, start, fold, gap, patience), f"ep {kind}, {schema}", "Append", "None" if patience is None else "ProcessingTime")


def windowed_scores(states: DataFrame, width: int, score: Callable[[np.ndarray], float], threshold: float, patience: int | None = None) -> DataFrame:
    """(ep, end, score, first_alarm) for a stream of (ep, t, x): every whole window of ``width`` steps.

    The step of an episode's first alarm never changes once set (-1 before).  Windows
    over steps that were given up are left out; rows without a step or value count as missing.
    """

    def fold(carried: list[float], t: int, x: float) -> tuple[list[float], tuple | None]:
        alarm, ring = int(carried[0]), [*carried[1:], x][-width:]
        if len(ring) < width:
            return [alarm, *ring], None
        value = float(score(np.array(ring)))
        alarm = t if alarm < 0 and value > threshold else alarm
        return [alarm, *ring], (value, alarm)

    return _in_order(states, ["end", "score", "first_alarm"], "end long, score double, first_alarm long", [-1.0], fold, lambda carried: carried[:1], patience)


def cusum(states: DataFrame, drift: float, limit: float, patience: int | None = None) -> DataFrame:
    """(ep, t, level, alarm): one-sided cumulative sum with reset at 0; steps that were given up leave it as it is."""

    def fold(carried: list[float], t: int, x: float) -> tuple[list[float], tuple | None]:
        level = max(0.0, carried[0] + x - drift)
        return [level], (level, level > limit)

    return _in_order(states, ["t", "level", "alarm"], "t long, level double, alarm boolean", [0.0], fold, list, patience)


class GrowingKernel(StatefulProcessor):
    """A kernel Christoffel model of each key that takes in every point after it has scored it.

    State of a key: its points and the rows of the inverse Cholesky factor; a new point
    appends one row to either.
    """

    def __init__(self, key: str, kernel: Kernel, lam: float, most: int):
        self.key, self.kernel, self.lam, self.most = key, kernel, lam, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "v array<double>")
        self.rows = handle.getListState("rows", "r array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        points = [np.array(p[0], dtype=float) for p in self.points.get()]
        factor = [np.array(r[0], dtype=float) for r in self.rows.get()]
        before, model, out = len(points), None, []
        if points:
            half = np.zeros((before, before))
            for i, r in enumerate(factor):
                half[i, :i + 1] = r
            model = KernCD(self.kernel, self.lam, np.array(points), half)
        arrived = pd.concat(list(rows)).sort_values("t", kind="stable")
        for t, v in zip(arrived["t"], arrived["v"]):
            x = np.array(v, dtype=float).reshape(1, -1)
            own = float(self.kernel.diag(x)[0])
            out.append((key[0], int(t), float(model.score_points(x)[0]) if model else own, len(points)))
            if len(points) >= self.most:
                raise ValueError(f"the model of {key[0]} would grow beyond {self.most} points")
            model = model.update(x[0]) if model else KernCD(self.kernel, self.lam, x, np.array([[1 / np.sqrt(own + self.lam)]]))
            points.append(x[0])
        for i in range(before, len(points)):
            self.points.appendValue((points[i].tolist(),))
            self.rows.appendValue((model.half[i, :i + 1].tolist(),))
        yield pd.DataFrame(out, columns=[self.key, "t", "score", "n"])


def growing_scores(stream: DataFrame, kernel: Kernel, lam: float = 1e-3, most: int = 2000) -> DataFrame:
    """(ep, t, score, n) for a stream of (ep, t, v): each point's score by the ``n`` points of its key that came before it.

    Keys have factors of their own and grow apart, over all executors; one with over
    ``most`` points is an error, so no point is passed over in silence.
    """
    stream.sparkSession.conf.set(*PROVIDER)
    kind = dict(stream.dtypes)["ep"]
    named = stream.select("ep", F.col("t").cast("long").alias("t"), F.col("v").cast("array<double>").alias("v")).filter("v is not null")
    return named.groupBy("ep").transformWithStateInPandas(GrowingKernel("ep", kernel, lam, most), f"ep {kind}, t long, score double, n long", "Append", "None")
