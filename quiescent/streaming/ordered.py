"""The recursive detector on streams whose samples come late.

Samples wait in a buffer of their series until the watermark has passed them and are
then taken in order, so that what comes late, but not later than the watermark
allows, has its place in the recursion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Setting and value that the operator needs: states that can be larger than memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _packed(us: np.ndarray, tie: np.ndarray, v: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return us.astype("<i8").tobytes(), tie.astype("<i8").tobytes(), v.astype("<f8").tobytes()


def _unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row[0], "<i8"), np.frombuffer(row[1], "<i8"), np.frombuffer(row[2], "<f8")


class OrderedEma(StatefulProcessor):
    """Buffer of a series, a row for what came together, and the recursion's state behind the last sample released.

    The state is called once for the samples of a series that come together, not for each.
    """

    def __init__(self, keys: list[str], ts: str, tie: str, value: str, beta: float, threshold: float) -> None:
        self.keys, self.ts, self.tie, self.value, self.beta, self.threshold = keys, ts, tie, value, beta, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "us binary, tie binary, v binary")
        self.last = handle.getValueState("last", "i long, mu double, var double")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, us: int) -> None:
        """One timer at the first millisecond that is not before the earliest sample held."""
        ms = -(-us // 1000)
        if self.timer.exists():
            (old,) = self.timer.get()
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        for pdf in rows:
            us = pdf[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
            if len(us):
                self.buffer.appendValue(_packed(us, pdf[self.tie].to_numpy("int64"), pdf[self.value].to_numpy("float64")))
                first = int(us.min()) if first is None else min(first, int(us.min()))
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        held = [_unpacked(r) for r in self.buffer.get()]
        if not held:
            return
        us, tie, v = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((tie, us))  # equal ones stay as they came
        us, tie, v = us[order], tie[order], v[order]
        ready = int(np.searchsorted(us, upto, side="right"))
        if ready < len(us):
            self._wake(int(us[ready]))
        if not ready:
            return
        i, mu, var = self.last.get() if self.last.exists() else (0, None, 0.0)
        out = []
        for t, x in zip(tie[:ready].tolist(), v[:ready].tolist(), strict=True):
            i += 1
            mu = x if mu is None else self.beta * mu + (1 - self.beta) * x
            var = self.beta * var + (1 - self.beta) * (x - mu) ** 2 if i > 1 else 0.0
            out.append((*key, t, i, x, mu, var, int(var > self.threshold)))
        if ready < len(us):
            self.buffer.put([_packed(us[ready:], tie[ready:], v[ready:])])
        else:
            self.buffer.clear()
        self.last.update((i, mu, var))
        yield pd.DataFrame(out, columns=[*self.keys, self.tie, "i", "v", "mu", "var", "z"])

    def close(self) -> None:
        pass


def ordered_ema_stream(stream: DataFrame, keys: list[str], ts: str, tie: str, value: str, beta: float, threshold: float, late: str) -> DataFrame:
    """``(keys, tie, i, v, mu, var, z)`` of a stream of samples in the order of ``ts`` and ``tie`` in each series.

    A sample is given once the watermark, ``late`` behind the latest sample of all
    series, has passed it, so a sample may come up to ``late`` after a later one and
    has its place; what comes later than that is dropped by Spark and counted in the
    query's progress. Rows equal in series, time and tie keep their number. Samples
    with a null time or value must be left out before. The end of a finite stream is
    told by a row of another series ``late`` or more behind all others; see :func:`end_marker`.
    """
    kinds = dict(stream.dtypes)
    for c, kind in ((tie, "bigint"), (value, "double")):
        if kinds[c] != kind:
            raise ValueError(f"{c}: {kind} wanted")
    fields = [f"`{k}` {kinds[k]}" for k in keys]
    grouped = stream.withWatermark(ts, late).select(*keys, ts, tie, value).groupBy(*keys)
    return grouped.transformWithStateInPandas(
        OrderedEma(keys, ts, tie, value, beta, threshold), ", ".join([*fields, f"`{tie}` long, i long, v double, mu double, var double, z int"]), "Append", "EventTime"
    )


def end_marker(samples: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row like those of ``samples`` with null keys in the year 2200, behind which nothing waits any more; its own output never comes."""
    row = ", ".join(f"cast({'null' if c in keys else repr('2200-01-01') if c == ts else '0'} as {t}) as `{c}`" for c, t in samples.dtypes)
    return samples.sparkSession.sql(f"select {row}")


def needs_state_store(spark: SparkSession) -> None:
    """Set the state store that keeps buffers on disk, where the session has another."""
    if spark.conf.get(STATE_STORE[0], "") != STATE_STORE[1]:
        spark.conf.set(*STATE_STORE)
