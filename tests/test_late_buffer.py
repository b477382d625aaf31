"""The buffer of late samples: few calls of the state, order of time and tie kept."""

from __future__ import annotations

import numpy as np
import pandas as pd

from quiescent.operators import recursive
from quiescent.streaming import ordered


class Cell:
    """A value or list state in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return list(self.rows) if self.many else self.rows[0]
            if name == "exists":
                return bool(self.rows)
            self.rows = {"appendValue": lambda: [*self.rows, args[0]], "put": lambda: list(args[0]), "update": lambda: [args[0]], "clear": lambda: []}[name]()

        return call


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def _cell(self, many):
        c = Cell(self.calls)
        c.many = many
        return c

    def getListState(self, name, schema):  # noqa: N802
        return self._cell(True)

    def getValueState(self, name, schema):  # noqa: N802
        return self._cell(False)

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.remove(ms)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_state_is_called_by_batch():
    rng = np.random.default_rng(6)
    n = 1000
    t, tie, v = np.sort(rng.integers(0, 200, n)), rng.integers(0, 3, n), rng.normal(0, 9, n)
    order = np.lexsort((tie, t))
    p, handle = ordered.OrderedEma(["u"], "ts", "k", "v", 0.8, 5.0), Handle()
    p.init(handle)
    late = np.argsort(t + rng.integers(0, 50, n), kind="stable")
    first, second = late[:600], np.sort(late[600:])
    got = []
    for part, mark in ((np.sort(first), t[late[600:]].min() - 1), (second, 10_000)):
        pdf = pd.DataFrame({"ts": pd.to_datetime(t[part] * 1000, unit="us"), "k": tie[part], "v": v[part]})
        assert not list(p.handleInputRows((7,), iter([pdf]), None))
        assert len(handle.timers) == 1
        handle.timers.clear()
        got += [x for x in p.handleExpiredTimer((7,), Mark(mark), None)]
    d = pd.concat(got)
    assert len(handle.calls) < 30 and not handle.timers
    assert d["i"].tolist() == list(range(1, n + 1)) and d["k"].tolist() == tie[order].tolist()
    assert sorted(d["v"]) == sorted(v)
    mu, var = recursive.ema_variance_kernel(d["v"].to_numpy(), 0.8)
    assert np.allclose(d["mu"], mu) and np.allclose(d["var"], var)
