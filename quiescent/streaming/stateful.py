"""The operators that make sense on streams: recursive state, windows, sessions, queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.recursive import ema_variance_kernel


def ema_variance_stream(stream: DataFrame, keys: list[str], idx: str, value: str, beta: float, threshold: float) -> DataFrame:
    """Adds ``mu``, ``var`` and ``z`` to a stream of samples, with (mean, variance) as the state of each series.

    A micro-batch's samples of a series are put in index order. Samples that come
    after a later one has been seen are dropped, for the recursion runs forward.
    """
    fields = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, mu, var = state.get if state.exists else (None, None, 0.0)
        pdf = pd.concat(list(batches)).sort_values(idx)
        if last is not None:
            pdf = pdf[pdf[idx] > last]
        if len(pdf):
            m, v = ema_variance_kernel(pdf[value].to_numpy(), beta, mu, var)
            state.update((int(pdf[idx].iloc[-1]), float(m[-1]), float(v[-1])))
            yield pdf.assign(mu=m, var=v, z=(v > threshold).astype("int32"))

    return stream.groupBy(*keys).applyInPandasWithState(run, f"{fields}, mu double, var double, z int", "last bigint, mu double, var double", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, ts: str, late: str, size: str, slide: str | None, keys: list[str], value: str) -> DataFrame:
    """Count, mean and sum by event-time windows; rows later than ``late`` are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys)
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "total")


def sessions(stream: DataFrame, ts: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    """Runs of events no further apart than ``gap``."""
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def serve_queries(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> object:
    """Answers each micro-batch of queries against a static index; ``sink`` gets the answers and the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(answer(batch), number)

    return queries.writeStream.foreachBatch(each)
