"""Detection on recordings stored as blocks of samples.

``blocks(rec_id, channel, i0, v array<double>)`` has a row for each channel and
stretch of a recording, ``i0`` being its first index; blocks of one start have one
length. The same rules as :mod:`.detect`, which keeps a row for each sample: here a
channel's variance, a stretch's vote and a recording's ranges are numpy calls, and
what moves between them is a byte for each sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DetectParams
from .recursive import ema_variance_kernel


def to_blocks(samples: DataFrame, keys: list[str], length: int, idx: str = "i", value: str = "v") -> DataFrame:
    """Rows of samples to rows of blocks of at most ``length``."""
    d = samples.withColumn("b_", F.floor((F.col(idx) - 1) / length))
    g = d.groupBy(*keys, "b_").agg(F.array_sort(F.collect_list(F.struct(idx, value))).alias("s"))
    return g.select(*keys, (F.col("b_") * length + 1).alias("i0"), F.col(f"s.{value}").cast("array<double>").alias("v"))


def label_blocks(blocks: DataFrame, beta: float, threshold: float) -> DataFrame:
    """``(rec_id, channel, i0, z binary)``: whether the moving variance exceeds the threshold, a byte for each sample."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i0")
        v = t["v"].combine_chunks()
        _, var = ema_variance_kernel(v.flatten().to_numpy(), beta)
        z = (var > threshold).astype(np.uint8)
        edge = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())])
        return pa.table({"rec_id": t["rec_id"], "channel": t["channel"], "i0": t["i0"], "z": pa.array([z[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    return blocks.groupBy("rec_id", "channel").applyInArrow(run, "rec_id string, channel string, i0 long, z binary")


def vote_blocks(labels: DataFrame, n_channels: int, agree: float = 0.6) -> DataFrame:
    """``(rec_id, i0, z binary)``: the joint label of each sample by the rule of :func:`.detect.channel_vote`, undecided ones 0."""

    def run(t: pa.Table) -> pa.Table:
        z = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in t["z"]])
        valid = len(z)
        ok = valid >= 3 if n_channels > 3 else valid == 2
        out = (z.sum(axis=0, dtype=np.int64) >= np.ceil(valid * agree)) & ok
        return pa.table({"rec_id": t["rec_id"][:1], "i0": t["i0"][:1], "z": pa.array([out.astype(np.uint8).tobytes()], pa.binary())})

    return labels.groupBy("rec_id", "i0").applyInArrow(run, "rec_id string, i0 long, z binary")


def _runs(on: np.ndarray, tol: int) -> np.ndarray:
    """Ranges (first, last) of indices set, steps up to ``tol`` apart joined."""
    at = on.nonzero()[0]
    if not len(at):
        return np.zeros((0, 2), np.int64)
    cut = (np.diff(at) > tol).nonzero()[0]
    return np.stack([at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]], axis=1)


def ranges_of(joint: DataFrame, p: DetectParams) -> DataFrame:
    """``(rec_id, episode_start, episode_end, start_idx, end_idx)`` of every burst in every episode; an episode without one has nulls."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i0")
        z = np.frombuffer(b"".join(t["z"].to_pylist()), np.uint8).copy()
        first = t["i0"][0].as_py()
        for a, b in _runs(z == 0, 1):
            if b - a + 1 < int(p.min_quiet_time * p.srate):
                z[a : b + 1] = 1
        w = int(p.ratio_window * p.srate)
        c = np.concatenate([[0], np.cumsum(z, dtype=np.int64)])
        k = np.arange(1, len(z) + 1)
        ratio = 1 - (c[k] - c[np.maximum(k - w, 0)]) / np.minimum(k, w)
        rows: list[tuple] = []
        for a, b in _runs((ratio > p.ratio_low) & (ratio < p.ratio_high), int(p.episode_gap * p.srate)):
            a = max(0, a - int(p.ratio_window)) if p.shift_start else a
            if b - a >= int(p.min_episode * p.srate):
                own = _runs(z[a : b + 1] == 1, p.burst_gap) + a + first
                rows += [(a + first, b + first, int(x), int(y)) for x, y in own] or [(a + first, b + first, None, None)]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        rec = t["rec_id"][0].as_py()
        return pa.table({"rec_id": pa.array([rec] * len(rows), pa.string()), **{n: pa.array(c, pa.int64()) for n, c in zip(("episode_start", "episode_end", "start_idx", "end_idx"), cols, strict=True)}})

    return joint.groupBy("rec_id").applyInArrow(run, "rec_id string, episode_start long, episode_end long, start_idx long, end_idx long")


def detect_blocks(blocks: DataFrame, n_channels: int, p: DetectParams) -> DataFrame:
    """Bursts in episodes of every recording."""
    return ranges_of(vote_blocks(label_blocks(blocks, p.beta, p.variance_threshold), n_channels, p.agree_fraction), p)
