"""Default parameters of the detection and similarity plans."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class DetectParams:
    """Episodes of alternating high and low variance."""

    srate: float = 200.0
    forgetting_time: float = 0.1047
    variance_threshold: float = 1.75
    agree_fraction: float = 0.6
    min_quiet_time: float = 0.5
    ratio_window: float = 60.0
    ratio_low: float = 0.5
    ratio_high: float = 1.0
    episode_gap: float = 60.0
    min_episode: float = 600.0
    burst_gap: int = 2
    shift_start: bool = False

    @property
    def beta(self) -> float:
        return math.exp(-1.0 / (self.forgetting_time * self.srate))


@dataclass(frozen=True)
class PrepParams:
    """Cleaning of recordings."""

    target_rate: float = 200.0
    highpass: float = 0.5
    highpass_order: int = 4
    lowpass: float = 50.0
    lowpass_order: int = 4
    notch: tuple[float, float] = (55.0, 65.0)
    notch_order: int = 6
    chunk_seconds: float = 5.0
    saturation: float = 500.0
    min_std: float = 1e-4
    max_hours: float = 72.0


@dataclass(frozen=True)
class SimilarityParams:
    """Pairwise comparison of segments."""

    srate: float = 200.0
    min_seconds: float = 0.5
    max_seconds: float = 5.0
    splice_seconds: float = 0.5
    dtw_window: int = 200
    min_segments: int = 20


@dataclass(frozen=True)
class LshParams:
    """Two-layer locality-sensitive hashing."""

    m_out: int = 10
    l_out: int = 50
    m_in: int = 10
    l_in: int = 10
    k: int = 1
    alpha: float = 0.1
    seed: int = 7


@dataclass(frozen=True)
class NoisyChannelParams:
    """Thresholds of noisy-channel detection."""

    deviation: float = 5.0
    noise: float = 5.0
    window_seconds: float = 1.0
    correlation: float = 0.4
    bad_fraction: float = 0.01
    ransac_samples: int = 50
    ransac_fraction: float = 0.25
    ransac_correlation: float = 0.75
    ransac_unbroken: float = 0.4
    ransac_window: float = 5.0
    max_iterations: int = 4
