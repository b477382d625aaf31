"""Dense numeric kernels on numpy arrays: filters, spectra, alignment, decomposition.

They take and give plain arrays and know nothing of Spark; operators apply them to
groups.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

# ---------------------------------------------------------------- filter design


def butterworth(order: int, cutoff: float | tuple[float, float], srate: float, kind: str = "low") -> np.ndarray:
    """Second-order sections ``(n, 6)`` of a digital Butterworth filter.

    Analogue prototype poles on the unit circle, moved to the band, then the
    bilinear transform with prewarped edges. ``kind`` is low, high, band or stop.
    """
    edges = np.atleast_1d(np.asarray(cutoff, float))
    warped = 2 * srate * np.tan(np.pi * edges / srate)
    p = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "low":
        poles, zeros = p * warped[0], np.zeros(0, complex)
    elif kind == "high":
        poles, zeros = warped[0] / p, np.zeros(order, complex)
    else:
        bw, w0 = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        half = p * bw / 2 if kind == "band" else bw / 2 / p
        root = np.sqrt(half**2 - w0**2)
        poles = np.concatenate([half + root, half - root])
        zeros = np.zeros(order, complex) if kind == "band" else np.concatenate([np.full(order, 1j * w0), np.full(order, -1j * w0)])
    fs2 = 2 * srate
    zp = (fs2 + poles) / (fs2 - poles)
    zz = np.concatenate([(fs2 + zeros) / (fs2 - zeros), np.full(len(poles) - len(zeros), -1.0)])
    at = {"low": 1.0, "high": -1.0, "stop": 1.0}.get(kind)
    centre = at if at is not None else np.exp(2j * np.pi * math.sqrt(edges[0] * edges[1]) / srate) if len(edges) > 1 else 1.0
    if kind == "band":
        centre = np.exp(1j * 2 * math.atan(math.sqrt(warped[0] * warped[1]) / fs2))
    sections = _pair(zz, zp)
    for s in sections:  # unit gain in the pass band, section by section
        s[:3] /= abs(np.polyval(s[:3], centre) / np.polyval(s[3:], centre))
    return np.array(sections)


def _pair(zeros: np.ndarray, poles: np.ndarray) -> list[np.ndarray]:
    """Sections of conjugate pairs, real roots two by two."""

    def halves(r: np.ndarray) -> list[list[complex]]:
        up = sorted((x for x in r if x.imag > 1e-12), key=lambda x: (abs(x - 1), x.real))
        real = sorted(x.real for x in r if abs(x.imag) <= 1e-12)
        return [[x, x.conjugate()] for x in up] + [real[i : i + 2] for i in range(0, len(real), 2)]

    zs, ps = halves(zeros), halves(poles)
    out = []
    for k in range(max(len(zs), len(ps))):
        b = np.real(np.poly(zs[k])) if k < len(zs) else np.ones(1)
        a = np.real(np.poly(ps[k])) if k < len(ps) else np.ones(1)
        out.append(np.concatenate([b, np.zeros(3 - len(b)), a, np.zeros(3 - len(a))]))
    return out


@lru_cache(maxsize=128)
def _responses(b0: float, b1: float, b2: float, a1: float, a2: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The triangular matrix of a section's response to an impulse, and its responses to either state."""
    h, g1, g2 = np.zeros(n), np.zeros(n), np.zeros(n)
    for out, drive, z0 in ((h, 1.0, (0.0, 0.0)), (g1, 0.0, (1.0, 0.0)), (g2, 0.0, (0.0, 1.0))):
        u, v = z0
        for i in range(n):
            xi = drive if i == 0 else 0.0
            y = b0 * xi + u
            u, v = b1 * xi - a1 * y + v, b2 * xi - a2 * y
            out[i] = y
    k = np.arange(n)
    return np.where(k[:, None] >= k, h[np.abs(k[:, None] - k)], 0.0), g1, g2


def _section(s: np.ndarray, x: np.ndarray, state: np.ndarray | None = None, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """One section over the last axis. Blocks by a triangular response matrix, two state numbers between them."""
    b0, b1, b2 = s[:3] / s[3]
    a1, a2 = s[4] / s[3], s[5] / s[3]
    z = np.zeros((*x.shape[:-1], 2)) if state is None else state.copy()
    n = min(block, x.shape[-1])
    if not n:
        return x.copy(), z
    toep, g1, g2 = _responses(*map(float, (b0, b1, b2, a1, a2)), block)  # shorter ones are their beginning
    y = np.empty_like(x, dtype=float)
    for i in range(0, x.shape[-1], n):
        part = x[..., i : i + n]
        m = part.shape[-1]
        y[..., i : i + m] = part @ toep[:m, :m].T + z[..., :1] * g1[:m] + z[..., 1:] * g2[:m]
        # the state after a block follows from its last two samples in and out
        xs, ys = part[..., -2:], y[..., i : i + m][..., -2:]
        if m == 1:
            z = np.stack([b1 * xs[..., 0] - a1 * ys[..., 0] + z[..., 1], b2 * xs[..., 0] - a2 * ys[..., 0]], axis=-1)
        else:
            z = np.stack([b1 * xs[..., 1] - a1 * ys[..., 1] + b2 * xs[..., 0] - a2 * ys[..., 0], b2 * xs[..., 1] - a2 * ys[..., 1]], axis=-1)
    return y, z


def sos_filter(sos: np.ndarray, x: np.ndarray, states: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sections one after the other over the last axis, and their states."""
    y, out = np.asarray(x, float), []
    for k, s in enumerate(sos):
        y, z = _section(s, y, None if states is None else states[k])
        out.append(z)
    return y, out


def _steady(sos: np.ndarray) -> list[np.ndarray]:
    """States in which a constant 1 leaves each section unchanged in time."""
    out, level = [], 1.0
    for s in sos:
        b, a = s[:3] / s[3], s[3:] / s[3]
        gain = b.sum() / a.sum() if a.sum() else 0.0
        y = level * gain
        out.append(np.array([y - b[0] * level, b[2] * level - a[2] * y]))
        level = y
    return out


def zero_phase(sos: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Forward and backward, over ends reflected about their first and last samples."""
    x = np.asarray(x, float)
    n = x.shape[-1]
    pad = min(n - 1, 3 * (2 * len(sos) + 1) if pad is None else pad)
    if pad > 0:
        left = 2 * x[..., :1] - x[..., pad:0:-1]
        right = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
        x = np.concatenate([left, x, right], axis=-1)
    base = _steady(sos)
    for _ in range(2):
        y, _z = sos_filter(sos, x, [z * x[..., :1] for z in base])
        x = y[..., ::-1]
    return x[..., pad : pad + n]


WINDOWS = {
    "hamming": lambda n: 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1)),
    "hann": lambda n: 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1)),
    "blackman": lambda n: 0.42 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1)) + 0.08 * np.cos(4 * np.pi * np.arange(n) / max(1, n - 1)),
    "rectangular": np.ones,
}


def kaiser_window(n: int, beta: float) -> np.ndarray:
    return np.kaiser(n, beta)


def fir_sinc(order: int, cutoff: float | tuple[float, float], srate: float, kind: str = "low", window: str | np.ndarray = "hamming") -> np.ndarray:
    """Windowed-sinc coefficients of an even order; low, high, band or stop."""
    if order % 2:
        raise ValueError("the order must be even")
    t = np.arange(order + 1) - order / 2
    w = WINDOWS[window](order + 1) if isinstance(window, str) else window

    def low(f: float) -> np.ndarray:
        h = 2 * f / srate * np.sinc(2 * f / srate * t) * w
        return h / h.sum()

    f = np.atleast_1d(np.asarray(cutoff, float))
    delta = np.zeros(order + 1)
    delta[order // 2] = 1
    if kind == "low":
        return low(f[0])
    if kind == "high":
        return delta - low(f[0])
    stop = low(f[0]) + delta - low(f[1])
    return stop if kind == "stop" else delta - stop


def fir_least_squares(order: int, bands: list[float], gains: list[float], srate: float, weights: list[float] | None = None, grid: int = 16) -> np.ndarray:
    """Linear-phase coefficients of an even order that fit piecewise linear gains best in the squared sense."""
    m = order // 2
    freq, want, wt = [], [], []
    for k in range(0, len(bands), 2):
        f = np.linspace(bands[k], bands[k + 1], grid * (m + 1))
        freq.append(f)
        want.append(np.interp(f, bands[k : k + 2], gains[k : k + 2]))
        wt.append(np.full(len(f), math.sqrt((weights[k // 2] if weights else 1.0) * (bands[k + 1] - bands[k]))))
    f, d, s = np.concatenate(freq), np.concatenate(want), np.concatenate(wt)
    a = np.cos(2 * np.pi * np.outer(f / srate, np.arange(m + 1)))
    c = np.linalg.lstsq(a * s[:, None], d * s, rcond=None)[0]
    return np.concatenate([c[:0:-1] / 2, c[:1], c[1:] / 2])


def fir_equiripple(order: int, bands: list[float], gains: list[float], srate: float, weights: list[float] | None = None, grid: int = 16, steps: int = 300) -> np.ndarray:
    """Linear-phase coefficients of an even order with the smallest largest error.

    Least squares whose weights are multiplied by the errors they leave, over and
    over: where the error is largest the weight grows until all peaks are equal.
    """
    m = order // 2
    freq, want, wt = [], [], []
    for k in range(0, len(bands), 2):
        f = np.linspace(bands[k], bands[k + 1], grid * (m + 1))
        freq.append(f)
        want.append(np.interp(f, bands[k : k + 2], gains[k : k + 2]))
        wt.append(np.full(len(f), weights[k // 2] if weights else 1.0))
    f, d, s = np.concatenate(freq), np.concatenate(want), np.concatenate(wt)
    a = np.cos(2 * np.pi * np.outer(f / srate, np.arange(m + 1)))
    w, best, least = np.full(len(f), 1 / len(f)), None, np.inf
    for _ in range(steps):
        g = np.sqrt(w)[:, None]
        c = np.linalg.lstsq(a * g, d * g[:, 0], rcond=None)[0]
        e = s * np.abs(a @ c - d)
        if e.max() < least:
            best, least = c, e.max()
        w = w * (e + 1e-12)
        w /= w.sum()
    return np.concatenate([best[:0:-1] / 2, best[:1], best[1:] / 2])


def minimum_phase(h: np.ndarray) -> np.ndarray:
    """The coefficients with the same magnitude response whose energy comes earliest, by the cepstrum."""
    n = 1 << int(np.ceil(np.log2(len(h) * 16)))
    c = np.fft.ifft(np.log(np.maximum(np.abs(np.fft.fft(h, n)), 1e-10))).real
    c[1 : n // 2] *= 2
    c[n // 2 + 1 :] = 0
    return np.fft.ifft(np.exp(np.fft.fft(c))).real[: len(h)]


def fft_convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Full convolution over the last axis."""
    n = x.shape[-1] + len(h) - 1
    m = 1 << int(np.ceil(np.log2(max(2, n))))
    return np.fft.irfft(np.fft.rfft(x, m) * np.fft.rfft(h, m), m)[..., :n]


def fir_apply(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Linear-phase filtering without delay, ends held constant."""
    x = np.asarray(x, float)
    k = len(h) // 2
    if not x.shape[-1]:
        return x
    p = np.concatenate([np.repeat(x[..., :1], k, axis=-1), x, np.repeat(x[..., -1:], k, axis=-1)], axis=-1)
    return fft_convolve(p, h)[..., 2 * k : 2 * k + x.shape[-1]]


def fft_brickwall(x: np.ndarray, srate: float, lo: float = 0.0, hi: float = 0.0, invert: bool = False) -> np.ndarray:
    """Spectral lines outside the band set to zero (inside it, inverted); 0 leaves an edge open."""
    x = np.asarray(x, float)
    f = np.fft.rfftfreq(x.shape[-1], 1 / srate)
    keep = (f >= lo) & ((f <= hi) if hi else True)
    s = np.fft.rfft(x)
    s[..., keep if invert else ~keep] = 0
    return np.fft.irfft(s, x.shape[-1])


def resample(x: np.ndarray, up: int, down: int, half: int = 10) -> np.ndarray:
    """By the ratio up / down through a Kaiser-windowed sinc, phase by phase; ``ceil(n up / down)`` samples."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    x = np.asarray(x, float)
    if up == down or not len(x):
        return x.copy()
    m = max(up, down)
    k = half * m
    t = np.arange(-k, k + 1)
    h = np.sinc(t / m) / m * np.kaiser(2 * k + 1, 5.0) * up
    n = -(-len(x) * up // down)
    at = np.arange(n) * down
    out = np.zeros(n)
    wide = 2 * k // up + 1
    first = -(-(at - k) // up)
    for j in range(wide + 1):
        src = first + j
        tap = at - src * up
        ok = (src >= 0) & (src < len(x)) & (np.abs(tap) <= k)
        out[ok] += x[src[ok]] * h[tap[ok] + k]
    return out


# ---------------------------------------------------------------- spectra


def welch(x: np.ndarray, srate: float, segment: int, overlap: int | None = None, window: str = "hamming", nfft: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided power density) averaged over segments; over the last axis."""
    x = np.asarray(x, float)
    segment = min(segment, x.shape[-1])
    overlap = segment // 2 if overlap is None else overlap
    w = WINDOWS[window](segment)
    nfft = segment if nfft is None else nfft
    starts = np.arange(0, x.shape[-1] - segment + 1, segment - overlap)
    total = 0.0
    for s in starts:
        total = total + np.abs(np.fft.rfft(x[..., s : s + segment] * w, nfft)) ** 2
    p = total / (len(starts) * srate * (w**2).sum())
    p[..., 1 : (-1 if nfft % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(nfft, 1 / srate), p


def band_power(freq: np.ndarray, psd: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Integral of a density over a band by trapezoids, ends interpolated."""
    f = np.concatenate([[lo], freq[(freq > lo) & (freq < hi)], [hi]])
    rows = np.atleast_2d(psd)
    out = np.array([np.trapezoid(np.interp(f, freq, r), f) for r in rows])
    return out if psd.ndim > 1 else out[0]


def dpss(n: int, nw: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Slepian tapers ``(k, n)`` and their energy concentrations, from the tridiagonal matrix they are eigenvectors of."""
    w = nw / n
    i = np.arange(n)
    diag = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * w)
    off = i[1:] * (n - i[1:]) / 2
    if n <= 1024:
        vec = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))[1][:, ::-1][:, :k].T
    else:  # shorter tapers stretched: they vary slowly
        small = dpss(1024, nw, k)[0]
        vec = np.array([np.interp(np.linspace(0, 1, n), np.linspace(0, 1, 1024), v) for v in small])
        vec = np.linalg.qr(vec.T)[0].T * np.sign((np.linalg.qr(vec.T)[0].T * vec).sum(axis=1))[:, None]
    for j, v in enumerate(vec):
        if (j % 2 == 0 and v.sum() < 0) or (j % 2 and v[: n // 2].sum() < 0):
            vec[j] = -v
    s = np.abs(np.fft.fft(vec, 8 * n, axis=1)) ** 2
    f = np.abs(np.fft.fftfreq(8 * n))
    return vec, s[:, f <= w].sum(axis=1) / s.sum(axis=1)


def multitaper(x: np.ndarray, srate: float, nw: float = 3.0, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power density) averaged over tapers."""
    v, _ = dpss(len(x), nw, k)
    s = np.abs(np.fft.rfft(v * x, axis=1)) ** 2 / srate
    s[:, 1 : (-1 if len(x) % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(len(x), 1 / srate), s.mean(axis=0)


def coherence(x: np.ndarray, y: np.ndarray, srate: float, nw: float = 3.0, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, magnitude of coherency) over tapers."""
    v, _ = dpss(len(x), nw, k)
    a, b = np.fft.rfft(v * x, axis=1), np.fft.rfft(v * y, axis=1)
    c = (a * b.conj()).mean(axis=0) / np.sqrt((np.abs(a) ** 2).mean(axis=0) * (np.abs(b) ** 2).mean(axis=0) + 1e-300)
    return np.fft.rfftfreq(len(x), 1 / srate), np.abs(c)


def line_f_test(x: np.ndarray, srate: float, nw: float = 3.0, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, F, complex amplitudes) of a sinusoid at each frequency, from tapered spectra."""
    v, _ = dpss(len(x), nw, k)
    h = v.sum(axis=1)
    s = np.fft.rfft(v * x, axis=1)
    amp = (h[:, None] * s).sum(axis=0) / (h**2).sum()
    rest = (np.abs(s - amp * h[:, None]) ** 2).sum(axis=0)
    return np.fft.rfftfreq(len(x), 1 / srate), (k - 1) * np.abs(amp) ** 2 * (h**2).sum() / np.maximum(rest, 1e-300), amp


def remove_line(x: np.ndarray, srate: float, line: float, width: float = 2.0, segment: float = 4.0) -> np.ndarray:
    """The strongest sinusoid near ``line`` fitted in half-overlapping segments and taken away with a smooth cross-fade."""
    x = np.asarray(x, float)
    n = min(len(x), int(segment * srate))
    if n < 16:
        return x.copy()
    fade, fit, weight = WINDOWS["hann"](n) + 1e-6, np.zeros(len(x)), np.zeros(len(x))
    starts = sorted({*range(0, len(x) - n + 1, n // 2), len(x) - n})
    t = np.arange(n) / srate
    for s in starts:
        part = x[s : s + n] - x[s : s + n].mean()
        spec = np.abs(np.fft.rfft(part * WINDOWS["hann"](n), 8 * n))
        f = np.fft.rfftfreq(8 * n, 1 / srate)
        near = np.flatnonzero(np.abs(f - line) <= width)
        if not len(near):
            return x.copy()
        at = f[near[spec[near].argmax()]]
        base = np.stack([np.cos(2 * np.pi * at * t), np.sin(2 * np.pi * at * t)], axis=1)
        fit[s : s + n] += fade * (base @ np.linalg.lstsq(base, part, rcond=None)[0])
        weight[s : s + n] += fade
    return x - fit / weight


def morlet(x: np.ndarray, srate: float, freqs: np.ndarray, cycles: float = 3.0) -> np.ndarray:
    """Complex coefficients ``(freq, time)`` of Gaussian-windowed oscillations; of several series at once with the series ahead."""
    size = x.shape[-1]
    out = np.zeros((*x.shape[:-1], len(freqs), size), complex)
    for i, f in enumerate(freqs):
        sd = cycles / (2 * np.pi * f)
        t = np.arange(-int(4 * sd * srate), int(4 * sd * srate) + 1) / srate
        w = np.exp(2j * np.pi * f * t - t**2 / (2 * sd**2))
        w /= np.abs(w).sum()
        n = size + len(w) - 1
        full = np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(w, n))
        out[..., i, :] = full[..., len(w) // 2 : len(w) // 2 + size]
    return out


def spectrogram(x: np.ndarray, srate: float, window: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, centres in s, power ``(freq, time)``) of Hann windows."""
    w = WINDOWS["hann"](window)
    at = np.arange(0, len(x) - window + 1, step)
    s = np.abs(np.fft.rfft(np.stack([x[a : a + window] for a in at]) * w, axis=1)) ** 2 if len(at) else np.zeros((0, window // 2 + 1))
    return np.fft.rfftfreq(window, 1 / srate), (at + window / 2) / srate, s.T / (srate * (w**2).sum())


def intertrial(coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean power in dB, phase locking) of coefficients ``(trial, freq, time)``."""
    mag = np.abs(coef)
    return 10 * np.log10((mag**2).mean(axis=0) + 1e-300), np.abs((coef / np.maximum(mag, 1e-300)).mean(axis=0))


def phase_coherence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Event-related phase coherence of two channels' coefficients ``(trial, freq, time)``."""
    cross = a * b.conj()
    return np.abs((cross / np.maximum(np.abs(cross), 1e-300)).mean(axis=0))


def phase_amplitude(x: np.ndarray, srate: float, f_phase: float, f_amp: float) -> float:
    """Mean vector length of one oscillation's amplitude over another's phase, relative to the mean amplitude."""
    p = np.angle(morlet(x, srate, np.array([f_phase]))[0])
    a = np.abs(morlet(x, srate, np.array([f_amp]))[0])
    return float(np.abs((a * np.exp(1j * p)).mean()) / max(a.mean(), 1e-300))


def time_warp(x: np.ndarray, marks: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A trial bent piecewise linearly so that its marks (indices) fall on the target ones."""
    n = x.shape[-1]
    src = np.concatenate([[0], marks, [n - 1]]).astype(float)
    dst = np.concatenate([[0], target, [n - 1]]).astype(float)
    at = np.interp(np.arange(n), dst, src)
    return np.apply_along_axis(lambda v: np.interp(at, np.arange(n), v), -1, x)


def angle_time_warp(phase: np.ndarray, marks: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The same for angles, unwrapped first and wrapped after."""
    return np.angle(np.exp(1j * time_warp(np.unwrap(phase, axis=-1), marks, target)))


# ---------------------------------------------------------------- comparison of segments


def max_xcorr(x: np.ndarray, y: np.ndarray, coeff: bool = False) -> float:
    """Largest cross-correlation over all lags; with ``coeff`` over the product of the norms."""
    if not len(x) or not len(y):
        return float("nan")
    n = len(x) + len(y) - 1
    m = 1 << int(np.ceil(np.log2(max(2, n))))
    r = np.fft.irfft(np.fft.rfft(x, m) * np.fft.rfft(y[::-1], m), m)[:n]
    best = float(r.max())
    if coeff:
        den = math.sqrt(float((x**2).sum() * (y**2).sum()))
        return best / den if den else float("nan")
    return best


def tile_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the rows of two matrices, by ``l1``, ``euclidean`` or ``cosine`` (NaN where a row is zero).

    Terms are added one coordinate after the other, so that a distance has the bits of
    the sum over the two arrays, whatever matrices the rows are part of.
    """
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    out = np.zeros((len(a), len(b)))
    term = np.empty_like(out)
    for x, y in zip(at, bt, strict=True):
        if metric == "cosine":
            np.multiply(x[:, None], y[None, :], out=term)
        else:
            np.subtract(x[:, None], y[None, :], out=term)
            if metric == "l1":
                np.abs(term, out=term)
            else:
                np.multiply(term, term, out=term)
        out += term
    if metric == "l1":
        return out
    if metric == "euclidean":
        return np.sqrt(out)
    len2 = lengths_product(a, b)
    return 1 - out / np.where(len2 == 0, np.nan, len2)


def lengths_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of the lengths of the rows of two matrices."""
    na, nb = np.zeros(len(a)), np.zeros(len(b))
    for n, m in ((na, a), (nb, b)):
        for x in m.T:
            n += x * x
    return np.sqrt(na[:, None] * nb[None, :])


def smallest(d: np.ndarray, k: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` smallest numbers of each row, NaN last and by ``last``, ties to the smaller column."""
    if d.shape[1] <= k:
        i, j = np.indices(d.shape)
        return i.reshape(-1), j.reshape(-1)
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    near = d <= kth
    i, j = near.nonzero()
    n = near.sum(axis=1)
    if (n == k).all():
        return i, j
    # rows with ties at the last place, or with fewer numbers than places
    odd = n != k
    keep = ~odd[i]
    top = np.lexsort((d[odd], last[odd]))[:, :k]
    return np.concatenate([i[keep], np.repeat(odd.nonzero()[0], k)]), np.concatenate([j[keep], top.reshape(-1)])


def tile_xcorr(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, coeff: bool = False) -> np.ndarray:
    """Largest cross-correlations of the rows of two matrices, each row padded with zeros from its length on.

    Only lags at which samples of both overlap count: where the shorter of two rows
    is padded to the longer, lags at which the padding alone overlaps would give 0,
    which only shows where all other lags are negative. A lag is a product of matrices,
    in pieces that stay in a core's cache.
    """
    out = np.full((len(a), len(b)), -np.inf)
    wa, wb = a.shape[1], b.shape[1]
    even_a, even_b = bool((na >= wa).all()), bool((nb >= wb).all())
    part = 128
    with np.errstate(invalid="ignore"):
        for j in range(0, len(b), part):
            bt = np.ascontiguousarray(b[j : j + part].T)
            short_b = nb[j : j + part]
            for i in range(0, len(a), part):
                x, best = a[i : i + part], out[i : i + part, j : j + part]
                r = np.empty(best.shape)
                for lag in range(1 - wb, wa):
                    first, last = max(0, lag), min(wa, wb + lag)
                    np.matmul(x[:, first:last], bt[first - lag : last - lag], out=r)
                    # lags at which the samples, not the padding, overlap
                    if lag > 0 and not even_a:
                        r[na[i : i + part] <= lag] = -np.inf
                    elif lag < 0 and not even_b:
                        r[:, short_b <= -lag] = -np.inf
                    np.maximum(best, r, out=best)
    out[na <= 0] = -np.inf
    out[:, nb <= 0] = -np.inf
    if coeff:
        out = out / np.maximum(np.sqrt((a**2).sum(axis=1))[:, None] * np.sqrt((b**2).sum(axis=1))[None, :], 1e-300)
    return out


def dtw_many(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, window: int) -> np.ndarray:
    """Warping distances of row pairs padded to one width, absolute differences summed along the path.

    Anti-diagonals of all pairs move on together; a diagonal's cells are rows of
    memory, so every step is on whole slices. The window is widened to the
    difference of the lengths; cells that are in no pair's window are not looked at.
    """
    p, n = x.shape
    if p > 512:  # what moves on together should stay in a core's cache
        return np.concatenate([dtw_many(x[k : k + 512], y[k : k + 512], nx[k : k + 512], ny[k : k + 512], window) for k in range(0, p, 512)])
    if not p:
        return np.zeros(0)
    wide = np.maximum(window, np.abs(nx - ny))
    return _warped(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), nx, ny, wide)


def _warped(xt: np.ndarray, yt: np.ndarray, nx: np.ndarray, ny: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Distances of pairs, a sample of all of them in a row of ``xt`` and one of ``yt``; the two broadcast to the shape of lengths and windows."""
    n, m = len(xt), len(yt)
    narrow, most = int(wide.min()), int(wide.max())
    last = nx + ny
    ends = np.unique(last)
    even = len(ends) == 1 and narrow == most and bool((nx == nx.flat[0]).all())
    out = np.full(last.shape, np.inf)
    # a diagonal's cells are kept from the one before its window's first, so rows are as many as the window is wide
    height = min(n + 1, most + 3)
    prev2, prev, cur = (np.full((height, *last.shape), np.inf) for _ in range(3))
    prev2[0] = 0.0  # the cell before the first of both
    cost = np.empty((min(n, most + 1), *last.shape))
    first = lambda d: max(0, (d - most + 1) // 2 - 1)
    for d in range(2, int(ends[-1]) + 1):
        lo, hi = max(1, d - m, (d - most + 1) // 2), min(n, d - 1, (d + most) // 2)
        s0, s1, s2 = first(d), first(d - 1), first(d - 2)
        cur[lo - 1 - s0] = np.inf
        if hi < n:
            cur[hi + 1 - s0] = np.inf
        if lo <= hi:
            cell, c = cur[lo - s0 : hi + 1 - s0], cost[: hi + 1 - lo]
            np.minimum(prev[lo - 1 - s1 : hi - s1], prev[lo - s1 : hi + 1 - s1], out=cell)
            np.minimum(cell, prev2[lo - 1 - s2 : hi - s2], out=cell)
            np.subtract(xt[lo - 1 : hi], yt[d - hi - 1 : d - lo][::-1], out=c)
            np.abs(c, out=c)
            cell += c
            if narrow < most:
                off = np.abs(2 * np.arange(lo, hi + 1) - d)
                if off.max() > narrow:
                    cell[off.reshape(-1, *[1] * wide.ndim) > wide] = np.inf
            if even:
                if d == ends[0]:
                    out[...] = cur[int(nx.flat[0]) - s0]
            elif d in ends:
                end = (last == d).nonzero()
                out[end] = cur[(nx[end] - s0, *end)]
        prev2, prev, cur = prev, cur, prev2
        if d == 2:
            prev2[0] = np.inf
    return out


#: Pairs of rows that are warped together.
WARPED = 8192


def tile_dtw(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, window: int) -> np.ndarray:
    """Warping distances of all rows of two matrices, each row padded from its length on.

    Rows of one length are laid side by side once and compared with all of another length; where
    lengths are so many that few rows share one, pairs are copied out.
    """
    out = np.full((len(a), len(b)), np.inf)
    la, lb = np.unique(na), np.unique(nb)
    if len(la) * len(lb) * 64 > max(64, out.size):
        w = max(a.shape[1], b.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, w - m.shape[1]))) for m in (a, b))
        for i in range(len(a)):
            k = np.full(len(b), i)
            out[i] = dtw_many(x[k], y, na[k], nb, window)
        return out
    for n in la:
        rows = np.flatnonzero(na == n)
        xt = np.ascontiguousarray(a[rows, :n].T)
        for m in lb:
            cols = np.flatnonzero(nb == m)
            yt = np.ascontiguousarray(b[cols, :m].T)
            if not n or not m:
                continue
            # what moves on together should stay in a core's cache
            wide = max(window, abs(int(n) - int(m)))
            width = max(1, min(len(cols), WARPED))
            height = max(1, WARPED // width)
            for j in range(0, len(cols), width):
                y = yt[:, None, j : j + width]
                for i in range(0, len(rows), height):
                    x = xt[:, i : i + height, None]
                    shape = (x.shape[1], y.shape[2])
                    got = _warped(x, y, np.full(shape, n), np.full(shape, m), np.full(shape, wide))
                    out[np.ix_(rows[i : i + height], cols[j : j + width])] = got
    return out


# ---------------------------------------------------------------- decomposition


def principal(x: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, scores, shares of variance) of rows' covariance; ``x`` is (row, time)."""
    c = x - x.mean(axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(c @ c.T / max(1, c.shape[1] - 1))
    k = len(s) if k is None else k
    return u[:, :k], u[:, :k].T @ c, s[:k] / max(s.sum(), 1e-300)


def sphere(x: np.ndarray) -> np.ndarray:
    """The symmetric matrix that makes the rows uncorrelated with equal variances."""
    v, e = np.linalg.eigh(np.cov(np.atleast_2d(x)))
    return 2 * e @ np.diag(1 / np.sqrt(np.maximum(v, 1e-12))) @ e.T


def rotate(a: np.ndarray, gamma: float = 1.0, steps: int = 100, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal rotation of loadings ``(variable, factor)``: gamma 1 varimax, 0 quartimax."""
    p, k = a.shape
    r, last = np.eye(k), 0.0
    for _ in range(steps):
        b = a @ r
        u, s, v = np.linalg.svd(a.T @ (b**3 - gamma / p * b @ np.diag((b**2).sum(axis=0))))
        r = u @ v
        if s.sum() < last * (1 + tol):
            break
        last = s.sum()
    return a @ r, r


def promax(a: np.ndarray, power: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Oblique rotation towards a power of the varimax loadings."""
    v, r = rotate(a)
    t = np.linalg.lstsq(v, v * np.abs(v) ** (power - 1), rcond=None)[0]
    t = t @ np.diag(np.sqrt(np.diag(np.linalg.inv(t.T @ t))))
    return v @ t, r @ t


def fast_ica(x: np.ndarray, k: int | None = None, seed: int = 0, steps: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(unmixing matrix, sources) by fixed-point iterations with tanh, all components at once."""
    c = x - x.mean(axis=1, keepdims=True)
    val, vec = np.linalg.eigh(np.cov(c))
    order = np.argsort(-val)[: k or len(val)]
    white = np.diag(1 / np.sqrt(np.maximum(val[order], 1e-12))) @ vec[:, order].T
    z = white @ c
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(order), len(order))))[0]
    for _ in range(steps):
        g = np.tanh(w @ z)
        new = g @ z.T / z.shape[1] - np.diag((1 - g**2).mean(axis=1)) @ w
        u, _s, v = np.linalg.svd(new)
        new = u @ v
        done = np.max(np.abs(np.abs((new * w).sum(axis=1)) - 1)) < tol
        w = new
        if done:
            break
    return w @ white, w @ z


def infomax_ica(x: np.ndarray, seed: int = 0, steps: int = 150, rate: float = 0.02, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(unmixing matrix, sources) by natural-gradient information maximisation over shuffled blocks of sphered data.

    Peaked and flat sources are told apart by the sign of their kurtosis after each pass.
    """
    c = x - x.mean(axis=1, keepdims=True)
    s = sphere(c) / 2
    z = s @ c
    n, w, rng = len(x), np.eye(len(x)), np.random.default_rng(seed)
    sign = np.ones(n)
    for step in range(steps):
        old, order = w.copy(), rng.permutation(z.shape[1])
        for i in range(0, len(order), block):
            u = w @ z[:, order[i : i + block]]
            w = w + rate / (1 + step / 30) * (np.eye(n) - (sign[:, None] * np.tanh(u) @ u.T + u @ u.T) / u.shape[1]) @ w
        u = w @ z
        sign = np.where((u**4).mean(axis=1) > 3 * (u**2).mean(axis=1) ** 2, 1.0, -1.0)
        if np.abs(w - old).max() < 1e-7:
            break
    return w @ s, w @ z


def sobi(x: np.ndarray, lags: int = 20, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(unmixing matrix, sources) by joint diagonalisation of lagged covariances with plane rotations."""
    c = x - x.mean(axis=1, keepdims=True)
    val, vec = np.linalg.eigh(np.cov(c))
    white = np.diag(1 / np.sqrt(np.maximum(val, 1e-12))) @ vec.T
    z = white @ c
    n, t = z.shape
    m = np.array([(z[:, k:] @ z[:, : t - k].T / (t - k)) for k in range(1, lags + 1)])
    m = (m + m.transpose(0, 2, 1)) / 2
    return _joint(m, sweeps) @ white, _joint(m, sweeps) @ z


def jade(x: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(unmixing matrix, sources) by joint diagonalisation of fourth-order cumulant matrices."""
    c = x - x.mean(axis=1, keepdims=True)
    val, vec = np.linalg.eigh(np.cov(c))
    white = np.diag(1 / np.sqrt(np.maximum(val, 1e-12))) @ vec.T
    z = white @ c
    n, t = z.shape
    mats = []
    for i in range(n):
        for j in range(i + 1):
            e = np.zeros((n, n))
            e[i, j] = e[j, i] = 1 if i == j else math.sqrt(0.5)
            q = (z * (z[i] * z[j])) @ z.T / t * (1 if i == j else math.sqrt(2))
            mats.append(q - np.trace(e) * np.eye(n) - 2 * e)
    v = _joint(np.array(mats), sweeps)
    return v @ white, v @ z


def _joint(m: np.ndarray, sweeps: int) -> np.ndarray:
    """Rows of the rotation that makes all symmetric matrices as diagonal as can be."""
    n = m.shape[1]
    v, m = np.eye(n), m.copy()
    for _ in range(sweeps):
        moved = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                g = np.array([m[:, p, p] - m[:, q, q], m[:, p, q] + m[:, q, p]])
                h = g @ g.T
                on, off = h[0, 0] - h[1, 1], h[0, 1] + h[1, 0]
                theta = 0.5 * math.atan2(off, on + math.hypot(on, off))
                if abs(theta) > 1e-9:
                    moved = True
                    r = np.array([[math.cos(theta), -math.sin(theta)], [math.sin(theta), math.cos(theta)]])
                    m[:, [p, q], :] = np.einsum("ji,kjl->kil", r, m[:, [p, q], :])
                    m[:, :, [p, q]] = np.einsum("kij,jl->kil", m[:, :, [p, q]], r)
                    v[:, [p, q]] = v[:, [p, q]] @ r
        if not moved:
            break
    return v.T


def kmeans(x: np.ndarray, k: int, steps: int = 100, seed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres); starts from the first rows, or from random ones with a seed."""
    c = (x[:k] if seed is None else x[np.random.default_rng(seed).permutation(len(x))[:k]]).astype(float).copy()
    lab = np.full(len(x), -1)
    for _ in range(steps):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        new = d.argmin(axis=1)
        if (new == lab).all():
            break
        lab = new
        for j in range(k):
            if (lab == j).any():
                c[j] = x[lab == j].mean(axis=0)
    return lab, c


def average_linkage(d: np.ndarray) -> np.ndarray:
    """Merges ``(a, b, distance, size)`` of average-linkage clustering of a distance matrix; new clusters are numbered on."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), np.ones(n), []
    live = np.ones(n, bool)
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(np.where(live[:, None] & live[None, :], d, np.inf)), d.shape)
        i, j = min(i, j), max(i, j)
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), d[i, j], size[i] + size[j]))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        live[j] = False
        size[i] += size[j]
        ids[i] = n + step
    return np.array(out).reshape(-1, 4)


def match_rows(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """Pairs of rows of two matrices by falling absolute correlation, each row once."""
    za = (a - a.mean(axis=1, keepdims=True)) / np.maximum(a.std(axis=1, keepdims=True), 1e-300)
    zb = (b - b.mean(axis=1, keepdims=True)) / np.maximum(b.std(axis=1, keepdims=True), 1e-300)
    r = za @ zb.T / a.shape[1]
    free, out = np.abs(r), []
    for _ in range(min(r.shape)):
        i, j = np.unravel_index(np.argmax(free), r.shape)
        out.append((int(i), int(j), float(r[i, j])))
        free[i, :] = -1
        free[:, j] = -1
    return out


def huber_mean(y: np.ndarray, rho: float = 1.0, steps: int = 100) -> np.ndarray:
    """Robust mean over rows of ``(channel, time)`` by reweighting residuals beyond ``rho`` scaled deviations."""
    m = np.median(y, axis=0)
    for _ in range(steps):
        r = y - m
        s = np.median(np.abs(r)) / 0.6745 + 1e-300
        w = np.minimum(1.0, rho * s / np.maximum(np.abs(r), 1e-300))
        new = (w * y).sum(axis=0) / w.sum(axis=0)
        if np.abs(new - m).max() < 1e-9 * (1 + np.abs(m).max()):
            return new
        m = new
    return m


def running_line_detrend(x: np.ndarray, srate: float, window: float, step: float) -> np.ndarray:
    """Less the weighted mean of lines fitted in moving windows."""
    n, s = max(2, int(round(window * srate))), max(1, int(round(step * srate)))
    n = min(n, len(x))
    fit, weight = np.zeros(len(x)), np.zeros(len(x))
    t = np.arange(n)
    tri = 1 - np.abs((t - (n - 1) / 2) / (n / 2)) ** 3 + 1e-6
    for a in sorted({*range(0, len(x) - n + 1, s), len(x) - n}):
        k, c = np.polyfit(t, x[a : a + n], 1)
        fit[a : a + n] += tri * (k * t + c)
        weight[a : a + n] += tri
    return x - fit / weight


def linear_detrend(x: np.ndarray) -> np.ndarray:
    t = np.arange(x.shape[-1])
    t = t - t.mean()
    return x - x.mean(axis=-1, keepdims=True) - (x @ t / max((t**2).sum(), 1e-300))[..., None] * t


def spherical_spline(source: np.ndarray, target: np.ndarray, order: int = 4, terms: int = 30, smooth: float = 1e-5) -> np.ndarray:
    """Weights ``(target, source)`` that carry values on a sphere from source to target positions."""

    def unit(p: np.ndarray) -> np.ndarray:
        return p / np.linalg.norm(p, axis=1, keepdims=True)

    def g(cosine: np.ndarray) -> np.ndarray:
        x = np.clip(cosine, -1, 1)
        p0, p1, out = np.ones_like(x), x, np.zeros_like(x)
        for n in range(1, terms + 1):
            out += (2 * n + 1) / (n * (n + 1)) ** order * p1
            p0, p1 = p1, ((2 * n + 1) * x * p1 - n * p0) / (n + 1)
        return out / (4 * np.pi)

    s, t = unit(source), unit(target)
    k = len(s)
    full = np.zeros((k + 1, k + 1))
    full[:k, :k] = g(s @ s.T) + smooth * np.eye(k)
    full[:k, k] = full[k, :k] = 1
    return np.concatenate([g(t @ s.T), np.ones((len(t), 1))], axis=1) @ np.linalg.pinv(full)[:, :k]


def laplacian(grid: np.ndarray) -> np.ndarray:
    """Four-neighbour Laplacian of a map, edges repeated."""
    p = np.pad(grid, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grid


def gradient_map(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gy, gx = np.gradient(grid)
    return gx, gy


def regress_out(y: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Rows of ``y`` less their least-squares fit by the rows of ``reference`` and a constant."""
    a = np.concatenate([reference, np.ones((1, reference.shape[1]))]).T
    return y - (a @ np.linalg.lstsq(a, y.T, rcond=None)[0]).T


def nelder_mead(f: object, x0: np.ndarray, steps: int = 500, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Minimum of a function of several numbers without gradients."""
    n = len(x0)
    pts = [np.asarray(x0, float)] + [np.asarray(x0, float) + (0.05 * (abs(x0[i]) or 1)) * np.eye(n)[i] for i in range(n)]
    val = [f(p) for p in pts]  # type: ignore[operator]
    for _ in range(steps):
        o = np.argsort(val)
        pts, val = [pts[i] for i in o], [val[i] for i in o]
        if abs(val[-1] - val[0]) <= tol * (abs(val[0]) + tol):
            break
        mid = np.mean(pts[:-1], axis=0)
        move = lambda k: mid + k * (pts[-1] - mid)  # noqa: E731, B023
        r = move(-1.0)
        fr = f(r)  # type: ignore[operator]
        if fr < val[0]:
            e = move(-2.0)
            fe = f(e)  # type: ignore[operator]
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = move(-0.5 if fr < val[-1] else 0.5)
            fc = f(c)  # type: ignore[operator]
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0], *[pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]]
                val = [val[0], *[f(p) for p in pts[1:]]]  # type: ignore[operator]
    k = int(np.argmin(val))
    return pts[k], float(val[k])


def _lambda_moments(a: float, b: float) -> tuple[float, float, float, float]:
    """Central moments one to four of ``u^a - (1 - u)^b`` for uniform u; the first is the mean."""

    def beta(x: float, y: float) -> float:
        return math.exp(math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y))

    raw = [sum((-1) ** j * math.comb(k, j) * beta(1 + a * (k - j), 1 + b * j) for j in range(k + 1)) for k in range(1, 5)]
    m1, m2, m3, m4 = raw
    return m1, m2 - m1**2, m3 - 3 * m1 * m2 + 2 * m1**3, m4 - 4 * m1 * m3 + 6 * m1**2 * m2 - 3 * m1**4


def lambda_fit(mean: float, sd: float, skew: float, kurt: float) -> tuple[float, float, float, float]:
    """Generalised lambda distribution with the given moments (kurtosis of the normal one: 3).

    Its quantile function is ``l1 + (p^l3 - (1 - p)^l4) / l2``. Shapes are searched
    without gradients, place and scale follow.
    """

    def miss(x: np.ndarray) -> float:
        if min(x) <= 1e-3 or max(x) > 5:
            return 1e6
        _, v, m3, m4 = _lambda_moments(float(x[0]), float(x[1]))
        return (m3 / v**1.5 - skew) ** 2 + (m4 / v**2 - kurt) ** 2

    shape, _ = nelder_mead(miss, np.array([0.135, 0.135]), 2000, 1e-14)
    m1, v, _, _ = _lambda_moments(float(shape[0]), float(shape[1]))
    l2 = math.sqrt(v) / sd
    return mean - m1 / l2, l2, float(shape[0]), float(shape[1])


def lambda_tail(x: float, params: tuple[float, float, float, float]) -> float:
    """Share of the distribution above a value."""
    l1, l2, l3, l4 = params
    lo, hi = 0.0, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if l1 + (p**l3 - (1 - p) ** l4) / l2 < x else (lo, p)
    return 1 - (lo + hi) / 2


# ---------------------------------------------------------------- sources


def champagne(y: np.ndarray, lead: np.ndarray, noise: np.ndarray, steps: int = 80, per_voxel: int = 1, update: str = "convex", noise_update: str | None = None, tol: float = 1e-16, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Sparse Bayesian inverse: (variances, weights ``(source, sensor)``, noise covariance, likelihoods).

    ``y`` is (sensor, time), ``lead`` (sensor, voxel x axis) with a voxel's axes side
    by side. Each step sets the model covariance, from it the weights, and from the
    mean source powers new variances: ``convex`` or ``mackay`` fixed points, or
    ``em``. Unless ``diagonal``, a voxel's axes share one variance. ``noise_update``
    is None or one of scalar, mackay, convex, em.
    """
    n, t = y.shape
    s = lead.shape[1]
    inv = lead.T / (lead**2).sum(axis=0)[:, None]
    v = np.full(s, ((inv @ y) ** 2).mean())
    cyy = y @ y.T / t
    sigma, like = noise.astype(float).copy(), []

    def pooled(x: np.ndarray) -> np.ndarray:
        return x if diagonal or per_voxel == 1 else np.repeat(x.reshape(-1, per_voxel).sum(axis=1), per_voxel)

    w = np.zeros((s, n))
    for _ in range(steps):
        c = lead * v @ lead.T + sigma
        val, vec = np.linalg.eigh(c)
        val = np.maximum(val, 1e-300)
        ci = vec / val @ vec.T
        like.append(float(-0.5 * (np.log(val).sum() + np.trace(ci @ cyy))))
        fc = lead.T @ ci
        w = v[:, None] * fc
        power = np.einsum("ij,jk,ik->i", w, cyy, w)
        gain = np.einsum("ij,ji->i", fc, lead)
        if update == "convex":
            v = np.sqrt(np.maximum(pooled(power), 0) / np.maximum(pooled(gain), 1e-300))
        elif update == "mackay":
            v = np.maximum(pooled(power), 0) / np.maximum(pooled(v * gain), 1e-300)
        else:
            v = pooled(power + v - v * gain * v) / (1 if diagonal or per_voxel == 1 else per_voxel)
        if noise_update:
            r = np.eye(n) - lead @ w
            res = r @ cyy @ r.T
            gone = sigma @ ci
            if noise_update == "scalar":
                sigma = np.eye(n) * (np.trace(res) / max(np.trace(gone), 1e-300))
            elif noise_update == "mackay":
                sigma = np.diag(np.diag(res) / np.maximum(np.diag(gone), 1e-300))
            elif noise_update == "convex":
                sigma = np.diag(np.sqrt(np.maximum(np.diag(res), 0) / np.maximum(np.diag(ci), 1e-300)))
            else:
                full = res + sigma - sigma @ ci @ sigma
                sigma = np.diag(np.diag(full)) if diagonal else (full + full.T) / 2
        if len(like) > 1 and abs(like[-1] - like[-2]) / t <= tol:
            break
    return v, w, sigma, like


def champagne_blocks(y: np.ndarray, lead: np.ndarray, noise: np.ndarray, per_voxel: int, steps: int = 50, prune: float = 1e-8, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(covariance block of each voxel, weights): full axis covariances, voxels whose trace falls below ``prune`` left out."""
    n, t = y.shape
    k = lead.shape[1] // per_voxel
    gamma = np.repeat(np.eye(per_voxel)[None], k, axis=0)
    blocks = lead.T.reshape(k, per_voxel, n)
    live = np.arange(k)
    for _ in range(steps):
        f = blocks[live]
        gf = np.einsum("vab,vbn->van", gamma[live], f)
        ci = np.linalg.pinv(np.einsum("vam,van->mn", f, gf) + noise)
        x = np.einsum("van,nm,mt->vat", gf, ci, y)
        z = np.einsum("van,nm,vbm->vab", f, ci, f)
        xx = np.einsum("vat,vbt->vab", x, x) / t
        val, vec = np.linalg.eigh((z + z.transpose(0, 2, 1)) / 2)
        root = np.sqrt(np.maximum(val, 1e-8))
        zh, zi = np.einsum("vab,vb,vcb->vac", vec, root, vec), np.einsum("vab,vb,vcb->vac", vec, 1 / root, vec)
        mid = zh @ xx @ zh
        mv, me = np.linalg.eigh((mid + mid.transpose(0, 2, 1)) / 2)
        new = zi @ np.einsum("vab,vb,vcb->vac", me, np.sqrt(np.maximum(mv, 0)), me) @ zi
        change = np.abs(new - gamma[live]).sum()
        gamma[live] = new
        gone = np.trace(new, axis1=1, axis2=2) < prune
        gamma[live[gone]] = 0
        live = live[~gone]
        if change < tol or not len(live):
            break
    gf = np.einsum("vab,vbn->van", gamma, blocks)
    ci = np.linalg.pinv(np.einsum("vam,van->mn", blocks, gf) + noise)
    return gamma, (gf @ ci).reshape(k * per_voxel, n)


def beamformer(y: np.ndarray, lead: np.ndarray, cov: np.ndarray, per_voxel: int = 3) -> np.ndarray:
    """One time course for each voxel: unit-gain minimum-variance weights, then the first principal axis."""
    inv = np.linalg.pinv(cov)
    k = lead.shape[1] // per_voxel
    out = np.zeros((k, y.shape[1]))
    for i in range(k):
        f = lead[:, i * per_voxel : (i + 1) * per_voxel]
        w = inv @ f @ np.linalg.pinv(f.T @ inv @ f)
        s = w.T @ y
        s = s - s.mean(axis=1, keepdims=True)
        out[i] = np.linalg.eigh(s @ s.T)[1][:, -1] @ s
    return out
