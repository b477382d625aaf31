"""Numeric kernels against closed forms and direct computation."""

from __future__ import annotations

import numpy as np
import pytest

from quiescent.functions import kernels as K

FS = 200.0
T = np.arange(0, 4, 1 / FS)


def gain(sos, f):
    z = np.exp(2j * np.pi * f / FS)
    out = 1.0
    for s in sos:
        out = out * abs(np.polyval(s[:3], z) / np.polyval(s[3:], z))
    return out


@pytest.mark.parametrize(("kind", "edge", "flat", "gone", "half"), [("low", 50.0, 5.0, 95.0, 50.0), ("high", 0.5, 20.0, 0.01, 0.5), ("stop", (55.0, 65.0), 20.0, 60.0, 55.0), ("band", (8.0, 13.0), 10.2, 1.0, 8.0)])
def test_butterworth_responses(kind, edge, flat, gone, half):
    sos = K.butterworth(4, edge, FS, kind)
    assert abs(gain(sos, flat) - 1) < 0.02 and gain(sos, gone) < 0.02
    assert abs(gain(sos, half) - np.sqrt(0.5)) < 0.02
    assert all(np.abs(np.roots(s[3:])).max() < 1 for s in sos)


def test_sections_match_the_recursion():
    sos = K.butterworth(3, 30.0, FS)
    x = np.random.default_rng(0).standard_normal(777)
    got, _ = K.sos_filter(sos, x)
    y = x.copy()
    for b0, b1, b2, a0, a1, a2 in sos:
        out, u, v = np.empty_like(y), 0.0, 0.0
        for i, xi in enumerate(y):
            out[i] = (b0 * xi + u) / a0
            u, v = b1 * xi - a1 * out[i] + v, b2 * xi - a2 * out[i]
        y = out
    assert np.allclose(got, y)
    a, st = K.sos_filter(sos, x[:300])
    b, _ = K.sos_filter(sos, x[300:], st)
    assert np.allclose(np.concatenate([a, b]), got)


def test_zero_phase_keeps_phase_and_constants():
    sos = K.butterworth(4, 50.0, FS)
    x = np.sin(2 * np.pi * 5 * T)
    assert np.abs(K.zero_phase(sos, x) - x)[50:-50].max() < 5e-3
    assert np.allclose(K.zero_phase(sos, np.full(500, 3.0)), 3.0)
    both = K.zero_phase(sos, np.stack([x, 2 * x]))
    assert np.allclose(both[1], 2 * both[0])


def test_fir_designs():
    h = K.fir_sinc(100, 20.0, FS)
    low, high = (abs(np.polyval(h, np.exp(-2j * np.pi * f / FS))) for f in (5, 60))
    assert abs(low - 1) < 1e-2 and high < 1e-2
    ls = K.fir_least_squares(60, [0, 15, 25, 100], [1, 1, 0, 0], FS)
    assert np.allclose(ls, ls[::-1]) and abs(abs(np.polyval(ls, np.exp(-2j * np.pi * 5 / FS))) - 1) < 2e-2
    er = K.fir_equiripple(40, [0, 15, 25, 100], [1, 1, 0, 0], FS)
    l2 = K.fir_least_squares(40, [0, 15, 25, 100], [1, 1, 0, 0], FS)

    def worst(c):
        f = np.concatenate([np.linspace(0, 15, 200), np.linspace(25, 100, 800)])
        return np.abs(np.abs(np.polyval(c, np.exp(-2j * np.pi * f / FS))) - (f < 20)).max()

    assert worst(er) < 0.8 * worst(l2) and np.allclose(er, er[::-1])
    mp = K.minimum_phase(h)
    assert np.argmax(np.abs(mp)) < np.argmax(np.abs(h))
    x = np.random.default_rng(1).standard_normal(300)
    assert np.allclose(K.fir_apply(x, h)[60:-60], np.convolve(x, h, "same")[60:-60])
    assert np.abs(K.fft_brickwall(np.sin(2 * np.pi * 50 * T), FS, 0, 20)).max() < 1e-9


def test_resample():
    x = np.sin(2 * np.pi * 3 * T)
    y = K.resample(x, 1, 2)
    assert len(y) == len(x) // 2 and np.abs(y - x[::2])[20:-20].max() < 1e-2
    z = K.resample(x, 3, 2)
    assert len(z) == len(x) * 3 // 2 and np.abs(z - np.sin(2 * np.pi * 3 * np.arange(len(z)) / 300))[30:-30].max() < 1e-2


def test_spectra():
    x = 2 * np.sin(2 * np.pi * 10 * T) + np.random.default_rng(2).standard_normal(len(T)) * 0.1
    f, p = K.welch(x, FS, 200)
    assert f[p.argmax()] == 10 and abs(np.trapezoid(p, f) - x.var()) < 0.1 * x.var()
    assert abs(K.band_power(f, p, 8, 12) - 2) < 0.2
    v, c = K.dpss(128, 3.0, 5)
    assert np.allclose(v @ v.T, np.eye(5), atol=1e-8) and c[0] > 0.999
    f, p = K.multitaper(x, FS)
    assert abs(f[p.argmax()] - 10) < 0.5
    f, ft, amp = K.line_f_test(x, FS)
    assert abs(f[ft.argmax()] - 10) < 0.3
    noise = np.random.default_rng(3).standard_normal((2, len(T)))
    _, co = K.coherence(x, x + 0.01 * noise[0], FS)
    assert co[40] > 0.99
    clean = K.remove_line(noise[1] + 3 * np.sin(2 * np.pi * 60 * T), FS, 60.0)
    assert np.corrcoef(clean, noise[1])[0, 1] > 0.98
    tf = np.abs(K.morlet(x, FS, np.array([5.0, 10.0])))
    assert tf[1].mean() > 3 * tf[0].mean()
    f, _t, s = K.spectrogram(x, FS, 100, 50)
    assert f[s.mean(axis=1).argmax()] == 10


def test_trial_measures():
    rng = np.random.default_rng(5)
    locked = np.stack([K.morlet(np.sin(2 * np.pi * 10 * T) + 0.1 * rng.standard_normal(len(T)), FS, np.array([10.0])) for _ in range(10)])
    loose = np.stack([K.morlet(np.sin(2 * np.pi * 10 * T + rng.random() * 6.28), FS, np.array([10.0])) for _ in range(40)])
    assert K.intertrial(locked)[1][0, 300] > 0.98 and K.intertrial(loose)[1][0, 300] < 0.5
    assert K.phase_coherence(locked, locked)[0, 300] > 0.999
    am = (1 + np.sin(2 * np.pi * 3 * T)) * np.sin(2 * np.pi * 40 * T) + np.sin(2 * np.pi * 3 * T)
    assert K.phase_amplitude(am, FS, 3, 40) > 3 * K.phase_amplitude(np.sin(2 * np.pi * 3 * T) + np.sin(2 * np.pi * 40 * T), FS, 3, 40)
    x = np.zeros(100)
    x[30] = 1
    assert K.time_warp(x, np.array([30]), np.array([50])).argmax() == 50


def test_decompositions():
    rng = np.random.default_rng(6)
    t = np.arange(3000)
    s = np.stack([np.sign(np.sin(t / 31)), np.sin(t / 7.3), rng.laplace(size=3000)])
    mix = rng.standard_normal((3, 3))

    def found(w):
        r = np.abs(np.corrcoef(np.concatenate([w, s]))[:3, 3:])
        return r.max(axis=0).min()

    for fn in (K.fast_ica, K.jade, K.infomax_ica):
        assert found(fn(mix @ s)[1]) > 0.9, fn.__name__
    src = np.stack([np.sin(t / 31), np.sin(t / 7.3), np.convolve(rng.standard_normal(3000), np.ones(9), "same")])
    w = K.sobi(mix @ src)[1]
    assert np.abs(np.corrcoef(np.concatenate([w, src]))[:3, 3:]).max(axis=0).min() > 0.9
    vec, score, share = K.principal(mix @ s, 2)
    assert vec.shape == (3, 2) and score.shape == (2, 3000) and share[0] >= share[1]
    c = np.cov(K.sphere(mix @ s) @ (mix @ s))
    assert np.allclose(c, 4 * np.eye(3), atol=1e-6)
    load = rng.standard_normal((8, 3))
    r, rot = K.rotate(load)
    assert np.allclose(rot @ rot.T, np.eye(3)) and np.allclose((r**2).sum(), (load**2).sum())
    assert K.promax(load)[0].shape == (8, 3)
    pts = np.concatenate([rng.standard_normal((20, 2)), rng.standard_normal((20, 2)) + 20])
    lab, _ = K.kmeans(pts, 2, seed=1)
    assert len(set(lab[:20])) == 1 and lab[0] != lab[-1]
    d = np.abs(np.subtract.outer(np.array([0, 1, 10.0]), np.array([0, 1, 10.0])))
    assert K.average_linkage(d).tolist() == [[0, 1, 1, 2], [2, 3, 9.5, 3]]
    assert [p[:2] for p in sorted(K.match_rows(s, s[::-1]))] == [(0, 2), (1, 1), (2, 0)]


def test_fits_and_geometry():
    rng = np.random.default_rng(7)
    y = np.tile(np.sin(T), (9, 1)) + 0.01 * rng.standard_normal((9, len(T)))
    y[0] += 50
    assert np.abs(K.huber_mean(y) - np.sin(T)).max() < 0.1
    assert np.abs(K.linear_detrend(3 + 2 * T)).max() < 1e-9
    assert np.abs(K.running_line_detrend(3 + 2 * T, FS, 1.0, 0.5)).max() < 1e-9
    p = rng.standard_normal((12, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    w = K.spherical_spline(p[:10], p[:10])
    assert np.allclose(w @ p[:10, 0], p[:10, 0], atol=1e-2) and np.allclose(w.sum(axis=1), 1, atol=1e-6)
    assert K.laplacian(np.eye(3)).sum() == 0 and K.gradient_map(np.ones((3, 3)))[0].sum() == 0
    ref = rng.standard_normal((1, 400))
    assert np.abs(K.regress_out(5 * ref + 1, ref)).max() < 1e-9
    x, v = K.nelder_mead(lambda a: (a[0] - 1) ** 2 + (a[1] + 2) ** 2, np.zeros(2))
    assert np.allclose(x, [1, -2], atol=1e-3) and v < 1e-5


def test_sparse_sources():
    rng = np.random.default_rng(8)
    lead = rng.standard_normal((12, 60))
    y = np.outer(lead[:, 7] + 0.5 * lead[:, 8], np.sin(np.arange(80) / 5)) + 0.01 * rng.standard_normal((12, 80))
    noise = np.eye(12) * 1e-3
    for update in ("convex", "mackay", "em"):
        v, w, _, like = K.champagne(y, lead, noise, 60, 3, update, diagonal=False)
        assert v.reshape(-1, 3).sum(axis=1).argmax() == 2 and like[-1] >= like[0]
    for rule in ("scalar", "mackay", "convex", "em"):
        _v, _w, sigma, _l = K.champagne(y, lead, noise, 20, noise_update=rule)
        assert np.isfinite(sigma).all() and (np.diag(sigma) >= 0).all()
    gamma, w = K.champagne_blocks(y, lead, noise, 3)
    assert np.trace(gamma, axis1=1, axis2=2).argmax() == 2 and w.shape == (60, 12)
    course = K.beamformer(y, lead, y @ y.T / 80 + noise)
    assert course.shape == (20, 80) and abs(np.corrcoef(course[2], np.sin(np.arange(80) / 5))[0, 1]) > 0.98


def test_lambda_distribution():
    fit = K.lambda_fit(0.0, 1.0, 0.0, 3.0)
    assert abs(K.lambda_tail(1.96, fit) - 0.025) < 2e-3 and abs(K.lambda_tail(0.0, fit) - 0.5) < 1e-6
    right = K.lambda_fit(2.0, 3.0, 0.5, 3.0)
    p = (np.arange(20000) + 0.5) / 20000
    q = right[0] + (p ** right[2] - (1 - p) ** right[3]) / right[1]
    assert abs(q.mean() - 2) < 0.01 and abs(q.std() - 3) < 0.03 and abs((((q - 2) / 3) ** 3).mean() - 0.5) < 0.03
