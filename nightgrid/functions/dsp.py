"""Signal kernels on one channel of one night. numpy only; design from the textbook formulas of digital filters and spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

TINY = np.finfo(float).tiny
#: Samples of a recording that a step is worked out for at once, where it needs room beside its result.
STRETCH = 1 << 18


def stretches(n: int, least: int = 0) -> Iterator[slice]:
    """``n`` samples one stretch after another, each of at least ``least`` but for the last."""
    size = max(STRETCH, least)
    return (slice(a, min(a + size, n)) for a in range(0, n, size))


def trailing(x: np.ndarray, n: int, statistic: str) -> np.ndarray:
    """A statistic of the last ``n`` values (fewer at the start), by pandas' name."""
    out, n = np.empty(len(x)), max(int(n), 1)
    for s in stretches(len(x), 4 * n):
        first = max(s.start - n + 1, 0)
        out[s] = getattr(pd.Series(x[first : s.stop]).rolling(n, min_periods=1), statistic)().to_numpy()[s.start - first :]
    return out


# --- filters -----------------------------------------------------------------------------------------------------


def butter_bandpass_sections(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of a digital Butterworth band-pass, by bilinear transform with pre-warping."""
    if not 0 < low < high < fs / 2:
        raise ValueError(f"band {low}-{high} Hz does not fit a rate of {fs} Hz")
    w1, w2 = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    bw, w0 = w2 - w1, np.sqrt(w1 * w2)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * bw / 2
    root = np.sqrt(half**2 - w0**2)
    poles = np.concatenate([half + root, half - root])
    z = (2 * fs + poles) / (2 * fs - poles)
    gain = (bw * 2 * fs) ** order / np.prod(2 * fs - poles)
    keep = sorted((p for p in z if p.imag > 1e-14), key=abs)
    real = sorted(p.real for p in z if abs(p.imag) <= 1e-14)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in keep] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    sections = np.array([[1.0, 0.0, -1.0, a1, a2] for a1, a2 in pairs])
    sections[:, :3] *= abs(gain.real) ** (1 / len(sections))
    return sections


def butter_edge_sections(order: int, edge: float, fs: float, high: bool) -> np.ndarray:
    """Second-order sections of a digital Butterworth low-pass, or of a high-pass, by bilinear transform with pre-warping."""
    w = 2 * fs * np.tan(np.pi * edge / fs)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    poles = w / proto if high else w * proto
    z = (2 * fs + poles) / (2 * fs - poles)
    zero, unit = (1.0, -1.0) if high else (-1.0, 1.0)
    out = []
    for p in z[z.imag > 1e-12]:
        out.append([1.0, -2 * zero, 1.0, -2 * p.real, abs(p) ** 2])
    for p in z[abs(z.imag) <= 1e-12].real:
        out.append([1.0, -zero, 0.0, -p, 0.0])
    out = np.array(out)
    # each section passes the far end of its band unchanged
    out[:, :3] *= ((1 + out[:, 3] * unit + out[:, 4]) / (out[:, 0] + out[:, 1] * unit + out[:, 2]))[:, None]
    return out


#: Samples that a filter works on as one matrix product.
BLOCK = 256


def _run_section(s: np.ndarray, x: np.ndarray, x0: float) -> np.ndarray:
    """One direct-form section started in the steady state of a constant input ``x0``; its output takes the input's place.

    Within a block the output is a matrix product of the block's input and of the two state values it starts with; only the
    state is carried from block to block.
    """
    b0, b1, b2, a1, a2 = s
    step, feed = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    powers = np.array(powers)
    reach = powers[:BLOCK] @ feed  # state that a unit input leaves after 1, 2, .. samples
    answer = np.concatenate([[b0], reach[: BLOCK - 1, 0]])
    i = np.arange(BLOCK)
    lag = i[None, :] - i[:, None]
    own = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)
    dc = (b0 + b1 + b2) / (1 + a1 + a2)
    p, q = (dc - b0) * x0, (b2 - a2 * dc) * x0
    (m00, m01), (m10, m11) = powers[BLOCK].tolist()
    for part in stretches(len(x)):
        n = part.stop - part.start
        rows = np.zeros((-(-n // BLOCK), BLOCK))
        rows.ravel()[:n] = x[part]
        starts = []
        for u, v in (rows @ reach[::-1]).tolist():
            starts.append((p, q))
            p, q = m00 * p + m01 * q + u, m10 * p + m11 * q + v
        x[part] = (rows @ own + np.array(starts) @ powers[:BLOCK, 0, :].T).ravel()[:n]
    return x


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd reflection at the ends."""
    n = len(x)
    pad = min(n - 1, 3 * (2 * len(sections) + 1))
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else np.array(x, float)
    for _ in range(2):
        for s in sections:
            ext = _run_section(s, ext, ext[0])
        ext = ext[::-1]
    return ext[pad : pad + n]


def bandpass(x: np.ndarray, fs: float, low: float, high: float, order: int = 3, safe: bool = False) -> np.ndarray:
    """Zero-phase band-pass; the upper edge is held below .99 of Nyquist; ``safe`` returns the input on a bad band."""
    x = np.asarray(x, float)
    try:
        return zero_phase(butter_bandpass_sections(order, low, min(high, 0.99 * fs / 2), fs), x) if len(x) > 1 else x
    except ValueError:
        if safe:
            return x
        raise


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal by the discrete Hilbert transform."""
    f = np.fft.rfft(x)
    f *= -1j
    f[0] = 0
    if len(x) % 2 == 0:
        f[-1] = 0
    turned = np.fft.irfft(f, len(x)) if len(x) > 1 else np.zeros(len(x))
    del f
    out = np.empty(len(x), complex)
    out.real, out.imag = x, turned
    return out


def envelope(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """amplitude envelope in a band; zeros if the band is above Nyquist."""
    return np.zeros(len(x)) if low >= fs / 2 else np.abs(analytic(bandpass(x, fs, low, high)))


# --- spectra -----------------------------------------------------------------------------------------------------


def tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    """Periodic Tukey window."""
    m = n + 1
    i = np.arange(n)
    edge = alpha * (m - 1) / 2
    w = np.ones(n)
    left, right = i < edge, i > (m - 1) - edge
    w[left] = 0.5 * (1 + np.cos(np.pi * (i[left] / edge - 1)))
    w[right] = 0.5 * (1 + np.cos(np.pi * (i[right] / edge - 2 / alpha + 1)))
    return w


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames of a series, or of each of several series of one length in rows."""
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., ::hop, :] if x.shape[-1] >= size else np.empty((*x.shape[:-1], 0, size))


#: Numbers in the frames that a spectrum is worked out of at once.
FRAME_NUMBERS = 1 << 20


def spectrogram_grid(n: int, fs: float, size: int, overlap: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequencies, frame centres in seconds, and hop of the frames of ``n`` samples."""
    hop = max(1, size - int(round(size * overlap)))
    return np.fft.rfftfreq(size, 1 / fs), (np.arange((n - size) // hop + 1 if n >= size else 0) * hop + size / 2) / fs, hop


def magnitude_blocks(x: np.ndarray, fs: float, size: int, overlap: float) -> Iterator[np.ndarray]:
    """Magnitudes (frames x bins) in density scaling, no detrending, some frames at a time: memory does not grow with the recording."""
    x, w = np.asarray(x, float), tukey(size)
    every = frames(x, size, spectrogram_grid(len(x), fs, size, overlap)[2])
    at_once = max(1, FRAME_NUMBERS // size)
    for i in range(0, len(every), at_once):
        yield np.abs(np.fft.rfft(every[i : i + at_once] * w)) / np.sqrt(fs * (w**2).sum())


def magnitude_spectrogram(x: np.ndarray, fs: float, size: int, overlap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """frequencies, frame centres in seconds, magnitudes of all frames: for short stretches."""
    f, t, _ = spectrogram_grid(len(x), fs, size, overlap)
    return f, t, np.concatenate([np.empty((0, len(f))), *magnitude_blocks(x, fs, size, overlap)])


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Power spectral density from half-overlapping Hann frames with their means removed; of each row, if there are rows."""
    x = np.asarray(x, float)
    size = min(size, x.shape[-1])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    f = frames(x, size, max(1, size // 2))
    p = (np.abs(np.fft.rfft((f - f.mean(-1, keepdims=True)) * w)) ** 2).mean(-2) / (fs * (w**2).sum())
    p[..., 1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / fs), p


def second_periodogram(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """power per second from two-second frames with a symmetric Hann window, half a second of zeros before, mean removed."""
    fs = int(round(fs))
    n = len(x) // fs
    half = fs // 2
    ext = np.concatenate([np.zeros(half), np.asarray(x, float), np.zeros(2 * fs)])
    f, at_once = frames(ext, 2 * fs, fs)[:n], max(1, FRAME_NUMBERS // (2 * fs))
    parts = [np.abs(np.fft.rfft((p - p.mean(1, keepdims=True)) * np.hanning(2 * fs))) ** 2 for p in (f[i : i + at_once] for i in range(0, n, at_once))]
    return np.fft.rfftfreq(2 * fs, 1 / fs), np.concatenate([np.empty((0, fs + 1)), *parts])


def band_power(freq: np.ndarray, power: np.ndarray, low: float, high: float) -> np.ndarray:
    """Sum over the half-open band."""
    return power[..., (freq >= low) & (freq < high)].sum(-1)


def db(x):
    """F9."""
    return 10 * np.log10(np.maximum(x, TINY))


def aperiodic(freq: np.ndarray, magnitude: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """residual log magnitude (frames x bins), exponent and intercept of a log-log line through 2-7 and 14-24 Hz (five bins at least)."""
    x = np.log10(np.maximum(freq, np.finfo(float).eps))
    fit = ((freq >= 2) & (freq <= 7)) | ((freq >= 14) & (freq <= 24))
    use = fit & np.isfinite(magnitude) & (magnitude > 0)
    y = np.log10(np.where(use, magnitude, 1.0))
    n = use.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mx, my = (use * x).sum(1) / n, y.sum(1) / n
        dx = np.where(use, x - mx[:, None], 0.0)
        slope = (dx * (y - my[:, None])).sum(1) / (dx**2).sum(1)
        slope[n < 5] = np.nan
        icept = my - slope * mx
    return np.log10(np.maximum(magnitude, TINY)) - icept[:, None] - slope[:, None] * x, -slope, icept


# --- peaks, beats, breaths ---------------------------------------------------------------------------------------


def local_peaks(x: np.ndarray) -> np.ndarray:
    """Middle index of every strict local maximum; flat tops count once."""
    if len(x) < 3:
        return np.empty(0, int)
    change = np.flatnonzero(np.diff(x) != 0)  # the last sample of each level
    up, down = (x[1:] > x[:-1])[change], (x[1:] < x[:-1])[change]
    k = np.flatnonzero(up[:-1] & down[1:])
    return (change[k] + 1 + change[k + 1]) // 2


def _low_before(heights: np.ndarray, valleys: np.ndarray) -> np.ndarray:
    """For each peak the lowest point on the way back to a higher peak (or the start); ``valleys[k]`` lies before peak k."""
    out, stack = np.empty(len(heights)), []
    for k, (h, low) in enumerate(zip(heights.tolist(), valleys.tolist())):
        while stack and stack[-1][0] <= h:
            low = min(low, stack.pop()[1])
        out[k] = low
        stack.append((h, low))
    return out


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the two lowest points on the way to higher ground; one pass over all local peaks."""
    every = np.union1d(local_peaks(x), peaks).astype(int)
    if not len(every):
        return np.empty(0)
    low = np.minimum.reduceat(x, np.concatenate([[0], every]))  # before the first peak, and from each peak to the next
    h = x[every]
    left, right = _low_before(h, low[:-1]), _low_before(h[::-1], low[:0:-1])[::-1]
    return (h - np.maximum(left, right))[np.searchsorted(every, peaks)]


def half_widths(x: np.ndarray, peaks: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Width of each peak at half its prominence ``heights``, between interpolated crossings."""
    out = np.empty(len(peaks))
    for k, (p, level) in enumerate(zip(peaks.tolist(), (x[peaks] - heights / 2).tolist())):
        edge = []
        for way in (-1, 1):
            span, found = 64, None
            while found is None:
                part = x[max(0, p - span) : p + 1][::-1] if way < 0 else x[p : p + span + 1]
                below = np.flatnonzero(part <= level)
                if len(below):
                    i = below[0]
                    found = i - ((level - part[i]) / (part[i - 1] - part[i]) if i and part[i] < level else 0.0)
                elif len(part) <= span:
                    found = float(len(part) - 1)
                span *= 4
            edge.append(found)
        out[k] = edge[0] + edge[1]
    return out


def spaced_peaks(x: np.ndarray, distance: int, prominence: np.ndarray | float = 0.0) -> np.ndarray:
    """Peaks at least ``distance`` apart (higher ones first) with the prominence asked for at their place."""
    p = local_peaks(x)
    at, keep = p.tolist(), [True] * len(p)
    for i in np.argsort(x[p], kind="stable")[::-1].tolist():
        if keep[i]:
            for way in (-1, 1):
                j = i + way
                while 0 <= j < len(at) and abs(at[j] - at[i]) < distance:
                    keep[j] = False
                    j += way
    p = p[np.array(keep, bool)]
    if not len(p):
        return p
    need = np.broadcast_to(prominence, len(x))[p]
    return p[prominences(x, p) >= need]


def moved_to_extremum(x: np.ndarray, peaks: np.ndarray, widths: np.ndarray, top: bool) -> np.ndarray:
    """each index moved to the highest (lowest) sample within half its width."""
    v = x if top else -x
    half = np.maximum(np.round(widths / 2).astype(int), 1)
    return np.array([a + int(np.argmax(v[a : p + h + 1])) for p, h in zip(peaks.tolist(), half.tolist()) for a in [max(p - h, 0)]], int)


def phase_extrema(cosine: np.ndarray, top: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """peaks (troughs) of the cosine of a phase, with widths at half prominence and prominences."""
    v = cosine if top else -cosine
    p = local_peaks(v)
    tall = prominences(v, p)
    return p, half_widths(v, p, tall), tall


def breath_extrema(x: np.ndarray, fs: float, cutoff: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """peaks and troughs of breathing with their widths: full swings of the phase of the .1-.5 Hz band, moved to the raw extremum."""
    cosine = np.cos(np.angle(analytic(bandpass(x, fs, 0.1, 0.5))))
    out = []
    for top in (True, False):
        p, width, tall = phase_extrema(cosine, top)
        ok = tall >= 1.9
        if cutoff > 0:
            ok &= (x[p] >= cutoff) if top else (x[p] <= -cutoff)
        at, first = np.unique(moved_to_extremum(x, p[ok], width[ok], top), return_index=True)
        out += [at, width[ok][first]]
    return tuple(out)


def clean_beats(rr_ms: np.ndarray, half: int = 4) -> np.ndarray:
    """300-2000 ms and within 20 % of the centred 9-beat median."""
    rr = np.asarray(rr_ms, float)
    med = pd.Series(rr).rolling(2 * half + 1, center=True, min_periods=3).median().to_numpy()
    return np.isfinite(rr) & (rr >= 300) & (rr <= 2000) & (np.abs(rr - med) <= 0.2 * med)


def dfa(x: np.ndarray, scales: tuple[int, ...] = (16, 20, 25, 32, 40, 50, 64)) -> float:
    """detrended fluctuation exponent; NaN for fewer than four of the largest boxes."""
    x = np.asarray(x, float)
    if len(x) < 4 * max(scales):
        return float("nan")
    y = np.cumsum(x - x.mean())
    f = []
    for s in scales:
        b = y[: len(y) // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        slope = (b * t).sum(1) / (t**2).sum()
        f.append(np.sqrt(((b - b.mean(1, keepdims=True) - slope[:, None] * t) ** 2).mean()))
    return float(np.polyfit(np.log(scales), np.log(np.maximum(f, TINY)), 1)[0])


def detrended(y: np.ndarray) -> np.ndarray:
    """Without its least-squares line; of each row, if there are rows."""
    t = np.arange(y.shape[-1]) - (y.shape[-1] - 1) / 2
    return y - y.mean(-1, keepdims=True) - t * (y @ t)[..., None] / (t @ t)


def ln_lf_hf(rr_ms: np.ndarray, fs: float = 4.0) -> float:
    """Log ratio of .04-.15 Hz to .15-.4 Hz power of beat intervals on an even grid of ``fs`` (at least 95 % of 300 s)."""
    if len(rr_ms) < 0.95 * 300 * fs or not np.isfinite(rr_ms).all():
        return float("nan")
    f, p = welch(detrended(rr_ms), fs, int(128 * fs))
    low, high = p[(f >= 0.04) & (f < 0.15)].sum(), p[(f >= 0.15) & (f <= 0.4)].sum()
    return float(np.log(low / high)) if low > 0 and high > 0 else float("nan")


def beat_band(x: np.ndarray, fs: float) -> np.ndarray:
    """The ECG in the band of the QRS complex, upright and scaled to a largest value of 1."""
    y = np.asarray(x, float) - np.nanmean(x)
    if len(y) < 32:
        return y
    if round(fs) == 200:
        y = zero_phase(butter_edge_sections(3, 5, fs, True), zero_phase(butter_edge_sections(3, 12, fs, False), y))
    else:
        high = min(15.0, 0.99 * fs / 2)
        y = bandpass(y, fs, min(5.0, 0.8 * high), high)
    y = -y if y.max() < -y.min() else y
    top = np.abs(y).max()
    return y / top if top > 0 else y


def r_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """R peaks by band-pass, slope energy, two adapting thresholds, a refractory time, T-wave rejection and search-back."""
    y = bandpass(x, fs, 5, min(15, 0.45 * fs), order=2, safe=True)
    w = max(1, int(0.15 * fs))
    energy = np.convolve(np.gradient(y) ** 2, np.ones(w) / w, "same")
    cand = spaced_peaks(energy, max(1, int(0.2 * fs)))
    if not len(cand):
        return cand
    first = energy[: int(2 * fs)]
    sig, noise, out, rr = first.max() * 0.5, first.mean() * 0.5, [], []
    best, a = -1, int(0.075 * fs)  # the strongest of the candidates passed over since the last beat

    def slope(p: int) -> float:
        return np.abs(np.gradient(y[max(0, p - a) : p + a + 1])).max() if a > 1 else 0.0

    for p in cand.tolist():
        thr = noise + 0.25 * (sig - noise)
        mean_rr = sum(rr[-8:]) / len(rr[-8:]) if rr else 0.0
        if mean_rr and p - out[-1] > 1.66 * mean_rr and best >= 0 and energy[best] > 0.5 * thr:
            rr.append(best - out[-1])
            out.append(best)
            sig = 0.25 * energy[best] + 0.75 * sig
        if energy[p] > thr:
            if out and p - out[-1] < 0.36 * fs and slope(p) < 0.5 * slope(out[-1]):
                noise = 0.125 * energy[p] + 0.875 * noise
                continue
            if out:
                rr.append(p - out[-1])
            out.append(p)
            best = -1
            sig = 0.125 * energy[p] + 0.875 * sig
        else:
            best = p if best < 0 or energy[p] > energy[best] else best
            noise = 0.125 * energy[p] + 0.875 * noise
    x = np.asarray(x, float)
    a, middle = max(1, int(0.08 * fs)), np.median(x)
    return np.unique([max(0, p - a) + int(np.argmax(np.abs(x[max(0, p - a) : p + a + 1] - middle))) for p in sorted(out)])


def spline_weights(n: int, at: np.ndarray) -> np.ndarray:
    """Weights (places x points) that give a not-a-knot cubic spline through ``n`` even points at places ``at``."""
    a, rhs = np.zeros((n, n)), np.zeros((n, n))
    a[0, :3] = a[-1, -3:] = [1, -2, 1]
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2], rhs[i, i - 1 : i + 2] = [1, 4, 1], [6, -12, 6]
    bend = np.linalg.solve(a, rhs)  # second derivatives, linear in the points
    i = np.clip(np.floor(at).astype(int), 0, n - 2)
    t = (at - i)[:, None]
    eye = np.eye(n)
    return (1 - t) * eye[i] + t * eye[i + 1] + (((1 - t) ** 3 - (1 - t)) * bend[i] + (t**3 - t) * bend[i + 1]) / 6


def refine_peaks(x: np.ndarray, peaks: np.ndarray, fs: float, half_window: float = 0.05, fine_hz: float = 1000.0) -> np.ndarray:
    """peak times in seconds between samples: top of a cubic spline of the .5-40 Hz ECG around each peak, in the record's polarity."""
    p = np.asarray(peaks, int)
    if not len(p) or len(x) < 16:
        return p / fs
    y = bandpass(np.asarray(x, float) - np.nanmean(x), fs, 0.5, min(40.0, 0.45 * fs), order=2)
    y = y if np.median(y[np.clip(p, 0, len(y) - 1)]) >= 0 else -y
    half = int(round(half_window * fs))
    fine = np.arange(-half, half + 1e-9, fs / fine_hz)
    out = p / fs
    inside = np.flatnonzero((p - half - 2 >= 0) & (p + half + 3 <= len(y)))
    near = y[p[inside, None] + np.arange(-half - 2, half + 3)]
    out[inside] = (p[inside] + fine[(near @ spline_weights(2 * half + 5, fine + half + 2).T).argmax(1)]) / fs
    return np.sort(out)


def breaths(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """breath peaks and prominences: .1-.7 Hz, 1.5 s apart, prominence .3 of the scaled rolling MAD over five minutes."""
    x = np.asarray(x, float)
    if len(x) < int(10 * fs):
        return np.empty(0, int), np.empty(0)
    y = bandpass(x - np.nanmean(x), fs, 0.1, min(0.7, 0.45 * fs), order=2)
    size = max(int(300 * fs), 3)
    around = lambda v: pd.Series(v).rolling(size, center=True, min_periods=max(size // 5, 1)).median().to_numpy()
    mad = 1.4826 * around(np.abs(y - around(y)))
    p = spaced_peaks(y, max(int(1.5 * fs), 1), 1e-12)
    tall = prominences(y, p)
    ok = tall >= 0.3 * mad[p]
    return p[ok], tall[ok]


def coherence(a: np.ndarray, b: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude-squared coherence from half-overlapping Hann frames; of each pair of rows, if there are rows."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    fa, fb = (frames(np.asarray(v, float), size, size // 2) for v in (a, b))
    A, B = (np.fft.rfft((f - f.mean(-1, keepdims=True)) * w) for f in (fa, fb))
    s = (np.abs(A) ** 2).mean(-2) * (np.abs(B) ** 2).mean(-2)
    return np.fft.rfftfreq(size, 1 / fs), np.abs((A * B.conj()).mean(-2)) ** 2 / np.maximum(s, TINY)


def slow_wave_mask(x: np.ndarray, fs: float, p2p: float = 75.0) -> np.ndarray:
    """samples inside .5-2 s waves of the .5-2 Hz band whose peak-to-peak height is large enough."""
    y = bandpass(np.nan_to_num(np.asarray(x, float)), fs, 0.5, min(2.0, 0.45 * fs), order=2)
    up = np.flatnonzero((y[:-1] < 0) & (y[1:] >= 0)) + 1  # a wave lasts from one upward crossing to the next
    if len(up) < 2:
        return np.zeros(len(y), bool)
    size = np.diff(up)
    height = (np.maximum.reduceat(y, up) - np.minimum.reduceat(y, up))[:-1]
    good = (size >= 0.5 * fs) & (size <= 2 * fs) & (height >= p2p)
    return np.concatenate([np.zeros(up[0], bool), np.repeat(good, size), np.zeros(len(y) - up[-1], bool)])


def _shifted(m: np.ndarray, by: int) -> np.ndarray:
    """``m[i + by]``, False outside."""
    out = np.zeros(len(m), bool)
    if abs(by) < len(m):
        if by >= 0:
            out[: len(m) - by] = m[by:]
        else:
            out[-by:] = m[:by]
    return out


def _taps(n: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """First and last offset of a structure of ``n`` samples in dilation and in erosion."""
    back = n // 2
    return ((-(n - 1 - back), back), (-back, n - 1 - back))


def closing(mask: np.ndarray, n: int) -> np.ndarray:
    """Binary closing with ``n`` samples in a row; what lies outside counts as False, so runs lose what touches an end."""
    m = np.asarray(mask, bool)
    (d0, d1), (e0, e1) = _taps(n)

    def held(mask: np.ndarray, lo: int, hi: int, least: int) -> np.ndarray:
        """Where at least ``least`` of the samples from ``lo`` to ``hi`` are set."""
        count, out = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)]), np.empty(len(mask), bool)
        for s in stretches(len(mask)):
            i = np.arange(s.start, s.stop)
            out[s] = count[np.minimum(i + hi + 1, len(mask))] - count[np.maximum(i + lo, 0)] >= least
        return out

    return held(held(m, d0, d1, 1), e0, e1, n)


def sparse_closing(mask: np.ndarray, n: int) -> np.ndarray:
    """dilation then erosion with two taps that have ``n`` samples between them; outside counts as False."""
    m = np.asarray(mask, bool)
    (d0, d1), (e0, e1) = _taps(n + 2)
    wide = _shifted(m, d0) | _shifted(m, d1)
    return _shifted(wide, e0) & _shifted(wide, e1)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (one past) of runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, bool).astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def filled(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of ``n`` samples that is True in the given ranges."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.clip(starts, 0, n), 1)
    np.add.at(step, np.clip(np.maximum(ends, starts), 0, n), -1)
    return np.cumsum(step, out=step)[:n] > 0


def touching(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Which of the half-open ranges a share a sample with any of the ranges b."""
    if not len(b0):
        return np.zeros(len(a0), bool)
    o = np.argsort(b0)
    latest = np.maximum.accumulate(b1[o])
    k = np.searchsorted(b0[o], a1) - 1  # ranges that begin before a ends
    return (k >= 0) & (latest[np.maximum(k, 0)] > a0)


def line_through(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Linear interpolation at 0..n-1, going on straight at both ends; zeros with fewer than two points."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok].astype(float), y[ok]
    if len(x) < 2:
        return np.zeros(n)
    out = np.empty(n)
    for s in stretches(n):
        i = np.arange(s.start, s.stop, dtype=float)
        v, head, tail = np.interp(i, x, y), i < x[0], i > x[-1]
        v[head] = y[0] + (i[head] - x[0]) * (y[1] - y[0]) / (x[1] - x[0])
        v[tail] = y[-1] + (i[tail] - x[-1]) * (y[-1] - y[-2]) / (x[-1] - x[-2])
        out[s] = v
    return out


def nearest_on(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """value of the nearest point (the earlier one half way), NaN outside the points."""
    if not len(x):
        return np.full(len(at), np.nan)
    mid, y, out = (x[:-1] + x[1:]) / 2, np.asarray(y, float), np.empty(len(at))
    for s in stretches(len(at)):
        out[s] = np.where((at[s] < x[0]) | (at[s] > x[-1]), np.nan, y[np.searchsorted(mid, at[s], "left")])
    return out


def nearest_mask(mask: np.ndarray, fs: float, to: float, n: int) -> np.ndarray:
    """A mask on another grid of ``n`` samples: that of the nearest sample, False past its end."""
    if fs == to:
        return np.pad(mask[:n], (0, max(n - len(mask), 0)))
    return nearest_on(np.arange(len(mask)) / fs, mask, np.arange(n) / to) > 0.5


def resampled(x: np.ndarray, fs: float, to: float, n: int) -> np.ndarray:
    """numbers on another even grid by straight lines, going on at the end."""
    return line_through(np.arange(len(x)) * (to / fs), np.asarray(x, float), n) if len(x) > 1 else np.zeros(n)


def block_rate(x: np.ndarray, fs: float, to: int, n: int) -> np.ndarray:
    """``n`` seconds at ``to`` values a second: means of equal blocks where the rate allows, else straight lines."""
    whole = int(round(fs))
    if whole == fs and whole % to == 0:
        return x[: n * whole].reshape(n * to, whole // to).mean(1)
    return np.interp((np.arange(n * to) + 0.5) / to, np.arange(len(x)) / fs, x)


def peak_baseline(t: np.ndarray, height: np.ndarray, ratio: float, all_count: bool, window: float = 120.0) -> tuple[np.ndarray, np.ndarray]:
    """for each peak the mean height of earlier peaks in the window that were no drop (of all where there is none, NaN
    without any), and whether it is a drop: below ``ratio`` of that. With ``all_count`` drops count for later means as well."""
    base, drop = np.full(len(t), np.nan), np.zeros(len(t), bool)
    first = np.searchsorted(t, t - window)
    total, kept, n_kept = np.concatenate([[0.0], np.cumsum(height)]), np.zeros(len(t) + 1), np.zeros(len(t) + 1, int)
    for i, a in enumerate(first.tolist()):
        if n_kept[i] > n_kept[a]:
            base[i] = (kept[i] - kept[a]) / (n_kept[i] - n_kept[a])
        elif i > a:
            base[i] = (total[i] - total[a]) / (i - a)
        drop[i] = height[i] < ratio * base[i]
        use = all_count or not drop[i]
        kept[i + 1], n_kept[i + 1] = kept[i] + (height[i] if use else 0.0), n_kept[i] + use
    return base, drop


def poor_airflow(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """starts and ends of stretches over two minutes whose strongest frequency (30-s frames, median over two minutes) is above .6 Hz.

    Marks stand at the frames' centres and gaps are closed by two taps five minutes apart, as surveyed: only rates at which frames
    lie a sample apart can give a run."""
    size = max(int(round(30 * fs)), 16)
    if len(x) < size:
        return np.empty(0, int), np.empty(0, int)
    step = size - min(int(round(size * 0.95)), size - 1)
    w = tukey(size)
    f = frames(np.asarray(x, float), size, step)
    top = np.fft.rfftfreq(size, 1 / fs)[np.concatenate([np.abs(np.fft.rfft((p - p.mean(1, keepdims=True)) * w)).argmax(1) for p in np.array_split(f, max(1, len(f) // 512))])]
    smooth = pd.Series(top).rolling(max(int(round(120 * fs / step)), 1), min_periods=1).median().to_numpy()
    mask = np.zeros(len(x), bool)
    at = np.round((np.arange(len(f)) * step + size / 2)).astype(int)
    mask[np.clip(at, 0, len(x) - 1)] = smooth > 0.6
    a, b = runs(sparse_closing(mask, max(int(round(300 * fs)), 1)))
    long = b - a > round(120 * fs)
    return a[long], b[long]


def adaptive_baseline(peaks: np.ndarray, heights: np.ndarray, window: float = 120.0, ratio: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """for each peak the mean height of earlier peaks in the window that were no drop (of all, if there is none), and whether it is one."""
    base, drop = np.empty(len(peaks)), np.zeros(len(peaks), bool)
    for i in range(len(peaks)):
        near = np.flatnonzero((peaks[:i] >= peaks[i] - window))
        good = near[~drop[near]]
        use = good if len(good) else near
        base[i] = heights[use].mean() if len(use) else heights[i]
        drop[i] = heights[i] < ratio * base[i]
    return base, drop
