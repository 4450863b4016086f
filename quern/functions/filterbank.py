"""Mel filter banks of waveforms: framing, window, power spectrum and mel weights, whole rows at a time in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least energy whose logarithm is taken: the distance from 1 to the next 32-bit float.
LEAST = float(np.finfo(np.float32).eps)


@dataclass(frozen=True)
class Form:
    """How features are made; lengths in ms, frequencies in Hz (a highest of 0 or less counts down from half the rate), floor of a frame's own energy."""

    rate: int = 16000
    bins: int = 80
    length: float = 25.0
    shift: float = 10.0
    dither: float = 0.0
    window: str = "hamming"
    energy: bool = False
    low: float = 20.0
    high: float = 0.0
    energy_last: bool = False
    emphasis: float = 0.97
    floor: float = 1.0
    seed: int = 0

    @property
    def samples(self) -> tuple[int, int, int]:
        """Samples of a frame, from one to the next, and of the Fourier transform."""
        n, step = int(self.rate * self.length / 1000), int(self.rate * self.shift / 1000)
        if n < 2 or step < 1:
            raise ValueError("frames of two samples at least, a sample or more apart")
        return n, step, 1 << (n - 1).bit_length()


def window(name: str, n: int) -> np.ndarray:
    turn = 2 * np.pi * np.arange(n) / (n - 1)
    shapes = {
        "hamming": 0.54 - 0.46 * np.cos(turn),
        "hanning": 0.5 - 0.5 * np.cos(turn),
        "povey": (0.5 - 0.5 * np.cos(turn)) ** 0.85,
        "blackman": 0.42 - 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn),
        "rectangular": np.ones(n),
    }
    if name not in shapes:
        raise ValueError(f"no window {name}; there are: {', '.join(shapes)}")
    return shapes[name]


def mel(f):
    return 1127.0 * np.log1p(np.asarray(f, float) / 700.0)


def weights(form: Form) -> np.ndarray:
    """The weight of each frequency below half the rate in each bin: triangles that are even and half overlap in mel."""
    size, half = form.samples[2], form.rate / 2
    high = form.high if form.high > 0 else half + form.high
    if not 0 <= form.low < high <= half:
        raise ValueError(f"no frequencies from {form.low} to {high} at a rate of {form.rate}")
    edges = np.linspace(mel(form.low), mel(high), form.bins + 2)
    at = mel(np.arange(size // 2) * form.rate / size)
    left, middle, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((at - left) / (middle - left), (right - at) / (right - middle)))


def filter_bank(samples: np.ndarray, form: Form, seed: int = 0) -> np.ndarray:
    """Log energies, a row for each frame that lies wholly within the samples; a waveform shorter than a frame has none.

    A frame loses its mean, gets its high frequencies raised, and is windowed.  With dither noise of that deviation,
    which the seeds alone decide, is added to the samples of each frame.
    """
    n, step, size = form.samples
    x = np.asarray(samples, float)
    if len(x) < n:
        return np.zeros((0, form.bins + form.energy))
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    if form.dither:
        frames = frames + form.dither * np.random.default_rng([form.seed, seed]).standard_normal(frames.shape)
    frames = frames - frames.mean(1, keepdims=True)
    raw = np.log(np.maximum((frames**2).sum(1), max(LEAST, form.floor)))
    before = np.concatenate([frames[:, :1], frames[:, :-1]], 1)
    frames = (frames - form.emphasis * before) * window(form.window, n)
    power = np.abs(np.fft.rfft(frames, size)[:, : size // 2]) ** 2
    out = np.log(np.maximum(power @ weights(form).T, LEAST))
    if form.energy:
        out = np.concatenate([out, raw[:, None]] if form.energy_last else [raw[:, None], out], 1)
    return out


def low_frame_rate(frames: np.ndarray, m: int, n: int) -> np.ndarray:
    """m neighbouring frames become one, every n frames; the first stands before the start, the last behind the end."""
    count = -(-len(frames) // n)
    if not count:
        return np.zeros((0, m * frames.shape[1] if frames.ndim == 2 else 0))
    at = np.arange(count)[:, None] * n + np.arange(m) - (m - 1) // 2
    return frames[np.clip(at, 0, len(frames) - 1)].reshape(count, -1)


def features(samples: Column | str, form: Form, seed: Column | None = None, stack: tuple[int, int] | None = None) -> Column:
    """filter_bank() of each row's samples as an array of arrays, with low_frame_rate(*stack) of it if asked; null of null."""

    @F.pandas_udf("array<array<double>>")
    def each(x: pd.Series, s: pd.Series) -> pd.Series:
        def one(v, k):
            if v is None:
                return None
            out = filter_bank(v, form, int(k) & (1 << 63) - 1)
            return list(low_frame_rate(out, *stack) if stack else out)

        return pd.Series([one(v, k) for v, k in zip(x, s, strict=True)])

    return each(samples, F.lit(0) if seed is None else F.xxhash64(seed))
