"""Windows and filter taps, computed on the driver with numpy (a few hundred numbers at most)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class WindowType:
    """A cosine-sum window: coefficients, stop-band attenuation in dB, and whether both ends are equal."""

    name: str
    coefficients: tuple[float, ...]
    max_attenuation: float
    symmetric: bool

    def make_window(self, n: int) -> np.ndarray:
        if n == 1:
            return np.ones(1)
        angle = 2 * np.pi * np.arange(n) / (n - 1 if self.symmetric else n)
        return sum((-1) ** k * a * np.cos(k * angle) for k, a in enumerate(self.coefficients))


def hamming(a0: float = 25 / 46) -> WindowType:
    return WindowType("hamming", (a0, 1 - a0), 53.0, True)


HAMMING = hamming()
BLACKMAN = WindowType("blackman", (0.42, 0.5, 0.08), 74.0, False)
BLACKMAN_HARRIS = WindowType("blackman-harris", (0.35875, 0.48829, 0.14128, 0.01168), 92.0, False)


def tap_count(samp_rate: float, twidth: float, window: WindowType) -> int:
    n = int(window.max_attenuation * samp_rate / (22.0 * twidth))
    return n | 1


def low_pass(samp_rate: float, cutoff: float, twidth: float, window: WindowType = HAMMING) -> np.ndarray:
    """Windowed-sinc taps with gain 1 at frequency 0."""
    n = tap_count(samp_rate, twidth, window)
    k = np.arange(n) - (n - 1) // 2
    ideal = 2 * cutoff / samp_rate * np.sinc(2 * cutoff / samp_rate * k)
    taps = ideal * window.make_window(n)
    return taps / taps.sum()


def low_pass_complex(samp_rate: float, cutoff: float, twidth: float, window: WindowType = HAMMING) -> np.ndarray:
    return low_pass(samp_rate, cutoff, twidth, window).astype(complex)


def multiband(bands: list[tuple[float, float]], n: int, window: np.ndarray) -> np.ndarray | None:
    """Taps that pass the given bands (fractions of the Nyquist frequency); None for bad bands."""
    if n == 0 or len(window) != n:
        return None
    ideal = np.zeros(n)
    for lo, hi in bands:
        a, b = math.floor(lo * n / 2), math.ceil(hi * n / 2)
        if not 0 <= a <= b <= n:
            return None
        ideal[a:b] = ideal[n - b : n - a] = 1
    return np.roll(np.fft.ifft(ideal) * math.sqrt(n), n // 2) * window


def hilbert_taps(window: np.ndarray) -> np.ndarray:
    """Odd-length Hilbert transformer: windowed 1/k on odd places, with unit gain."""
    n = len(window)
    mid = (n - 1) // 2
    k = np.arange(n) - mid
    taps = np.where(k % 2 == 1, 1.0 / np.where(k == 0, 1, k), 0.0) * window
    odd = np.arange(1, mid + 1, 2)
    gain = 2 * sum((-1) ** ((i - 1) // 2) * taps[mid + i] for i in odd)
    return taps / abs(gain)
