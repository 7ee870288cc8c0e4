"""Small tables for spectra, built on the driver; their size depends on parameters only."""

from __future__ import annotations

import math


def hz_to_mel(f: float) -> float:
    return 2595.0 * math.log10(1.0 + f / 700.0)


def mel_to_hz(m: float) -> float:
    return 700.0 * (10.0 ** (m / 2595.0) - 1.0)


def hann(n: int, periodic: bool = False) -> list[float]:
    """Raised cosine; symmetric unless periodic."""
    span = n if periodic else n - 1
    return [1.0] * n if n <= 1 else [0.5 - 0.5 * math.cos(2 * math.pi * i / span) for i in range(n)]


def mel_filters(n_fft: int, sample_rate: int, n_mels: int, low: float = 0.0, high: float | None = None) -> list[tuple[int, int, float]]:
    """(mel, bin, weight) of triangles between evenly spaced mel points; a side without width counts 1 wide."""
    top, bins = high or sample_rate / 2.0, n_fft // 2 + 1
    a, z = hz_to_mel(low), hz_to_mel(top)
    corner = [math.floor((n_fft + 1) * mel_to_hz(a + (z - a) * i / (n_mels + 1)) / sample_rate) for i in range(n_mels + 2)]
    out = []
    for m in range(n_mels):
        left, mid, right = corner[m : m + 3]
        for k in range(bins):
            if left <= k < mid:
                w = (k - left) / ((mid - left) or 1)
            elif mid <= k < right:
                w = (right - k) / ((right - mid) or 1)
            else:
                continue
            if w > 0:
                out.append((m, k, w))
    return out
