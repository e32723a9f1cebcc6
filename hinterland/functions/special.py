"""Gamma-function family on arrays, for use inside tasks."""

from __future__ import annotations

import numpy as np

_SHIFT = 10


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers: recurrence up to x >= 10, then Stirling's series."""
    x = np.asarray(x, float)
    z, down = x + _SHIFT, np.zeros_like(x)
    for i in range(_SHIFT):
        down -= np.log(x + i)
    r = 1.0 / (z * z)
    tail = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z
    return down + (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + tail


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    z, down = x + _SHIFT, np.zeros_like(x)
    for i in range(_SHIFT):
        down -= 1.0 / (x + i)
    r = 1.0 / (z * z)
    return down + np.log(z) - 0.5 / z - r * (
        1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))
    )


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    z, down = x + _SHIFT, np.zeros_like(x)
    for i in range(_SHIFT):
        down += 1.0 / (x + i) ** 2
    r = 1.0 / (z * z)
    return down + 1.0 / z + 0.5 * r + r / z * (
        1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66)))
    )
