"""One-dimensional weights."""

from __future__ import annotations


def exp_weights(window: int, half_life: int) -> list[float]:
    """Weights that halve every ``half_life`` steps into the past; the newest, last, is 1."""
    for name, value in (("window", window), ("half_life", half_life)):
        if not isinstance(value, int) or isinstance(value, bool):
            raise TypeError(f"{name} must be an integer")
        if value <= 0:
            raise ValueError(f"{name} must be positive")
    return [2.0 ** (-age / half_life) for age in range(window - 1, -1, -1)]
