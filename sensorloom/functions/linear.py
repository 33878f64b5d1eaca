"""Linear class scores as column math (batch) and plain arithmetic (stream)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearScorer:
    """Softmax over ``intercept + coefficients · features`` per class, rounded before any comparison."""

    classes: tuple[str, ...]
    features: tuple[str, ...]
    intercepts: tuple[float, ...]
    coefficients: tuple[tuple[float, ...], ...]
    digits: int = 9

    def columns(self, prefix: str = "p_") -> dict[str, Column]:
        margins = []
        for b, weights in zip(self.intercepts, self.coefficients, strict=True):
            margin = F.lit(float(b))
            for f, w in zip(self.features, weights, strict=True):
                margin = margin + F.col(f) * F.lit(float(w))
            margins.append(margin)
        top = F.greatest(*margins)
        powers = [F.exp(m - top) for m in margins]
        total = sum(powers[1:], powers[0])
        return {prefix + c: F.round(p / total, self.digits) for c, p in zip(self.classes, powers, strict=True)}

    def score(self, values: dict[str, np.ndarray]) -> list[list[float]]:
        """Scores of each sample; ``values`` has the samples of a feature as one array."""
        return self.score_arrays(values).T.tolist()

    def score_arrays(self, values: dict[str, np.ndarray]) -> np.ndarray:
        """Scores, one line for each class."""
        margins = np.array(
            [
                b + sum(w * values[f] for f, w in zip(self.features, weights, strict=True))
                for b, weights in zip(self.intercepts, self.coefficients, strict=True)
            ]
        )
        powers = np.exp(margins - margins.max(axis=0))
        return rounded(powers / powers.sum(axis=0), self.digits)


def rounded(shares: np.ndarray, digits: int) -> np.ndarray:
    """``round`` of numbers from 0 to 1: the nearest decimal is the quotient of two integers, so only those near a tie go one by one."""
    if not 0 <= digits <= 12:
        return np.array([round(x, digits) for x in shares.ravel().tolist()]).reshape(shares.shape)
    scaled = shares * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
    out[near] = [round(x, digits) for x in shares[near].tolist()]
    return out


def trailing_statistics(elapsed: np.ndarray, values: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    """The batch window statistics of every full window of ``rows`` samples; ``values`` has one line per signal."""
    x, y = (np.lib.stride_tricks.sliding_window_view(a, rows, axis=-1) for a in (elapsed, values))
    dx = x - x.mean(axis=-1, keepdims=True)
    mean = y.mean(axis=-1)
    dy = y - mean[..., None]
    with np.errstate(all="ignore"):
        slope = (dx * dy).sum(axis=-1) / (dx * dx).sum(axis=-1)  # not a number where a window has one time only
    return {
        "mean": mean, "std": np.sqrt((dy * dy).mean(axis=-1)), "min": y.min(axis=-1), "max": y.max(axis=-1), "slope": slope, "delta": y[..., -1] - y[..., 0],
    }


def frame_aggregates(
    values: Sequence[np.ndarray], times: Sequence[np.ndarray], some: Sequence[np.ndarray] | None = None, pairs: Sequence[np.ndarray] | None = None
) -> dict[str, np.ndarray]:
    """Mean, deviation, extremes and slope of many frames at once, by the updates of Spark's aggregates in their order.

    ``values[j]`` holds row j (oldest first) of every frame, one line per signal, and ``times[j]`` its time. ``some`` and
    ``pairs`` tell which rows have a value, and a value and a time; without them all have. ``none`` and ``slope_none``
    mark frames without a result.
    """
    take = lambda keep, new, old: new if keep is None else np.where(keep, new, old)
    zero = np.zeros(values[0].shape)
    count, total, mean, m2, low, high = zero, zero, zero, zero, np.full(zero.shape, np.nan), np.full(zero.shape, -np.inf)
    pair_count, time_mean, time_m2, value_mean, product = zero, zero, zero, zero, zero
    if some is None:
        count = pair_count = time_mean = time_m2 = 0.0  # alike for all signals
    with np.errstate(all="ignore"):
        for j, (x, t) in enumerate(zip(values, times)):
            keep, both = (None, None) if some is None else (some[j], pairs[j])
            first = count == 0
            total = take(keep, total + x, total)
            delta = x - mean
            step = delta / (count + 1.0)
            m2 = take(keep, m2 + delta * (delta - step), m2)
            mean = take(keep, mean + step, mean)
            low = take(keep, np.where(first | (x < low) | (low != low), x, low), low)
            high = take(keep, np.where(first | (x > high) | (x != x), x, high), high)
            count = take(keep, count + 1.0, count)
            shift = t - time_mean
            turn = shift / (pair_count + 1.0)
            moved = mean if keep is None else value_mean + (x - value_mean) / (pair_count + 1.0)
            product = take(both, product + shift * (x - moved), product)
            value_mean = take(both, moved, value_mean)
            time_m2 = take(both, time_m2 + shift * (shift - turn), time_m2)
            time_mean = take(both, time_mean + turn, time_mean)
            pair_count = take(both, pair_count + 1.0, pair_count)
        found = {"mean": total / count, "std": np.sqrt(m2 / count), "min": low, "max": high, "slope": product / time_m2}
    return found | {"none": np.broadcast_to(count == 0, zero.shape), "slope_none": np.array(np.broadcast_to(time_m2 == 0, zero.shape))}
