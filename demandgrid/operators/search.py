"""Search for good parameters from the trials so far.

After a few spread-out trials, a Gaussian process over the unit cube of the ranges predicts mean
and spread of the loss everywhere; the next trial is where the expected improvement over the best is
largest. A trial is first judged on a share of the work, and given up when that is worse than
the median of what earlier trials had reached with the same share. Only parameters and losses are
held here: a number per trial, whatever the size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np

#: Trials before the first prediction, and points at which the improvement is compared.
FIRST_TRIALS, CANDIDATES = 5, 2000
#: Share of the work after which a trial may be given up, and trials to have before any is.
EARLY_SHARE, EARLY_AFTER = 0.25, 4
_NOISE = 1e-5


@dataclass(frozen=True)
class Range:
    """Values from ``low`` to ``high``; evenly in the logarithm, or whole numbers only, if asked for."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, u: float) -> float | int:
        if self.log:
            x = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        else:
            x = self.low + u * (self.high - self.low)
        return int(min(self.high, max(self.low, round(x)))) if self.whole else float(min(self.high, max(self.low, x)))


@dataclass(frozen=True)
class Trial:
    """``loss`` after ``share`` of the work: 1.0 unless the trial was given up."""

    number: int
    params: dict[str, float | int]
    loss: float
    share: float


def _kernel(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)) / scale * math.sqrt(5)
    return (1 + d + d * d / 3) * np.exp(-d)


def _process(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Length scale of the largest likelihood, the factor of its covariance, and the weights of the points."""
    best = None
    for scale in (0.1, 0.2, 0.35, 0.6, 1.0, 2.0):
        factor = np.linalg.cholesky(_kernel(x, x, scale) + _NOISE * np.eye(len(x)))
        weights = np.linalg.solve(factor.T, np.linalg.solve(factor, y))
        likelihood = -0.5 * y @ weights - np.log(np.diag(factor)).sum()
        if best is None or likelihood > best[0]:
            best = likelihood, scale, factor, weights
    return best[1:]


_ERF = np.vectorize(math.erf)


def propose(x: np.ndarray, losses: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The point of the unit cube with the largest expected improvement."""
    y = (losses - losses.mean()) / (losses.std() or 1.0)
    scale, factor, weights = _process(x, y)
    near = x[np.argmin(y)] + rng.normal(0, 1, (CANDIDATES // 2, x.shape[1])) * 10.0 ** rng.uniform(-2.5, -0.8, (CANDIDATES // 2, 1))
    points = np.clip(np.concatenate([rng.random((CANDIDATES // 2, x.shape[1])), near]), 0, 1)
    k = _kernel(points, x, scale)
    mean = k @ weights
    spread = np.sqrt(np.maximum(1e-12, 1 - (np.linalg.solve(factor, k.T) ** 2).sum(axis=0)))
    z = (y.min() - mean) / spread
    gain = spread * (z * 0.5 * (1 + _ERF(z / math.sqrt(2))) + np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    return points[np.argmax(gain)]


def minimise(
    loss: Callable[[dict[str, float | int], float], float], space: Mapping[str, Range], trials: int, seed: int = 42, early: bool = True
) -> list[Trial]:
    """``trials`` trials in the order made; ``loss(params, share)`` is what ``share`` of the work reaches.

    The same seed and losses give the same trials. With ``early``, a trial that is worse after ``EARLY_SHARE`` of the work than the
    median of the earlier ones there keeps that loss and gets no more work.
    """
    rng = np.random.default_rng(seed)
    names = sorted(space)
    first = min(trials, FIRST_TRIALS)
    # One point in each of ``first`` slices of every range.
    spread = np.stack([(rng.permutation(first) + rng.random(first)) / max(1, first) for _ in names], axis=1)
    points: list[np.ndarray] = []
    early_losses: list[float] = []

    def expected() -> np.ndarray:
        """Losses after all the work: those of trials given up, with what the work after that brought the others."""
        gains = [t.loss - e for t, e in zip(out, early_losses) if t.share == 1.0]
        rest = float(np.median(gains)) if gains else 0.0
        return np.array([t.loss + (rest if t.share < 1.0 else 0.0) for t in out])

    out: list[Trial] = []
    for number in range(trials):
        u = spread[number] if number < first else propose(np.array(points), expected(), rng)
        params = {n: space[n].at(float(v)) for n, v in zip(names, u)}
        value, share = None, 1.0
        if early:
            value = loss(params, EARLY_SHARE)
            if len(early_losses) >= EARLY_AFTER and value > float(np.median(early_losses)):
                share = EARLY_SHARE
            early_losses.append(value)
        if share == 1.0:
            value = loss(params, 1.0)
        points.append(u)
        out.append(Trial(number, params, float(value), share))
    return out
