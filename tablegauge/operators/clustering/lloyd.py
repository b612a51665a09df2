"""The steps of k-means that a table's tasks and a bag's task share, so that both label alike."""

from __future__ import annotations

import numpy as np

#: A start ends when no centre moves farther, or after so many rounds.
TOLERANCE, ROUNDS = 1e-4, 300
#: Distances held at once.
DISTANCES = 2_000_000


def squares(x: np.ndarray, centers: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """Squared distances, rows by centres; ``norms`` are the squares of the rows if they are known."""
    norms = (x * x).sum(1) if norms is None else norms
    out = norms[:, None] - 2.0 * x @ centers.T
    out += (centers * centers).sum(1)
    return np.maximum(out, 0.0, out=out)


def spread_centers(sample: np.ndarray, k: int, rng: np.random.Generator, tries: int = 5) -> np.ndarray:
    """``k`` rows of the sample, each drawn by its squared distance to those before it; of several
    draws the one that lowers the cost most is kept."""
    centers = [sample[rng.integers(len(sample))]]
    near = squares(sample, centers[0][None])[:, 0]
    while len(centers) < k:
        total = near.sum()
        if total <= 0:
            centers.append(sample[rng.integers(len(sample))])
            continue
        drawn = rng.choice(len(sample), tries, p=near / total)
        options = np.minimum(near[:, None], squares(sample, sample[drawn]))
        best = options.sum(0).argmin()
        centers.append(sample[drawn[best]])
        near = options[:, best]
    return np.array(centers)


def first_centers(sample: np.ndarray, k: int, n_init: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, k, d)`` first centres, and the middle point they are relative to.

    Rows are taken in the order of their values: the starts depend on the rows only.
    """
    # Distances are taken from a middle point: large offsets would cost digits.
    middle = sample.mean(0)
    sample = sample[np.lexsort(sample.T[::-1])] - middle
    rng = np.random.default_rng(seed)
    return np.stack([spread_centers(sample, k, rng) for _ in range(n_init)]), middle


def sums(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """``(starts * k, d + 2)``: sum of the rows nearest to each centre, their number, their cost."""
    count, k, d = centers.shape
    out = np.zeros((count * k, d + 2))
    step = max(1, DISTANCES // k)
    for at in range(0, len(x), step):
        some = x[at: at + step]
        rows, norms = np.arange(len(some)), (some * some).sum(1)
        for s in range(count):
            square = squares(some, centers[s], norms)
            nearest = square.argmin(1)
            here = np.zeros((len(some), k))
            here[rows, nearest] = 1.0
            mine = out[s * k: (s + 1) * k]
            mine[:, :-2] += here.T @ some
            mine[:, -2] += np.bincount(nearest, minlength=k)
            mine[:, -1] += here.T @ square[rows, nearest]
    return out


def moved(found: np.ndarray, centers: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The means that follow from :func:`sums`, and which starts stand still; a centre without rows
    stays where it is."""
    found = found.reshape(*centers.shape[:2], -1)
    sizes = found[..., -2:-1]
    new = np.where(sizes > 0, found[..., :-2] / np.maximum(sizes, 1.0), centers)
    return new, np.sqrt(((new - centers) ** 2).sum(2)).max(1) <= tolerance


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    middle = centers.mean(0)
    return squares(x - middle, centers - middle).argmin(1)
