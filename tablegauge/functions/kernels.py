"""Explicit features whose inner products approximate kernels; their number does not depend on the width."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class RandomFourier:
    """``exp(-gamma |x - y|^2)`` by random waves."""

    width: int
    n_components: int
    seed: int
    gamma: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        waves = rng.normal(scale=np.sqrt(2 * self.gamma), size=(self.width, self.n_components))
        shift = rng.uniform(0, 2 * np.pi, self.n_components)
        return np.sqrt(2.0 / self.n_components) * np.cos(x @ waves + shift)


@dataclass(frozen=True)
class TensorSketch:
    """``(gamma x.y + offset)^degree`` by hashed products.

    The features of a power are all products of ``degree`` entries.  Each factor is hashed into
    ``n_components`` signed buckets; the hash of a product is the circular convolution of the
    factors' hashes, so the products are never formed, whatever their number.
    """

    width: int
    n_components: int
    seed: int
    degree: int
    gamma: float = 1.0
    offset: float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        x = np.sqrt(self.gamma) * x
        if self.offset:
            x = np.hstack([x, np.full((len(x), 1), np.sqrt(self.offset))])
        product = 1.0
        for _ in range(self.degree):
            bucket = rng.integers(0, self.n_components, self.width + 1)[: x.shape[1]]
            sign = rng.choice([-1.0, 1.0], self.width + 1)[: x.shape[1]]
            # Entries by bucket, so that a bucket is a run of columns.
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            hashed = np.zeros((len(x), self.n_components))
            hashed[:, used] = np.add.reduceat((x * sign)[:, order], first, axis=1)
            product = product * np.fft.rfft(hashed, axis=1)
        return np.fft.irfft(product, self.n_components, axis=1)
