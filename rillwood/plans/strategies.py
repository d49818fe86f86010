"""What makes candidate splits and what judges them; learners take others in their place.

A generator gives the places of bins that a split may stand at (values up to and with the bin go left), from the bins' values
and weights and a source of randomness. An evaluator gives the worth of each of several splits, from what they put on the left
(a row a split, a column a target name) and from the whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Generator = Callable[[np.ndarray, np.ndarray, np.random.Generator], np.ndarray]
Evaluator = Callable[[np.ndarray, np.ndarray], np.ndarray]


def equal_mass(splits: int = 16) -> Generator:
    """The first bin up to which each k-th of ``splits`` shares of the weight is."""

    def places(keys: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        upto = np.cumsum(mass)
        return np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, splits) / splits))

    return places


def every_bin(keys: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return np.arange(len(keys))


def one_of(generator: Generator) -> Generator:
    """One of another's candidates at random, as extremely randomised trees take it."""

    def place(keys: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        found = generator(keys, mass, rng)
        found = found[found < len(keys) - 1]
        return found[rng.integers(len(found), size=1)] if len(found) else found

    return place


def entropies(counts: np.ndarray) -> np.ndarray:
    """Of each row, in bits; 0 for an empty one."""
    whole = counts.sum(axis=-1, keepdims=True)
    share = np.divide(counts, whole, out=np.zeros_like(counts), where=whole > 0)
    return -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(axis=-1)


def information_gain(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    tau = left.sum(axis=1) / whole.sum()
    return entropies(whole) - tau * entropies(left) - (1 - tau) * entropies(whole - left)


def gini_gain(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    def impurity(counts: np.ndarray) -> np.ndarray:
        n = counts.sum(axis=-1, keepdims=True)
        return 1 - (np.divide(counts, n, out=np.zeros_like(counts), where=n > 0) ** 2).sum(axis=-1)

    tau = left.sum(axis=1) / whole.sum()
    return impurity(whole) - tau * impurity(left) - (1 - tau) * impurity(whole - left)


def squared_gain(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """How much of the sum of squared errors two means take away; columns n, s and q."""
    (n, s), (m, t) = left[:, :2].T, whole[:2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((n > 0) & (n < m), s * s / n + (t - s) ** 2 / (m - n) - t * t / m, 0.0)


def value_gain(one: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Of a word against the others: H (1 - m) - m H(word) for the word with the least m H(word), nothing for the rest."""
    m = one.sum(axis=1) / whole.sum()
    cost = m * entropies(one)
    return np.where(np.arange(len(m)) == cost.argmin(), entropies(whole) * (1 - m) - cost, -np.inf)
