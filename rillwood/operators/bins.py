"""Bins of a value with target sums that merge over tasks, batches and streams.

Bins stand at the largest value they hold, in order, and carry a weight for each target name: a label, or n, s and q (weight,
sum and sum of squares of a numeric target). Merging adds what stands at the same value, so it is exact, whatever the order,
as long as there are no more values than bins; past that the two neighbours that are lightest together become one, again and
again. What a split at a bin puts on the left is then wrong by the rows that joins have moved up to it: a join moves no more
than the lighter two of the neighbours, so a bin that holds much of a leaf stays where it is. Words aren't joined: each has a
bin.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SUMS = ["n", "s", "q"]
#: Columns of a table of bins, beside those that say whose they are.
COLUMNS = "numbers array<double>, words array<string>, names array<string>, weights array<double>"


@dataclass
class Bins:
    keys: np.ndarray
    names: list[str]
    weights: np.ndarray  # a row a bin

    @property
    def numeric(self) -> bool:
        return self.keys.dtype != object

    @property
    def mass(self) -> np.ndarray:
        return self.weights[:, 0] if self.names == SUMS else self.weights.sum(axis=1)

    def row(self) -> tuple:
        keys = self.keys.tolist()
        return (keys, None, self.names, self.weights.ravel().tolist()) if self.numeric else (None, keys, self.names, self.weights.ravel().tolist())

    @classmethod
    def of(cls, numbers: list | None, words: list | None, names: list[str], weights: list[float]) -> Bins:
        keys = np.array(numbers, np.float64) if words is None else np.array(words, object)
        return cls(keys, list(names), np.array(weights, np.float64).reshape(len(keys), len(names)))


def _joined(mass: np.ndarray, most: int) -> np.ndarray:
    """The number of the bin that each of the bins goes to, ``most`` of them."""
    n = len(mass)
    if n > 4 * most:  # first by equal mass, so that the search below is short
        before = np.cumsum(mass) - mass
        step = np.floor(before / (mass.sum() / (4 * most)))
        first = np.cumsum(np.append(True, step[1:] != step[:-1])) - 1
        return _joined(np.bincount(first, weights=mass), most)[first]
    left, right, weight = list(range(-1, n - 1)), list(range(1, n + 1)), mass.tolist()
    alive, heap = [True] * n, [(weight[i] + weight[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    for _ in range(n - most):
        while True:
            w, i, j = heapq.heappop(heap)
            if alive[i] and alive[j] and right[i] == j and w == weight[i] + weight[j]:
                break
        alive[i] = False  # the upper one stays
        weight[j] = w
        left[j] = left[i]
        if left[i] >= 0:
            right[left[i]] = j
            heapq.heappush(heap, (weight[left[i]] + w, left[i], j))
        if right[j] < n:
            heapq.heappush(heap, (w + weight[right[j]], j, right[j]))
    stays = np.array(alive)
    return np.cumsum(stays) - stays  # a bin that goes counts with the next that stays


def merged(parts: Iterable[Bins], most: int) -> Bins:
    """All bins as one, of at most ``most`` for numbers."""
    parts = list(parts)
    names = SUMS if parts[0].names == SUMS else sorted({x for p in parts for x in p.names})
    at = {x: i for i, x in enumerate(names)}
    keys, place = np.unique(np.concatenate([p.keys for p in parts]), return_inverse=True)
    weights, start = np.zeros((len(keys), len(names))), 0
    for p in parts:
        rows = place[start : start + len(p.keys)]
        weights[np.ix_(rows, [at[x] for x in p.names])] += p.weights  # a part has a value once
        start += len(p.keys)
    out = Bins(keys, names, weights)
    if out.numeric and len(keys) > most:
        to = _joined(out.mass, most)
        small = np.zeros((to[-1] + 1, len(names)))
        np.add.at(small, to, weights)
        out = Bins(keys[np.append(to[1:] != to[:-1], True)], names, small)
    return out


def by_leaf(leaf: np.ndarray, values: np.ndarray, weight: np.ndarray, target: np.ndarray, names: list[str]) -> Iterator[tuple[int, Bins]]:
    """The bins of each leaf's rows. ``target``: numbers of ``names``, or of a numeric target its values."""
    if not len(leaf):
        return
    if values.dtype == object:
        words, values = np.unique(values, return_inverse=True)
    else:
        words = None
    order = np.lexsort((values, leaf))
    leaf, values, weight, target = leaf[order], values[order], weight[order], target[order]
    fresh = np.append(True, (leaf[1:] != leaf[:-1]) | (values[1:] != values[:-1]))
    cell, starts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    k = len(names)
    if names == SUMS:
        sums = np.stack([np.bincount(cell, weights=weight * x) for x in (np.ones(len(target)), target, target * target)], axis=1)
    else:
        sums = np.bincount(cell * k + target, weights=weight, minlength=len(starts) * k).reshape(-1, k)
    keys, leaves = values[starts], leaf[starts]
    edges = np.append(np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1])), len(leaves))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = keys[a:b] if words is None else words[keys[a:b]]
        yield int(leaves[a]), Bins(own, names, sums[a:b])


def read(table: pa.Table) -> list[Bins]:
    return [Bins.of(*r) for r in zip(*(table.column(c).to_pylist() for c in ("numbers", "words", "names", "weights")))]
