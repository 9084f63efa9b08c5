"""Small driver-side mathematics over results that have one row per K, column or bin."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def explained_fractions(eigenvalues: Sequence[float], permuted: np.ndarray | None = None, tiny: float = 1e-6) -> tuple[np.ndarray, np.ndarray | None]:
    """Share of each eigenvalue in their sum, and the same of the permuted ones (index, round).

    Where the actual eigenvalue is not above ``tiny`` both count as zero.
    """
    actual = np.asarray(eigenvalues, float)
    live = actual > tiny
    shares = np.where(live, actual, 0) / actual[live].sum()
    if permuted is None:
        return shares, None
    null = np.where(live[:, None], np.asarray(permuted, float), 0)
    return shares, null / null.sum(0)


def f_of_k(distortions: Sequence[float], n_dims: int) -> np.ndarray:
    """f(K) of Pham, Dimov and Nguyen (2005) for K = 1, 2, ...: least where K fits best."""
    s = np.asarray(distortions, float)
    out = np.ones(len(s))
    weight = 1 - 3 / (4 * n_dims)
    for k in range(1, len(s)):
        if s[k - 1] != 0:
            out[k] = s[k] / (weight * s[k - 1])
        weight += (1 - weight) / 6
    return out


def complete_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of complete-linkage clustering; clusters made are numbered from n on."""
    n = len(distance)
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    name = list(range(n))
    alive = list(range(n))
    merges = []
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(np.argmin(sub)), len(alive))
        a, b = sorted((alive[i], alive[j]))
        merges.append((*sorted((name[a], name[b])), float(d[a, b])))
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[a, a] = np.inf
        name[a] = n + len(merges) - 1
        alive.remove(b)
    return merges


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int) -> list[int]:
    """Cluster numbers of the n leaves when k clusters are left."""
    members = {i: [i] for i in range(n)}
    for m, (a, b, _) in enumerate(merges[: n - k]):
        members[n + m] = members.pop(a) + members.pop(b)
    out = [0] * n
    for c, leaves in enumerate(sorted(members.values(), key=min)):
        for leaf in leaves:
            out[leaf] = c
    return out


def purity(found: Sequence[int], expected: Sequence[int]) -> float:
    """Share of the items that are of their cluster's most frequent expected group."""
    total = 0
    for c in set(found):
        of = [e for f, e in zip(found, expected) if f == c]
        total += max(of.count(e) for e in set(of))
    return total / len(found)


def dissimilarity(correlation: np.ndarray) -> np.ndarray:
    return (1 - correlation) / 2


def likelihood_ratio(h1: np.ndarray, h0: np.ndarray, bins: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2 (h1 - h0) per item, and the density of it: values, heights, edges."""
    ratio = 2 * (np.asarray(h1, float) - np.asarray(h0, float))
    heights, edges = np.histogram(ratio, bins=bins, density=True)
    return ratio, heights, edges
