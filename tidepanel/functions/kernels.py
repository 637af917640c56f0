"""Small dense problems in NumPy: sparse and ridge regression, trees of one feature, clustering."""

from __future__ import annotations

import numpy as np


def robust_scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scaled, medians, deviations); deviations below 1e-10 count as 1."""
    mid = np.median(x, axis=0)
    mad = np.median(np.abs(x - mid), axis=0)
    mad = np.where(mad < 1e-10, 1.0, mad)
    return (x - mid) / mad, mid, mad


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, where, times = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(times)
    return (last - (times - 1) / 2)[where]


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    a, b = ranks(x), ranks(y)
    a, b = a - a.mean(), b - b.mean()
    size = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / size) if size > 0 else 0.0


def ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept."""
    mean, level = x.mean(axis=0), y.mean()
    centred = x - mean
    weights = np.linalg.solve(centred.T @ centred + penalty * np.eye(x.shape[1]), centred.T @ (y - level))
    return weights, float(level - mean @ weights)


def lasso_path(gram: np.ndarray, right: np.ndarray, penalties: np.ndarray, rounds: int = 500, tiny: float = 1e-8) -> np.ndarray:
    """Weights for each penalty, largest first, by coordinate descent on the Gram matrix (both divided by n)."""
    weights, found = np.zeros(len(right)), []
    size = np.diag(gram)
    for penalty in penalties:
        for _ in range(rounds):
            change = 0.0
            for j in np.flatnonzero(size > 0):
                part = right[j] - gram[j] @ weights + size[j] * weights[j]
                new = np.sign(part) * max(abs(part) - penalty, 0.0) / size[j]
                change = max(change, abs(new - weights[j]))
                weights[j] = new
            if change < tiny:
                break
        found.append(weights.copy())
    return np.array(found)


def penalties(right: np.ndarray, steps: int = 50, least: float = 1e-3) -> np.ndarray:
    most = max(np.abs(right).max(), 1e-12)
    return most * np.logspace(0, np.log10(least), steps)


def lasso_cv(x: np.ndarray, y: np.ndarray, folds: int = 5, steps: int = 50, ratio: float = 1.0, expanding: bool = False) -> tuple[np.ndarray, float, float]:
    """(weights, intercept, penalty) with the penalty of least error over contiguous folds; ``ratio`` below 1 adds a ridge part.

    A fold is judged by a fit on all others or, if ``expanding``, on what comes before it: rows are then in the order of time.
    """
    mean, level, n = x.mean(axis=0), y.mean(), len(x)
    centred, goal = x - mean, y - level
    right = centred.T @ goal / n
    grid = penalties(right / ratio, steps)

    def path(a: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.array([lasso_path(a + (1 - ratio) * p * np.eye(len(r)), r, np.array([ratio * p]))[0] for p in grid]) if ratio < 1 else lasso_path(a, r, grid)

    error = np.zeros(steps)
    for test in np.array_split(np.arange(n), min(folds + expanding, n)):
        train = np.arange(test[0] if len(test) else 0) if expanding else np.setdiff1d(np.arange(n), test)
        if not len(train) or not len(test):
            continue
        m, v = x[train].mean(axis=0), y[train].mean()
        a = x[train] - m
        coef = path(a.T @ a / len(train), v, a.T @ (y[train] - v) / len(train))
        error += ((y[test][None, :] - v - coef @ (x[test] - m).T) ** 2).sum(axis=1)
    best = int(error.argmin())
    weights = path(centred.T @ centred / n, level, right)[best]
    return weights, float(level - mean @ weights), float(grid[best])


def lasso_ic(x: np.ndarray, y: np.ndarray, kind: str = "bic", steps: int = 50) -> np.ndarray:
    """Weights on the lasso path of least information criterion."""
    n, centred, goal = len(x), x - x.mean(axis=0), y - y.mean()
    coef = lasso_path(centred.T @ centred / n, centred.T @ goal / n, penalties(centred.T @ goal / n, steps))
    rest = ((goal[None, :] - coef @ centred.T) ** 2).sum(axis=1)
    price = np.log(n) if kind == "bic" else 2.0
    return coef[int((n * np.log(np.maximum(rest / n, 1e-300)) + price * (np.abs(coef) > 1e-12).sum(axis=1)).argmin())]


def tree_edges(x: np.ndarray, y: np.ndarray, depth: int = 3, leaf: int = 100, bins: int = 10) -> np.ndarray:
    """Inner bin edges of a regression tree on one feature; none below two leaves' rows."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    found: list[tuple[float, float]] = []

    def split(a: int, b: int, level: int) -> None:
        n = b - a
        if level == 0 or n < 2 * leaf:
            return
        total = np.cumsum(y[a:b])
        k = np.arange(1, n)
        gain = total[:-1] ** 2 / k + (total[-1] - total[:-1]) ** 2 / (n - k) - total[-1] ** 2 / n
        gain = np.where((k >= leaf) & (n - k >= leaf) & (x[a : b - 1] < x[a + 1 : b]), gain, -np.inf)
        best = int(gain.argmax())
        if not np.isfinite(gain[best]) or gain[best] <= 0:
            return
        found.append((float(gain[best]), (x[a + best] + x[a + best + 1]) / 2))
        split(a, a + best + 1, level - 1)
        split(a + best + 1, b, level - 1)

    split(0, len(x), depth)
    return np.sort([e for _, e in sorted(found, reverse=True)[: bins - 1]])


def average_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers by average linkage, merged while the least mean distance is at most ``cut``."""
    n = len(distance)
    d, size = distance.astype(float).copy(), np.ones(n)
    np.fill_diagonal(d, np.inf)
    label, alive = np.arange(n), np.ones(n, bool)
    while alive.sum() > 1:
        i, j = np.unravel_index(d.argmin(), d.shape)
        if d[i, j] > cut:
            break
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def knn_mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate (Kraskov) of the mutual information of two samples, 0 at least."""
    n = len(x)
    if n <= k:
        return 0.0
    scale = lambda v: (v - v.mean()) / (v.std() or 1.0)
    x, y = scale(x), scale(y)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    radius = np.empty(n)
    for first in range(0, n, 512):
        part = slice(first, min(first + 512, n))

        def nearest(low: int, high: int, part: slice = part) -> np.ndarray:
            """The k + 1 least distances of the block's points to those from ``low`` to ``high``, themselves included."""
            least = np.empty((part.stop - part.start, 0))
            for a in range(low, high, 8192):
                b = min(a + 8192, high)
                far = np.maximum(np.abs(x[part, None] - x[None, a:b]), np.abs(y[part, None] - y[None, a:b]))
                least = np.concatenate([least, far], axis=1)
                if least.shape[1] > k + 1:
                    least = np.partition(least, k, axis=1)[:, : k + 1]
            return least.max(axis=1)

        # what is near in x bounds the distance, and the bound says which others can be nearer
        low, high = max(0, min(first - 64, n - k - 1)), min(n, part.stop + 64)
        bound = nearest(low, high) * (1 + 1e-9)
        low, high = min(low, np.searchsorted(x, (x[part] - bound).min())), max(high, np.searchsorted(x, (x[part] + bound).max(), "right"))
        radius[part] = nearest(int(low), int(high))
    inside = lambda v: np.searchsorted(s := np.sort(v), v + radius, "left") - np.searchsorted(s, v - radius, "right")
    digamma = np.concatenate([[np.nan], -0.5772156649015329 + np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])])
    nx, ny = np.maximum(inside(x), 1), np.maximum(inside(y), 1)
    return float(max(0.0, digamma[n] + digamma[k] - (digamma[nx] + digamma[ny]).mean()))
