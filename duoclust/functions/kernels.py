"""Small dense fits for one dataset at a time: helpers of grouped Spark tasks."""

from __future__ import annotations

import numpy as np

#: Fixed value: added inside logarithms.
EPS = 1e-10


class Sparse:
    """A matrix of the entries that are not zero, with the products that the fits take; repeated cells are added up."""

    __array_ufunc__ = None

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        cell, at = np.unique(row.astype(np.int64) * shape[1] + col, return_inverse=True)
        self.shape, self.row, self.col = shape, cell // shape[1], cell % shape[1]
        self.value = np.bincount(at, value, len(cell))

    def __len__(self) -> int:
        return self.shape[0]

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * v[self.col], self.shape[0])

    def __rmatmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * w[self.row], self.shape[1])

    def sum(self, axis: int = 1) -> np.ndarray:
        return np.bincount(self.row, self.value, self.shape[0]) if axis == 1 else np.bincount(self.col, self.value, self.shape[1])

    def dense_row(self, k: int) -> np.ndarray:
        out, at = np.zeros(self.shape[1]), slice(*np.searchsorted(self.row, [k, k + 1]))
        out[self.col[at]] = self.value[at]
        return out


def normalized_mcc(truth: np.ndarray, labels: np.ndarray) -> float:
    # classes are matched by value, as a contingency table of equal labels would be
    counts = [dict(zip(*(v.tolist() for v in np.unique(a, return_counts=True)), strict=True)) for a in (truth, labels)]
    return counted_mcc(*counts, int((np.asarray(truth) == np.asarray(labels)).sum()))


def counted_mcc(truth: dict, labels: dict, same: int) -> float:
    """normalized_mcc() from how often each class occurs on either side and how many rows have the same on both."""
    values = sorted(truth.keys() | labels.keys())
    a, b = (np.array([counts.get(v, 0) for v in values], float) for counts in (truth, labels))
    s, c = float(a.sum()), float(same)
    below = np.sqrt((s * s - b @ b) * (s * s - a @ a))
    return float(50.0 + 50.0 * abs((c * s - a @ b) / below)) if below > 0 else 50.0


def loss_and_gradient(x: np.ndarray, w: np.ndarray, model: str) -> tuple[float, np.ndarray]:
    """Of a soft partition: w is the membership in cluster 1 of each row of x."""
    loss, gradient = 0.0, np.zeros(len(x))
    totals = x.sum(axis=1)
    for weights, sign in ((w, 1.0), (1 - w, -1.0)):
        f = weights @ x
        size = weights.sum() if model == "bernoulli" else f.sum()
        p = f / size
        lp = np.log(p + EPS)
        if model == "multinomial":
            score, d = f @ lp, f / (p + EPS)
            g = x @ lp + (x @ d - totals * (p @ d)) / size
        else:
            lq = np.log(1 - p + EPS)
            score, d = f @ lp + (size - f) @ lq, f / (p + EPS) - (size - f) / (1 - p + EPS)
            own = np.ones(len(x)) if model == "bernoulli" else totals
            g = x @ (lp - lq) + own * lq.sum() + (x @ d - own * (p @ d)) / size
        scale = np.log(2) if model == "bernoulli" else 1.0
        loss -= score / scale
        gradient -= sign * g / scale
    return loss, gradient


def bounded_descent(fun, start: np.ndarray, low: float, high: float, steps: int, tolerance: float = 1e-8, memory: int = 8) -> tuple[np.ndarray, float, int, bool]:
    """Projected quasi-Newton descent in a box: (x, value, steps taken, converged). Two-loop recursion over the free
    coordinates, backtracking along the projected path."""
    x = np.clip(start, low, high)
    value, g = fun(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for step in range(1, steps + 1):
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if np.abs(g[free]).max(initial=0.0) <= tolerance:
            return x, value, step - 1, True
        q, alphas = np.where(free, g, 0.0), []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ q))
            q = q - alphas[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            q = q * ((s @ y) / (y @ y))
        else:
            q = q / max(1.0, np.abs(q).max())
        for (s, y, rho), alpha in zip(pairs, reversed(alphas), strict=True):
            q = q + s * (alpha - rho * (y @ q))
        direction = np.where(free, -q, 0.0)
        if direction @ g >= 0:
            direction, pairs = np.where(free, -g, 0.0), []
        length = 1.0
        for _ in range(50):
            new = np.clip(x + length * direction, low, high)
            new_value, new_g = fun(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * (g @ (new - x)):
                break
            length /= 2
        else:
            return x, value, step, True
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))] if len(pairs) >= memory else [*pairs, (s, y, 1 / (s @ y))]
        done = value - new_value <= tolerance * max(abs(value), abs(new_value), 1.0)
        x, value, g = new, new_value, new_g
        if done:
            return x, value, step, True
    return x, value, steps, False


def median_membership(projection: np.ndarray) -> np.ndarray:
    m = np.full(len(projection), 0.1)
    m[np.argsort(projection, kind="stable")[len(projection) // 2 :]] = 0.9
    return m


def soft_loo(x: np.ndarray, w: np.ndarray, smoothing: float) -> tuple[float, np.ndarray]:
    """Weighted mean bits a token with each row's own share left out, and its gradient by w."""
    f, r = w @ x, x.sum(axis=1)
    v = x.shape[1]
    top = f - w[:, None] * x + smoothing
    below = f.sum() - w * r + smoothing * v
    safe = np.where(r > 0, r, 1.0)
    bits = -(x * (np.log2(top) - np.log2(below)[:, None])).sum(axis=1) / safe
    total = w.sum()
    mean = (w @ bits) / total
    # d bits_i / d w_k = -(sum_j x_ij ([k != i] x_kj / top_ij) - r_i [k != i] r_k / below_i) / (r_i ln 2)
    a = (w / safe)[:, None] * x / top
    share = a.sum(axis=0)
    b = w / safe * r / below
    through = -((x @ share - (a * x).sum(axis=1)) - r * (b.sum() - b)) / np.log(2)
    return mean, (bits - mean + through) / total


def penalised(x: np.ndarray, w: np.ndarray, model: str, weight: float, target: float, smoothing: float) -> tuple[float, np.ndarray]:
    loss, g = loss_and_gradient(x, w, model)
    if not weight or not target:
        return loss, g
    one, g1 = soft_loo(x, w, smoothing)
    zero, g0 = soft_loo(x, 1 - w, smoothing)
    gap = abs(one - zero)
    if gap >= target:
        return loss, g
    short = target - gap
    factor = 1 + weight * short * short
    d_gap = np.sign(one - zero) * (g1 + g0)
    return loss * factor, g * factor - loss * 2 * weight * short * d_gap


def partition_start(x: np.ndarray | Sparse, model: str, k: int, max_iter: int = 500, tolerance: float = 1e-8, least: float = 0.02, seed: int = 0, logit: float = 10.0, weight: float = 0.0, target: float = 0.0, smoothing: float = 0.5) -> dict | None:
    """Where start k of partition() ends: the median split of row totals, or of the k-th randomly signed ones. None if a
    cluster has under `least` of the rows."""
    rng, low, signs = np.random.default_rng(seed), 1 / (1 + np.exp(logit)), None
    for _ in range(k):
        signs = rng.choice([-1.0, 1.0], x.shape[1])
    projection = x.sum(axis=1) if signs is None else x @ signs
    m, value, steps, fine = bounded_descent(lambda w: penalised(x, w, model, weight, target, smoothing), median_membership(projection), low, 1 - low, max_iter, tolerance)
    labels = (m >= 0.5).astype(int)
    if min(labels.sum(), len(x) - labels.sum()) / len(x) < least or not np.isfinite(value):
        return None
    return {"labels": labels, "membership": m, "loss": value, "n_iter": steps, "success": fine, "restart": k}


def partition(x: np.ndarray | Sparse, model: str, n_init: int = 6, max_iter: int = 500, **options) -> dict:
    """The best of several starts; starts that end with a cluster under `least` of the rows do not count."""
    ends = [e for k in range(n_init) if (e := partition_start(x, model, k, max_iter, **options)) is not None]
    if not ends:
        raise ValueError("every start collapsed into one cluster")
    return min(ends, key=lambda e: e["loss"])


def sparse_kmeans(x: Sparse, seed: int, n_init: int = 100, max_iter: int = 100_000, tolerance: float = 1e-3) -> np.ndarray:
    """kmeans() of a sparse matrix: distances by products."""
    rng, best = np.random.default_rng(seed), (np.inf, None)
    n, squares = len(x), np.bincount(x.row, x.value**2, len(x))
    mean = x.sum(axis=0) / n
    stop = tolerance * (squares.sum() / n - mean @ mean) / x.shape[1]

    def distances(c: np.ndarray) -> np.ndarray:
        return np.maximum(squares - 2 * (x @ c) + c @ c, 0)

    for _ in range(n_init):
        first = x.dense_row(rng.integers(n))
        d = distances(first)
        c = [first, x.dense_row(rng.choice(n, p=d / d.sum())) if d.sum() > 0 else first]
        for _ in range(max_iter):
            labels = (distances(c[1]) < distances(c[0])).astype(int)
            sizes = [n - labels.sum(), labels.sum()]
            new = [(((labels == k).astype(float)) @ x) / sizes[k] if sizes[k] else c[k] for k in (0, 1)]
            moved = sum(((a - b) ** 2).sum() for a, b in zip(new, c, strict=True))
            c = new
            if moved <= stop:
                break
        d0, d1 = distances(c[0]), distances(c[1])
        if (cost := np.minimum(d0, d1).sum()) < best[0]:
            best = (cost, (d1 < d0).astype(int))
    return best[1]


def kmeans(x: np.ndarray, seed: int, n_init: int = 100, max_iter: int = 100_000, tolerance: float = 1e-3) -> np.ndarray:
    rng, best = np.random.default_rng(seed), (np.inf, None)
    stop = tolerance * x.var(axis=0).mean()
    for _ in range(n_init):
        first = x[rng.integers(len(x))]
        d = ((x - first) ** 2).sum(axis=1)
        second = x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else first
        c = np.stack([first, second])
        for _ in range(max_iter):
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            labels = d.argmin(axis=1)
            new = np.stack([x[labels == k].mean(axis=0) if (labels == k).any() else c[k] for k in (0, 1)])
            moved = ((new - c) ** 2).sum()
            c = new
            if moved <= stop:
                break
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        if (cost := d.min(axis=1).sum()) < best[0]:
            best = (cost, d.argmin(axis=1))
    return best[1]


def _log_normal(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    root = np.linalg.cholesky(cov)
    z = np.linalg.solve(root, (x - mean).T)
    return -0.5 * (x.shape[1] * np.log(2 * np.pi) + (z * z).sum(axis=0)) - np.log(np.diag(root)).sum()


def gmm(x: np.ndarray, seed: int, max_iter: int = 100, tolerance: float = 1e-3, floor: float = 1e-6) -> np.ndarray:
    r = np.eye(2)[kmeans(x, seed, n_init=1)]
    last = -np.inf
    for _ in range(max_iter):
        n = r.sum(axis=0) + 1e-15
        logs = []
        for k in (0, 1):
            mean = r[:, k] @ x / n[k]
            cov = ((x - mean).T * r[:, k]) @ (x - mean) / n[k] + floor * np.eye(x.shape[1])
            logs.append(np.log(n[k] / len(x)) + _log_normal(x, mean, cov))
        logs = np.stack(logs, axis=1)
        whole = np.logaddexp(logs[:, 0], logs[:, 1])
        r = np.exp(logs - whole[:, None])
        if abs(whole.mean() - last) < tolerance:
            break
        last = whole.mean()
    return r.argmax(axis=1)


def dbscan_binary(x: np.ndarray, least: int = 5) -> np.ndarray:
    """Equal rows in groups of `least` or more are clusters; the rest is noise."""
    _, inverse, counts = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    dense = np.flatnonzero(counts >= least)
    number = np.full(len(counts), -1)
    number[dense] = np.arange(len(dense))
    return number[inverse.ravel()]


def regularized_em(x: np.ndarray, seed: int, max_iter: int = 10_000, tolerance: float = 1e-4, shrink: float = 1e-2, first: np.ndarray | None = None) -> np.ndarray:
    """EM whose covariances lean towards the sample covariance by `shrink`, with 1e-3 on the diagonal."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    goal = np.cov(x, rowvar=False)
    means, covs, share = x[rng.choice(len(x), 2, replace=False)] if first is None else first, [goal, goal], np.full(2, 0.5)
    for _ in range(max_iter):
        logs = np.stack([np.log(share[k]) + _log_normal(x, means[k], covs[k] + 1e-3 * np.eye(d)) for k in (0, 1)], axis=1)
        r = np.exp(logs - np.logaddexp(logs[:, 0], logs[:, 1])[:, None])
        n = r.sum(axis=0) + 1e-12
        new = (r.T @ x) / n[:, None]
        covs = [(1 - shrink) * ((x - new[k]).T * r[:, k]) @ (x - new[k]) / n[k] + shrink * goal for k in (0, 1)]
        share = n / len(x)
        if np.abs(new - means).max() < tolerance:
            break
        means = new
    return r.argmax(axis=1)


def cross_entropy_clusters(x: np.ndarray, seed: int, max_iter: int = 100, tolerance: float = 1e-6, log_space: bool = True, first: np.ndarray | None = None) -> np.ndarray:
    """Equal-weight Gaussian responsibilities; without log_space densities are compared as they are (differential entropy)."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    means, covs = x[rng.choice(len(x), 2, replace=False)] if first is None else first, [np.cov(x, rowvar=False)] * 2
    for _ in range(max_iter):
        logs = np.stack([_log_normal(x, means[k], covs[k] + 1e-3 * np.eye(d)) for k in (0, 1)], axis=1)
        if log_space:
            r = np.exp(logs - np.logaddexp(logs[:, 0], logs[:, 1])[:, None])
        else:
            density = np.exp(logs)
            if not (density.sum(axis=1) > 0).all():
                raise FloatingPointError("densities vanish")
            r = density / density.sum(axis=1, keepdims=True)
        n = r.sum(axis=0) + 1e-12
        new = (r.T @ x) / n[:, None]
        covs = [((x - new[k]).T * r[:, k]) @ (x - new[k]) / n[k] for k in (0, 1)]
        moved, means = np.abs(new - means).max(), new
        if moved < tolerance:
            break
    return r.argmax(axis=1)


def _spread(h: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """std(h) * mean(h) / |w| and its derivative by h."""
    mean, std, norm = h.mean(), h.std() + 1e-300, np.linalg.norm(w)
    return std * mean / norm, (mean * (h - mean) / (len(h) * std) + std / len(h)) / norm * scale


def gaussian_objective(x: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, np.ndarray]:
    """Spread of the self-information under the weighted Gaussian, and its gradient by the weights."""
    total = w.sum()
    u = w / total
    mean = u @ x
    c = x - mean
    cov = (c.T * u) @ c + ridge * np.eye(x.shape[1])
    inverse = np.linalg.inv(cov)
    z = c @ inverse
    h = 0.5 * (x.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + (c * z).sum(axis=1))
    f, a = _spread(h, np.ones(len(h)), w)
    big = 0.5 * (a.sum() * inverse - (z.T * a) @ z)
    q = a @ z
    g = ((c @ big) * c).sum(axis=1) - np.trace(big @ (cov - ridge * np.eye(x.shape[1]))) - c @ q
    return f, g / total - f * w / (w @ w)


def radius_objective(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Spread of the weighted L2 radii, and its gradient by the weights."""
    r = np.linalg.norm(x, axis=1)
    f, a = _spread(w * r, r, w)
    return f, a - f * w / (w @ w)


def weighted_start(x: np.ndarray, objective, k: int, seed: int, max_iter: int = 180) -> tuple[np.ndarray, float]:
    """(labels, value) of start k of weighted_partition()."""
    rng = np.random.default_rng(seed)
    for j in range(k + 1):
        first = rng.uniform(0, 1, len(x)) if j == 0 else rng.uniform(0.05, 0.95, len(x))
    w, value, _, _ = bounded_descent(lambda v: objective(x, v), first, 1e-6, 1.0, max_iter, 1e-6)
    if not np.isfinite(value):
        raise FloatingPointError("no finite value")
    return np.round(w).astype(int), value


def weighted_partition(x: np.ndarray, objective, seed: int, starts: int = 2, max_iter: int = 180) -> np.ndarray:
    """Labels from the best of several bounded descents; weights of one half and less round to 0."""
    ends = []
    for k in range(starts):
        try:
            ends.append(weighted_start(x, objective, k, seed, max_iter))
        except FloatingPointError:
            continue
    if not ends:
        raise FloatingPointError("no start gave a finite value")
    return min(ends, key=lambda e: e[1])[0]
