"""Moments of one large matrix of vectors, and the fits that rest on them.

A task adds up weight, weighted sum and weighted Gram matrix of its rows, in blocks; these rows, one for each task and
set of weights, are merged as a tree, and the driver adds the last few. Weights are columns, so one scan serves several
sets. Every step of an expectation-maximisation is such a scan: parameters go out by broadcast, moments come back.

Vectors are arrays of one length (others fail); rows without a vector or a weight take no part in moments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Rows that are multiplied at a time; the fewest that the driver adds up itself.
BLOCK, LAST = 4096, 32


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _sums(df: DataFrame, columns: list[str], of: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what `of` adds up of a block of them: an array of fixed size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = of([_vectors(c) if pa.types.is_list(c.type) else np.asarray(c) for c in part.columns])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.ravel()], pa.list_(pa.float64()))})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = _vectors(batch.column("s")).sum(axis=0)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": pa.array([total], pa.list_(pa.float64()))})

    parts = df.select(*columns).mapInArrow(partial, "s array<double>")
    tree = parts.withColumn("__to", F.pmod(F.spark_partition_id(), F.lit(LAST))).repartitionById(LAST, "__to").select("s").mapInArrow(merged, "s array<double>")
    rows = [np.array(r["s"]) for r in tree.collect()]  # LAST at most
    return np.sum(rows, axis=0) if rows else np.zeros(0)


def _prepared(df: DataFrame, vector: str, *more: str) -> tuple[DataFrame, int]:
    x = df.dropna(subset=[vector, *more]).select(F.col(vector).cast("array<double>").alias("x"), *(F.col(c).cast("double").alias(c) for c in more))
    first = x.select(F.size("x")).first()
    return x, first[0] if first else 0


def moments(df: DataFrame, vector: str, weights: list[str], shift: np.ndarray | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(sum of weights, weighted mean, weighted covariance with the sum as divisor) for each column of weights, from one
    scan; products are taken about `shift`, a point near the mean (the plain mean, from a scan of its own, by default)."""
    x, d = _prepared(df, vector, *weights)
    if shift is None:
        shift = mean(df, vector)

    def block(columns: list[np.ndarray]) -> np.ndarray:
        c = columns[0] - shift
        return np.stack([np.concatenate([[w.sum()], w @ c, ((c.T * w) @ c).ravel()]) for w in columns[1:]])

    total = _sums(x, ["x", *weights], block).reshape(len(weights), -1) if d else np.zeros((len(weights), 1))
    return [_moment(t, shift) for t in total]


def _moment(t: np.ndarray, shift: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    d = len(shift)
    off = t[1 : 1 + d] / t[0]
    return float(t[0]), shift + off, t[1 + d : 1 + d + d * d].reshape(d, d) / t[0] - np.outer(off, off)


def mean(df: DataFrame, vector: str) -> np.ndarray:
    x, d = _prepared(df, vector)
    total = _sums(x, ["x"], lambda c: np.concatenate([[len(c[0])], c[0].sum(axis=0)])) if d else np.zeros(1)
    return total[1:] / max(total[0], 1)


def _log_normal(c: np.ndarray, at: np.ndarray, root: np.ndarray) -> np.ndarray:
    z = np.linalg.solve(root, (c - at).T)
    return -0.5 * (c.shape[1] * math.log(2 * math.pi) + (z * z).sum(axis=0)) - np.log(np.diag(root)).sum()


def _responsibilities(method: str, c: np.ndarray, state: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(shares of two clusters in each row, log of the whole density)."""
    means, roots, share = state
    logs = np.stack([_log_normal(c, means[k], roots[k]) for k in (0, 1)], axis=1)
    if method in ("gmm", "regularized"):
        logs = logs + np.log(share)
    whole = np.logaddexp(logs[:, 0], logs[:, 1])
    if method == "differential":
        density = np.exp(logs)
        if not (density.sum(axis=1) > 0).all():
            raise FloatingPointError("densities vanish")
        return density / density.sum(axis=1, keepdims=True), whole
    return np.exp(logs - whole[:, None]), whole


#: Steps, tolerance and what is added to the diagonal when densities are taken, for each method.
METHODS = {"gmm": (100, 1e-3, 1e-6), "regularized": (10_000, 1e-4, 1e-3), "cec": (100, 1e-6, 1e-3), "differential": (100, 1e-6, 1e-3)}


def mixture(df: DataFrame, vector: str, method: str, first: np.ndarray, shrink: float = 1e-2, max_iter: int | None = None) -> DataFrame:
    """df with `label`, 0 or 1: two Gaussian clusters of a matrix that no task holds, from two first means. "gmm" is
    plain EM from the rows nearest to each; "regularized" leans covariances towards the sample's by `shrink`; "cec" takes
    clusters of equal weight; "differential" compares densities as they are and raises FloatingPointError (inside a task's
    error) where they vanish. One scan a step."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    steps, tolerance, ridge = METHODS[method]
    x, d = _prepared(df, vector)
    sc, shift = df.sparkSession.sparkContext, mean(df, vector)
    n, _, cov = moments(df.withColumn("__one", F.lit(1.0)), vector, ["__one"], shift)[0]
    goal, eye = cov * n / (n - 1), np.eye(d)
    means, covs, share, last = np.asarray(first, float) - shift, [goal, goal], np.full(2, 0.5), -math.inf

    def scan(state: tuple, hard: bool = False) -> np.ndarray:
        shared = sc.broadcast(state)

        def block(columns: list[np.ndarray]) -> np.ndarray:
            c = columns[0] - shift
            if hard:
                near = ((c[:, None, :] - shared.value[0][None]) ** 2).sum(axis=2).argmin(axis=1)
                r, whole = np.eye(2)[near], np.zeros(len(c))
            else:
                r, whole = _responsibilities(method, c, shared.value)
            return np.stack([np.concatenate([[r[:, k].sum()], r[:, k] @ c, ((c.T * r[:, k]) @ c).ravel(), [whole.sum()]]) for k in (0, 1)])

        return _sums(x, ["x"], block).reshape(2, -1)

    def state_of() -> tuple:
        return means, [np.linalg.cholesky(c + ridge * eye) for c in covs], share

    hard, used = method == "gmm", None  # labels are those of the last expectation, as in the kernels
    for _ in range(steps if max_iter is None else max_iter):
        used = None if hard else state_of()
        t = scan((means, None, None), True) if hard else scan(used)
        whole, sizes = t[0, -1] / n, t[:, 0] + (1e-15 if method == "gmm" else 1e-12)
        if method == "gmm" and not hard and abs(whole - last) < tolerance:
            break
        new = t[:, 1 : 1 + d] / sizes[:, None]
        covs = [t[k, 1 + d : 1 + d + d * d].reshape(d, d) / sizes[k] - np.outer(new[k], new[k]) * (2 - t[k, 0] / sizes[k]) for k in (0, 1)]
        if method == "regularized":
            covs = [(1 - shrink) * c + shrink * goal for c in covs]
        moved, means, share, last = np.abs(new - means).max(), new, sizes / n, whole if not hard else -math.inf
        if method != "gmm" and moved < tolerance:
            break
        hard = False
    shared = sc.broadcast(used or state_of())

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.asarray(batch.column("__x").flatten()).reshape(batch.num_rows, d) - shift
            label = _responsibilities(method, c, shared.value)[0].argmax(axis=1) if len(c) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(label.astype(np.int32))], [*names, "label"])

    kept = df.drop("label")
    names = kept.columns
    return kept.withColumn("__x", F.col(vector).cast("array<double>")).mapInArrow(labelled, StructType([*kept.schema.fields, StructField("label", IntegerType())]))


def two_rows(df: DataFrame, vector: str, key: str, seed: int = 0) -> np.ndarray:
    """Two vectors that the hash of the key picks."""
    rows = df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).select(F.col(vector).cast("array<double>")).limit(2).collect()
    return np.array([r[0] for r in rows], float)


def gaussian_spread(df: DataFrame, vector: str, weight: str, ridge: float = 1e-2) -> tuple[float, DataFrame]:
    """(value, df with `slope`): the spread of the self-information under the weighted Gaussian of all components, and its
    derivative by each row's weight. Moments are one scan, Mahalanobis terms under a broadcast inverse another: what a row
    adds to the slopes is linear in its self-information, so sums with and without it do. Slopes are computed where they
    are read."""
    x, d = _prepared(df, vector, weight)
    sc, shift = df.sparkSession.sparkContext, mean(df, vector)
    total, at, cov = moments(df, vector, [weight], shift)[0]
    inner = cov + ridge * np.eye(d)
    inverse, base = np.linalg.inv(inner), 0.5 * (d * math.log(2 * math.pi) + np.linalg.slogdet(inner)[1])
    shared = sc.broadcast((at, inverse))

    def terms(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centre, inv = shared.value
        c = v - centre
        z = c @ inv
        return c, z, base + 0.5 * (c * z).sum(axis=1)

    def block(columns: list[np.ndarray]) -> np.ndarray:
        _, z, h = terms(columns[0])
        w = columns[1]
        return np.concatenate([[len(h), h.sum(), (h * h).sum(), (w * w).sum()], z.sum(axis=0), h @ z, (z.T @ z).ravel(), ((z.T * h) @ z).ravel()])

    t = _sums(x, ["x", weight], block)
    n, h1, h2, ww = t[:4]
    z1, hz, zz, hzz = t[4 : 4 + d], t[4 + d : 4 + 2 * d], t[4 + 2 * d : 4 + 2 * d + d * d].reshape(d, d), t[4 + 2 * d + d * d :].reshape(d, d)
    centre, norm = h1 / n, math.sqrt(ww)
    std = math.sqrt(max(h2 / n - centre * centre, 0.0)) + 1e-300
    value = std * centre / norm
    # the derivative by h of a row is rise * h + level
    rise = centre / (n * std) / norm
    level = std / n / norm - rise * centre
    big = 0.5 * ((rise * h1 + level * n) * inverse - (rise * hzz + level * zz))
    q, trace = rise * hz + level * z1, float(np.trace(big @ cov))
    plan = sc.broadcast((big, q))

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, _, _ = terms(np.asarray(batch.column("__x").flatten()).reshape(batch.num_rows, d))
            w, (m, k) = np.asarray(batch.column("__w")), plan.value
            g = (((c @ m) * c).sum(axis=1) - trace - c @ k) / total - value * w / ww
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(g)], [*names, "slope"])

    kept = df.drop("slope")
    names = kept.columns
    wide = kept.withColumn("__x", F.col(vector).cast("array<double>")).withColumn("__w", F.col(weight).cast("double"))
    return value, wide.mapInArrow(slopes, StructType([*kept.schema.fields, StructField("slope", DoubleType())]))
