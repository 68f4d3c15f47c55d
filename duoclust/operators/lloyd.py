"""k-means of a matrix that no task holds, many starts at once.

A scan serves all starts: centres go out by broadcast, and each task hands back, for every start and centre, how many
rows are nearest to it, their sum and their cost. First centres are drawn over the whole matrix: rows enter with a
probability in proportion to their distance from the centres drawn so far, by a hash of their key, so that a lost task
draws the same rows again; the few drawn rows, weighted by the rows nearest to each, are then thinned to k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalar import at_least
from .gram import _prepared, _sums

#: Rounds that draw first centres, and rows that one draws on average, times k.
ROUNDS, OVERSAMPLE = 3, 4


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None], 0)


def step(df: DataFrame, vector: str, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows nearest to each centre, their mean, cost) of every start: one Lloyd step of all of them in one scan. Ties go
    to the first centre; a centre without rows stays where it is."""
    x, d = _prepared(df, vector)
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def block(columns: list[np.ndarray]) -> np.ndarray:
        out = []
        for c in shared.value:
            near = _distances(columns[0], c)
            label = near.argmin(axis=1)
            one = np.eye(len(c))[label]
            out += [one.sum(axis=0), (one.T @ columns[0]).ravel(), [near.min(axis=1).sum()]]
        return np.concatenate(out)

    total, at, out = _sums(x, ["x"], block), 0, []
    for c in centres:
        n, s, cost = total[at : at + len(c)], total[at + len(c) : at + len(c) * (1 + d)].reshape(len(c), d), total[at + len(c) * (1 + d)]
        out.append((n, np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c), float(cost)))
        at += len(c) * (1 + d) + 1
    return out


def nearest(df: DataFrame, vector: str, centres: np.ndarray, name: str = "label") -> DataFrame:
    """df with the number of each row's nearest centre, the first in a tie; null where it has no vector."""
    shared, kept = df.sparkSession.sparkContext.broadcast(np.asarray(centres, float)), df.drop(name)
    names = kept.columns

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__x")
            known = np.flatnonzero(np.asarray(column.is_valid()))
            label = np.full(batch.num_rows, -1)
            if len(known):
                label[known] = _distances(np.asarray(column.flatten()).reshape(len(known), -1), shared.value).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(label.astype(np.int32), mask=label < 0)], [*names, name])

    return kept.withColumn("__x", F.col(vector).cast("array<double>")).mapInArrow(labelled, StructType([*kept.schema.fields, StructField(name, IntegerType())]))


def first_centres(df: DataFrame, vector: str, key: str, seeds: list[int], k: int) -> list[np.ndarray]:
    """k first centres for each seed, drawn with probabilities in proportion to squared distances."""
    at_least(1, k=k, seeds=len(seeds))
    x = df.dropna(subset=[vector]).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    sc = df.sparkSession.sparkContext
    centres = [np.array([r["x"] for r in x.orderBy(F.xxhash64("key", F.lit(s)), "key").limit(1).collect()], float) for s in seeds]
    for turn in range(ROUNDS):
        costs = [c for _, _, c in step(df, vector, centres)]
        shared = sc.broadcast((centres, costs))
        chance = [((F.xxhash64("key", F.lit(s), F.lit(turn)).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)).alias(f"u{i}") for i, s in enumerate(seeds)]

        def drawn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, cost = shared.value
            for batch in batches:
                v = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
                for i, c in enumerate(known):
                    if cost[i] > 0 and len(v):
                        hit = np.asarray(batch.column(f"u{i}")) < OVERSAMPLE * k * _distances(v, c).min(axis=1) / cost[i]
                        if hit.any():
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), i, np.int32)), pa.array(list(v[hit]), pa.list_(pa.float64()))], ["start", "x"])

        rows = x.select("x", *chance).mapInArrow(drawn, "start int, x array<double>").collect()  # OVERSAMPLE * k for each start, on average
        for i in range(len(seeds)):
            more = [r["x"] for r in rows if r["start"] == i]
            centres[i] = np.vstack([centres[i], *([np.array(sorted(more))] if more else [])])
    weights = [n for n, _, _ in step(df, vector, centres)]
    return [_thinned(c, w, k, s) for c, w, s in zip(centres, weights, seeds, strict=True)]


def _thinned(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the points, each next one with a probability in proportion to weight and squared distance."""
    rng = np.random.default_rng(seed)
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < k:
        p = weights * _distances(points, np.array(chosen)).min(axis=1)
        chosen.append(points[rng.choice(len(points), p=p / p.sum())] if p.sum() > 0 else chosen[0])
    return np.array(chosen)


def kmeans(df: DataFrame, vector: str, key: str, seeds: list[int], k: int = 2, max_iter: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """df with `label`: the cheapest of the starts, one for each seed, the first in a tie. A start rests when its centres
    move by less than `tolerance` in all (squared); the scans end with the last."""
    centres, resting, costs = first_centres(df, vector, key, seeds, k), [False] * len(seeds), [np.inf] * len(seeds)
    for _ in range(max_iter):
        moving = [i for i, r in enumerate(resting) if not r]
        if not moving:
            break
        for i, (_, new, cost) in zip(moving, step(df, vector, [centres[i] for i in moving]), strict=True):
            resting[i], centres[i], costs[i] = ((new - centres[i]) ** 2).sum() <= tolerance, new, cost
    costs = [cost for _, _, cost in step(df, vector, centres)]
    return nearest(df, vector, centres[int(np.argmin(costs))])
