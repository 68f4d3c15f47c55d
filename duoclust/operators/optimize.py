"""Fits of one matrix that no single task can hold."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import at_least
from ..sources.io import dropped, materialised, scratch
from . import gram, score


def _signed(matrix: DataFrame, seed: int, start: int) -> DataFrame:
    """(row, total): each row's sum with a sign for every feature, drawn by hash."""
    sign = F.when(F.pmod(F.xxhash64("feature", F.lit(seed), F.lit(start)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return matrix.groupBy("row").agg(F.sum(F.col("value") * sign).alias("total"))


def large_partition(matrix: DataFrame, model: str, steps: int = 30, logit: float = 10.0, tolerance: float = 1e-6, starts: int = 6, least: float = 0.02, weight: float = 0.0, target: float = 0.0, smoothing: float = 0.5, seed: int = 0) -> DataFrame:
    """(row, m, label): memberships that descend the loss, with the penalty of `weight` for a gap of soft means under
    `target`, from the median split of row totals and, from the second start on, of randomly signed ones. The start
    with the least loss counts, if both its clusters have `least` of the rows; ValueError if none has.

    All starts descend together, each as columns of one table (quasi_newton). With a penalty, whose value needs a pass
    of its own for every start, they follow each other by projected gradient steps of Barzilai-Borwein length."""
    at_least(0, steps=steps, tolerance=tolerance, least=least, weight=weight, target=target)
    at_least(1, starts=starts)
    with scratch() as keep:
        matrix = materialised(score.checked(matrix, model), "matrix")
        first = [score.median_split(_signed(matrix, seed, k) if k else score.row_totals(matrix), "total") for k in range(starts)]
        if weight and target:
            ends = [_descended(matrix, materialised(f, "members"), model, steps, logit, tolerance, (weight, target, smoothing)) for f in first]
        else:
            members, values = quasi_newton(matrix, first, model, steps, logit, tolerance)
            ends = [(members.select("row", F.col(f"m{k}").alias("m")), v) for k, v in enumerate(values)]
        best = None
        for at, value in ends:
            ones, rows = at.agg(F.count_if(F.col("m") >= 0.5), F.count("*")).first()
            if min(ones, rows - ones) >= least * rows and math.isfinite(value) and (best is None or value < best[1]):
                best = at, value
        if best is None:
            raise ValueError("every start collapsed into one cluster")
        keep.append(materialised(best[0].select("row", "m", (F.col("m") >= 0.5).cast("int").alias("label")), "partition"))
    return keep[0]


#: Step lengths that one pass tries, each half of the one before; halvings at most.
TRIED, HALVINGS = 3, 48
_EPS, _LN2 = score.EPS, score.LN2


def _two_loops(gram: np.ndarray, k: int, most: float) -> np.ndarray:
    """Coefficients of the descent direction over the basis (k steps s, k changes y, the free gradient), from the inner
    products of the basis alone."""
    delta = np.zeros(2 * k + 1)
    delta[-1] = 1.0
    rho, alpha = [1 / gram[i, k + i] for i in range(k)], np.zeros(k)
    for i in reversed(range(k)):
        alpha[i] = rho[i] * (gram[i] @ delta)
        delta[k + i] -= alpha[i]
    delta *= gram[k - 1, 2 * k - 1] / gram[2 * k - 1, 2 * k - 1] if k else 1 / max(1.0, most)
    for i in range(k):
        delta[i] += alpha[i] - rho[i] * (gram[k + i] @ delta)
    if delta @ gram[-1] <= 0:  # no descent: the gradient itself
        delta = np.zeros(2 * k + 1)
        delta[-1] = 1.0
    return -delta


class _Start:
    """What the driver keeps of one start: its loss, the inner products of its basis by the names of their columns, the
    steps whose pairs count, and where it stands."""

    def __init__(self, k: int):
        self.k, self.value, self.dots, self.tags, self.most, self.done, self.halved = k, math.inf, {}, [], 0.0, False, 0

    def pair(self, tag: int) -> list[str]:
        return [f"s{self.k}_{tag}", f"y{self.k}_{tag}"]

    def basis(self) -> list[str]:
        return [self.pair(t)[0] for t in self.tags] + [self.pair(t)[1] for t in self.tags] + [f"g{self.k}"]

    def gram(self) -> np.ndarray:
        names = self.basis()
        return np.array([[self.dots[tuple(sorted((a, b)))] for b in names] for a in names])


def _free(k: int, low: float) -> Column:
    m, g = F.col(f"m{k}"), F.col(f"g{k}")
    return ~(((m <= low) & (g > 0)) | ((m >= 1 - low) & (g < 0)))


def _vector(values) -> Column:
    """Folded to one constant, so that code is compiled once for all its values."""
    return F.array(*[F.lit(float(v)) for v in values])


def _sums(sizes: dict[str, tuple[float, float]], model: str) -> list[Column]:
    """For each column of weighted feature totals: loss, sum of lq and sum of p * d of both clusters, as aggregates over
    features. `sizes` are those of clusters 0 and 1; `f` is a feature's total."""
    both, out = _vector([v for pair in sizes.values() for v in pair]), []
    for at, name in enumerate(sizes):
        for c in (0, 1):
            size, f = both[2 * at + c], F.col(name) if c else F.col("f") - F.col(name)
            p = f / size
            lq = F.ln(1 - p + _EPS) if model != "multinomial" else F.lit(0.0)
            d = f / (p + _EPS) - ((size - f) / (1 - p + _EPS) if model != "multinomial" else F.lit(0.0))
            part = f * F.ln(p + _EPS) + ((size - f) * lq if model != "multinomial" else F.lit(0.0))
            out += [F.sum(part).alias(f"{name}_{c}_score"), F.sum(lq).alias(f"{name}_{c}_lq"), F.sum(p * d).alias(f"{name}_{c}_pd")]
    return out


def _slope(name: str, sizes: tuple[float, float], model: str) -> Column:
    """What an occurrence of a feature adds to the derivative by its row's membership."""
    both, a = _vector(sizes), []
    for c in (0, 1):
        size, f = both[c], F.col(name) if c else F.col("f") - F.col(name)
        p = f / size
        lq = F.ln(1 - p + _EPS) if model != "multinomial" else F.lit(0.0)
        d = f / (p + _EPS) - ((size - f) / (1 - p + _EPS) if model != "multinomial" else F.lit(0.0))
        a.append(F.ln(p + _EPS) - lq + d / size)
    return a[0] - a[1]


def quasi_newton(matrix: DataFrame, first: list[DataFrame], model: str, steps: int, logit: float = 10.0, tolerance: float = 1e-6, memory: int = 5) -> tuple[DataFrame, list[float]]:
    """(members, losses): where limited-memory quasi-Newton descents of the loss in the box of memberships end, from all
    of `first` (row, m) together; members (row, m0, m1, ...), written.

    A table holds, for each row and start, membership, gradient and the last steps and changes of gradient. The
    recursion needs only their inner products, sums that the driver sees. A step takes two passes over the matrix for
    all starts and several step lengths at once: weighted totals of the features, which give the losses; then the
    derivatives, by a join of the features' slopes. Starts that have converged leave the columns."""
    model, low = score.score_model(model), 1 / (1 + math.exp(logit))
    entries = matrix.select("row", "feature", F.col("value").cast("double").alias("value"))
    rows = materialised(entries.groupBy("row").agg(F.collect_list(F.struct("feature", "value")).alias("x"), F.sum("value").alias("r")), "rows")
    state = rows.select("row", "r")
    for k, members in enumerate(first):
        state = state.join(members.select("row", F.greatest(F.lit(low), F.least(F.lit(1 - low), "m")).alias(f"m{k}")), "row")
    every = [_Start(k) for k in range(len(first))]
    state = materialised(state, "members")
    n, total = state.agg(F.count("*"), F.sum("r")).first()

    def measured(points: dict[str, Column], also: dict[str, Column], at: DataFrame) -> tuple[DataFrame, dict]:
        """(features with a weighted total for each of `points`, sums): points are memberships over the rows of `at`."""
        asked = [a for p, c in points.items() for a in (F.sum(c).alias(f"{p}_w"), F.sum(c * F.col("r")).alias(f"{p}_t"))]
        sums = at.agg(*asked, *(c.alias(k) for k, c in also.items())).first().asDict()
        met = rows.select("row", "x").join(at.select("row", *(c.alias(p) for p, c in points.items())), "row").select(F.explode("x").alias("x"), *points)
        features = met.groupBy("x.feature").agg(F.sum("x.value").alias("f"), *(F.sum(F.col("x.value") * F.col(p)).alias(p) for p in points))
        features = materialised(features, "features")
        sizes = {p: (n - sums[f"{p}_w"], sums[f"{p}_w"]) if model == "bernoulli" else (total - sums[f"{p}_t"], sums[f"{p}_t"]) for p in points}
        sums |= features.agg(*_sums(sizes, model)).first().asDict() | {f"{p}_sizes": v for p, v in sizes.items()}
        return features, sums

    def loss(sums: dict, p: str) -> float:
        parts = [sums[f"{p}_{c}_score"] for c in (0, 1)]
        return math.nan if None in parts else -sum(parts) / (_LN2 if model == "bernoulli" else 1.0)

    def graded(features: DataFrame, sums: dict, chosen: dict[int, str], at: DataFrame) -> DataFrame:
        """`at` with the new gradient h of the chosen point of each start."""
        slopes = features.select("feature", *(_slope(p, sums[f"{p}_sizes"], model).alias(f"a{k}") for k, p in chosen.items()))
        by_row = entries.join(slopes, "feature").groupBy("row").agg(*(F.sum(F.col("value") * F.col(f"a{k}")).alias(f"a{k}") for k in chosen))
        out = at.join(by_row, "row")
        for k, p in chosen.items():
            lean, (s0, s1) = [sums[f"{p}_{c}_lq"] for c in (0, 1)], sums[f"{p}_sizes"]
            const = -sums[f"{p}_0_pd"] / s0 + sums[f"{p}_1_pd"] / s1 + (lean[0] - lean[1] if model != "multinomial" else 0.0)
            own = F.lit(1.0) if model == "bernoulli" else F.col("r")
            out = out.withColumn(f"h{k}", (F.col(f"a{k}") + own * _vector([const])[0]) / (_LN2 if model == "bernoulli" else 1.0))
        return out.drop(*(f"a{k}" for k in chosen))

    def products(at: DataFrame, active: list[_Start], tag: int | None) -> None:
        """The inner products that the step `tag` has changed: those of its pair and of the free gradient."""
        asked, keys = {}, {}
        for s in active:
            g = F.when(_free(s.k, low), F.col(f"g{s.k}")).otherwise(0.0)
            new = s.pair(tag) if tag is not None else []
            names = [*s.basis(), *new]
            column = {c: F.col(c) for c in names} | {f"g{s.k}": g}
            for x in [*new, f"g{s.k}"]:
                for y in names:
                    key = tuple(sorted((x, y)))
                    keys[f"{key[0]}/{key[1]}"] = s, key
                    asked[f"{key[0]}/{key[1]}"] = F.sum(column[x] * column[y])
            asked[f"{s.k}/most"] = F.max(F.abs(g))
        got = at.agg(*(c.alias(k) for k, c in asked.items())).first().asDict()
        for s in active:
            s.most = got.pop(f"{s.k}/most") or 0.0
        for name, v in got.items():
            s, key = keys[name]
            s.dots[key] = v or 0.0

    points = {f"p{s.k}": F.col(f"m{s.k}") for s in every}
    features, sums = measured(points, {}, state)
    for s in every:
        s.value = loss(sums, f"p{s.k}")
    state = materialised(graded(features, sums, {s.k: f"p{s.k}" for s in every}, state).withColumnsRenamed({f"h{s.k}": f"g{s.k}" for s in every}), "members", state, features)
    products(state, every, None)
    for step in range(steps):
        active = [s for s in every if not s.done and s.most > tolerance and math.isfinite(s.value)]
        if not active:
            break
        moving, taken, direction, tried = list(active), {}, {}, []
        for s in active:
            delta, s.halved = _vector(_two_loops(s.gram(), len(s.tags), s.most)), 0
            whole = sum((F.col(c) * delta[i] for i, c in enumerate(s.basis())), F.lit(0.0))
            direction[s.k] = F.when(_free(s.k, low), whole).otherwise(0.0)
        while moving:
            points, also = {}, {}
            for s in moving:
                lengths = _vector([0.5 ** (s.halved + j) for j in range(TRIED)])
                for j in range(TRIED):
                    points[f"p{s.k}_{j}"] = at = F.greatest(F.lit(low), F.least(F.lit(1 - low), F.col(f"m{s.k}") + lengths[j] * direction[s.k]))
                    also[f"p{s.k}_{j}_down"] = F.sum(F.col(f"g{s.k}") * (at - F.col(f"m{s.k}")))
            features, sums = measured(points, also, state)
            tried.append(features)
            for s in list(moving):
                for j in range(TRIED):
                    p = f"p{s.k}_{j}"
                    new = loss(sums, p)
                    if math.isfinite(new) and new <= s.value + 1e-4 * sums[f"{p}_down"]:
                        taken[s.k] = (p, new, points[p], features, sums)
                        break
                s.halved += TRIED
                if s.k in taken or s.halved >= HALVINGS:
                    moving.remove(s)
        if not taken:
            dropped(*tried)
            break
        moved = state.withColumns({f"n{k}": t[2] for k, t in taken.items()})
        for features in tried:
            chosen = {k: t[0] for k, t in taken.items() if t[3] is features}
            if chosen:
                moved = graded(features, next(t[4] for t in taken.values() if t[3] is features), chosen, moved)
        columns = {c: F.col(c) for c in ["row", "r", *(f"m{s.k}" for s in every)]}
        for s in active:
            s.done = s.k not in taken
            if s.done:
                continue
            new = taken[s.k][1]
            s.done, s.value = s.value - new <= tolerance * max(abs(s.value), abs(new), 1.0), new
            columns[f"m{s.k}"] = F.col(f"n{s.k}")
            if not s.done:
                change = F.col(f"n{s.k}") - F.col(f"m{s.k}"), F.col(f"h{s.k}") - F.col(f"g{s.k}")
                columns |= {c: F.col(c) for c in s.basis()[:-1]} | dict(zip(s.pair(step), change, strict=True)) | {f"g{s.k}": F.col(f"h{s.k}")}
        state = materialised(moved.select(*(c.alias(k) for k, c in columns.items())), "members", state, *tried)
        left = [s for s in active if not s.done]
        if left:
            products(state, left, step)
        for s in left:
            if s.dots[tuple(sorted(s.pair(step)))] > 1e-12:
                s.tags = [*s.tags[-memory + 1 :], step]
    return state.select("row", *(f"m{s.k}" for s in every)), [s.value for s in every]


def _descended(matrix: DataFrame, members: DataFrame, model: str, steps: int, logit: float, tolerance: float, gap: tuple[float, float, float]) -> tuple[DataFrame, float]:
    """(row, m, g) where the descent of one start ends, and the loss there."""
    low = 1 / (1 + math.exp(logit))

    def loss(at: DataFrame) -> float:
        found = score.penalised_loss(matrix, at, model, *gap) if gap[0] and gap[1] else score.loss(matrix, at, model)
        return found.first()["loss"]

    def graded(at: DataFrame) -> DataFrame:
        return materialised(at.join(score.penalised_gradient(matrix, at, model, *gap), "row"), "step")

    value, at = loss(members), graded(members)
    length = 0.1 / max(at.agg(F.max(F.abs("g"))).first()[0], 1e-300)
    for _ in range(steps):
        for _ in range(20):
            moved = at.select("row", F.greatest(F.lit(low), F.least(F.lit(1 - low), F.col("m") - length * F.col("g"))).alias("m"))
            moved = materialised(moved, "members")
            new = loss(moved)
            if new < value:
                break
            length /= 4
        else:
            break
        done = value - new <= tolerance * max(1.0, abs(value))
        after = graded(moved)
        if done:
            return after, new
        both = after.select("row", F.col("m").alias("m2"), F.col("g").alias("g2")).join(at, "row")
        ss, sy = both.agg(F.sum((F.col("m2") - F.col("m")) ** 2), F.sum((F.col("m2") - F.col("m")) * (F.col("g2") - F.col("g")))).first()
        length = ss / sy if sy and sy > 0 else 4 * length
        at, value = after, new
    return at, value


def weighted_moments(df: DataFrame, vector: str, weight: str, ridge: float = 1e-2) -> DataFrame:
    """(i, j, covariance) for i <= j, of largest likelihood under the weights, with the ridge on the diagonal; from Gram
    blocks, one row of sums for each task."""
    _, _, cov = gram.moments(df, vector, [weight])[0]
    cells = [(i, j, float(cov[i, j]) + (ridge if i == j else 0.0)) for i in range(len(cov)) for j in range(i, len(cov))]
    return df.sparkSession.createDataFrame(cells, "i int, j int, covariance double")


def sample_covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, covariance) of named columns, one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    wide = df.agg(*(F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{k}").alias("covariance")) for k, (a, b) in enumerate(pairs)))).alias("x")
    return wide.select(cells).select("x.*")
