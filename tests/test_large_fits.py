"""Fits of matrices that no task holds, and fits dealt to many tasks, against the kernels."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoclust.functions import kernels
from duoclust.operators import gram, inference, lloyd, optimize, order, text
from duoclust.plans import benchmarks
from duoclust.sources import io


def counts_of(spark, seed=1, n=60, d=12):
    rng = np.random.default_rng(seed)
    p = np.where(np.arange(n)[:, None] < n // 2, rng.dirichlet(np.ones(d), 1), rng.dirichlet(np.ones(d), 1))
    x = rng.poisson(p * 20).astype(float)
    x[:, 0] += 1
    entries = [(i, j, float(x[i, j])) for i in range(n) for j in range(d) if x[i, j]]
    return x, spark.createDataFrame(entries, "row long, feature long, value double").repartition(3)


def starts_of(spark, x, k=3):
    rng = np.random.default_rng(2)
    firsts = [kernels.median_membership(x.sum(axis=1) if i == 0 else x @ rng.choice([-1.0, 1.0], x.shape[1])) for i in range(k)]
    return firsts, [spark.createDataFrame([(i, float(v)) for i, v in enumerate(m)], "row long, m double") for m in firsts]


@pytest.mark.parametrize("model", ["bernoulli", "binomial", "multinomial"])
def test_quasi_newton_ends_where_the_kernel_ends(spark, model):
    """After as many steps: both go the same way."""
    x, matrix = counts_of(spark)
    if model == "bernoulli":
        x, matrix = (x > 2).astype(float), matrix.where("value > 2").withColumn("value", F.lit(1.0))
        x = x[x.sum(axis=1) > 0]
        ids = {r["row"]: k for k, r in enumerate(matrix.select("row").distinct().orderBy("row").collect())}
        matrix = spark.createDataFrame([(ids[r["row"]], r["feature"], 1.0) for r in matrix.collect()], "row long, feature long, value double")
    firsts, members = starts_of(spark, x)
    low = 1 / (1 + np.exp(10.0))
    with io.scratch():
        found, losses = optimize.quasi_newton(matrix, members, model, 12, tolerance=1e-9)
        ends = {r["row"]: [r[f"m{k}"] for k in range(3)] for r in found.collect()}
    for k, first in enumerate(firsts):
        _, value, _, _ = kernels.bounded_descent(lambda w: kernels.loss_and_gradient(x, w, model), first, low, 1 - low, 12, 1e-9, memory=5)
        m = np.array([ends[i][k] for i in range(len(x))])
        assert losses[k] == pytest.approx(kernels.loss_and_gradient(x, m, model)[0], rel=1e-9)
        assert losses[k] == pytest.approx(value, rel=1e-6) and m.min() >= low - 1e-15 and m.max() <= 1 - low + 1e-15


def test_large_partition_leaves_only_its_result(spark):
    x, matrix = counts_of(spark)
    folder = io.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    found = optimize.large_partition(matrix, "multinomial")
    assert len(set(os.listdir(folder)) - before) == 1
    m = np.array([r["m"] for r in found.orderBy("row").collect()])
    assert kernels.loss_and_gradient(x, m, "multinomial")[0] <= kernels.partition(x, "multinomial")["loss"] * (1 + 1e-5)
    assert found.where((F.col("m") >= 0.5) != (F.col("label") == 1)).count() == 0


def test_two_loops_by_products_equal_two_loops_by_vectors():
    rng = np.random.default_rng(0)
    s, y, g = rng.normal(size=(3, 9)), rng.normal(size=(3, 9)), rng.normal(size=9)
    y = np.where((s * y).sum(axis=1)[:, None] > 0, y, -y)
    basis = np.vstack([s, y, g])
    delta = optimize._two_loops(basis @ basis.T, 3, np.abs(g).max())
    q, alphas = g.copy(), []
    for i in (2, 1, 0):
        alphas.append((s[i] @ q) / (s[i] @ y[i]))
        q = q - alphas[-1] * y[i]
    q = q * (s[2] @ y[2]) / (y[2] @ y[2])
    for i in (0, 1, 2):
        q = q + s[i] * (alphas[2 - i] - (y[i] @ q) / (s[i] @ y[i]))
    assert np.allclose(delta @ basis, -q) if q @ g > 0 else np.allclose(delta @ basis, -g)


# ---------------------------------------------------------------- fits dealt by cost


def test_starts_are_dealt_to_tasks_of_equal_cost(spark):
    rows = spark.range(400).select("id", F.pow(F.col("id") % 20, F.lit(2)).cast("double").alias("cost"))
    load = order.dealt(rows, F.col("cost"), "id", tasks=16).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("cost").alias("c"), F.count("*").alias("n")).collect()
    assert len(load) == 16 and sum(r["n"] for r in load) == 400 and max(r["c"] for r in load) < 2 * np.mean([r["c"] for r in load])
    config = benchmarks.Config(simulations=1, restarts=2, iterations=5)
    tasks = benchmarks.categorical_tasks(spark, config)
    plan = benchmarks.categorical_trials(tasks, config)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_ties_go_to_the_first_start(spark):
    names = [c.split()[0] for c in io.TRIALS.split(", ")]
    ends = spark.range(1).select(*(F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in io.TRIALS.split(", ") if c.split()[0] != "mcc"))
    ends = ends.crossJoin(spark.createDataFrame([(3, 1.0, 30.0), (1, 1.0, 10.0), (2, 1.0, 20.0), (0, None, 0.0)], "start int, loss double, mcc double"))
    best = benchmarks._best(ends, io.TRIALS).collect()
    assert len(best) == 1 and best[0]["mcc"] == 10.0 and best[0].__fields__ == names


def test_partition_equals_the_best_of_its_starts():
    x, _ = np.random.default_rng(3).poisson(2.0, (40, 9)).astype(float), None
    best = kernels.partition(x, "multinomial", n_init=4, max_iter=50, seed=5)
    ends = [kernels.partition_start(x, "multinomial", k, 50, seed=5) for k in range(4)]
    assert best["loss"] == min(e["loss"] for e in ends if e) and best["restart"] == min((e["loss"], e["restart"]) for e in ends if e)[1]


def test_sparse_fits_equal_dense_fits():
    rng = np.random.default_rng(4)
    x = rng.poisson(0.6, (50, 14)).astype(float)
    x[:, 0] += 1
    row, col = np.nonzero(x)
    at = np.repeat(np.arange(len(row)), x[row, col].astype(int))  # a cell in as many entries as it counts
    sparse = kernels.Sparse(row[at], col[at], np.ones(len(at)), x.shape)
    w, v = rng.uniform(size=50), rng.normal(size=14)
    assert np.allclose(w @ sparse, w @ x) and np.allclose(sparse @ v, x @ v) and np.allclose(sparse.sum(axis=1), x.sum(axis=1)) and np.allclose(sparse.dense_row(7), x[7])
    for model in ("binomial", "multinomial"):
        assert kernels.partition(sparse, model, 2, 40)["loss"] == pytest.approx(kernels.partition(x, model, 2, 40)["loss"], rel=1e-9)
    cost = lambda labels: sum(((x[labels == k] - x[labels == k].mean(axis=0)) ** 2).sum() for k in (0, 1))
    assert cost(kernels.sparse_kmeans(sparse, 0)) == pytest.approx(cost(kernels.kmeans(x, 0)), rel=0.02)


# ---------------------------------------------------------------- the sweep


def test_counts_of_every_width_come_from_one_pass(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(0, i, [rng.choice(list("abc")).item() for _ in range(rng.integers(0, 4))]) for i in range(12)], "k int, t int, toks array<string>")
    placed = text.sequences(docs, "k", ["t"], ranges=3, toks=F.col("toks")).cache()
    for n in (1, 2, 3):
        found = text.counts_by_width(text.ngram_spans(placed, n, block=4), [1, 2, 5, 30]).collect()
        for w in (1, 2, 5, 30):
            want = {tuple(r["feature"]): (r["cnt"], r["first"]["place"]) for r in text.feature_counts(text.occurrences(placed, n, w)).collect()}
            assert {tuple(r["feature"]): (r["cnt"], r["first"]) for r in found if r["width"] == w} == want


# ---------------------------------------------------------------- replicates


def test_masks_are_the_least_numbers(spark):
    rows = spark.range(300).select(F.col("id").alias("row")).repartition(7)
    for draw in ("md5", "counter"):
        for size in (0, 1, 150, 300):
            got = {r["row"]: np.unpackbits(np.frombuffer(bytes(r["mask"]), np.uint8), count=11) for r in inference.subset_masks(rows, 11, size, draw).collect()}
            import pyarrow as pa

            h = inference._drawn(pa.array(range(300)), np.arange(11), draw)
            want = np.argsort(np.argsort(h, axis=0), axis=0) < size
            assert all((got[i] == want[i]).all() for i in range(300))


def test_importance_of_salted_features_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(inference, "SALTS", 3)
    rng = np.random.default_rng(6)
    x, label = rng.poisson(1.0, (80, 6)).astype(float), rng.integers(0, 2, 80)
    entries = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(80) for j in range(6) if x[i, j]], "row long, feature string, value double")
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "row long, label int")
    got = {r["feature"]: (r["mean"], r["std"]) for r in inference.half_sample_importance(entries, labels, 21).collect()}
    import pyarrow as pa

    h = inference._drawn(pa.array(range(80)), np.arange(21), "md5")
    half = np.argsort(np.argsort(h, axis=0), axis=0) < 40
    for j in range(6):
        d = [x[half[:, r] & (label == 1), j].mean() - x[half[:, r] & (label == 0), j].mean() for r in range(21)]
        assert got[f"f{j}"] == (pytest.approx(np.mean(d)), pytest.approx(np.std(d, ddof=1)))


def test_permutations_of_any_number_of_rows(spark):
    v, side = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0], [True, True, False, False, False, False]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(v, side, strict=True))], "row long, v double, one boolean").repartition(3)
    got = inference.permutation_by_hash(df, "v", "one", 20_000, draw="counter").first()
    from itertools import combinations

    seen = abs(np.mean(v[:2]) - np.mean(v[2:]))
    assert got["p"] == pytest.approx(np.mean([abs(sum(c) / 2 - (sum(v) - sum(c)) / 4) >= seen - 1e-12 for c in combinations(v, 2)]), abs=0.02)


# ---------------------------------------------------------------- Gram blocks


def blobs(spark, n=300, d=5):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(n // 2, d)), rng.normal(size=(n // 2, d)) * 2 + 3])
    w = rng.uniform(0.1, 1.0, n)
    return x, w, spark.createDataFrame([(i, v.tolist(), float(a), "clash") for i, (v, a) in enumerate(zip(x, w, strict=True))], "id long, v array<double>, w double, label string").repartition(5)


def test_moments_of_several_weights(spark):
    x, w, df = blobs(spark)
    for (total, mean, cov), u in zip(gram.moments(df.withColumn("one", F.lit(1.0)), "v", ["w", "one"]), (w, np.ones(len(x))), strict=True):
        assert total == pytest.approx(u.sum()) and np.allclose(mean, np.average(x, axis=0, weights=u)) and np.allclose(cov, np.cov(x.T, bias=True, aweights=u))


@pytest.mark.parametrize("method", ["regularized", "cec", "differential", "gmm"])
def test_mixtures_equal_the_kernels(spark, method):
    x, _, df = blobs(spark)
    first = x[[3, 290]]
    got = [r["label"] for r in gram.mixture(df, "v", method, first).orderBy("id").collect()]
    if method == "regularized":
        want = kernels.regularized_em(x, 0, first=first)
    elif method == "gmm":
        labels = kernels.kmeans(x, 0)
        first = np.stack([x[labels == k].mean(axis=0) for k in (0, 1)])
        got, want = [r["label"] for r in gram.mixture(df, "v", method, first).orderBy("id").collect()], kernels.gmm(x, 0)
        want = want if (np.array(got) == want).mean() > 0.5 else 1 - want
    else:
        want = kernels.cross_entropy_clusters(x, 0, log_space=method == "cec", first=first)
    assert (np.array(got) == want).all()


def test_gaussian_spread_equals_the_kernel(spark):
    x, w, df = blobs(spark)
    value, found = gram.gaussian_spread(df, "v", "w")
    want, slopes = kernels.gaussian_objective(x, w)
    assert value == pytest.approx(want, rel=1e-10) and np.allclose([r["slope"] for r in found.orderBy("id").collect()], slopes, rtol=1e-7, atol=1e-12)
    assert found.columns == ["id", "v", "w", "label", "slope"]


def test_lloyd_steps_and_many_starts(spark):
    x, _, df = blobs(spark)
    centres = [x[[0, 299]], x[[5, 6]], np.array([[0.0] * 5, [1e9] * 5])]
    for (n, mean, cost), c in zip(lloyd.step(df, "v", centres), centres, strict=True):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        label = d.argmin(axis=1)
        assert n.tolist() == [(label == k).sum() for k in (0, 1)] and cost == pytest.approx(d.min(axis=1).sum(), rel=1e-6)
        assert all(np.allclose(mean[k], x[label == k].mean(axis=0) if (label == k).any() else c[k]) for k in (0, 1))
    price = lambda labels: sum(((x[labels == k] - x[labels == k].mean(axis=0)) ** 2).sum() for k in np.unique(labels))
    got = np.array([r["label"] for r in lloyd.kmeans(df, "v", "id", [0, 1, 2]).orderBy("id").collect()])
    assert price(got) <= 1.001 * price(kernels.kmeans(x, 0))
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, None)], "id long, v array<double>")
    assert {r["label"] for r in lloyd.kmeans(same, "v", "id", [0]).where("v IS NOT NULL").collect()} == {0}


@pytest.mark.parametrize(("model", "n", "width"), [("multinomial", 1, 2), ("binomial", 2, 3)])
def test_sweep_in_blocks_finds_what_the_kernels_find(spark, model, n, width):
    """Windows over three blocks, some without labels, against one matrix in memory; descents that outlast KEEP."""
    from duoclust.operators import blocks
    from duoclust.plans import benchmarks

    rng = np.random.default_rng(7)
    size, top = 2 * blocks.ROWS + 400, 9
    side = (np.arange(size) // 150) % 2
    docs = [[f"w{int(v)}" for v in (rng.geometric(0.25, rng.integers(0, 5)) + 2 * k) % 14] for k in side]
    labelled = [i for i in range(size) if i % 97]
    df = spark.createDataFrame([(0, i, size, d) for i, d in enumerate(docs)], "key int, seq long, n_docs long, toks array<string>")
    labels = spark.createDataFrame([(i, int(side[i])) for i in labelled], "row long, label int")
    got = benchmarks.text_sweep(df, labels, [n], [width], [top], restarts=3, iterations=40, model=model, kmeans_starts=6).collect()

    spans = benchmarks.text.ngram_spans(df, n)
    ranked = benchmarks.text.ranked_by_width(benchmarks.text.counts_by_width(spans, [width]), top)
    names = {tuple(r["feature"]): k for k, r in enumerate(ranked.select("feature").orderBy(F.xxhash64("feature")).collect())}
    x = np.zeros((size, top))
    for r in spans.collect():
        if (k := names.get(tuple(r["feature"]))) is not None:
            x[max(0, r["de"] - width + 1) : min(size - 1, r["ds"] + width) + 1, k] += 1
    rows = np.array([i for i in labelled if x[i].any()])
    r, c = np.nonzero(x[rows])
    sparse = kernels.Sparse(r, c, x[rows][r, c], (len(rows), top))
    best = kernels.partition(sparse, model, 3, 40)
    assert len(got) == 1 and (got[0]["n_samples"], got[0]["n_features"]) == (len(rows), top) and best["n_iter"] > blocks.KEEP
    assert (got[0]["optimizer_iterations"], got[0]["optimizer_success"]) == (best["n_iter"], best["success"])
    assert got[0]["information_loss"] == pytest.approx(best["loss"], rel=1e-9)
    assert got[0]["information_mcc"] == pytest.approx(kernels.normalized_mcc(side[rows], best["labels"]), abs=1e-9)
    assert got[0]["kmeans_mcc"] == pytest.approx(kernels.normalized_mcc(side[rows], kernels.sparse_kmeans(sparse, 0, 6)), abs=1e-9)


def test_blocks_bound_what_a_task_holds(spark):
    from duoclust.operators import blocks

    size = 3 * blocks.ROWS
    entries = spark.createDataFrame([(b, i, i, size, [0], None) for i in range(size) for b in {max(0, i - 1) // blocks.ROWS, min(size - 1, i + 2) // blocks.ROWS}] + [(i // blocks.ROWS, i, None, None, None, 1) for i in range(size)], "block int, ds long, de long, n_docs long, cols array<int>, label long")
    found = blocks.counted(entries, [(0, 2, 1)]).collect()
    assert {r["block"]: len(r["truth"]) // 8 for r in found} == {0: blocks.ROWS, 1: blocks.ROWS, 2: blocks.ROWS}
    assert sum(int(np.frombuffer(r["x"], r["kind"]).sum()) for r in found) == sum(min(size - 1, i + 2) - max(0, i - 1) + 1 for i in range(size))
