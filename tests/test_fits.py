"""Queries that no SQL states: against kernels, against the losses they lower and against published quality."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoclust.functions import kernels
from duoclust.operators import optimize, score
from duoclust.plans import benchmarks
from duoclust.plans.registry import QUERIES, _matrix

from .conftest import SF


def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("size(embedding) > 0").orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)


def cost(x, labels):
    return sum(((x[labels == k] - x[labels == k].mean(axis=0)) ** 2).sum() for k in np.unique(labels))


def test_large_kmeans_costs_what_the_kernel_costs(spark):
    ids, x = vectors(spark)
    got = {r["vec_id"]: r["label"] for r in QUERIES["large_kmeans"](spark, SF).collect()}
    assert sorted(got) == ids and cost(x, np.array([got[i] for i in ids])) <= 1.02 * cost(x, kernels.kmeans(x, 0))


def test_large_gmm_labels_every_row(spark):
    ids, _ = vectors(spark)
    got = {r["vec_id"]: r["label"] for r in QUERIES["large_gmm"](spark, SF).collect()}
    assert sorted(got) == ids and set(got.values()) <= {0, 1}


def test_large_partition_lowers_the_loss(spark):
    x, members, _ = _matrix(spark, SF)
    found = optimize.large_partition(x, "multinomial", steps=2)
    value = lambda m: score.loss(x, m, "multinomial").first()["loss"]
    assert value(found.select("row", "m")) < value(members)
    assert found.where((F.col("m") >= 0.5) != (F.col("label") == 1)).count() == 0


def test_partitions_are_the_kernels(spark):
    """Each conversation's loss is that of its memberships."""
    got = [r.asDict() for r in QUERIES["optimized_partitions"](spark, SF).collect()]
    assert all(math.isnan(r["membership"]) or (r["membership"] >= 0.5) == (r["label"] == 1) for r in got)
    fitted = {r["key"] for r in got if not math.isnan(r["loss"])}
    assert fitted and all(len({r["loss"] for r in got if r["key"] == k}) == 1 for k in fitted)


@pytest.fixture(scope="module")
def categorical(spark):
    config = benchmarks.Config(simulations=4)
    tasks = benchmarks.categorical_tasks(spark, config).where("fraction = 0.9 and panel in (0, 2, 5, 6)")
    rows = benchmarks.categorical_trials(tasks, config).groupBy("panel", "method").agg(F.avg("mcc").alias("mcc")).collect()
    return {(r["panel"], r["method"]): r["mcc"] for r in rows}


#: Published means and deviations at a fraction of 0.9: information method, k-means, mixture, density.
PUBLISHED = {
    0: ((96.51, 2.18), (80.14, 5.26), (58.93, 7.88), (50.00, 0.0)), 2: ((99.93, 0.29), (87.00, 4.54), (58.72, 8.22), (54.26, 3.26)),
    5: ((92.82, 2.57), (74.57, 4.91), (60.00, 6.51), (65.89, 1.55)), 6: ((56.94, 5.11), (56.56, 5.07), (56.02, 4.90), (50.00, 0.0)),
}


@pytest.mark.parametrize("panel", sorted(PUBLISHED))
def test_categorical_quality_is_the_published_one(categorical, panel):
    for method, (mean, std) in zip(("Cross-Entropy", "K-means", "GMM", "DBSCAN"), PUBLISHED[panel], strict=True):
        assert abs(categorical[panel, method] - mean) <= 4 * std / 2 + 1.5, (method, categorical[panel, method], mean)  # four simulations


def test_gaussian_quality_is_the_published_one(spark):
    config = benchmarks.Config(simulations=4)
    tasks = benchmarks.gaussian_tasks(spark, config).where("dimension = 50 and coefficient = 2 and noise = 0")
    rows = benchmarks.gaussian_trials(tasks, config).groupBy("method").agg(F.avg(F.nanvl("mcc", F.lit(None).cast("double"))).alias("mcc"), F.count("failure").alias("failed")).collect()
    got = {r["method"]: r for r in rows}
    for method, mean, std in (("Self-Information", 96.51, 3.84), ("$L_2$ Norm", 84.85, 8.53), ("Gaussian Mixture", 56.78, 4.24), ("CEC", 55.18, 3.02), ("Reg. EM", 54.88, 3.00)):
        assert abs(got[method]["mcc"] - mean) <= 4 * std / 2 + 1.5, (method, got[method], mean)
    assert got["Differential Entropy"]["mcc"] is None and all(r["failed"] == 0 for r in got.values())
    asked = benchmarks.gaussian_trials(tasks, config, 1, 1, differential_entropy=True).where("method = 'Differential Entropy'").agg(F.avg("mcc")).first()[0]
    assert 50 <= asked <= 100


def test_permutations_agree_with_the_normal_law(spark):
    row = QUERIES["permutation_significance"](spark, SF).first()
    assert row["permutations"] == 100_000 and row["p"] == pytest.approx((row["exceedances"] + 1) / 100_001)


def test_permutation_p_of_a_small_panel(spark):
    """All subsets of six values, by their own count."""
    from itertools import combinations

    from duoclust.operators import inference

    v, side = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0], [True, True, False, False, False, False]
    seen = abs(np.mean(v[:2]) - np.mean(v[2:]))
    hits = [abs(sum(c) / 2 - (sum(v) - sum(c)) / 4) >= seen - 1e-12 for c in combinations(v, 2)]
    got = inference.permutation_test(v, side, spark, 20_000).first()
    assert got["p"] == pytest.approx(np.mean(hits), abs=0.02)
    with pytest.raises(ValueError):
        inference.permutation_test([0.0] * (inference.PANEL + 1), [True] * (inference.PANEL + 1), spark, 10)


def test_text_sweep_has_a_row_for_each_combination(spark):
    got = QUERIES["text_sweep"](spark, SF).collect()
    assert {(r["ngram"], r["window"], r["features"]) for r in got} == {(n, w, f) for n in (1, 2) for w in (2, 4) for f in ("100", "300")}
    assert all(r["optimizer_success"] in (True, False) and (math.isnan(r["information_mcc"]) or 0 <= r["information_mcc"] <= 100) for r in got)


def _small(spark, seed=3, n=8, d=5):
    rng = np.random.default_rng(seed)
    x, m = rng.integers(0, 4, (n, d)).astype(float), rng.uniform(0.1, 0.9, n)
    x[:, 0] += 1
    matrix = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(d) if x[i, j]], "row long, feature long, value double")
    return x, m, matrix, spark.createDataFrame([(i, float(v)) for i, v in enumerate(m)], "row long, m double")


@pytest.mark.parametrize("model", ["binomial", "multinomial"])
def test_penalised_gradients_are_the_slopes(spark, model):
    x, m, matrix, members = _small(spark)
    loss = lambda w: kernels.penalised(x, w, model, 2.0, 3.0, 0.5)[0]
    got = [r["g"] for r in score.penalised_gradient(matrix, members, model, 2.0, 3.0).orderBy("row").collect()]
    for i, g in enumerate(got):
        step = np.zeros(len(m))
        step[i] = 1e-6
        assert g == pytest.approx((loss(m + step) - loss(m - step)) / 2e-6, rel=1e-4, abs=1e-4)


def test_audit_finds_the_slopes_of_the_kernel(spark):
    x, m, matrix, members = _small(spark)
    x = (x > 0).astype(float)
    loss = lambda w: kernels.loss_and_gradient(x, w, "bernoulli")[0]
    got = score.slope_audit(matrix.withColumn("value", F.lit(1.0)), members).orderBy("row").collect()
    for r in got:
        step = np.eye(len(m))[r["row"]] * 1e-4
        assert r["slope"] == pytest.approx((loss(m + step) - loss(m - step)) / 2e-4, rel=1e-6, abs=1e-6) and r["g"] == pytest.approx(r["slope"], rel=1e-4, abs=1e-4)


def test_rows_without_entries_have_no_slope(spark):
    _, _, matrix, members = _small(spark)
    more = members.unionByName(spark.createDataFrame([(99, 0.3)], "row long, m double"))
    got = {r["row"]: (r["g0"], r["g1"]) for r in score.soft_loo_gradient(matrix, more).collect()}
    assert got[99] == (0.0, 0.0) and len(got) == 9


def test_large_partition_of_several_starts(spark):
    _, _, matrix, _ = _small(spark, n=12)
    found = {r["row"]: r["label"] for r in optimize.large_partition(matrix, "multinomial", steps=2, starts=2, weight=1.0, target=1.0).collect()}
    assert len(found) == 12 and 0 < sum(found.values()) < 12
    with pytest.raises(ValueError):
        optimize.large_partition(matrix, "multinomial", steps=0, starts=1, least=0.9)


@pytest.mark.parametrize("size", [0, 1, 60, 120, 500])
def test_random_subsets_are_the_least_hashes(spark, size):
    import hashlib

    from duoclust.operators import inference

    got = sorted(map(tuple, inference.random_subsets(spark.range(120).withColumnRenamed("id", "row"), 3, size).collect()))
    least = lambda k: sorted(range(120), key=lambda i: hashlib.md5(f"{k}-{i}".encode()).hexdigest())[:size]
    assert got == sorted((k, i) for k in range(3) for i in least(k))
