from __future__ import annotations

import numpy as np
import pytest

from duoclust.functions import kernels


def differences(f, w):
    g = np.zeros(len(w))
    for i in range(len(w)):
        a, b = w.copy(), w.copy()
        a[i] += 1e-6
        b[i] -= 1e-6
        g[i] = (f(a) - f(b)) / 2e-6
    return g


@pytest.fixture
def binary():
    rng = np.random.default_rng(20260728)
    return (rng.random((12, 17)) < rng.uniform(0.08, 0.72, 17)).astype(float), rng.uniform(0.15, 0.85, 12)


def direct_loss(x, w):
    total = 0.0
    for weights in (w, 1 - w):
        p = [sum(weights[i] * x[i, j] for i in range(len(x))) / weights.sum() for j in range(x.shape[1])]
        assert abs(sum(p) - 1) > 1e-3  # probabilities of features are no distribution
        for i in range(len(x)):
            for j in range(x.shape[1]):
                total += weights[i] * (x[i, j] * np.log2(p[j] + kernels.EPS) + (1 - x[i, j]) * np.log2(1 - p[j] + kernels.EPS))
    return -total


def test_bernoulli_loss_is_the_direct_one(binary):
    x, w = binary
    np.testing.assert_allclose(kernels.loss_and_gradient(x, w, "bernoulli")[0], direct_loss(x, w), rtol=1e-12, atol=1e-10)


@pytest.mark.parametrize("model", ["bernoulli", "binomial", "multinomial"])
def test_gradients(binary, model):
    x, w = binary
    np.testing.assert_allclose(kernels.loss_and_gradient(x, w, model)[1], differences(lambda v: kernels.loss_and_gradient(x, v, model)[0], w), rtol=1e-6, atol=2e-6)
    np.testing.assert_allclose(kernels.penalised(x, w, model, 2.0, 9.0, 0.5)[1], differences(lambda v: kernels.penalised(x, v, model, 2.0, 9.0, 0.5)[0], w), rtol=1e-5, atol=1e-3)


def test_soft_loo_and_gaussian_gradients(binary):
    x, w = binary
    np.testing.assert_allclose(kernels.soft_loo(x, w, 0.5)[1], differences(lambda v: kernels.soft_loo(x, v, 0.5)[0], w), rtol=1e-6, atol=2e-6)
    rng = np.random.default_rng(20260729)
    y, u = rng.normal(size=(11, 4)), rng.uniform(0.1, 1, 11)
    for f in (kernels.gaussian_objective, kernels.radius_objective):
        np.testing.assert_allclose(f(y, u)[1], differences(lambda v, f=f: f(y, v)[0], u), rtol=1e-6, atol=2e-6)


def test_no_penalty_is_the_plain_loss(binary):
    x, w = binary
    assert kernels.penalised(x, w, "multinomial", 0.0, 1.0, 0.5)[0] == kernels.loss_and_gradient(x, w, "multinomial")[0]
    assert kernels.penalised(x, w, "multinomial", 2.0, 0.0, 0.5)[0] == kernels.loss_and_gradient(x, w, "multinomial")[0]


def test_mcc_of_known_tables():
    for cells, score in (((447, 28, 27, 356), 93.51694504077723), ((93, 363, 381, 8), 88.94266482278707)):
        truth = np.repeat([1, 0, 1, 0], cells)
        labels = np.repeat([1, 1, 0, 0], cells)
        assert kernels.normalized_mcc(truth, labels) == pytest.approx(score, rel=1e-13)
    assert kernels.normalized_mcc(np.array([0, 1]), np.array([1, 1])) == 50.0


def test_partition_finds_planted_clusters():
    from duoclust.plans.benchmarks import sparse_bernoulli

    x, truth = sparse_bernoulli(200, 0.01, 0.11, 0.9, 50, np.random.default_rng(1))
    best = kernels.partition(x, "bernoulli", n_init=2, max_iter=150)
    assert kernels.normalized_mcc(truth, best["labels"]) > 95
    with pytest.raises(ValueError, match="collapsed"):
        kernels.partition(np.ones((4, 2)), "bernoulli", n_init=1, max_iter=5, least=0.6)


def test_rounding_rules_differ():
    w = np.array([0.5, 0.500001, 1.0])
    assert (w >= 0.5).astype(int).tolist() == [1, 1, 1]
    assert np.round(w).astype(int).tolist() == [0, 1, 1]


def test_dbscan_on_bits():
    x = np.array([[0, 1]] * 5 + [[1, 1]] * 4 + [[0, 0]] * 6)
    assert kernels.dbscan_binary(x).tolist() == [1] * 5 + [-1] * 4 + [0] * 6
