"""Rates of mixing where a wanted domain is scarce."""

from __future__ import annotations

import numpy as np
import pytest

from duoclust.llm import mixing


def test_a_domain_of_one_percent_meets_its_target(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(50, 500, 2000)
    wanted = np.where(np.arange(2000) % 100 == 0, 0.97, 0.02) + rng.uniform(-0.01, 0.01, 2000)
    rows = [(i, i, int(n[i]), [float(wanted[i]), float(1 - wanted[i])]) for i in range(2000)]
    soft = spark.createDataFrame(rows, "doc_id long, row long, n long, p array<double>")
    got = mixing.rates(soft, [0.9, 0.1]).selectExpr("sum(rate * n * p[0]) / sum(n)", "sum(rate * n * p[1]) / sum(n)", "min(rate)").first()
    assert got[0] == pytest.approx(0.9, abs=1e-3) and got[1] == pytest.approx(0.1, abs=1e-3) and got[2] >= 0


def test_a_target_out_of_reach_is_told(spark):
    soft = spark.createDataFrame([(i, i, 10 + i, [0.5, 0.5]) for i in range(20)], "doc_id long, row long, n long, p array<double>")
    with pytest.warns(UserWarning, match="no rates meet"):
        got = mixing.rates(soft, [0.9, 0.1]).selectExpr("sum(rate * n) / sum(n)").first()
    assert got[0] == pytest.approx(1.0, abs=0.05)
