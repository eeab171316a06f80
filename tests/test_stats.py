import math
import random

import numpy as np
import pytest

from hemispark.operators import stats


def test_fisher():
    odds, p = stats.fisher_exact(2767, 233, 7580, 660)
    assert odds == pytest.approx(1.0340, abs=5e-5) and p == pytest.approx(0.6935, abs=5e-4)
    assert stats.fisher_exact(3, 1, 1, 3)[1] == pytest.approx(34 / 70)
    assert stats.fisher_exact(0, 0, 0, 0)[1] == 1.0


def test_f_tail():
    for f in (0.3, 1.0, 2.5, 7.0):
        assert stats.f_tail(f, 2, 10) == pytest.approx((1 + f / 5) ** -5, rel=1e-10)  # closed form for 2 degrees
    assert stats.f_tail(1.0, 7, 7) == pytest.approx(0.5, rel=1e-10)
    assert stats.f_tail(0, 3, 9) == 1.0


def test_granger_is_ordinary_least_squares(spark):
    rng = random.Random(2)
    x = [abs(rng.gauss(0, 1)) for _ in range(60)]
    y = [0.0, 0.0]
    for t in range(2, 60):
        y.append(0.4 * y[-1] + 0.7 * x[t - 1] + rng.gauss(0, 0.5))
    df = spark.createDataFrame([("a", t, x[t], y[t]) for t in range(60)] + [("few", t, 0.0, 1.0 * t) for t in range(30)], "g string, t int, x double, y double")
    got = {(r.g, r.lag): (r.f, r.df_num, r.df_den) for r in stats.granger(df, "g", ["t"], "x", "y").collect()}
    assert {g for g, _ in got} == {"a"}
    for lag in (1, 2, 3):
        full = np.array([[1, *(y[t - k] for k in range(1, lag + 1)), *(x[t - k] for k in range(1, lag + 1))] for t in range(lag, 60)])
        target = np.array(y[lag:])
        rest = lambda m: float(((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum())
        den = len(target) - 2 * lag - 1
        want = (rest(full[:, : 1 + lag]) - rest(full)) / lag / (rest(full) / den)
        assert got["a", lag] == (pytest.approx(want, rel=1e-8), lag, den)
    assert stats.f_tail(*got["a", 1]) < 1e-6


def test_logit(spark):
    rows = [(1.0, 1.0)] * 30 + [(0.0, 1.0)] * 10 + [(1.0, 0.0)] * 15 + [(0.0, 0.0)] * 45
    got = {r.term: r for r in stats.logit(spark.createDataFrame(rows, "y double, x double"), "y", ["x"]).collect()}
    assert got["x"].coefficient == pytest.approx(math.log(30 * 45 / (10 * 15)), abs=1e-5)
    assert got["x"].std_error == pytest.approx(math.sqrt(1 / 30 + 1 / 10 + 1 / 15 + 1 / 45), abs=1e-5)


def test_random_intercept(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        u = rng.normal(0, 2)
        rows += [(f"g{g}", float(x), float(1 + 0.5 * x + u + rng.normal(0, 1))) for x in rng.normal(0, 1, 25)]
    got = {r.term: r for r in stats.random_intercept(spark.createDataFrame(rows, "g string, x double, y double"), "y", ["x"], "g").collect()}
    assert got["x"].coefficient == pytest.approx(0.5, abs=0.1) and got["x"].p < 1e-6
    assert got["group_variance"].coefficient == pytest.approx(4, rel=0.6) and got["residual_variance"].coefficient == pytest.approx(1, rel=0.15)
    # dense likelihood at the estimate is not beaten nearby
    groups = {}
    for g, x, y in rows:
        groups.setdefault(g, []).append((x, y))

    def dense(theta):
        a, b, ld, n = np.zeros((2, 2)), np.zeros(2), 0.0, len(rows)
        parts = []
        for v in groups.values():
            X, Y = np.array([[1, x] for x, _ in v]), np.array([y for _, y in v])
            V = np.eye(len(v)) + theta
            W = np.linalg.inv(V)
            a, b, ld = a + X.T @ W @ X, b + X.T @ W @ Y, ld + np.linalg.slogdet(V)[1]
            parts.append((X, Y, W))
        beta = np.linalg.solve(a, b)
        s = sum((Y - X @ beta) @ W @ (Y - X @ beta) for X, Y, W in parts) / n
        return -0.5 * (n * math.log(2 * math.pi * s) + ld + n), beta

    theta = got["group_variance"].coefficient / got["residual_variance"].coefficient
    assert dense(theta)[1][1] == pytest.approx(got["x"].coefficient, rel=1e-6)
    assert dense(theta)[0] >= max(dense(theta * 0.98)[0], dense(theta * 1.02)[0]) - 1e-9


def test_counting(spark):
    df = spark.createDataFrame([(0.001,), (0.03,), (0.2,), (None,)], "p double")
    assert tuple(stats.count_significant(df).first()) == (3, 2, 1)
