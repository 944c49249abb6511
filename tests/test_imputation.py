"""Chained equations from sufficient statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import imputation


def data(spark, n=300, p=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p)) @ rng.standard_normal((p, p)) + rng.standard_normal(p) * 100
    x[rng.random((n, p)) < [0.1, 0.25, 0.0, 0.3][:p]] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], f"n{i}") for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, " + ", ".join(f"c{j} double" for j in range(p)) + ", note string")


def plain_rounds(x, rounds, start, fit):
    """Column after column, over the rows themselves."""
    lacks, x = np.isnan(x), np.where(np.isnan(x), start, x)
    for _ in range(rounds):
        for c in range(x.shape[1]):
            if not lacks[:, c].any():
                continue
            others = [j for j in range(x.shape[1]) if j != c]
            a, b = x[~lacks[:, c]][:, others], x[~lacks[:, c], c]
            w = fit(a - a.mean(0), b - b.mean())
            x[lacks[:, c], c] = (x[lacks[:, c]][:, others] - a.mean(0)) @ w + b.mean()
    return x


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_equals_round_by_round(spark, rounds):
    x, df = data(spark)
    got = {r["id"]: r for r in imputation.iterative_impute(df, ["c0", "c1", "c2", "c3"], rounds).collect()}
    want = plain_rounds(x, rounds, np.nanmean(x, 0), lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0])
    assert len(got) == 300 and got[7]["note"] == "n7"
    assert np.allclose([[got[i][f"c{j}"] for j in range(4)] for i in range(300)], want, rtol=1e-8)


def test_equals_the_passes_over_the_data(spark, monkeypatch):
    x, df = data(spark, 80, 3, 2)
    cols = ["c0", "c1", "c2"]
    fast = {r["id"]: tuple(r) for r in imputation.iterative_impute(df, cols, 2, "median").collect()}
    monkeypatch.setattr(imputation, "MAX_NUMBERS", 20)       # too many patterns: over the data
    assert imputation.fit_iterative(df, cols) is None
    slow = {r["id"]: tuple(r) for r in imputation.iterative_impute(df, cols, 2, "median").collect()}
    assert all(np.allclose(fast[i][1:4], slow[i][1:4], rtol=1e-8) and fast[i][4] == slow[i][4] for i in slow)


def evidence_ridge(a, b):
    """The same fixed point as found by plain alternation on the rows."""
    n, alpha, lam = len(b), 1 / np.var(b), 1.0
    s = np.linalg.svd(a, compute_uv=False) ** 2
    for _ in range(3000):
        w = np.linalg.solve(a.T @ a + lam / alpha * np.eye(a.shape[1]), a.T @ b)
        used = (alpha * s / (lam + alpha * s)).sum()
        lam, alpha = (used + 2e-6) / (w @ w + 2e-6), (n - used + 2e-6) / (((b - a @ w) ** 2).sum() + 2e-6)
    return np.linalg.solve(a.T @ a + lam / alpha * np.eye(a.shape[1]), a.T @ b)


def test_bayesian_ridge_and_order(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((60, 5))
    b = a @ [1, 0, 0, 2, 0] + rng.standard_normal(60)
    a, b = a - a.mean(0), b - b.mean()
    w = imputation.bayesian_ridge(60, None, None, a.T @ a, a.T @ b, b @ b, tol=0, rounds=3000)
    assert np.allclose(w, evidence_ridge(a, b), rtol=1e-9)
    x, df = data(spark)
    fitted = imputation.fit_iterative(df, ["c3", "c1", "c2", "c0"], 3, estimator="bayesian_ridge", ascending=True)
    got = {r["id"]: r for r in fitted.apply(df).collect()}
    want = plain_rounds(x[:, [2, 0, 1, 3]], 3, np.nanmean(x, 0)[[2, 0, 1, 3]], evidence_ridge)
    assert np.allclose([[got[i][f"c{j}"] for j in (2, 0, 1, 3)] for i in range(300)], want, rtol=1e-3)


def test_new_rows_and_odd_columns(spark):
    x, df = data(spark)
    fitted = imputation.fit_iterative(df.where("c0 IS NOT NULL"), ["c0", "c1", "c2"])
    new = spark.createDataFrame([(1, None, 2.0, 3.0, "a"), (2, 1.0, float("nan"), 3.0, "b"), (3, None, None, None, "c")],
                                "id long, c0 double, c1 double, c2 double, note string")
    out = {r["id"]: r for r in fitted.apply(new).collect()}
    assert out[1]["c0"] == pytest.approx(fitted.initial[0])      # a pattern that was not fitted
    assert out[2]["c1"] not in (None, 0.0) and not np.isnan(out[2]["c1"])
    assert [out[3][c] for c in ("c0", "c1", "c2")] == pytest.approx(fitted.initial)
    none = df.withColumn("c0", F.lit(None).cast("double"))
    assert {r["c0"] for r in imputation.iterative_impute(none, ["c0", "c1"], 2).collect()} == {0.0}
    assert imputation.iterative_impute(df.where("id < 0"), ["c0", "c1"], 2).count() == 0
