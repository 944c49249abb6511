"""Gram-path solvers against numpy closed forms."""

import numpy as np
import pytest

from kestrel.operators import gram


def _moments(X, y):
    n, p = X.shape
    Z = np.hstack([np.ones((n, 1)), X, y[:, None]])
    zz = Z.T @ Z
    return gram.Moments(zz[0, 0], zz[0, 1:p + 1], zz[0, p + 1], zz[1:p + 1, 1:p + 1], zz[1:p + 1, p + 1],
                        zz[p + 1, p + 1], np.zeros(p), 0.0)


def _data(seed=0, n=400, p=4):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p)) * [1, 3, 0.5, 10] + [5, -2, 0, 100]
    y = X @ [1.5, -0.2, 3.0, 0.05] + rng.normal(size=n)
    return X, y


def test_ols_and_ridge():
    X, y = _data()
    m = _moments(X, y)
    f = gram.fit_linear(m, "ols")
    A = np.hstack([np.ones((len(y), 1)), X])
    beta = np.linalg.lstsq(A, y, rcond=None)[0]
    assert f.intercept == pytest.approx(beta[0], rel=1e-8)
    assert np.allclose(f.coef, beta[1:], rtol=1e-8)
    mu, sd = X.mean(0), X.std(0)
    Xs = (X - mu) / sd
    w = np.linalg.solve(Xs.T @ Xs + 10 * np.eye(4), Xs.T @ (y - y.mean()))
    fr = gram.fit_linear(m, "ridge", alpha=10.0)
    assert np.allclose(fr.scaled_coef, w, rtol=1e-9)


def test_lasso_kkt_and_sse():
    X, y = _data(1)
    m = _moments(X, y)
    f = gram.fit_linear(m, "lasso", alpha=0.1)
    mu, sd = X.mean(0), X.std(0)
    Xs = (X - mu) / sd
    resid = (y - y.mean()) - Xs @ f.scaled_coef
    g = Xs.T @ resid / len(y)
    for gj, wj in zip(g, f.scaled_coef):
        if wj != 0:
            assert gj == pytest.approx(0.1 * np.sign(wj), abs=1e-5)
        else:
            assert abs(gj) <= 0.1 + 1e-6
    pred = f.intercept + X @ f.coef
    assert gram.sse(m, f) == pytest.approx(((y - pred) ** 2).sum(), rel=1e-9)


def test_singular_design_predictions_unique():
    X, y = _data(2)
    Xs = np.hstack([X, 2 * X[:, :1]])
    f = gram.fit_linear(_moments(Xs, y), "ols")
    f0 = gram.fit_linear(_moments(X, y), "ols")
    assert np.allclose(f.intercept + Xs @ f.coef, f0.intercept + X @ f0.coef, rtol=1e-8)


def test_rfe_keeps_strong_features():
    X, y = _data(3)
    ranks = gram.rfe_ols(_moments(X, y), 2)
    assert sorted(ranks) == [1, 1, 2, 3]
    assert ranks[0] == 1 and ranks[2] == 1


def test_gram_moments_spark(spark):
    X, y = _data(4, n=300)
    rows = [(int(i % 3), *map(float, X[i]), float(y[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, d double, y double")
    folds = gram.gram_moments(df, ["a", "b", "c", "d"], "y", group="fold")
    tot = gram.total(folds)
    f = gram.fit_linear(tot, "ols")
    f0 = gram.fit_linear(_moments(X, y), "ols")
    assert np.allclose(f.coef, f0.coef, rtol=1e-8)
    assert set(folds) == {0, 1, 2}


def test_logistic_newton_stationary(spark):
    from kestrel.operators import logistic as lg
    rng = np.random.default_rng(5)
    n = 400
    X = rng.normal(size=(n, 2))
    yv = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + X @ [1.0, -2.0])))).astype(int)
    rows = [(float(a), float(b), int(t), int(i % 5)) for (a, b), t, i in zip(X, yv, range(n))]
    df = spark.createDataFrame(rows, "a double, b double, y int, fold int")
    specs = [lg.Spec("all", 0.5, -1, False), lg.Spec("bal", 0.5, 2, True)]
    coefs = lg.fit_many(df, ["a", "b"], "y", specs)
    A = np.hstack([X, np.ones((n, 1))])
    b = coefs["all"].coef
    mu = 1 / (1 + np.exp(-(A @ b)))
    grad = b - 0.5 * A.T @ (yv - mu)
    assert np.max(np.abs(grad)) < 1e-8
    keep = np.arange(n) % 5 != 2
    n1, n0 = yv[keep].sum(), (1 - yv[keep]).sum()
    sw = np.where(yv[keep] == 1, keep.sum() / (2 * n1), keep.sum() / (2 * n0))
    b2 = coefs["bal"].coef
    mu2 = 1 / (1 + np.exp(-(A[keep] @ b2)))
    assert np.max(np.abs(b2 - 0.5 * A[keep].T @ (sw * (yv[keep] - mu2)))) < 1e-8


def test_known_centre_saves_a_pass_and_rows_with_holes_are_skipped(spark):
    rows = [(k % 3 if k % 11 else None, float(k), float(k * k % 17) if k % 7 else float("nan"), 2.0 * k if k % 5 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double")
    full = df.na.drop("any")
    given = gram.gram_moments(df, ["a", "b"], "y", group="g", centre=([44.0, 8.0], 90.0))
    assert {k: m.n for k, m in given.items()} == {r["g"]: r["count"] for r in full.groupBy("g").count().collect()}
    for other in (gram.gram_moments(df, ["a", "b"], "y", group="g"), gram.gram_moments(full, ["a", "b"], "y", group="g", shift=False)):
        for k, m in given.items():
            for one, two in zip(m.centred(), other[k].centred()):
                np.testing.assert_allclose(one, two, rtol=1e-9, atol=1e-7)
    assert (given[0].shift_x == [44.0, 8.0]).all() and given[0].shift_y == 90.0
    text = df.where("g IS NOT NULL").selectExpr("CAST(g AS STRING) AS g", "a", "b", "y")
    assert set(gram.gram_moments(text, ["a", "b"], "y", group="g")) == {"0", "1", "2"}


def test_regression_comparison_takes_three_passes_of_moments(spark, monkeypatch):
    """Given features and the eliminated ones share one, each PCA table is read once for its own."""
    from kestrel.plans import q_models
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 5))
    names = q_models.WIDE_FEATURES
    df = spark.createDataFrame([(i, "test" if i % 5 == 0 else "train", i % 4, float(v @ [1, 2, 0, 0, 3]) + 50, *map(float, v)) for i, v in enumerate(x)],
                               "rid long, split string, fold int, price double, " + ", ".join(f"{c} double" for c in names))
    calls, plain = [], gram.gram_moments
    monkeypatch.setattr(gram, "gram_moments", lambda *a, **k: calls.append(k.get("centre")) or plain(*a, **k))
    monkeypatch.setattr(q_models, "model_frame", lambda *_: (df, names, "price"))
    monkeypatch.setattr(q_models, "RFE_COMPARED_K", 3)
    rows, _ = q_models._regression_table.__wrapped__(spark, "/nowhere")
    assert len(calls) == 3 and sum(c is not None for c in calls) == 2
    found = {(r[0], r[1]): r for r in rows}
    assert found["feature_selection_rfe_3", "ols"][4] == pytest.approx(found["all_features", "ols"][4], abs=1e-8) == 0
    monkeypatch.setattr(gram, "gram_moments", plain)
    suite = q_models.md.fit_regression_suite(df.where("split = 'train'"), ["quantity", "discount", "retailprice"], "price")
    again = {m: (p, s) for m, p, s, _ in suite}
    for model in ("ridge", "lasso", "elasticnet"):
        row = found["feature_selection_rfe_3", model]
        assert row[2] == q_models._params(again[model][0]) and row[3] == pytest.approx(again[model][1])


def test_numbers_of_a_csv_are_parsed_once(spark, tmp_path):
    from kestrel.sources import io
    df = spark.createDataFrame([(1, 1.5, "a"), (2, None, "NA"), (3, float("nan"), None), (4, float("-inf"), "x")], "i int, v double, t string")
    io.write_csv(df, f"{tmp_path}/t", compression="gzip")
    back = io.read_csv(spark, f"{tmp_path}/t", df.schema, multi_line=False)
    assert sorted(map(tuple, back.collect())) == [(1, 1.5, "a"), (2, None, None), (3, None, None), (4, float("-inf"), "x")]
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rlike") == 2
    assert [r["v"] for r in io.read_csv(spark, f"{tmp_path}/t", df.schema, na_values=("1.5",)).orderBy("i").collect()] == [None, None, None, float("-inf")]
