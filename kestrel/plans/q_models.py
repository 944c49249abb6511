"""Queries: feature selection, PCA, regression / classification, metrics,
leaderboards (F*, R*, L*, V*, M9-M11)."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import functions as F

from kestrel.operators import comparison
from kestrel.operators import features as fe
from kestrel.operators import forest
from kestrel.operators import gram
from kestrel.operators import imputation
from kestrel.operators import logistic
from kestrel.operators import missing as mm
from kestrel.operators import models as md
from kestrel.operators.neighbors import knn_impute
from kestrel.plans.frames import BIN_SQL, WIDE_FEATURES, WIDE_SQL, bin_frame, holes, sql_hole, table, vec_frame, wide
from kestrel.plans.q_clean import split_sql
from kestrel.plans.registry import register, round_doubles
from kestrel.session import scratch_dir
from kestrel.sources import io

W = f"WITH wide AS ({WIDE_SQL})"


# ---------------------------------------------------------------- model frames
def model_frame(spark, sf_dir, brands: bool = False):
    """holes -> rows with a target -> indicators -> exact split + folds ->
    train-fitted median fill -> one-hot ptype (all levels: singular design),
    with ``brands`` also one-hot brand.  Returns (frame, feature names, target)."""
    src = holes(spark, sf_dir).where(F.col("price").isNotNull()).persist()  # several fitting passes follow
    h = mm.na_indicators(src, WIDE_FEATURES)
    h = mm.train_test_split(h, "rid", 0.2, seed="42")
    # what is fitted comes first: folds shuffle the rows, and every pass would do so again
    fills = mm.fit_simple_imputer(h.where(F.col("split") == "train"), WIDE_FEATURES)
    levels = {c: mm.levels_of(src, c) for c in (["ptype", "brand"] if brands else ["ptype"])}
    h = mm.apply_fills(mm.kfold(h, "rid", 5), fills)
    for c, found in levels.items():
        h = mm.one_hot(h, c, levels=found, prefix="genre")
    # feature groups by name (P3): plain numeric, ``*_missing`` indicators, ``genre_*`` dummies
    from kestrel.functions.columns import feature_groups
    cands = [c for c in h.columns if c not in ("rid", "price", "split", "fold", "returnflag", "linestatus", "brand")]
    feats = feature_groups(cands, prefix="genre_", suffix="_missing")
    # many passes follow (moments, metrics per model): cut the lineage once, into a Parquet
    # table in the shared folder, whose 0/1 columns take next to no room
    h = spark.read.parquet(io.write_table(h.select("rid", "split", "fold", "price", *feats), scratch_dir(spark, "model_frame")))
    src.unpersist()
    return h, feats, "price"


def _params(p):
    return json.dumps(p, sort_keys=True)


# ---------------------------------------------------------------- M11, F1-F3
@register("M11_standard_scaler_train_fit", f"""{W},
s AS {split_sql('wide', 'rid')},
st AS (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in WIDE_FEATURES)} FROM s WHERE split = 'train')
SELECT split, {', '.join(f"round(avg(({c} - m_{c}) / s_{c}), 8) AS mean_{c}, round(stddev_pop(({c} - m_{c}) / s_{c}), 8) AS std_{c}" for c in WIDE_FEATURES)}
FROM s, st GROUP BY split""")
def q_m11(spark, sf_dir):
    s = mm.train_test_split(wide(spark, sf_dir), "rid", 0.2, seed="42")
    stats = fe.fit_scaler(s.where(F.col("split") == "train"), WIDE_FEATURES)
    z = fe.apply_scaler(s, stats)
    return round_doubles(z.groupBy("split").agg(
        *[x for c in WIDE_FEATURES for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))]), 8)


@register("F1_variance_threshold", f"""{W}
{' UNION ALL '.join(f"SELECT '{c}' AS feature, var_pop({c}) > 0 AS kept FROM (SELECT *, 1.0 AS const_col FROM wide)" for c in WIDE_FEATURES + ['const_col'])}""")
def q_f1(spark, sf_dir):
    w = wide(spark, sf_dir).withColumn("const_col", F.lit(1.0))
    kept = set(fe.variance_threshold(w, WIDE_FEATURES + ["const_col"], 0.0))
    return spark.createDataFrame([(c, c in kept) for c in WIDE_FEATURES + ["const_col"]], "feature string, kept boolean")


@register("F2_top5_target_correlated", f"""{W}
SELECT feature FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, price) AS r FROM wide" for c in WIDE_FEATURES)})
ORDER BY abs(r) DESC LIMIT 5""")
def q_f2(spark, sf_dir):
    from kestrel.operators.aggregates import target_correlations
    return target_correlations(wide(spark, sf_dir), "price", WIDE_FEATURES, top=5).select("feature")


@register("F3_f_score_topk", f"""{W}
SELECT feature, round(r, 8) AS corr, round(r * r / (1 - r * r) * (n - 2), 6) AS f_score FROM (
{' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, price) AS r, count(*) AS n FROM wide" for c in WIDE_FEATURES)})
ORDER BY f_score DESC LIMIT 3""")
def q_f3(spark, sf_dir):
    return round_doubles(fe.f_scores(wide(spark, sf_dir), WIDE_FEATURES, "price", top=3), 8, {"f_score": 6})


def _mi_sql():
    probs = [i / 10 for i in range(1, 10)]
    cols = WIDE_FEATURES + ["price"]
    edges = ", ".join(f"quantile_cont({c}, {p}) AS e_{c}_{i}" for c in cols for i, p in enumerate(probs))
    binx = ", ".join("(" + " + ".join(f"CAST({c} > e_{c}_{i} AS INTEGER)" for i in range(9)) + f") AS b_{c}"
                     for c in cols)
    joint = " UNION ALL ".join(f"SELECT '{c}' AS feature, b_{c} AS xb, b_price AS yb FROM b" for c in WIDE_FEATURES)
    return f"""{W},
e AS (SELECT {edges} FROM wide),
b AS (SELECT {binx} FROM wide, e),
j AS (SELECT feature, xb, yb, count(*) AS nxy FROM ({joint}) GROUP BY 1, 2, 3),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n,
             sum(nxy) OVER (PARTITION BY feature, xb) AS nx, sum(nxy) OVER (PARTITION BY feature, yb) AS ny FROM j)
SELECT feature, round(sum(nxy * 1.0 / n * ln(nxy * 1.0 * n / (nx * ny))), 8) AS mutual_info FROM m GROUP BY feature"""


@register("F4_mutual_information_binned", _mi_sql())
def q_f4(spark, sf_dir):
    return round_doubles(fe.mutual_information(wide(spark, sf_dir), WIDE_FEATURES, "price", bins=10), 8)


# ---------------------------------------------------------------- L1-L4 closed forms (oracle twins)
def _train(spark, sf_dir):
    return mm.train_test_split(wide(spark, sf_dir), "rid", 0.2, seed="42")


TRAIN = f"{W}, s AS {split_sql('wide', 'rid')}, tr AS (SELECT * FROM s WHERE split = 'train')"


@register("L1_ols_one_feature", f"""{TRAIN}
SELECT round(regr_slope(price, quantity), 6) AS coef, round(regr_intercept(price, quantity), 4) AS intercept FROM tr""")
def q_l1(spark, sf_dir):
    tr = _train(spark, sf_dir).where(F.col("split") == "train")
    fit = gram.fit_linear(gram.total(gram.gram_moments(tr, ["quantity"], "price")), "ols")
    return round_doubles(spark.createDataFrame([(float(fit.coef[0]), float(fit.intercept))],
                                               "coef double, intercept double"), 6, {"intercept": 4})


def _moments_sql(a, b):
    """Centred, population-scaled 2x2 design and right-hand side in SQL."""
    return f"""m AS (SELECT count(*) AS n, stddev_pop({a}) AS sa, stddev_pop({b}) AS sb,
        covar_pop({a}, {b}) * count(*) AS cab, var_pop({a}) * count(*) AS caa, var_pop({b}) * count(*) AS cbb,
        covar_pop({a}, price) * count(*) AS ray, covar_pop({b}, price) * count(*) AS rby,
        avg({a}) AS ma, avg({b}) AS mb, avg(price) AS my FROM tr),
z AS (SELECT *, caa / (sa * sa) AS c11, cab / (sa * sb) AS c12, cbb / (sb * sb) AS c22,
        ray / sa AS r1, rby / sb AS r2 FROM m)"""


@register("L2_ridge_two_features", f"""{TRAIN},
{_moments_sql('quantity', 'discount')},
w AS (SELECT *, ((c22 + 10.0) * r1 - c12 * r2) / ((c11 + 10.0) * (c22 + 10.0) - c12 * c12) AS w1,
                ((c11 + 10.0) * r2 - c12 * r1) / ((c11 + 10.0) * (c22 + 10.0) - c12 * c12) AS w2 FROM z)
SELECT round(w1 / sa, 6) AS coef_quantity, round(w2 / sb, 6) AS coef_discount,
       round(my - w1 / sa * ma - w2 / sb * mb, 4) AS intercept FROM w""")
def q_l2(spark, sf_dir):
    tr = _train(spark, sf_dir).where(F.col("split") == "train")
    fit = gram.fit_linear(gram.total(gram.gram_moments(tr, ["quantity", "discount"], "price")), "ridge", alpha=10.0)
    return round_doubles(spark.createDataFrame([(float(fit.coef[0]), float(fit.coef[1]), float(fit.intercept))],
                                               "coef_quantity double, coef_discount double, intercept double"),
                         6, {"intercept": 4})


def _soft_sql(l1, l2):
    return f"""m AS (SELECT count(*) AS n, stddev_pop(quantity) AS sa, covar_pop(quantity, price) * count(*) AS ray,
        var_pop(quantity) * count(*) AS caa, avg(quantity) AS ma, avg(price) AS my FROM tr),
w AS (SELECT *, sign(ray / sa) * greatest(abs(ray / sa) - n * {l1}, 0) / (caa / (sa * sa) + n * {l2}) AS w1 FROM m)
SELECT round(w1 / sa, 6) AS coef, round(my - w1 / sa * ma, 4) AS intercept FROM w"""


@register("L3_lasso_one_feature", f"""{TRAIN},
{_soft_sql(100.0, 0.0)}""")
def q_l3(spark, sf_dir):
    tr = _train(spark, sf_dir).where(F.col("split") == "train")
    fit = gram.fit_linear(gram.total(gram.gram_moments(tr, ["quantity"], "price")), "lasso", alpha=100.0)
    return round_doubles(spark.createDataFrame([(float(fit.coef[0]), float(fit.intercept))],
                                               "coef double, intercept double"), 6, {"intercept": 4})


@register("L4_elasticnet_one_feature", f"""{TRAIN},
{_soft_sql(100.0 * 0.5, 100.0 * 0.5)}""")
def q_l4(spark, sf_dir):
    tr = _train(spark, sf_dir).where(F.col("split") == "train")
    fit = gram.fit_linear(gram.total(gram.gram_moments(tr, ["quantity"], "price")), "elasticnet",
                          alpha=100.0, l1_ratio=0.5)
    return round_doubles(spark.createDataFrame([(float(fit.coef[0]), float(fit.intercept))],
                                               "coef double, intercept double"), 6, {"intercept": 4})


@register("V4_regression_metrics_test", f"""{W}, s AS {split_sql('wide', 'rid')},
f AS (SELECT regr_slope(price, quantity) AS b, regr_intercept(price, quantity) AS a FROM s WHERE split = 'train'),
p AS (SELECT price, a + b * quantity AS pred FROM s, f WHERE split = 'test')
SELECT round(sqrt(avg(power(price - pred, 2))), 6) AS rmse, round(avg(abs(price - pred)), 6) AS mae,
       round(1 - sum(power(price - pred, 2)) / (var_pop(price) * count(*)), 8) AS r2 FROM p""")
def q_v4(spark, sf_dir):
    s = _train(spark, sf_dir)
    fit = gram.fit_linear(gram.total(gram.gram_moments(s.where(F.col("split") == "train"), ["quantity"], "price")), "ols")
    test = s.where(F.col("split") == "test").select("price", md.linear_predict(["quantity"], fit))
    return round_doubles(md.regression_metrics(test, "price"), 6, {"r2": 8})


@register("V10_residual_bins_one_feature", f"""{W}, s AS {split_sql('wide', 'rid')},
f AS (SELECT regr_slope(price, quantity) AS b, regr_intercept(price, quantity) AS a FROM s WHERE split = 'train'),
p AS (SELECT a + b * quantity AS fitted, price - (a + b * quantity) AS residual FROM s, f WHERE split = 'test'),
m AS (SELECT min(fitted) AS lo, max(fitted) AS hi FROM p)
SELECT CAST(least(floor(20 * (fitted - lo) / (hi - lo)) + 1, 20) AS INTEGER) AS bin, count(*) AS n,
       round(avg(residual), 4) AS mean_residual, round(stddev_samp(residual), 4) AS std_residual
FROM p, m GROUP BY 1""")
def q_v10b(spark, sf_dir):
    s = _train(spark, sf_dir)
    fit = gram.fit_linear(gram.total(gram.gram_moments(s.where(F.col("split") == "train"), ["quantity"], "price")), "ols")
    res = md.residuals(s.where(F.col("split") == "test").select("price", md.linear_predict(["quantity"], fit)), "price")
    return round_doubles(md.residual_bins(res, 20).withColumn("bin", F.col("bin").cast("int")), 4)


# ---------------------------------------------------------------- L1-L5, V3, V9-V12 on the model frame
def _suite(spark, sf_dir, brands=False):
    h, feats, y = model_frame(spark, sf_dir, brands)
    train = h.where(F.col("split") == "train")
    test = h.where(F.col("split") == "test")
    return h, feats, y, train, test


def _eval_rows(test, feats, y, suite, variant):
    """Test rmse / mae / r2 of every fitted model in one aggregate pass."""
    preds = [md.linear_predict(feats, fit, f"_p{i}") for i, (_, _, _, fit) in enumerate(suite)]
    t = test.select(y, *preds)
    aggs = [F.var_pop(y).alias("_vy"), F.count(F.lit(1)).alias("_n")]
    for i in range(len(suite)):
        err = F.col(y) - F.col(f"_p{i}")
        aggs += [F.avg(err * err).alias(f"_mse{i}"), F.avg(F.abs(err)).alias(f"_mae{i}")]
    r = t.agg(*aggs).collect()[0]
    rows = []
    for i, (model, params, score, _) in enumerate(suite):
        mse = r[f"_mse{i}"]
        r2 = 1 - mse / r["_vy"] if r["_vy"] else float("nan")
        rows.append((variant, model, _params(params), float(score), float(mse ** 0.5), float(r[f"_mae{i}"]),
                     float(r2)))
    return rows


SCHEMA_CMP = "variant string, model string, best_params string, cv_rmse double, rmse double, mae double, r2 double"


@register("L1_L4_V3_regression_cv_grid")
def q_suite(spark, sf_dir):
    """OLS / ridge / lasso / elastic net, 5-fold CV over the reference grids
    (one pass of moments), refit on train, test metrics."""
    h, feats, y, train, test = _suite(spark, sf_dir)
    suite = md.fit_regression_suite(train, feats, y)
    return round_doubles(spark.createDataFrame(_eval_rows(test, feats, y, suite, "all_features"), SCHEMA_CMP), 6)


@register("L5_log1p_target_ols")
def q_l5(spark, sf_dir):
    """OLS on log1p(target), predictions back through expm1 (only when min(y) > 0)."""
    h, feats, y, train, test = _suite(spark, sf_dir)
    if train.agg(F.min(y)).collect()[0][0] <= 0:
        return spark.createDataFrame([], "rmse double, mae double, r2 double")
    suite = md.fit_regression_suite(train, feats, y, grids={"ols": [{}]}, transform="log1p")
    fit = suite[0][3]
    pred = F.expm1(md.linear_predict(feats, fit, "_lp")).alias("pred")
    return round_doubles(md.regression_metrics(test.select(y, pred), y), 6)


@register("V9_coefficient_table_ols")
def q_v9(spark, sf_dir):
    h, feats, y, train, test = _suite(spark, sf_dir)
    fit = gram.fit_linear(gram.total(gram.gram_moments(train, feats, y)), "ols")
    return round_doubles(md.coefficient_table(spark, feats, fit), 4)


@register("V10_residuals_by_fitted_bin")
def q_v10(spark, sf_dir):
    h, feats, y, train, test = _suite(spark, sf_dir)
    fit = gram.fit_linear(gram.total(gram.gram_moments(train, feats, y)), "ols")
    res = md.residuals(test.select(y, md.linear_predict(feats, fit)), y)
    return round_doubles(md.residual_bins(res, 20), 4)


@register("V11_qq_line")
def q_v11(spark, sf_dir):
    h, feats, y, train, test = _suite(spark, sf_dir)
    fit = gram.fit_linear(gram.total(gram.gram_moments(train, feats, y)), "ols")
    res = md.residuals(test.select(y, md.linear_predict(feats, fit)), y)
    _, line = md.qq_points(res)
    return round_doubles(line, 6)


RFE_K, RFE_COMPARED_K = 20, 30  # fixed values: features that elimination keeps, alone and in comparisons


def _rfe_features(train, feats, y, k, moments=None):
    ranks = gram.rfe_ols(gram.total(moments or gram.gram_moments(train, feats, y)), min(k, len(feats)))
    return [f for f, r in zip(feats, ranks) if r == 1], ranks


@register("F5_rfe_ols_ranks")
def q_f5(spark, sf_dir):
    """Elimination down to 20 of all features, brands included, and the fit on those."""
    h, feats, y, train, test = _suite(spark, sf_dir, brands=True)
    kept, ranks = _rfe_features(train, feats, y, RFE_K)
    fit = gram.fit_linear(gram.total(gram.gram_moments(train, kept, y)), "ols")
    m = md.regression_metrics(test.select(y, md.linear_predict(kept, fit)), y).first()
    rows = [(f, int(r), float(m["rmse"]), float(m["r2"])) for f, r in zip(feats, ranks)]
    return round_doubles(spark.createDataFrame(rows, "feature string, ranking int, test_rmse double, test_r2 double"), 4)


@register("F7_lasso_nonzero_coefficients")
def q_f7(spark, sf_dir):
    h, feats, y, train, test = _suite(spark, sf_dir)
    fit = gram.fit_linear(gram.total(gram.gram_moments(train, feats, y)), "lasso", alpha=0.001)
    rows = [(f, float(w), float(abs(w))) for f, w in zip(feats, fit.scaled_coef) if w != 0]
    m = md.regression_metrics(test.select(y, md.linear_predict(feats, fit)), y).collect()[0]
    df = spark.createDataFrame(rows, "feature string, coef double, abs_coef double")
    return round_doubles(df.withColumn("test_rmse", F.lit(m["rmse"])).withColumn("test_r2", F.lit(m["r2"]))
                           .orderBy(F.desc("abs_coef")), 4)


@register("F8_random_forest_importance")
def q_f8(spark, sf_dir):
    """300 trees on all features, grown without a depth limit."""
    h, feats, y, train, test = _suite(spark, sf_dir)
    return round_doubles(forest.fit(train, feats, y, "rid").importances(), 6)


@register("F8_random_forest_test_metrics")
def q_f8_metrics(spark, sf_dir):
    h, feats, y, train, test = _suite(spark, sf_dir)
    scored = forest.fit(train, feats, y, "rid").predict(test, "rid", "pred").join(test.select("rid", y), "rid")
    return round_doubles(md.regression_metrics(scored, y), 4)


# ---------------------------------------------------------------- R1-R5 PCA
@register("R1_pca_variance_2d", f"""{W}
SELECT CAST(component AS INTEGER) AS component,
       round(CASE WHEN component = 1 THEN (1 + r) / 2 ELSE (1 - r) / 2 END, 8) AS explained_variance_ratio
FROM (VALUES (1), (2)) c(component), (SELECT abs(corr(quantity, price)) AS r FROM wide)""")
def q_r1b(spark, sf_dir):
    _, _, ratios = fe.pca_fit(wide(spark, sf_dir), ["quantity", "price"])
    vt = fe.variance_table(ratios, spark).drop("cumulative_explained_variance_ratio")
    return round_doubles(vt, 8)


@register("R1_R2_pca_variance_curve")
def q_r1(spark, sf_dir):
    v = vec_frame(spark, sf_dir)
    cols = [c for c in v.columns if c.startswith("e")]
    _, _, ratios = fe.pca_fit(v, cols)
    vt = fe.variance_table(ratios, spark)
    k90, k95 = fe.components_for(vt, 0.90), fe.components_for(vt, 0.95)
    return round_doubles(vt.withColumn("k90", F.lit(k90)).withColumn("k95", F.lit(k95)), 8)


@register("R3_pca_2d_projection")
def q_r3(spark, sf_dir):
    v = vec_frame(spark, sf_dir)
    cols = [c for c in v.columns if c.startswith("e")]
    stats, model, _ = fe.pca_fit(v, cols, k=2)
    return round_doubles(fe.pca_project(v, cols, stats, model, 2, keep=["vec_id", "label"]), 6)


def pca_variant(train, test, cols, y, threshold=0.95):
    """Leakage-safe PCA export (R4): scaler + PCA fitted on train only,
    components kept up to ``threshold`` of variance."""
    stats, model, ratios = fe.pca_fit(train, cols)
    vt = fe.variance_table(ratios, train.sparkSession)
    k = fe.components_for(vt, threshold)
    tr = fe.pca_project(train, cols, stats, model, k, keep=["rid", y, "fold"])
    te = fe.pca_project(test, cols, stats, model, k, keep=["rid", y, "fold"])
    return tr, te, [f"PC{i + 1}" for i in range(k)], vt


def export_pca(spark, train, test, cols, y, name):
    """Write the training, test and variance tables of a PCA variant as CSV, under gzip as
    the text of a double takes twice its bytes, and read them back (R4, S10): (train, test,
    component names, variance table)."""
    tr, te, pcs, vt = pca_variant(train, test, cols, y)
    base, out = scratch_dir(spark, name), []
    for part, df in (("train", tr), ("test", te), ("variance", vt)):
        io.write_csv(df, f"{base}/{part}.csv", compression="gzip")
        out.append(io.read_csv(spark, f"{base}/{part}.csv", df.schema, multi_line=False))
    return out[0], out[1], pcs, out[2]


@register("R4_R5_pca_train_test_export")
def q_r4(spark, sf_dir):
    """Both modes, from the tables as read back."""
    h, feats, y, train, test = _suite(spark, sf_dir)
    rows = []
    for variant, cols in (("pca_all_features", feats), ("pca_continuous_only", WIDE_FEATURES)):
        tr, te, pcs, vt = export_pca(spark, train, test, cols, y, variant)
        rows.append((variant, len(pcs), tr.count(), te.count(),
                     float(vt.where(F.col("component") == len(pcs)).collect()[0][2])))
    return round_doubles(spark.createDataFrame(rows, "variant string, n_components int, n_train long, n_test long, "
                                                     "cumulative double"), 8)


@lru_cache(maxsize=4)
def _regression_table(spark, sf_dir):
    """Four variants x four models: rows of ``SCHEMA_CMP`` and the chosen parameters."""
    h, feats, y, train, test = _suite(spark, sf_dir, brands=True)
    # one pass of moments serves elimination and both variants of given features
    folds = gram.gram_moments(train, feats, y, group="fold")
    sel, _ = _rfe_features(train, feats, y, RFE_COMPARED_K, folds)
    kept = [feats.index(c) for c in sel]
    variants = [("all_features", train, test, feats, folds),
                (f"feature_selection_rfe_{len(sel)}", train, test, sel, {k: m.subset(kept) for k, m in folds.items()})]
    whole = gram.total(folds)
    mean = whole.means()[1] + whole.shift_y
    for variant, cols in (("pca_continuous_only", WIDE_FEATURES), ("pca_all_features", feats)):
        tr, te, pcs, _ = export_pca(spark, train, test, cols, y, variant)
        # components of standardised training rows have mean zero
        variants.append((variant, tr, te, pcs, gram.gram_moments(tr, pcs, y, group="fold", centre=([0.0] * len(pcs), mean))))
    rows, params = [], {}
    for variant, tr, te, cols, moments in variants:
        suite = md.fit_regression_suite(tr, cols, y, folds=moments)
        rows += _eval_rows(te, cols, y, suite, variant)
        params |= {f"{variant}::{model}": chosen for model, chosen, _, _ in suite if chosen}
    return rows, params


@register("V12_regression_comparison")
def q_v12_table(spark, sf_dir):
    """The whole comparison, by variant and rising RMSE."""
    rows, _ = _regression_table(spark, sf_dir.rstrip("/"))
    return round_doubles(spark.createDataFrame(rows, SCHEMA_CMP).orderBy("variant", "rmse", "model"), 6)


@register("V12_V14_regression_comparison_leaderboard")
def q_v12(spark, sf_dir):
    """The best model of each variant by RMSE (tie MAE), the overall pick flagged."""
    rows, _ = _regression_table(spark, sf_dir.rstrip("/"))
    return round_doubles(md.leaderboard(spark.createDataFrame(rows, SCHEMA_CMP), [("rmse", "asc"), ("mae", "asc")]), 6)


@register("S8_best_params_json")
def q_best_params(spark, sf_dir):
    """Chosen parameters of the regression comparison, written as JSON and read back."""
    _, params = _regression_table(spark, sf_dir.rstrip("/"))
    back = io.read_params_json(spark, io.write_params_json(spark, params, scratch_dir(spark, "best_params")))
    rows = [(model, name, float(v)) for model, chosen in back.items() for name, v in chosen.items()]
    return spark.createDataFrame(rows, "model string, parameter string, value double")


@register("V14_leaderboard_operator", f"""{W},
r AS (SELECT returnflag AS variant, ptype AS model, avg(price) AS rmse, avg(quantity) AS mae FROM wide GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY rmse, mae) AS rn FROM r) WHERE rn = 1),
g AS (SELECT variant, model FROM r ORDER BY rmse, mae LIMIT 1)
SELECT b.variant, b.model, round(b.rmse, 6) AS rmse, round(b.mae, 6) AS mae,
       CAST(g.variant IS NOT NULL AS INTEGER) AS selected
FROM b LEFT JOIN g ON b.variant = g.variant AND b.model = g.model""")
def q_v14(spark, sf_dir):
    r = (wide(spark, sf_dir).groupBy(F.col("returnflag").alias("variant"), F.col("ptype").alias("model"))
         .agg(F.avg("price").alias("rmse"), F.avg("quantity").alias("mae")))
    return round_doubles(md.leaderboard(r, [("rmse", "asc"), ("mae", "asc")]), 6)


# ---------------------------------------------------------------- classification
SCORE_SQL = f"(SELECT doc_id, quality, 1.0 / (1.0 + exp(-(n_chars - 3000.0) / 1000.0)) AS score FROM ({BIN_SQL}))"


def _scored(spark, sf_dir):
    b = bin_frame(spark, sf_dir)
    return b.select("doc_id", "quality", (1.0 / (1.0 + F.exp(-(F.col("n_chars") - 3000.0) / 1000.0))).alias("score"))


@register("V5_V6_P16_confusion_metrics", f"""
WITH s AS {SCORE_SQL},
c AS (SELECT count(*) FILTER (WHERE quality = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE quality = 0 AND score >= 0.5) AS fp,
             count(*) FILTER (WHERE quality = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE quality = 1 AND score >= 0.5) AS tp FROM s),
d AS (SELECT *, CAST(tn AS DOUBLE) AS dtn, CAST(fp AS DOUBLE) AS dfp, CAST(fn AS DOUBLE) AS dfn, CAST(tp AS DOUBLE) AS dtp,
             CAST(tn + fp + fn + tp AS DOUBLE) AS nn FROM c)
SELECT tn, fp, fn, tp, round(CASE WHEN tp + fn > 0 THEN dtp / (dtp + dfn) END, 8) AS sensitivity,
       round(CASE WHEN tn + fp > 0 THEN dtn / (dtn + dfp) END, 8) AS specificity,
       round(CASE WHEN tp + fp > 0 THEN dtp / (dtp + dfp) ELSE 0 END, 8) AS precision,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * dtp / (2 * dtp + dfp + dfn) ELSE 0 END, 8) AS f1,
       round((dtp + dtn) / nn, 8) AS accuracy,
       round(((dtp + dtn) / nn - ((dtp + dfp) * (dtp + dfn) + (dtn + dfn) * (dtn + dfp)) / (nn * nn))
             / (1 - ((dtp + dfp) * (dtp + dfn) + (dtn + dfn) * (dtn + dfp)) / (nn * nn)), 8) AS kappa FROM d""")
def q_v5(spark, sf_dir):
    return round_doubles(md.confusion_metrics(_scored(spark, sf_dir), "quality"), 8)


@register("V7_roc_auc_rank_sum", f"""
WITH s AS {SCORE_SQL},
r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(CASE WHEN quality = 1 THEN rk END) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality <> 1)), 8) AS roc_auc FROM r""")
def q_v7(spark, sf_dir):
    return round_doubles(md.roc_auc(_scored(spark, sf_dir), "quality"), 8)


@register("V8_average_precision_stepwise", f"""
WITH s AS {SCORE_SQL},
h AS (SELECT score, count(*) AS n, sum(quality) AS npos FROM s GROUP BY score),
c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS k, sum(npos) OVER (ORDER BY score DESC) AS tp,
             sum(npos) OVER () AS p FROM h)
SELECT round(sum(npos / p * tp / k), 8) AS pr_auc FROM c""")
def q_v8(spark, sf_dir):
    return round_doubles(md.average_precision(_scored(spark, sf_dir), "quality"), 8)


@register("V2_stratified_fold_balance", f"""
WITH b AS ({BIN_SQL}), f AS (
  SELECT quality, doc_id, CAST((row_number() OVER (PARTITION BY quality
    ORDER BY ('0x' || substr(md5(concat_ws('|', '42', 'fold', doc_id)), 1, 8))::BIGINT, doc_id) - 1) % 5 AS INTEGER) AS fold FROM b)
SELECT quality, fold, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM f GROUP BY 1, 2""")
def q_v2(spark, sf_dir):
    folds = mm.kfold(bin_frame(spark, sf_dir), "doc_id", 5, stratify="quality")
    return folds.groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


def class_frame(spark, sf_dir):
    """documents join labels -> what a text measures, raw and as logarithms, language and
    source one-hot; exact stratified split and folds.  (frame, features, numbers, target)."""
    from kestrel.functions.columns import leaking_fields
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.length(text).cast("double").alias("chars"), F.size(words).cast("double").alias("words"),
        F.size(F.array_distinct(words)).cast("double").alias("distinct_words"),
        *[F.regexp_count(text, F.lit(p)).cast("double").alias(c) for c, p in (
            ("lines", "\n"), ("digits", "[0-9]"), ("capitals", "[A-Z]"), ("stops", "[.!?]"), ("symbols", "[#*$%&|<>]"), ("commas", "[,;:]"))])
    b = d.join(table(spark, sf_dir, "labels"), "doc_id")
    numbers = ["chars", "words", "distinct_words", "lines", "digits", "capitals", "stops", "symbols", "commas"]
    b = b.withColumns({f"log_{c}": F.log1p(c) for c in numbers}).withColumn("word_length", F.col("chars") / F.greatest("words", F.lit(1.0)))
    numbers += [f"log_{c}" for c in numbers] + ["word_length"]
    b = b.drop(*leaking_fields(b.schema, ("toxic",)))  # leakage guard (P12): the second label never enters X
    for c in ("lang", "source"):
        b = mm.one_hot(b, c, levels=mm.levels_of(b, c), prefix=c)
    feats = numbers + [c for c in b.columns if c.startswith(("lang_", "source_"))]
    b = mm.train_test_split(b, "doc_id", 0.2, seed="42", stratify="quality")
    b = mm.kfold(b, "doc_id", 5, stratify="quality").select("doc_id", "split", "fold", "quality", *feats).checkpoint()
    return b, feats, numbers, "quality"


@lru_cache(maxsize=4)
def _class_comparison(spark, sf_dir):
    """Four variants x three models with the C grid."""
    b, feats, numbers, y = class_frame(spark, sf_dir)
    train = b.where(F.col("split") == "train")
    ranks, _ = logistic.rfe(train, feats, y, min(RFE_COMPARED_K, len(feats)))
    kept = [f for f in feats if ranks[f] == 1]
    variants = {"all_features": feats, f"feature_selection_rfe_{len(kept)}": kept}
    for name, cols in (("pca_continuous_only", numbers), ("pca_all_features", feats)):
        stats, model, ratios = fe.pca_fit(train, cols)
        k = fe.components_for(fe.variance_table(ratios, spark), 0.95)
        parts = fe.pca_project(b, cols, stats, model, k, keep=["doc_id"])
        parts = parts.select("doc_id", *[F.col(c).alias(f"{name}_{c}") for c in parts.columns[1:]])
        b, variants[name] = b.join(parts, "doc_id"), parts.columns[1:]
    b = b.checkpoint()
    return b, y, comparison.classification(b, variants, y, "doc_id", md.LOGREG_CS)


@register("V13_classification_comparison")
def q_class_table(spark, sf_dir):
    """All features, RFE, and both PCA variants x unweighted, balanced and SMOTE logistic
    regression, C by stratified CV; by variant and falling ROC-AUC."""
    return round_doubles(_class_comparison(spark, sf_dir.rstrip("/"))[2].table, 6)


@register("V13_best_model_confusion")
def q_best_confusion(spark, sf_dir):
    """The best model by ROC-AUC, then F1, refitted with its C on all training rows (a SMOTE
    model with the new rows), and its confusion matrix on the test rows."""
    b, y, out = _class_comparison(spark, sf_dir.rstrip("/"))
    best = out.table.orderBy(F.desc_nulls_last("roc_auc"), F.desc("f1"), "variant", "model").first()
    fit = out.refit(f"{best['variant']}::{best['model']}")
    scored = b.where(F.col("split") == "test").select(y, logistic.score_expr(fit.columns, fit.coef).alias("score"))
    return round_doubles(md.confusion_metrics(scored, y).select(
        F.lit(best["variant"]).alias("variant"), F.lit(best["model"]).alias("model"), F.lit(best["C"]).alias("C"), "*"), 6)


@register("L6_L7_V13_V15_logistic_cv_leaderboard")
def q_l6(spark, sf_dir):
    """The best model of each variant by F1, ROC-AUC and kappa, the overall pick flagged (V15),
    and the best by ROC-AUC then F1 marked (V13)."""
    from kestrel.operators.clean import flag_best
    res = flag_best(_class_comparison(spark, sf_dir.rstrip("/"))[2].table, [F.desc("roc_auc"), F.desc("f1")], flag="best_by_auc")
    return round_doubles(md.leaderboard(res, [("f1", "desc"), ("roc_auc", "desc"), ("kappa", "desc")]), 6)


def _scaled_class_frame(spark, sf_dir):
    b, feats, _, y = class_frame(spark, sf_dir)
    return fe.apply_scaler(b, fe.fit_scaler(b.where(F.col("split") == "train"), feats)), feats, y


@register("L6_mllib_logistic_fixed_C")
def q_l6m(spark, sf_dir):
    """The same model through MLlib's LogisticRegression (regParam = 1/(C·n),
    unpenalised intercept) for a fixed C, as the library's MLlib path."""
    b, feats, y = _scaled_class_frame(spark, sf_dir)
    train, test = b.where(F.col("split") == "train"), b.where(F.col("split") == "test")
    va, m = md.fit_logistic(train, feats, y, 1.0, balanced=True)
    return round_doubles(md.classification_metrics(md.logistic_scores(va, m, test, keep=[y]), y), 6)


@register("L8_smote_logistic")
def q_l8(spark, sf_dir):
    """SMOTE on training rows only, inside each fold, then unweighted logistic regression
    with C from the grid."""
    b, feats, _, y = class_frame(spark, sf_dir)
    out = comparison.classification(b, {"all_features": feats}, y, "doc_id", md.LOGREG_CS, models=("logreg_smote_l2",))
    return round_doubles(out.table, 6)


@register("F6_rfe_logistic")
def q_f6(spark, sf_dir):
    """Logistic elimination on the raw features of the training rows, down to 30."""
    b, feats, _, y = class_frame(spark, sf_dir)
    ranks, fit = logistic.rfe(b.where(F.col("split") == "train"), feats, y, min(RFE_COMPARED_K, len(feats)))
    return spark.createDataFrame([(f, int(ranks[f]), fit.converged) for f in feats], "feature string, ranking int, converged boolean")


# ---------------------------------------------------------------- closed forms in SQL
@register("L5_log1p_one_feature", f"""{TRAIN},
f AS (SELECT regr_slope(ln(1 + price), quantity) AS b, regr_intercept(ln(1 + price), quantity) AS a FROM tr)
SELECT round(any_value(b), 8) AS coef, round(any_value(a), 8) AS intercept,
       round(sqrt(avg(power(price - (exp(a + b * quantity) - 1), 2))), 4) AS rmse,
       round(avg(abs(price - (exp(a + b * quantity) - 1))), 4) AS mae FROM s, f WHERE split = 'test'""")
def q_l5_one(spark, sf_dir):
    """OLS on log1p of the target, judged in its own units on the test rows."""
    s = _train(spark, sf_dir)
    tr = s.where(F.col("split") == "train").withColumn("price", F.log1p("price"))
    fit = gram.fit_linear(gram.total(gram.gram_moments(tr, ["quantity"], "price")), "ols")
    pred = F.expm1(md.linear_predict(["quantity"], fit, "_lp")).alias("pred")
    m = md.regression_metrics(s.where(F.col("split") == "test").select("price", pred), "price")
    return m.select(F.round(F.lit(float(fit.coef[0])), 8).alias("coef"), F.round(F.lit(float(fit.intercept)), 8).alias("intercept"),
                    F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@register("V9_coefficient_table_two_features", f"""{TRAIN},
{_moments_sql('quantity', 'discount')},
w AS (SELECT (c22 * r1 - c12 * r2) / (c11 * c22 - c12 * c12) AS w1, (c11 * r2 - c12 * r1) / (c11 * c22 - c12 * c12) AS w2 FROM z)
SELECT 'quantity' AS feature, round(w1, 4) AS coef, round(abs(w1), 4) AS abs_coef FROM w
UNION ALL SELECT 'discount', round(w2, 4), round(abs(w2), 4) FROM w""")
def q_v9_two(spark, sf_dir):
    tr = _train(spark, sf_dir).where(F.col("split") == "train")
    fit = gram.fit_linear(gram.total(gram.gram_moments(tr, ["quantity", "discount"], "price")), "ols")
    return round_doubles(md.coefficient_table(spark, ["quantity", "discount"], fit), 4)


@register("V3_ridge_cv_rmse_one_feature", f"""{W},
f AS (SELECT *, CAST((row_number() OVER (
    ORDER BY ('0x' || substr(md5(concat_ws('|', '42', 'fold', rid)), 1, 8))::BIGINT, rid) - 1) % 5 AS INTEGER) AS fold FROM wide),
a AS (SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0]) AS alpha),
m AS (SELECT k.fold, count(*) AS n, avg(quantity) AS mx, stddev_pop(quantity) AS sx, avg(price) AS my, covar_pop(quantity, price) AS cxy
      FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold GROUP BY k.fold),
c AS (SELECT fold, alpha, mx, my, n * cxy / sx / (n + alpha) / sx AS b FROM m, a),
e AS (SELECT alpha, c.fold, sqrt(avg(power(price - my - b * (quantity - mx), 2))) AS rmse FROM c JOIN f ON f.fold = c.fold GROUP BY ALL)
SELECT CAST(alpha AS DOUBLE) AS alpha, round(avg(rmse), 6) AS cv_rmse FROM e GROUP BY alpha""")
def q_v3_one(spark, sf_dir):
    """The whole ridge grid by five-fold CV; the scaler is refitted per fold."""
    folds = gram.gram_moments(mm.kfold(wide(spark, sf_dir), "rid", 5), ["quantity"], "price", group="fold")
    rows = [(float(a), gram.cv_rmse(folds, "ridge", a)) for a in md.RIDGE_ALPHAS]
    return round_doubles(spark.createDataFrame(rows, "alpha double, cv_rmse double"), 6)


@register("R2_components_two_features", f"""{W},
r AS (SELECT (1 + abs(corr(quantity, price))) / 2 AS first FROM wide)
SELECT CASE WHEN first >= 0.6 THEN 1 ELSE 2 END AS k60, CASE WHEN first >= 0.9 THEN 1 ELSE 2 END AS k90,
       CASE WHEN first >= 0.99 THEN 1 ELSE 2 END AS k99 FROM r""")
def q_r2(spark, sf_dir):
    _, _, ratios = fe.pca_fit(wide(spark, sf_dir), ["quantity", "price"])
    vt = fe.variance_table(ratios, spark)
    k60, k90, k99 = (fe.components_for(vt, t) for t in (0.6, 0.9, 0.99))
    return spark.createDataFrame([(k60, k90, k99)], "k60 int, k90 int, k99 int")


# ---------------------------------------------------------------- M9, M10
def _imputer_frames(spark, sf_dir):
    """Numbers and two categories with holes, indicators and an exact split."""
    src = holes(spark, sf_dir, [*WIDE_FEATURES, "price", "ptype", "brand"]).where(F.col("price").isNotNull())
    h = mm.na_indicators(src, WIDE_FEATURES)
    h = mm.train_test_split(h, "rid", 0.2, seed="411").checkpoint()
    return h.where(F.col("split") == "train"), h.where(F.col("split") == "test")


@register("M10_imputer_comparison_ridge")
def q_m10(spark, sf_dir):
    """Ridge(alpha=1) behind four ways to fill: medians, KNN (z-scored), KNN with rare types
    merged, and chained equations (Bayesian ridge, fewest gaps first, ten rounds); categories
    get their mode and are one-hot encoded.  Fitted on all training rows, scored on all test
    rows."""
    tr, te = _imputer_frames(spark, sf_dir)
    cats = ["ptype", "brand"]
    modes = mm.fit_simple_imputer(tr, [], cats)
    medians = mm.fit_simple_imputer(tr, WIDE_FEATURES)
    near = [knn_impute(x, tr, WIDE_FEATURES, "rid").checkpoint() for x in (tr, te)]
    chained = imputation.fit_iterative(tr, WIDE_FEATURES, estimator="bayesian_ridge", ascending=True)
    merged = [mm.merge_rare_levels(mm.apply_fills(tr, modes), mm.apply_fills(x, modes), "ptype", 200) for x in near]
    pairs = {"simple_median": [mm.apply_fills(x, medians) for x in (tr, te)], "knn_k5_distance": near,
             "knn_k5_merged_types": merged, "iterative_bayesian_ridge": [chained.apply(x) for x in (tr, te)]}
    numbers = WIDE_FEATURES + [c for c in tr.columns if c.endswith("_missing")]
    rows = []
    for name, (a, b) in pairs.items():
        a, b = mm.apply_fills(a, modes), mm.apply_fills(b, modes)
        for c in cats:
            levels = mm.levels_of(a, c)
            a, b = mm.one_hot(a, c, levels=levels, prefix="cat"), mm.one_hot(b, c, levels=levels, prefix="cat")
        feats = numbers + [c for c in a.columns if c.startswith("cat_")]
        fit = gram.fit_linear(gram.total(gram.gram_moments(a, feats, "price")), "ridge", alpha=1.0, scale=False)
        m = md.regression_metrics(b.select("price", md.linear_predict(feats, fit)), "price").collect()[0]
        rows.append((name, float(m["rmse"])))
    return round_doubles(spark.createDataFrame(rows, "imputer string, rmse double"), 6)


@register("M9_iterative_impute_one_gap", f"""{W},
h AS (SELECT rid, brand, quantity, {sql_hole("price")} FROM wide),
f AS (SELECT regr_slope(price, quantity) AS b, regr_intercept(price, quantity) AS a FROM h)
SELECT brand, count(*) AS n, round(avg(coalesce(price, a + b * quantity)), 6) AS price FROM h, f GROUP BY brand""")
def q_m9_one(spark, sf_dir):
    """With gaps in one column alone the rounds end at its regression on the others."""
    h = holes(spark, sf_dir, ["price"]).select("rid", "brand", "quantity", "price")
    out = imputation.iterative_impute(h, ["quantity", "price"])
    return round_doubles(out.groupBy("brand").agg(F.count("*").alias("n"), F.avg("price").alias("price")))


@register("M9_iterative_impute")
def q_m9(spark, sf_dir):
    """Chained-equation imputation, ten rounds over all feature columns."""
    h = holes(spark, sf_dir).select("rid", *WIDE_FEATURES)
    out = imputation.iterative_impute(h, WIDE_FEATURES)
    return round_doubles(out.agg(*[F.avg(c).alias(c) for c in WIDE_FEATURES]), 6)
