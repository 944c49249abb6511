"""Model fitting glue, predictions, metrics and leaderboards (L*, V*).

Linear models are solved on the Gram path (:mod:`kestrel.operators.gram`);
predictions are plain column expressions.  Logistic regression uses MLlib
(distributed L-BFGS) with the regularisation mapped to sklearn's ``C``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import distributions as dist
from kestrel.operators.windows import order_columns
from kestrel.operators import gram
from kestrel.operators.ranking import ranked_histogram

# fixed values: the reference's hyper-parameter grids
RIDGE_ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]
LASSO_ALPHAS = [0.0005, 0.001, 0.01, 0.1, 1.0]
ENET_ALPHAS = [0.001, 0.01, 0.1, 1.0]
ENET_L1_RATIOS = [0.2, 0.5, 0.8]
LOGREG_CS = [0.01, 0.1, 1.0, 10.0]


def regression_grids() -> dict:
    return {
        "ols": [{}],
        "ridge": [{"alpha": a} for a in RIDGE_ALPHAS],
        "lasso": [{"alpha": a} for a in LASSO_ALPHAS],
        "elasticnet": [{"alpha": a, "l1_ratio": r} for a in ENET_ALPHAS for r in ENET_L1_RATIOS],
    }


# ---------------------------------------------------------------- linear
def linear_predict(features, fit: gram.LinearFit, name: str = "pred") -> Column:
    expr = F.lit(float(fit.intercept))
    for c, w in zip(features, fit.coef):
        expr = expr + F.col(c) * F.lit(float(w))
    return expr.alias(name)


def regression_metrics(df: DataFrame, label: str, pred: str = "pred") -> DataFrame:
    """rmse, mae, r2 on the given rows (V4), one aggregate.  For a constant label r2
    is 1 if every prediction is right, else 0."""
    err = F.col(label) - F.col(pred)
    return df.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                  F.when(F.var_pop(label) > 0, 1 - F.try_divide(F.sum(err * err), F.var_pop(label) * F.count(F.lit(1))))
                  .when(F.sum(err * err) > 0, 0.0).when(F.count(F.lit(1)) > 0, 1.0).alias("r2"))


def fit_regression_suite(train: DataFrame, features, label: str, fold_col: str = "fold",
                         grids: dict | None = None, transform: str | None = None, folds: dict | None = None) -> list:
    """CV grid search for every model on one pass of moments (L1-L5, V3), or on the moments
    by fold in ``folds``.  Returns [(model, params, cv_rmse, LinearFit)], refit on all training rows."""
    grids = grids or regression_grids()
    src = train
    if transform == "log1p":
        src = train.withColumn(label, F.log1p(label))
    folds = folds or gram.gram_moments(src, features, label, group=fold_col)
    tot = gram.total(folds)
    out = []
    for model, grid in grids.items():
        params, score = gram.grid_search(folds, model, grid)
        fit = gram.fit_linear(tot, model, **params)
        out.append((model, params, score, fit))
    return out


def coefficient_table(spark, features, fit: gram.LinearFit) -> DataFrame:
    """(feature, coef, abs_coef) sorted by |coef| desc (V9); coefficients of the
    standardised features, so that their sizes compare."""
    rows = [(f, float(w), float(abs(w))) for f, w in zip(features, fit.scaled_coef)]
    return spark.createDataFrame(rows, "feature string, coef double, abs_coef double").orderBy(
        F.desc("abs_coef"), "feature")


def residuals(df: DataFrame, label: str, pred: str = "pred") -> DataFrame:
    """(fitted, residual)."""
    return df.select(F.col(pred).alias("fitted"), (F.col(label) - F.col(pred)).alias("residual"))


def residual_bins(res: DataFrame, bins: int = 20) -> DataFrame:
    """Residual mean / std per equal-width fitted-value bin (V10 summary)."""
    s = res.agg(F.min("fitted").alias("lo"), F.max("fitted").alias("hi")).collect()[0]
    lo, hi = s["lo"], s["hi"]
    b = F.least(F.width_bucket(F.col("fitted"), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)) \
        if hi != lo else F.lit(1)
    return res.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean_residual"),
                                           F.stddev_samp("residual").alias("std_residual"))


def qq_points(res: DataFrame, col: str = "residual") -> tuple[DataFrame, DataFrame]:
    """Normal Q-Q points with Filliben's plotting positions and the fitted
    line (slope, intercept, r) (V11).  Positions come from the distributed
    ranked histogram; a tied value has the mean quantile of its positions."""
    rh = ranked_histogram(res, col)
    n = F.col("total")
    both = dist.normal_scores_udf(F.col("before"), F.col("n"), n)
    pts = rh.select(F.col(col).alias("sample"), "n", both.alias("_q")).select(
        "sample", "n", F.col("_q.mean").alias("theoretical"), F.col("_q.squares").alias("_squares"))
    # every copy of a tied value has a position of its own
    line = pts.agg((F.sum(F.col("n") * F.col("theoretical") * F.col("sample")) / F.sum("n")).alias("_sxy"),
                   (F.sum(F.col("n") * F.col("theoretical")) / F.sum("n")).alias("_mx"),
                   (F.sum(F.col("n") * F.col("sample")) / F.sum("n")).alias("_my"),
                   (F.sum("_squares") / F.sum("n")).alias("_sxx"),
                   (F.sum(F.col("n") * F.col("sample") ** 2) / F.sum("n")).alias("_syy"))
    cov = F.col("_sxy") - F.col("_mx") * F.col("_my")
    vx = F.col("_sxx") - F.col("_mx") ** 2
    vy = F.col("_syy") - F.col("_my") ** 2
    slope = F.try_divide(cov, vx)
    line = line.select(slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"),
                       F.try_divide(cov, F.sqrt(vx * vy)).alias("r"))
    return pts.drop("_squares"), line


# ---------------------------------------------------------------- logistic
def balanced_weights(df: DataFrame, label: str, out: str = "_w") -> DataFrame:
    """sklearn ``class_weight='balanced'``: n / (2 · n_class)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    k = len(counts)
    m = F.create_map(*[x for c, v in counts.items() for x in (F.lit(c), F.lit(n / (k * v)))])
    return df.withColumn(out, m[F.col(label)])


def fit_logistic(train: DataFrame, features, label: str, C: float, balanced: bool = False,
                 max_iter: int = 200):
    """L2 logistic regression, sklearn's C mapped to MLlib's regParam =
    1/(C·n) (n = training rows, or the sum of weights).  Features should be
    standardised already; MLlib does not penalise the intercept (liblinear
    does: a documented difference)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(features), outputCol="_f")
    d = va.transform(train)
    weight = None
    if balanced:
        d = balanced_weights(d, label)
        weight = "_w"
    n = d.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).collect()[0][0]
    lr = LogisticRegression(featuresCol="_f", labelCol=label, regParam=1.0 / (C * n), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=1e-10, family="binomial")
    if weight:
        lr = lr.setWeightCol(weight)
    return va, lr.fit(d)


def logistic_scores(va, model, df: DataFrame, keep=(), name: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    t = model.transform(va.transform(df))
    return t.select(*keep, vector_to_array("probability")[1].alias(name))


# ---------------------------------------------------------------- classification metrics
def roc_auc(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """ROC-AUC by the rank-sum formula with average ranks (ties count 1/2) (V7).

    Works on the score histograms of all rows and of the positives: a score
    shared by many rows is one histogram row.  NULL with one class only.
    """
    d = scored.select(F.col(label).alias("_y"), score).where(F.col(score).isNotNull() & F.col(label).isNotNull())
    h = d.groupBy(score).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("_y") == 1).alias("pos"))
    rh = ranked_histogram(None, score, hist=h.select(score, "n")).select(score, "rank", F.col("n").alias("all"))
    s = rh.join(h.select(score, "pos"), score).agg(
        F.sum(F.col("pos") * F.col("rank")).alias("r1"), F.sum("pos").cast("double").alias("n1"),
        F.sum(F.col("all") - F.col("pos")).alias("n0"))
    return s.select(F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * F.col("n0"))
                    .alias("roc_auc"))


def average_precision(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """Step-wise average precision Σ (R_k − R_{k−1}) P_k over distinct
    thresholds (V8), from two ranked histograms (all rows, positives).  NULL
    without a positive row."""
    d = scored.select(F.col(label).cast("double").alias("_pos"), score).where(F.col(score).isNotNull())
    h = d.groupBy(score).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_pos").alias("npos"))
    all_rh = ranked_histogram(None, score, hist=h.select(score, "n")).select(score, "before", "total")
    pos_h = h.select(score, F.col("npos").alias("n"))
    pos_rh = ranked_histogram(None, score, hist=pos_h).select(score, F.col("before").alias("pbefore"),
                                                               F.col("total").alias("P"))
    j = h.join(all_rh, score).join(pos_rh, score)
    tp = F.col("P") - F.col("pbefore")          # positives with score >= s
    k = F.col("total") - F.col("before")        # rows with score >= s
    contrib = F.try_divide(F.col("npos"), F.col("P")) * (tp / k)
    return j.agg(F.sum(contrib).alias("pr_auc"))


def confusion_metrics(scored: DataFrame, label: str, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """TN, FP, FN, TP at ``score >= threshold`` and sensitivity, specificity,
    precision (0 if undefined), F1, accuracy, Cohen's kappa (V5, V6, P16)."""
    pred = (F.col(score) >= threshold).cast("int")
    y = F.col(label)
    c = scored.agg(F.count_if((y == 0) & (pred == 0)).alias("tn"), F.count_if((y == 0) & (pred == 1)).alias("fp"),
                   F.count_if((y == 1) & (pred == 0)).alias("fn"), F.count_if((y == 1) & (pred == 1)).alias("tp"))
    tn, fp, fn, tp = [F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp")]
    n = tn + fp + fn + tp
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    sens = F.when(tp + fn > 0, tp / (tp + fn))
    spec = F.when(tn + fp > 0, tn / (tn + fp))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    acc = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    kappa = F.when(pe < 1, (acc - pe) / (1 - pe)).otherwise(0.0)
    return c.select("tn", "fp", "fn", "tp", sens.alias("sensitivity"), spec.alias("specificity"),
                    prec.alias("precision"), f1.alias("f1"), acc.alias("accuracy"), kappa.alias("kappa"))


def classification_metrics(scored: DataFrame, label: str, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """One row: roc_auc, pr_auc and the confusion metrics."""
    a = roc_auc(scored, label, score).collect()[0][0]
    p = average_precision(scored, label, score).collect()[0][0]
    return confusion_metrics(scored, label, score, threshold).select(
        F.lit(a).cast("double").alias("roc_auc"), F.lit(p).cast("double").alias("pr_auc"), "*")


# ---------------------------------------------------------------- leaderboards
def leaderboard(results: DataFrame, order, partition: str = "variant", flag: str = "selected") -> DataFrame:
    """Best row per ``partition`` under ``order`` (W1), flagged 1 if it is the
    overall best under the same order (P15, V14, V15).  For result tables
    (one row per model), so the windows are tiny."""
    oc = order_columns(order)  # a model without a metric comes last
    w = Window.partitionBy(partition).orderBy(*oc)
    best = results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    g = Window.orderBy(*oc)
    top = results.withColumn("_g", F.row_number().over(g)).where(F.col("_g") == 1).select(
        F.col(partition).alias("_bp"), F.col("model").alias("_bm"))
    return (best.join(F.broadcast(top), (best[partition] == top["_bp"]) & (best["model"] == top["_bm"]), "left")
                .withColumn(flag, F.col("_bp").isNotNull().cast("int")).drop("_bp", "_bm"))

