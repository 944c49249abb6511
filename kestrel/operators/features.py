"""Scaling, feature selection and dimension reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.aggregates import to_long, pearson
from kestrel.operators.ranking import _search, exact_quantiles, ranked_histogram, value_histogram


# ---------------------------------------------------------------- M11
def fit_scaler(fit: DataFrame, columns) -> dict:
    """Mean and population std per column from ``fit`` (NULLs ignored); a
    zero std becomes 1 (sklearn's StandardScaler).  One aggregate row."""
    cols = list(columns)
    row = fit.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] if row[f"s{i}"] else 1.0) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, stats: dict) -> DataFrame:
    """(x − mean) / std as plain column expressions (stays in codegen)."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


# ---------------------------------------------------------------- F1-F4
def variance_threshold(fit: DataFrame, columns, threshold: float = 0.0) -> list[str]:
    """Columns whose population variance on ``fit`` exceeds ``threshold`` (F1)."""
    cols = list(columns)
    row = fit.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).collect()[0]
    return [c for i, c in enumerate(cols) if (row[f"v{i}"] or 0.0) > threshold]


def f_scores(df: DataFrame, columns, target: str, top: int | None = None) -> DataFrame:
    """Univariate regression F = r²/(1−r²)·(n−2) per feature, by F desc (F3);
    infinite for a perfect correlation, NULL for a constant column."""
    cols = list(columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[pearson(c, target).alias(c) for c in cols])
    long = row.unpivot(["_n"], cols, "feature", "corr")
    out = long.select("feature", "corr",
                      F.when(F.abs("corr") >= 1, float("inf")).otherwise(
                          F.try_divide(F.col("corr") ** 2, 1 - F.col("corr") ** 2) * (F.col("_n") - 2)).alias("f_score"))
    out = out.orderBy(F.desc_nulls_last("f_score"), "feature")
    return out.limit(top) if top else out


def quantile_binned(df: DataFrame, columns, bins: int = 10) -> DataFrame:
    """Long (row_id-less) frame (column, bin) with equal-frequency bins from
    exact quantile edges per column; duplicate edges merge bins."""
    long = to_long(df, columns).where(F.col("value").isNotNull())
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(long, "value", probs, by="column", bucket_by="column").collect()
    per = {}
    for r in edges:
        per.setdefault(r["column"], set()).add(r["quantile"])
    m = F.create_map(*[x for c, e in per.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in sorted(e)]))])
    return long.withColumn("bin", F.size(F.filter(m[F.col("column")], lambda b: b < F.col("value"))))


def mutual_information(df: DataFrame, columns, target: str, bins: int = 10, top: int | None = None) -> DataFrame:
    """Mutual information (nats) between each feature and the target on
    equal-frequency bins (F4; a binned estimator, not sklearn's k-NN one).

    All edges come from one histogram of the columns and the target; the rows are binned
    where they stand, without a join, and counted by combining aggregates."""
    cols = list(columns)
    d = df.select(*cols, target).na.drop("any")
    names = [f"x{i}" for i in range(len(cols))]
    d = d.select(*[F.col(c).cast("double").alias(n) for c, n in zip([*cols, target], [*names, "y"])])
    hist = value_histogram(to_long(d, d.columns), "value", "column").checkpoint()
    rh = ranked_histogram(None, "value", by="column", hist=hist, bucket_by="column")
    edges = {}
    for r in exact_quantiles(None, "value", [i / bins for i in range(1, bins)], by="column", rh=rh).collect():
        edges.setdefault(r["column"], set()).add(r["quantile"])

    def binned(c: str):
        e = sorted(edges.get(c, ()), key=lambda v: (v != v, v))  # NaN is above all, as in Spark
        return _search(F.col(c), e, 0, len(e))
    xb = d.select(binned("y").alias("ybin"), *[binned(n).alias(n) for n in names]).unpivot(["ybin"], names, "column", "xbin")
    joint = xb.groupBy("column", "xbin", "ybin").agg(F.count(F.lit(1)).alias("nxy"))
    w = Window.partitionBy("column")
    joint = (joint.withColumn("n", F.sum("nxy").over(w))
                  .withColumn("nx", F.sum("nxy").over(Window.partitionBy("column", "xbin")))
                  .withColumn("ny", F.sum("nxy").over(Window.partitionBy("column", "ybin"))))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    feature = F.element_at(F.array(*[F.lit(c) for c in cols]), F.substring("column", 2, 9).cast("int") + 1)
    out = joint.groupBy(feature.alias("feature")).agg(F.sum(term).alias("mutual_info"))
    out = out.orderBy(F.desc("mutual_info"), "feature")
    return out.limit(top) if top else out


# ---------------------------------------------------------------- R1-R5 PCA
def pca_fit(fit: DataFrame, columns, k: int | None = None):
    """Standardise with the fit frame's population std and fit MLlib PCA.
    Returns (scaler stats, PCAModel, explained variance ratios)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    cols = list(columns)
    stats = fit_scaler(fit, cols)
    va = VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="skip")
    scaled = va.transform(apply_scaler(fit.select(*cols), stats))
    model = PCA(k=k or len(cols), inputCol="_v", outputCol="_pc").fit(scaled)
    return stats, model, [float(v) for v in model.explainedVariance.toArray()]


def variance_table(ratios, spark) -> DataFrame:
    """(component, explained_variance_ratio, cumulative_explained_variance_ratio)
    — the running sum over p rows (W4)."""
    rows = [(i + 1, float(r)) for i, r in enumerate(ratios)]
    df = spark.createDataFrame(rows, "component int, explained_variance_ratio double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative_explained_variance_ratio", F.sum("explained_variance_ratio").over(w))


def components_for(variance: DataFrame, threshold: float) -> int:
    """First component whose cumulative ratio reaches ``threshold``."""
    r = (variance.where(F.col("cumulative_explained_variance_ratio") >= threshold - 1e-12)
                 .agg(F.min("component")).collect()[0][0])
    return int(r) if r is not None else variance.count()


def pca_project(df: DataFrame, columns, stats: dict, model, k: int, keep=()) -> DataFrame:
    """PC1..PCk columns (R3, R4) for any frame, with ``keep`` columns carried."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    cols = list(columns)
    va = VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="keep")
    t = model.transform(va.transform(apply_scaler(df.select(*keep, *cols), stats)))
    arr = vector_to_array("_pc")
    return t.select(*keep, *[arr[i].alias(f"PC{i + 1}") for i in range(k)])

