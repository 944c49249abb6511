"""Profiles and aggregates.

Wide per-column statistics are computed by unpivoting the columns into a long
``(column, value)`` frame and grouping by ``column``: one aggregate, any number
of columns, no codegen-size limit, and the per-column work is spread by the
shuffle rather than by hundreds of expressions in one task.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.columns import numeric_columns
from kestrel.operators.ranking import (CASE_LIMIT, assign_buckets, exact_median, exact_quantiles, ranked_histogram,
                                       value_histogram)


# ---------------------------------------------------------------- long form
def to_long(df: DataFrame, columns, value_name: str = "value", id_cols=(),
            cast: str | None = "double") -> DataFrame:
    """Unpivot ``columns`` into (id_cols..., column, value); NULL cells kept."""
    cols = list(columns)
    src = df.select(*id_cols, *[(F.col(c).cast(cast) if cast else F.col(c)).alias(c) for c in cols])
    return src.unpivot(list(id_cols), cols, "column", value_name)


# ---------------------------------------------------------------- missing values
def na_counts(df: DataFrame, columns=None, nonzero_only: bool = True) -> DataFrame:
    """(column, na_count) sorted by count desc then name (A1)."""
    cols = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    out = row.unpivot([], cols, "column", "na_count")
    if nonzero_only:
        out = out.where(F.col("na_count") > 0)
    return out.orderBy(F.desc("na_count"), "column")


def na_total(df: DataFrame, columns=None) -> DataFrame:
    """Single row: total NULL cells (A2)."""
    cols = list(columns or df.columns)
    expr = sum((F.col(c).isNull().cast("bigint") for c in cols), F.lit(0).cast("bigint"))
    return df.agg(F.sum(expr).cast("bigint").alias("na_total"))


def na_rates(df: DataFrame, columns=None, top: int | None = 15) -> DataFrame:
    """(column, na_rate) sorted desc (A3); rate = NULL share of rows."""
    cols = list(columns or df.columns)
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    out = row.unpivot([], cols, "column", "na_rate").orderBy(F.desc("na_rate"), "column")
    return out.limit(top) if top else out


def shape(df: DataFrame) -> DataFrame:
    """Single row (n_rows, n_cols) (A4)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


# ---------------------------------------------------------------- describe
def describe_numeric(df: DataFrame, columns=None, buckets: int | None = None) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 % (exact, linear), max per column (A5)."""
    cols = list(columns or numeric_columns(df))
    long = to_long(df, cols).where(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by="column", buckets=buckets,
                        bucket_by="column")
    qw = q.groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("p25"),
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("p50"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("p75"))
    return moments.join(qw, "column", "left")


def describe_categorical(df: DataFrame, columns) -> DataFrame:
    """count, unique, top, freq per column (A6).  ``top`` is the most frequent
    value, the smallest one on ties; computed from the per-value histogram with
    a combining aggregate, never by collecting a column's values."""
    long = to_long(df, columns, cast="string").where(F.col("value").isNotNull())
    hist = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v")))
    return (hist.groupBy("column")
                .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b"))
                .select("column", "count", "unique", F.col("b.v").alias("top"),
                        (-F.col("b.neg_n")).alias("freq")))


# ---------------------------------------------------------------- categories
def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(column value, n) with NULL as its own level, desc by n then value."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    out = out.orderBy(F.desc("n"), F.asc_nulls_last(column))
    return out.limit(top) if top else out


def top_k_levels(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent non-NULL levels, ties broken by name (W9).  The
    result has at most k rows, so it may be broadcast safely."""
    return (df.where(F.col(column).isNotNull())
              .groupBy(column).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc(column)).limit(k))


def keep_levels(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Membership filter to the given levels (P9): a left-semi join, broadcast only if
    Spark finds the levels small enough."""
    return df.join(levels.select(column), column, "left_semi")


def keep_top_levels(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows of the k most frequent levels; k rows are broadcast."""
    return df.join(F.broadcast(top_k_levels(df, column, k).select(column)), column, "left_semi")


def n_levels(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """Distinct non-NULL count (A10); HyperLogLog++ when ``approx``."""
    f = F.approx_count_distinct(column) if approx else F.count_distinct(column)
    return df.agg(f.alias("n_distinct"))


# ---------------------------------------------------------------- groups
def group_summary(df: DataFrame, group, value: str, buckets: int | None = None) -> DataFrame:
    """n / mean / median / std (n-1) of ``value`` per group, by mean desc.

    Moments come from one combining aggregate.  The median comes from the
    ranked histogram (exact, distributed): Spark's ``median`` would merge all
    distinct values of a group in one task, which a hot group cannot afford.
    """
    by = [group] if isinstance(group, str) else list(group)
    mom = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                              F.stddev_samp(value).alias("std"))
    med = exact_median(df, value, by, buckets=buckets)
    from kestrel.operators.ranking import null_safe_join
    return null_safe_join(mom, med, by, "left").orderBy(F.desc("mean"))


def group_median(df: DataFrame, keys, value: str, name: str = "median") -> DataFrame:
    """Exact median per composite key; NULL keys form their own group."""
    return exact_median(df, value, keys, name=name)


def quantiles(df: DataFrame, value: str, probs, by=None) -> DataFrame:
    """Linear-interpolated quantiles."""
    return exact_quantiles(df, value, probs, by)


# ---------------------------------------------------------------- shape of distributions
def skew_kurtosis(df: DataFrame, columns=None) -> DataFrame:
    """Biased skewness and biased excess kurtosis per column, by |skew| desc."""
    cols = list(columns or numeric_columns(df))
    long = to_long(df, cols).where(F.col("value").isNotNull())
    out = long.groupBy("column").agg(F.skewness("value").alias("skew"),
                                     F.kurtosis("value").alias("kurtosis"))
    return out.orderBy(F.desc(F.abs("skew")), "column")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max] (A17): (bin 1..bins, lo, hi, n).
    The maximum falls in the last bin (closed right edge)."""
    s = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).collect()[0]
    lo, hi = s["lo"], s["hi"]
    x = df.where(F.col(column).isNotNull())
    if lo is None:
        return x.select(F.lit(1).alias("bin"), F.lit(0.0).alias("bin_lo"), F.lit(0.0).alias("bin_hi"),
                        F.lit(0).cast("bigint").alias("n")).limit(0)
    if lo == hi:
        b = F.lit(1)
    else:
        b = F.least(F.width_bucket(F.col(column), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    out = x.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    return out.select("bin", (F.lit(lo) + (F.col("bin") - 1) * width).alias("bin_lo"),
                      (F.lit(lo) + F.col("bin") * width).alias("bin_hi"), "n")


#: Bins of a bandwidth, and distinct values or bins at most.
KDE_BINS, KDE_MAX_BINS = 500, 1 << 17


def kde_curve(df: DataFrame, column: str, grid_points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid over [min, max].

    Bandwidth by Scott's rule (sample std · n^(-1/5)).  Up to ``KDE_MAX_BINS`` distinct values
    are counted and summed as they are.  Of more, every value is shared between the two
    nearest of ``KDE_BINS`` fine bins a bandwidth, in proportion (one combining aggregate), and
    the binned weights are convolved with the kernel.  The error is at most 0.05 (d/h)²/h for
    bins of width d, and far less where the density is smooth; a range of more than
    ``KDE_MAX_BINS`` bins makes them wider.
    """
    s = df.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("sd"),
               F.min(column).alias("lo"), F.max(column).alias("hi")).collect()[0]
    n, sd, lo, hi = s["n"], s["sd"], s["lo"], s["hi"]
    if not n or sd is None or sd == 0:
        raise ValueError("kde needs at least two distinct values")
    h = sd * n ** (-1.0 / 5.0)
    counts = value_histogram(df, column).limit(KDE_MAX_BINS + 1).toArrow()
    values, weight = (counts.column(i).to_numpy().astype(float) for i in (0, 1))
    if len(values) > KDE_MAX_BINS:
        bins = int(min(KDE_MAX_BINS, math.ceil(KDE_BINS * (hi - lo) / h)))
        width = (hi - lo) / bins
        at = (F.col(column) - F.lit(lo)) / F.lit(width)
        low = F.least(F.floor(at), F.lit(bins - 1))
        rows = (df.where(F.col(column).isNotNull()).select(low.alias("b"), (at - low).alias("f"))
                .groupBy("b").agg(F.count("*").alias("n"), F.sum("f").alias("f")).collect())  # at most a row a bin
        weight = np.zeros(bins + 1)
        for r in rows:
            weight[r["b"]] += r["n"] - r["f"]
            weight[r["b"] + 1] += r["f"]
        values = lo + np.arange(bins + 1) * width
    x = lo + np.arange(grid_points) * ((hi - lo) / (grid_points - 1))
    density = [float((weight * np.exp(-0.5 * ((p - values) / h) ** 2)).sum() / (math.sqrt(2 * math.pi) * h * n)) for p in x]
    return df.sparkSession.createDataFrame([(i, float(p), d) for i, (p, d) in enumerate(zip(x, density))],
                                           "point int, x double, density double")


def box_stats(df: DataFrame, value: str, by=None) -> DataFrame:
    """q1, median, q3 and whiskers at 1.5·IQR, per group (A19).  Grouped
    fences join back by key; global fences are three collected numbers."""
    from kestrel.operators.ranking import null_safe_join
    byl = [] if by is None else ([by] if isinstance(by, str) else list(by))
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], byl)
    qw = q.groupBy(*byl).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"))
    if not byl:
        r = qw.collect()[0]
        q1, med, q3 = r["q1"], r["median"], r["q3"]
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = F.col(value).between(F.lit(lo), F.lit(hi))
        return df.agg(F.lit(q1).alias("q1"), F.lit(med).alias("median"), F.lit(q3).alias("q3"),
                      F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
                      F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
                      F.count_if(F.col(value).isNotNull() & ~inside).alias("n_outliers"))
    qw = qw.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
           .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = null_safe_join(df.select(*byl, value), qw, byl)
    inside = F.col(value).between(F.col("lo_fence"), F.col("hi_fence"))
    w = j.groupBy(*byl).agg(F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
                            F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
                            F.count_if(F.col(value).isNotNull() & ~inside).alias("n_outliers"))
    return null_safe_join(qw, w, byl).drop("lo_fence", "hi_fence")


# ---------------------------------------------------------------- correlation
def pearson(a: str, b: str) -> F.Column:
    """Pearson's r over the rows where both columns have a value, as an aggregate;
    NULL where one of them does not vary (``corr`` divides by zero there)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = [F.stddev_pop(F.when(both, F.col(c).cast("double"))) for c in (a, b)]
    return F.try_divide(F.covar_pop(a, b), spread[0] * spread[1])


def _pair_sums(df: DataFrame, cols, centre: float | None = None) -> DataFrame:
    """``i, j`` and the sums of a Pearson correlation for every ordered pair of
    columns over the rows where both have a value: one pass and p x p numbers from
    each task, for any number of columns.  Values are taken from ``centre``, or from
    the columns' means, which take a pass of their own."""
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    means = [centre] * len(cols) if centre is not None else data.agg(
        *[F.avg(c).alias(c) for c in data.columns]).first()
    shift, p = np.array([0.0 if m is None else m for m in means]), len(cols)

    def run(batches):
        n, x1, x2, xy = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan) - shift
            there = (~np.isnan(x)).astype(float)
            x[there == 0] = 0
            n += there.T @ there
            x1 += x.T @ there
            x2 += (x * x).T @ there
            xy += x.T @ x
        i, j = np.indices((p, p))
        yield pd.DataFrame({k: v.ravel() for k, v in (("i", i), ("j", j), ("n", n), ("x", x1), ("y", x1.T),
                                                      ("xx", x2), ("yy", x2.T), ("xy", xy))})
    sums = "n double, x double, y double, xx double, yy double, xy double"
    parts = data.mapInPandas(run, f"i int, j int, {sums}")
    return parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in ("n", "x", "y", "xx", "yy", "xy")])


def _gram_correlations(df: DataFrame, cols, centre: float | None = None) -> DataFrame:
    """``i, j, corr`` by :func:`_pair_sums`; NULL where a column does not vary."""
    def spread(one, two):
        square = F.col("n") * F.col(two) - F.col(one) * F.col(one)
        return F.when(square > 1e-12 * F.col("n") * F.col(two), F.sqrt(square))
    corr = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / (spread("x", "xx") * spread("y", "yy"))
    return _pair_sums(df, cols, centre).select("i", "j", corr.alias("corr"))


def _pair_ranks(df: DataFrame, columns: list[int], p: int) -> DataFrame:
    """``column, value, ranks`` of ``df(x0, x1, ...)``: the rank of each value of a column
    among the rows that know column j too, as entry j, less the mean of those ranks."""
    known = [f"n{j}" for j in range(p)]
    items = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"x{i}").alias("value")) for i in columns])
    long = df.select(*[F.col(f"x{j}").isNotNull().cast("long").alias(f"n{j}") for j in range(p)], F.explode(items).alias("v"))
    long = long.select("v.*", *known).where(F.col("value").isNotNull())
    hist = long.groupBy("column", "value").agg(*[F.sum(n).cast("double").alias(n) for n in known]).checkpoint()
    hist = assign_buckets(hist, "value", hist, bucket_by="column")
    lower = Window.partitionBy("column").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = hist.groupBy("column", "_b").agg(*[F.sum(n).alias(n) for n in known])  # a row for each bucket
    totals = totals.select("column", "_b", *[x for n in known for x in (
        F.coalesce(F.sum(n).over(lower), F.lit(0.0)).alias(f"b{n}"), F.sum(n).over(Window.partitionBy("column")).alias(f"t{n}"))])
    inside = Window.partitionBy("column", "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0.0)).alias(f"i{n}") for n in known])
    ranks = F.array(*[F.col(f"b{n}") + F.col(f"i{n}") + (F.col(n) - F.col(f"t{n}")) / 2.0 for n in known])
    return hist.join(totals, ["column", "_b"]).select("column", "value", ranks.alias("ranks")).checkpoint()


def _ranked_pairs(df: DataFrame, cols, pairs) -> DataFrame:
    """``i, j, corr``: Spearman's rho of each pair of columns, ranked over the rows where both
    have a value.  A column's values are ranked once for all its pairs; a row gets its ranks
    by value, and products are summed by task."""
    p, used = len(cols), sorted({i for i, _ in pairs})
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    ranks = _pair_ranks(rows, used, p)
    sizes = {r["column"]: r["count"] for r in ranks.groupBy("column").count().collect()}
    for i in used:
        own = ranks.where(F.col("column") == i).select(F.col("value").alias("_v"), F.col("ranks").alias(f"r{i}"))
        if sizes.get(i, 0) * max(p, 10) <= 10 * BROADCAST_VALUES:
            rows = rows.join(F.broadcast(own), F.col(f"x{i}") == F.col("_v"), "left").drop("_v")
        else:  # rows without a value match nothing, and are dealt evenly
            deal = F.when(F.col(f"x{i}").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(65_536))).otherwise(F.lit(0))
            rows = (rows.withColumn("_d", deal).join(own.withColumn("_o", F.lit(0).cast("long")),
                                                     (F.col(f"x{i}") == F.col("_v")) & (F.col("_d") == F.col("_o")), "left")
                    .drop("_v", "_d", "_o"))
    wanted = np.array(pairs)

    def run(batches):
        xy, xx = np.zeros((p, p)), np.zeros((p, p))
        for whole in batches:
            step = max(1, 2_000_000 // (p * p))
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                a, there = np.zeros((batch.num_rows, p, p)), np.zeros((batch.num_rows, p))
                for k, i in enumerate(used):
                    column = batch.column(k)
                    here = column.is_valid().to_numpy(zero_copy_only=False)
                    there[here, i] = 1
                    a[here, i] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                a *= there[:, None, :]
                xy += np.einsum("nij,nji->ij", a, a)
                xx += np.einsum("nij,nij->ij", a, a)
        i, j = wanted.T
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i.astype(np.int32), j.astype(np.int32), xy[i, j], xx[i, j], xx[j, i])],
                                         names=["i", "j", "xy", "xx", "yy"])
    schema = "i int, j int, xy double, xx double, yy double"
    none = df.sparkSession.createDataFrame([(i, j, 0.0, 0.0, 0.0) for i, j in pairs], schema)  # of an empty table
    parts = rows.select(*[f"r{i}" for i in used]).mapInArrow(run, schema).unionByName(none)
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
    return sums.select("i", "j", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("corr"))


def correlation_matrix(df: DataFrame, columns, method: str = "pearson") -> DataFrame:
    """Long (a, b, corr, i, j) for every ordered pair.

    Each pair uses the rows where both columns have a value, whatever the other
    columns hold and however many there are.  Spearman ranks columns without
    NULLs once; a pair with NULLs is ranked on its own rows.
    """
    cols = list(columns)
    if method == "spearman":
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"h{i}") for i, c in enumerate(cols)],
                     F.count(F.lit(1)).alias("n")).first()
        whole = [i for i in range(len(cols)) if not row[i]]
        pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if row[i] or row[j]]
        parts = []
        if whole:
            at = F.array(*[F.lit(i) for i in whole])
            ranks = rank_columns(df, [cols[i] for i in whole])
            middle = (row["n"] + 1) / 2.0  # the mean of the ranks
            parts.append(_gram_correlations(ranks, [cols[i] for i in whole], middle).select(
                F.element_at(at, F.col("i") + 1).alias("i"), F.element_at(at, F.col("j") + 1).alias("j"), "corr"))
        if pairs:
            parts.append(_ranked_pairs(df, cols, pairs))
        out = reduce(DataFrame.unionByName, parts)
    else:
        out = _gram_correlations(df, cols)
    arr = F.array(*[F.lit(c) for c in cols])
    return out.select(F.element_at(arr, F.col("i") + 1).alias("a"), F.element_at(arr, F.col("j") + 1).alias("b"),
                      "corr", "i", "j")


#: Distinct values of a column whose ranks are broadcast.
BROADCAST_VALUES = 100_000


def rank_columns(df: DataFrame, columns, row_id: str | None = None) -> DataFrame:
    """Replace each column by its average rank (W6); NULL stays.

    The value histograms of all columns come from one combining aggregate.  A column of at
    most ``BROADCAST_VALUES`` distinct values gets its ranks from its broadcast histogram.
    For any other the rows are dealt by value range, once: the rank is the number of rows in
    lower ranges, plus the place in the own range.  Values that fill a range of their own
    have known ranks, and their rows are dealt evenly.
    """
    cols = list(columns)
    out = df.select(*([row_id] if row_id else []), *cols)
    hist = value_histogram(to_long(df, cols), "value", "column")
    ranks = ranked_histogram(None, "value", by="column", hist=hist, bucket_by="column").select(
        "column", "value", "n", "before", "total", "rank").checkpoint()
    sizes = {r["column"]: r["count"] for r in ranks.groupBy("column").count().collect()}
    for i, c in enumerate(cols):
        own = ranks.where(F.col("column") == c)
        if sizes.get(c, 0) <= BROADCAST_VALUES:
            out = out.join(F.broadcast(own.select(F.col("value").alias(c), F.col("rank").alias(f"_r{i}"))), c, "left")
        else:
            out = _rank_by_ranges(out, c, own, f"_r{i}")
    return out.select(*([row_id] if row_id else []), *[F.col(f"_r{i}").alias(c) for i, c in enumerate(cols)])


def _rank_by_ranges(df: DataFrame, column: str, ranks: DataFrame, out: str) -> DataFrame:
    """``df`` with the rank of ``column`` from ``ranks(value, n, before, total, rank)``."""
    spark = df.sparkSession
    ranges = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a value with more rows than a range has: its rank is known, at most ``ranges`` of them
    hot = ranks.where(F.col("n") * ranges > F.col("total")).select(F.col("value").alias(column), F.col("rank").alias("_hot"))
    placed = ranks.withColumn("_g", F.floor(F.col("before") * ranges / F.col("total")).cast("int"))
    edges = placed.groupBy("_g").agg(F.min("value").alias("v"), F.min("before").alias("b")).orderBy("v").collect()  # a row a range
    lower = [float(r["v"]) for r in edges]
    starts = spark.createDataFrame([(i, float(r["b"])) for i, r in enumerate(edges)], "_g int, _start double")
    spread = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(ranges)).cast("int")
    rows = _in_ranges(df.join(F.broadcast(hot), column, "left"), column, lower)
    rows = rows.withColumn("_g", F.when(F.col(column).isNull() | F.col("_hot").isNotNull(), spread).otherwise(F.col("_g")))
    before = F.rank().over(Window.partitionBy("_g").orderBy(column)) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy("_g", column))
    hot_before = F.col("_start")  # rows of hot values are not in the window: they are added below
    rows = rows.withColumn("_local", before).withColumn("_ties", ties).join(F.broadcast(starts), "_g", "left")
    # rows of hot values inside a range that are smaller than the value
    shift = ranks.where(F.col("n") * ranges > F.col("total")).select(F.col("value").alias("_hv"), F.col("n").alias("_hn")).collect()
    inside = F.lit(0.0)
    for r in shift:  # at most ``ranges`` values
        v, n, k = float(r["_hv"]), float(r["_hn"]), bisect_right(lower, float(r["_hv"])) - 1
        inside = inside + F.when((F.col("_g") == k) & (F.col(column) > v), n).otherwise(0.0)
    rank = hot_before + inside + F.col("_local") + (F.col("_ties") + 1) / 2.0
    value = F.when(F.col(column).isNull(), F.lit(None)).otherwise(F.coalesce("_hot", rank))
    return rows.withColumn(out, value).drop("_hot", "_g", "_local", "_ties", "_start")


def _in_ranges(df: DataFrame, column: str, lower: list[float]) -> DataFrame:
    """``df`` with ``_g``: the last of the rising lower edges that is not above the value, by
    a CASE tree, or by MLlib's Bucketizer (a binary search) for many edges."""
    def find(at: int, end: int) -> F.Column:
        if end - at <= 1:
            return F.lit(at)
        mid = (at + end) // 2
        return F.when(F.col(column) < F.lit(lower[mid]), find(at, mid)).otherwise(find(mid, end))
    if len(lower) <= CASE_LIMIT:
        return df.withColumn("_g", find(0, len(lower)))
    from pyspark.ml.feature import Bucketizer
    splits = [float("-inf"), *lower[1:], float("inf")]
    out = Bucketizer(splits=splits, inputCol="_gv", outputCol="_gd", handleInvalid="keep").transform(
        df.withColumn("_gv", F.col(column).cast("double")))
    return out.withColumn("_g", F.col("_gd").cast("int")).drop("_gv", "_gd")


def lower_triangle(corr_long: DataFrame) -> DataFrame:
    """Keep i >= j of a long matrix."""
    return corr_long.where(F.col("i") >= F.col("j"))


def target_correlations(df: DataFrame, target: str, columns=None, top: int | None = 15) -> DataFrame:
    """(feature, corr, abs_corr) against the target, by |corr| desc."""
    cols = [c for c in (columns or numeric_columns(df)) if c != target]
    row = df.agg(*[pearson(c, target).alias(c) for c in cols])
    out = (row.unpivot([], cols, "feature", "corr")
              .withColumn("abs_corr", F.abs("corr"))
              .orderBy(F.desc_nulls_last("abs_corr"), "feature"))
    return out.limit(top) if top else out


def simple_regression(df: DataFrame, y: str, x: str, by=None) -> DataFrame:
    """slope, intercept, r² of y on x."""
    byl = [] if by is None else ([by] if isinstance(by, str) else list(by))
    return df.groupBy(*byl).agg(F.regr_slope(y, x).alias("slope"),
                                F.regr_intercept(y, x).alias("intercept"),
                                F.regr_r2(y, x).alias("r2"),
                                F.regr_count(y, x).alias("n"))


def positive_rate(df: DataFrame, label: str, by=None) -> DataFrame:
    """n and share of label = 1."""
    byl = [] if by is None else ([by] if isinstance(by, str) else list(by))
    return df.groupBy(*byl).agg(F.count(F.lit(1)).alias("n"),
                                F.avg(F.col(label).cast("double")).alias("positive_rate"))


# ---------------------------------------------------------------- contingency
def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed cells (a, b, n) with both keys non-NULL."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
              .groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))


def top_joint_counts(df: DataFrame, a: str, b: str, top_a: int, top_b: int) -> DataFrame:
    """Joint counts restricted to the top-N levels of a and top-M of b (both
    ranked on the whole frame), with the share of the restricted total (A16)."""
    ta, tb = top_k_levels(df, a, top_a), top_k_levels(df, b, top_b)
    sub = keep_levels(keep_levels(df, a, ta), b, tb)
    ct = contingency(sub, a, b)
    return ct.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def quartile_bins(df: DataFrame, column: str, q: int = 4, out: str = "bin") -> DataFrame:
    """``qcut``: q equal-frequency bins, right-closed, lowest edge included.
    Edges are exact quantiles; duplicate edges raise like pandas."""
    probs = [i / q for i in range(q + 1)]
    edges_df = exact_quantiles(df, column, probs).orderBy("prob")
    edges = [r["quantile"] for r in edges_df.collect()]  # q + 1 numbers
    if len(set(edges)) != len(edges):
        raise ValueError(f"Bin edges must be unique: {edges}")
    expr = F.when(F.col(column).isNull() | (F.col(column) < edges[0]) | (F.col(column) > edges[q]),
                  F.lit(None).cast("int")).otherwise(
        F.coalesce(*[F.when(F.col(column) <= edges[i], F.lit(i)) for i in range(1, q + 1)]))
    return df.withColumn(out, expr)
