"""Confirmatory statistics.

Every test is reduced to aggregates first — per-group moments, a value
histogram, a contingency table — and only the resulting handful of numbers
goes through a p-value function (pandas UDF over result rows).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions import distributions as dist
from kestrel.operators.aggregates import _ranked_pairs, pearson, rank_columns, to_long
from kestrel.operators.missing import subsample
from kestrel.operators.ranking import (assign_buckets, exact_median, exact_quantiles, null_safe_join, ranked_histogram,
                                       value_histogram)


def _list(by):
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


# ---------------------------------------------------------------- T1 normality
def shapiro_by_group(df: DataFrame, value: str, by, row_id: str, max_n: int = 5000,
                     seed="411") -> DataFrame:
    """Shapiro-Wilk (W, p) per group on at most ``max_n`` seeded rows.

    The sample is drawn by :func:`subsample` (exact, distributed), so each
    group handed to ``applyInPandas`` is bounded by ``max_n`` rows.
    """
    byl = _list(by)
    s = subsample(df.where(F.col(value).isNotNull()).select(*byl, row_id, value), row_id, max_n,
                  seed=seed, by=byl)
    schema = T.StructType([*[df.schema[b] for b in byl],
                           T.StructField("n", T.LongType()), T.StructField("W", T.DoubleType()),
                           T.StructField("p_value", T.DoubleType())])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = dist.shapiro_wilk(pdf[value].to_numpy(dtype=float))
        row = {b: [pdf[b].iloc[0]] for b in byl}
        row.update({"n": [len(pdf)], "W": [w], "p_value": [p]})
        return pd.DataFrame(row)

    if not byl:
        s = s.withColumn("_all", F.lit(0))
        return s.groupBy("_all").applyInPandas(
            lambda pdf: fn(pdf), schema=schema).select("n", "W", "p_value")
    return s.groupBy(*byl).applyInPandas(fn, schema=schema)


def shapiro_columns(df: DataFrame, columns, row_id: str, max_n: int = 5000, seed="411") -> DataFrame:
    """(column, n, W, p_value) for several columns at once (T1 over an unpivot)."""
    long = to_long(df, columns, id_cols=[row_id]).where(F.col("value").isNotNull())
    return shapiro_by_group(long, "value", "column", row_id, max_n, seed)


def jarque_bera(df: DataFrame, columns) -> DataFrame:
    """Whole-table normality companion: JB = n/6 (S² + K²/4), χ²(2) p."""
    long = to_long(df, columns).where(F.col("value").isNotNull())
    m = long.groupBy("column").agg(F.count("value").alias("n"), F.skewness("value").alias("s"),
                                   F.kurtosis("value").alias("k"))
    jb = F.col("n") / 6.0 * (F.col("s") ** 2 + F.col("k") ** 2 / 4.0)
    return m.select("column", "n", jb.alias("jb"), dist.chi2_sf_udf(jb, F.lit(2.0)).alias("p_value"))


# ---------------------------------------------------------------- T2-T4 correlations
def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """r and two-sided p on pairwise-complete rows."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = d.agg(pearson(x, y).alias("corr"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("p_value", dist.corr_p_udf("corr", F.col("n").cast("double")))


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """ρ (Pearson on average ranks) and two-sided t-approximation p."""
    d = df.select(F.col(x).cast("double").alias("_rx"), F.col(y).cast("double").alias("_ry"))
    d = d.where(F.col("_rx").isNotNull() & F.col("_ry").isNotNull())
    r = rank_columns(d, ["_rx", "_ry"]).agg(pearson("_rx", "_ry").alias("corr"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("p_value", dist.corr_p_udf("corr", F.col("n").cast("double")))


def _rank_correlations(df: DataFrame, y: str, columns) -> list[float | None]:
    """Spearman's rho of ``y`` and each of ``columns``, all without NULLs.

    The columns' ranks are added up by value of ``y`` (one combining aggregate), and ``y``
    is ranked among its values, so the rows are not sorted or joined for its ranks.
    """
    middle = (df.count() + 1) / 2.0  # the mean of the ranks
    ranks = rank_columns(df, columns, row_id=y)
    own = [F.col(c) - middle for c in columns]
    h = ranks.groupBy(y).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(r).alias(f"s{i}") for i, r in enumerate(own)],
                             *[F.sum(r * r).alias(f"q{i}") for i, r in enumerate(own)]).checkpoint()
    h = assign_buckets(h, y, h)
    inside = Window.partitionBy("_b").orderBy(y).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = h.groupBy("_b").agg(F.sum("n").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(lower), F.lit(0.0)).alias("_start"))
    h = h.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0.0))).join(F.broadcast(starts), "_b")
    theirs = F.col("_start") + F.col("_before") + (F.col("n") + 1) / 2.0 - middle
    row = h.agg(F.sum(F.col("n") * theirs * theirs).alias("y"), *[x for i in range(len(columns)) for x in (
        F.sum(F.col(f"s{i}") * theirs).alias(f"s{i}"), F.sum(f"q{i}").alias(f"q{i}"))]).first()
    return [row[f"s{i}"] / math.sqrt(row[f"q{i}"] * row["y"]) if row["y"] and row[f"q{i}"] else None for i in range(len(columns))]


def target_spearman(df: DataFrame, target: str, columns) -> DataFrame:
    """``column, spearman, pearson, n``: the correlations of each column with the target over
    the rows where both have a value; a column without such rows is left out.

    The target and the columns without NULLs are ranked once; where one of a pair has
    NULLs, the pair is ranked on its own rows.
    """
    cols = list(dict.fromkeys(columns))
    names, y = [f"x{i}" for i in range(len(cols))], f"x{len(cols)}"
    d = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip([*cols, target], [*names, y])])
    both = {c: F.col(c).isNotNull() & F.col(y).isNotNull() for c in names}
    row = d.agg(F.count_if(F.col(y).isNull()).alias("_y"), *[x for c in names for x in (
        F.count_if(F.col(c).isNull()).alias(f"_h{c}"), F.count_if(both[c]).alias(f"_n{c}"), pearson(c, y).alias(f"_p{c}"))]).first()
    whole = [c for c in names if not row["_y"] and not row[f"_h{c}"]]
    holed = [i for i, c in enumerate(names) if c not in whole]
    rho = {}
    if whole:
        rho = dict(zip(whole, _rank_correlations(d, y, whole)))
    if holed:
        pairs = [p for i in holed for p in ((i, len(cols)), (len(cols), i))]
        rho |= {names[r["i"]]: r["corr"] for r in _ranked_pairs(d, [*names, y], pairs).where(F.col("i") < F.col("j")).collect()}
    rows = [(c, rho.get(n), row[f"_p{n}"], row[f"_n{n}"]) for c, n in zip(cols, names) if row[f"_n{n}"]]
    return df.sparkSession.createDataFrame(rows, "column string, spearman double, pearson double, n long")


def correlation_tests(df: DataFrame, target: str, columns, row_id: str, alpha: float = 0.05,
                      max_n: int = 5000) -> DataFrame:
    """Per feature: Pearson if both it and the target pass Shapiro (p > alpha),
    else Spearman; (feature, method, corr, p_value, normality_p_feature,
    abs_corr) sorted by |corr| (T4)."""
    cols = [c for c in columns if c != target]
    norm = shapiro_columns(df, [*cols, target], row_id, max_n)
    npv = {r["column"]: r["p_value"] for r in norm.collect()}  # one row per column
    ty = npv.get(target)
    stats = target_spearman(df, target, cols)
    pear = {c for c in cols if npv.get(c) is not None and ty is not None and not math.isnan(npv[c])
            and not math.isnan(ty) and npv[c] > alpha and ty > alpha}
    use_p = F.col("column").isin(*pear) if pear else F.lit(False)
    nmap = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(npv.get(c)).cast("double"))])
    out = stats.select(F.col("column").alias("feature"),
                       F.when(use_p, "Pearson").otherwise("Spearman").alias("method"),
                       F.when(use_p, F.col("pearson")).otherwise(F.col("spearman")).alias("corr"),
                       "n", nmap[F.col("column")].alias("normality_p_feature"))
    out = out.withColumn("p_value", dist.corr_p_udf("corr", F.col("n").cast("double")))
    return out.withColumn("abs_corr", F.abs("corr")).orderBy(F.desc("abs_corr")).drop("n")


# ---------------------------------------------------------------- T5-T7, T10-T11 ANOVA family
def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    return (df.where(F.col(value).isNotNull())
              .groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                  F.var_samp(value).alias("var")))


def one_way_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """F, p, eta² (T6, T7) from per-group (n, mean, var) — one aggregate."""
    return _anova_of(group_moments(df, value, group))


def _anova_of(moments: DataFrame) -> DataFrame:
    """:func:`one_way_anova` of ``moments(n, mean, var)``, a row for each group."""
    g = moments.fillna({"var": 0.0})
    tot = g.agg(F.sum("n").alias("nn"), F.count(F.lit(1)).alias("k"),
                (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")).collect()[0]  # one row
    nn, k, grand = tot["nn"] or 0, tot["k"], tot["grand"]
    s = g.agg(F.sum(F.col("n") * (F.col("mean") - F.lit(grand)) ** 2).alias("ssb"),
              F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"))
    # NULL for one group, for as many groups as rows, and without variance inside groups
    f = F.try_divide(F.try_divide(F.col("ssb"), F.lit(float(k - 1))), F.try_divide(F.col("ssw"), F.lit(float(nn - k))))
    out = s.select(f.alias("F"), F.lit(float(k - 1)).alias("df_between"),
                   F.lit(float(nn - k)).alias("df_within"),
                   F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta2"),
                   F.lit(nn).cast("bigint").alias("N"), F.lit(k).cast("bigint").alias("k"))
    return out.withColumn("p_value", dist.f_sf_udf("F", "df_between", "df_within"))


def levene_median(df: DataFrame, value: str, group: str, hist: DataFrame | None = None) -> DataFrame:
    """Brown-Forsythe Levene: ANOVA on |x - group median| (T5).  The median is
    the exact distributed one; the join back is an equi-join on the group.  With
    the value histogram ``hist(group, value, n)`` at hand the rows are not read."""
    if hist is None:
        d = df.where(F.col(value).isNotNull()).select(group, value)
        med = exact_median(d, value, group, name="_med")
        z = null_safe_join(d, med, [group]).withColumn("_z", F.abs(F.col(value) - F.col("_med")))
        a = one_way_anova(z, "_z", group)
    else:
        rh = ranked_histogram(None, value, group, hist=hist)
        med = exact_quantiles(None, value, [0.5], group, rh=rh).select(group, F.col("quantile").alias("_med"))
        z = null_safe_join(hist, med.checkpoint(), [group]).withColumn("_z", F.abs(F.col(value) - F.col("_med")))
        mean = F.sum(F.col("n") * F.col("_z")) / F.sum("n")
        # the squares are taken from the mean, which needs a second pass over the histogram
        z = null_safe_join(z, z.groupBy(group).agg(mean.alias("_mean")).checkpoint(), [group])
        square = F.sum(F.col("n") * (F.col("_z") - F.col("_mean")) ** 2)
        g = z.groupBy(group).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"),
                                 F.try_divide(square, F.sum("n") - 1).alias("var"))
        a = _anova_of(g.checkpoint())  # a row for each group
    return a.select(F.col("F").alias("W"), F.col("p_value"), "df_between", "df_within")


def tukey_hsd(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """All-pairs Tukey HSD from group moments (T11): (group1, group2, meandiff,
    p_adj, lower, upper, reject), group1 < group2."""
    g = group_moments(df, value, group).fillna({"var": 0.0})
    rows = g.collect()  # one row per group
    k = len(rows)
    N = sum(r["n"] for r in rows)
    mse = sum((r["n"] - 1) * r["var"] for r in rows) / (N - k)
    qcrit = dist.studentized_range_ppf(1 - alpha, k, N - k)
    a, b = g.alias("a"), g.alias("b")
    pairs = a.join(b, F.col(f"a.{group}") < F.col(f"b.{group}"))  # k x k group table only
    diff = F.col("b.mean") - F.col("a.mean")
    se = F.sqrt(F.lit(mse / 2.0) * (1.0 / F.col("a.n") + 1.0 / F.col("b.n")))
    out = pairs.select(F.col(f"a.{group}").alias("group1"), F.col(f"b.{group}").alias("group2"),
                       diff.alias("meandiff"), se.alias("_se"))
    out = out.withColumn("p_adj", dist.tukey_p_udf(F.abs("meandiff") / F.col("_se"), F.lit(float(k)),
                                                   F.lit(float(N - k))))
    return (out.withColumn("lower", F.col("meandiff") - qcrit * F.col("_se"))
               .withColumn("upper", F.col("meandiff") + qcrit * F.col("_se"))
               .withColumn("reject", F.col("p_adj") < alpha).drop("_se"))


# ---------------------------------------------------------------- T8-T9 Kruskal-Wallis
def kruskal_wallis(df: DataFrame, value: str, group: str, hist: DataFrame | None = None) -> DataFrame:
    """H with tie correction, chi²(k-1) p, epsilon².

    Ranks come from the global ranked histogram of the value; each group's
    rank sum is Σ n_g(v)·rank(v) over the (group, value) histogram, which may be
    passed as ``hist(group, value, n)``; the rows are not read then.
    """
    d = None
    if hist is None:
        d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    gh = value_histogram(d, value, group) if hist is None else hist.where(F.col(group).isNotNull())
    rh = ranked_histogram(d, value, hist=gh.groupBy(value).agg(F.sum("n").alias("n")))
    ties = rh.agg(F.sum(F.col("n") ** 3 - F.col("n")).alias("tie"), F.sum("n").alias("N"))
    rs = (gh.join(rh.select(value, "rank"), value)
            .groupBy(group).agg(F.sum(F.col("n") * F.col("rank")).alias("R"), F.sum("n").alias("ng")))
    tr = ties.collect()[0]  # one row
    tie, nn = tr["tie"] or 0.0, tr["N"] or 0.0
    s = rs.agg(F.sum(F.col("R") ** 2 / F.col("ng")).alias("s"), F.count(F.lit(1)).alias("k"))
    N = F.lit(float(nn))
    # NULL without two different values
    h0 = F.try_divide(F.lit(12.0), N * (N + 1)) * F.col("s") - 3 * (N + 1)
    h = F.try_divide(h0, 1 - F.try_divide(F.lit(tie), N ** 3 - N))
    eps = F.when(N > F.col("k"), F.try_divide(h - F.col("k") + 1, N - F.col("k")))
    out = s.select(h.alias("H"), (F.col("k") - 1).cast("double").alias("dof"), N.cast("bigint").alias("N"),
                   F.col("k").cast("bigint").alias("k"), eps.alias("epsilon2"))
    return out.withColumn("p_value", dist.chi2_sf_udf("H", "dof"))


# ---------------------------------------------------------------- T12-T13 post-hoc
def group_pairs(levels: DataFrame, group: str) -> DataFrame:
    """All i < j pairs of a bounded level list (J5); ``pos`` orders the levels."""
    a = levels.select(F.col(group).alias("group_1"), F.col("pos").alias("pos_1"))
    b = levels.select(F.col(group).alias("group_2"), F.col("pos").alias("pos_2"))
    return a.join(b, F.col("pos_1") < F.col("pos_2"))


def mann_whitney_pairs(df: DataFrame, value: str, group: str, levels: DataFrame,
                       buckets: int | None = None, hist: DataFrame | None = None) -> DataFrame:
    """Two-sided Mann-Whitney U for every pair of the given levels.

    ``levels`` (group, pos) is bounded (top-k).  The value histogram is
    pivoted once into k count columns (one combining aggregate), running
    counts below each value come from windows over value buckets plus tiny
    per-bucket offsets (as in the ranked histogram), and one aggregate gives,
    for every pair, U_1 = Σ_v n_1(v)·(N_2(<v) + n_2(v)/2) and the tie term
    Σ_v (t³ − t) with t = n_1(v) + n_2(v).  p uses the tie-corrected normal
    approximation with continuity correction.  The histogram may be passed as
    ``hist(group, value, n)``; the rows are not read then.
    """
    lv = levels.orderBy("pos").collect()  # k rows
    names = [r[group] for r in lv]
    k = len(names)
    d = (df if hist is None else hist).where(F.col(value).isNotNull() & F.col(group).isin(*names))
    h = d.groupBy(value).pivot(group, names).agg(F.count(F.lit(1)) if hist is None else F.sum("n"))
    h = h.select(value, *[F.coalesce(F.col(f"`{g}`"), F.lit(0)).cast("double").alias(f"n{i}")
                          for i, g in enumerate(names)])
    h = assign_buckets(h, value, d, buckets)
    w_local = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = h.withColumns({f"l{i}": F.coalesce(F.sum(f"n{i}").over(w_local), F.lit(0.0)) for i in range(k)})
    tot = h.groupBy("_b").agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(k)])
    w_off = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    tot = tot.select("_b", *[F.coalesce(F.sum(f"t{i}").over(w_off), F.lit(0.0)).alias(f"o{i}") for i in range(k)])
    j = local.join(F.broadcast(tot), "_b")  # tot: one row per bucket
    pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
    aggs = []
    for a, b in pairs:
        below_b = F.col(f"o{b}") + F.col(f"l{b}")
        t = F.col(f"n{a}") + F.col(f"n{b}")
        aggs.append(F.sum(F.col(f"n{a}") * (below_b + F.col(f"n{b}") / 2.0)).alias(f"u_{a}_{b}"))
        aggs.append(F.sum(t * t * t - t).alias(f"tie_{a}_{b}"))
    aggs += [F.sum(f"n{i}").alias(f"N{i}") for i in range(k)]
    row = j.agg(*aggs).collect()[0]  # 2·k(k-1)/2 + k numbers
    out = []
    for a, b in pairs:
        n1, n2 = row[f"N{a}"], row[f"N{b}"]
        u1, tie = row[f"u_{a}_{b}"], row[f"tie_{a}_{b}"]
        nn = n1 + n2
        sigma = math.sqrt(n1 * n2 / 12.0 * ((nn + 1) - tie / (nn * (nn - 1)))) if nn > 1 else 0.0
        z = (abs(u1 - n1 * n2 / 2.0) - 0.5) / sigma if sigma > 0 else 0.0
        p = min(1.0, 2.0 * dist.norm_sf(max(z, 0.0))) if sigma > 0 else 1.0
        out.append((names[a], names[b], float(u1), float(p)))
    sch = T.StructType([T.StructField("group_1", df.schema[group].dataType),
                        T.StructField("group_2", df.schema[group].dataType),
                        T.StructField("U_stat", T.DoubleType()), T.StructField("p_value_raw", T.DoubleType())])
    return df.sparkSession.createDataFrame(out, sch)


def holm_adjust(df: DataFrame, p_col: str = "p_value_raw", out: str = "p_value_holm",
                order_tiebreak: str | None = None) -> DataFrame:
    """Holm step-down: (m - i)·p_(i), running max, clipped to 1.
    For result tables (one row per comparison)."""
    w = Window.orderBy(p_col, *([order_tiebreak] if order_tiebreak else []))
    wc = w.rowsBetween(Window.unboundedPreceding, 0)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_m", m)
    d = d.withColumn("_a", (F.col("_m") - F.col("_i")) * F.col(p_col))
    return d.withColumn(out, F.least(F.lit(1.0), F.max("_a").over(wc))).drop("_i", "_m", "_a")


# ---------------------------------------------------------------- T14-T16 contingency
def chi2_independence(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """χ², dof, p and bias-corrected Cramér's V from the observed cells.

    Without Yates' correction χ² = Σ O²/E − N over *observed* cells, so zero
    cells never have to be materialised.  With dof = 1 (2x2) Yates' correction
    needs all four cells, which are then built from the 2 x 2 margins.
    """
    cells = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
               .groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("O")))
    ra = cells.groupBy(a).agg(F.sum("O").alias("Ra"))
    cb = cells.groupBy(b).agg(F.sum("O").alias("Cb"))
    tot = cells.agg(F.sum("O").alias("N"), F.countDistinct(a).alias("r"), F.countDistinct(b).alias("c")).collect()[0]
    N, r, c = tot["N"] or 0.0, tot["r"], tot["c"]
    dof = (r - 1) * (c - 1)
    spark = df.sparkSession
    if N == 0:
        return spark.createDataFrame([(None, 0, None, None, 0.0)], "chi2 double, dof int, p_value double, cramers_v double, n double")
    e = cells.join(ra, a).join(cb, b).withColumn("E", F.col("Ra") * F.col("Cb") / N)
    if yates and dof == 1:
        # 2 x 2: the four cells and margins are eight numbers; zero cells count too
        obs = {(r[a], r[b]): r["O"] for r in cells.collect()}
        rows_a = {r[a]: r["Ra"] for r in ra.collect()}
        cols_b = {r[b]: r["Cb"] for r in cb.collect()}
        chi2 = 0.0
        for ka, va in rows_a.items():
            for kb, vb in cols_b.items():
                e_ = va * vb / N
                d_ = abs(obs.get((ka, kb), 0.0) - e_)
                chi2 += (d_ - min(0.5, d_)) ** 2 / e_
    else:
        chi2 = e.agg(F.sum(F.col("O") ** 2 / F.col("E"))).collect()[0][0] - N
    p = dist.chi2_sf(chi2, dof) if dof > 0 else 1.0
    found = spark.createDataFrame([(float(chi2), int(dof), float(p), float(N), float(r), float(c))],
                                  "chi2 double, dof int, p_value double, n double, _r double, _c double")
    return found.select("chi2", "dof", "p_value", association("chi2", "n", "_r", "_c").alias("cramers_v"), "n")


def association(chi2: str, n: str, *levels: str) -> F.Column:
    """Cramér's V corrected for bias (Bergsma, 2013) as a column (T15): phi squared
    less its expectation under independence, over the smaller corrected number of
    levels less one.  NULL for one row, or for a single level."""
    free = F.col(n) - 1
    first, second = (F.col(x) - 1 for x in levels)
    excess = F.try_divide(F.col(chi2), F.col(n)) - F.try_divide(first * second, free)
    room = F.least(*[x - F.try_divide(x * x, free) for x in (first, second)])
    return F.when(room > 0, F.sqrt(F.try_divide(F.greatest(excess, F.lit(0.0)), room)))


def odds_ratio_2x2(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n00+.5)(n11+.5)/((n01+.5)(n10+.5)) with levels in sorted order.
    Only defined for a 2x2 table; other shapes give NULL."""
    cells = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
               .groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))
    la, lb = (cells.select(c).distinct().orderBy(c).limit(3).collect() for c in (a, b))  # a third level ends it
    if len(la) != 2 or len(lb) != 2:
        return df.sparkSession.createDataFrame([(None,)], "odds_ratio double")
    a0, a1, b0, b1 = la[0][0], la[1][0], lb[0][0], lb[1][0]

    def cell(x, y):
        return F.sum(F.when((F.col(a) == x) & (F.col(b) == y), F.col("n")).otherwise(0)) + 0.5
    return cells.agg(((cell(a0, b0) * cell(a1, b1)) / (cell(a0, b1) * cell(a1, b0))).alias("odds_ratio"))


def choose_pair(columns_kinds, first: str = "track_genre", second: str = "popularity_bin"):
    """Which two categoricals to cross (T17): the preferred pair when both
    exist, else the first two categorical columns, else None."""
    names = [c for c, _ in columns_kinds]
    if first in names and second in names:
        return first, second
    cats = [c for c, k in columns_kinds if k in ("object", "category")]
    return (cats[0], cats[1]) if len(cats) >= 2 else None


def assumptions_hold(normality: DataFrame, variances: DataFrame, alpha: float = 0.05) -> bool:
    """Whether no group departs from normality and the variances agree, from the
    result rows of both tests (``p_value``); decides for ANOVA (T10).  A group too
    small to test does not count; a variance test without a value speaks against."""
    r = (normality.select(F.lit(0).alias("part"), (F.col("p_value") <= alpha).alias("broken"))
         .unionByName(variances.select(F.lit(1).alias("part"), (~F.coalesce(
             (F.col("p_value") > alpha) & ~F.isnan("p_value"), F.lit(False))).alias("broken")))
         .agg(F.count_if("broken").alias("n")).first())
    return r["n"] == 0


#: Groups of a pairwise comparison at most; the pairs grow with their square.
MAX_GROUPS = 200


def compare_groups(df: DataFrame, value: str, group: str, row_id: str, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The test that the assumptions ask for, and its post-hoc pairs.

    Groups that look normal with equal variances: ANOVA and Tukey's pairs; otherwise
    Kruskal-Wallis and pairwise Mann-Whitney tests with Holm's correction.  The first
    frame is ``test, statistic, p_value, effect`` (eta or epsilon squared), the second
    ``test, group1, group2, statistic, p_adj, reject`` (mean difference or U).
    """
    # one histogram serves the variance test, the rank test and the pairs
    hist = value_histogram(df, value, group).checkpoint()
    if assumptions_hold(shapiro_by_group(df, value, group, row_id), levene_median(df, value, group, hist), alpha):
        name, pairs_name = "anova", "tukey"
        whole = one_way_anova(df, value, group).select(F.col("F").alias("statistic"), "p_value", F.col("eta2").alias("effect"))
        pairs = tukey_hsd(df, value, group, alpha).select("group1", "group2", F.col("meandiff").alias("statistic"), "p_adj", "reject")
    else:
        name, pairs_name = "kruskal", "mann_whitney_holm"
        whole = kruskal_wallis(df, value, group, hist).select(F.col("H").alias("statistic"), "p_value", F.col("epsilon2").alias("effect"))
        names = (hist.where(F.col(group).isNotNull())
                 .groupBy(group).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), group))
        levels = names.limit(MAX_GROUPS + 1).collect()
        if len(levels) > MAX_GROUPS:
            raise ValueError(f"pairwise tests take at most {MAX_GROUPS} groups")
        kind = df.schema[group].dataType.simpleString()
        levels = df.sparkSession.createDataFrame([(r[group], i) for i, r in enumerate(levels)], f"`{group}` {kind}, pos int")
        found = holm_adjust(mann_whitney_pairs(df, value, group, levels, hist=hist), order_tiebreak="group_1")
        pairs = found.select(F.col("group_1").alias("group1"), F.col("group_2").alias("group2"),
                             F.col("U_stat").alias("statistic"), F.col("p_value_holm").alias("p_adj"),
                             (F.col("p_value_holm") < alpha).alias("reject"))
    return (whole.select(F.lit(name).alias("test"), "statistic", "p_value", "effect"),
            pairs.select(F.lit(pairs_name).alias("test"), "group1", "group2", "statistic", "p_adj", "reject"))
