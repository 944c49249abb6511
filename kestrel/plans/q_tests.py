"""Queries: confirmatory statistics (T*).

SQL engines here have no incomplete beta / gamma / erf, so each test is
registered twice: ``*_stat`` (the statistic, checked against the oracle) and
``*_test`` (statistic plus p-value; p-values are unit-tested against known
values in tests/test_distributions.py).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import aggregates as agg
from kestrel.operators import stat_tests as st
from kestrel.plans.frames import WIDE_FEATURES, WIDE_SQL, table, wide
from kestrel.plans.registry import register, round_doubles

W = f"WITH wide AS ({WIDE_SQL})"
TOP = f"""{W},
top AS (SELECT brand, row_number() OVER (ORDER BY count(*) DESC, brand) AS pos
        FROM wide GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 10),
t AS (SELECT * FROM wide WHERE brand IN (SELECT brand FROM top))"""


def _top(spark, sf_dir, k=10):
    return agg.keep_top_levels(wide(spark, sf_dir), "brand", k)


def _levels(spark, sf_dir, k=10):
    from pyspark.sql import Window
    lv = agg.top_k_levels(wide(spark, sf_dir), "brand", k)
    return lv.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "brand")))  # k rows


# ---------------------------------------------------------------- T1
@register("T1_shapiro_sample_sizes", f"""{TOP}
SELECT brand, least(count(*), 5000) AS n FROM t GROUP BY brand""")
def q_t1n(spark, sf_dir):
    return st.shapiro_by_group(_top(spark, sf_dir), "price", "brand", "rid").select("brand", "n")


@register("T1_shapiro_by_group_test")
def q_t1(spark, sf_dir):
    return round_doubles(st.shapiro_by_group(_top(spark, sf_dir), "price", "brand", "rid"), 8)


def _jb_sql(c):
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, round(count({c}) / 6.0 * ("
            f"power(avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5), 2) + "
            f"power(avg(power({c} - m, 4)) / power(avg(power({c} - m, 2)), 2) - 3, 2) / 4), 6) AS jb "
            f"FROM wide, (SELECT avg({c}) AS m FROM wide)")


@register("T1_jarque_bera_stat", f"""{W}
{' UNION ALL '.join(_jb_sql(c) for c in WIDE_FEATURES + ['price'])}""")
def q_t1jbs(spark, sf_dir):
    return round_doubles(st.jarque_bera(wide(spark, sf_dir), WIDE_FEATURES + ["price"]).drop("p_value"), 6)


@register("T1_jarque_bera_whole_table")
def q_t1jb(spark, sf_dir):
    return round_doubles(st.jarque_bera(wide(spark, sf_dir), WIDE_FEATURES + ["price"]), 6)


# ---------------------------------------------------------------- T2, T3
@register("T2_pearson_stat", f"""{W}
SELECT round(corr(quantity, price), 8) AS corr, count(*) AS n FROM wide""")
def q_t2s(spark, sf_dir):
    return round_doubles(st.pearson_test(wide(spark, sf_dir), "quantity", "price").drop("p_value"), 8)


@register("T2_pearson_test")
def q_t2(spark, sf_dir):
    return round_doubles(st.pearson_test(wide(spark, sf_dir), "quantity", "price"), 8)


@register("T3_spearman_stat", f"""{W},
r AS (SELECT rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS ry FROM wide)
SELECT round(corr(rx, ry), 8) AS corr, count(*) AS n FROM r""")
def q_t3s(spark, sf_dir):
    return round_doubles(st.spearman_test(wide(spark, sf_dir), "quantity", "price").drop("p_value"), 8)


@register("T3_spearman_test")
def q_t3(spark, sf_dir):
    return round_doubles(st.spearman_test(wide(spark, sf_dir), "quantity", "price"), 8)


@register("T4_correlation_method_table")
def q_t4(spark, sf_dir):
    """Pearson-or-Spearman per feature against the target, sorted by |corr|."""
    w = wide(spark, sf_dir)
    return round_doubles(st.correlation_tests(w, "price", WIDE_FEATURES, "rid"), 8)


@register("T4_correlation_stats", f"""{W},
r AS (SELECT {', '.join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in WIDE_FEATURES + ['price'])} FROM wide)
{' UNION ALL '.join(f"SELECT '{c}' AS feature, round(corr(r_{c}, r_price), 8) AS spearman FROM r" for c in WIDE_FEATURES)}""")
def q_t4s(spark, sf_dir):
    out = st.target_spearman(wide(spark, sf_dir), "price", WIDE_FEATURES)
    return round_doubles(out.select(F.col("column").alias("feature"), "spearman"), 8)


# ---------------------------------------------------------------- T5-T7
ANOVA_SQL = """g AS (SELECT brand, count(*) AS n, avg({v}) AS m, var_samp({v}) AS v FROM {src} GROUP BY brand),
tot AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS gm FROM g)
SELECT round((sum(n * power(m - gm, 2)) / (k - 1)) / (sum((n - 1) * v) / (nn - k)), 6) AS {fname},
       CAST(k - 1 AS DOUBLE) AS df_between, CAST(nn - k AS DOUBLE) AS df_within{extra}
FROM g, tot GROUP BY nn, k, gm"""


@register("T6_T7_anova_stat", f"""{TOP},
{ANOVA_SQL.format(v='price', src='t', fname='F', extra=', round(sum(n * power(m - gm, 2)) / (sum(n * power(m - gm, 2)) + sum((n - 1) * v)), 8) AS eta2, nn AS N, k')}""")
def q_t6s(spark, sf_dir):
    a = st.one_way_anova(_top(spark, sf_dir), "price", "brand").drop("p_value")
    return round_doubles(a, 6, {"eta2": 8})


@register("T6_T7_anova_test")
def q_t6(spark, sf_dir):
    return round_doubles(st.one_way_anova(_top(spark, sf_dir), "price", "brand"), 8)


@register("T5_levene_median_stat", f"""{TOP},
md AS (SELECT brand, median(price) AS med FROM t GROUP BY brand),
zz AS (SELECT t.brand, abs(price - med) AS z FROM t JOIN md ON t.brand = md.brand),
{ANOVA_SQL.format(v='z', src='zz', fname='W', extra='')}""")
def q_t5s(spark, sf_dir):
    return round_doubles(st.levene_median(_top(spark, sf_dir), "price", "brand").drop("p_value"), 6)


@register("T5_levene_median_test")
def q_t5(spark, sf_dir):
    return round_doubles(st.levene_median(_top(spark, sf_dir), "price", "brand"), 8)


# ---------------------------------------------------------------- T8, T9, T10
@register("T8_T9_kruskal_stat", f"""{TOP},
r AS (SELECT brand, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS rk FROM t),
g AS (SELECT brand, sum(rk) AS rs, count(*) AS n FROM r GROUP BY brand),
ties AS (SELECT sum(power(c, 3) - c) AS tie FROM (SELECT count(*) AS c FROM t GROUP BY price)),
s AS (SELECT sum(rs * rs / n) AS s, sum(n) AS nn, count(*) AS k FROM g)
SELECT round((12.0 / (nn * (nn + 1)) * s - 3 * (nn + 1)) / (1 - tie / (power(nn, 3) - nn)), 6) AS H,
       CAST(k - 1 AS DOUBLE) AS dof, nn AS N, k,
       round(((12.0 / (nn * (nn + 1)) * s - 3 * (nn + 1)) / (1 - tie / (power(nn, 3) - nn)) - k + 1) / (nn - k), 8) AS epsilon2
FROM s, ties""")
def q_t8s(spark, sf_dir):
    return round_doubles(st.kruskal_wallis(_top(spark, sf_dir), "price", "brand").drop("p_value"), 6,
                         {"epsilon2": 8})


@register("T8_T9_kruskal_test")
def q_t8(spark, sf_dir):
    return round_doubles(st.kruskal_wallis(_top(spark, sf_dir), "price", "brand"), 8)


@register("T10_anova_or_kruskal_decision")
def q_t10(spark, sf_dir):
    """Normality per group (Shapiro) + Levene decide ANOVA vs Kruskal-Wallis;
    the chosen test's statistic and p-value are returned."""
    return round_doubles(st.compare_groups(_top(spark, sf_dir), "price", "brand", "rid")[0], 8)


@register("T10_posthoc_of_decision")
def q_t10_posthoc(spark, sf_dir):
    """The post-hoc pairs that belong to the decision."""
    return round_doubles(st.compare_groups(_top(spark, sf_dir), "price", "brand", "rid")[1], 8)


# ---------------------------------------------------------------- T11
@register("T11_tukey_pairs_stat", f"""{TOP},
g AS (SELECT brand, avg(price) AS m FROM t GROUP BY brand)
SELECT a.brand AS group1, b.brand AS group2, round(b.m - a.m, 6) AS meandiff FROM g a JOIN g b ON a.brand < b.brand""")
def q_t11s(spark, sf_dir):
    return round_doubles(st.tukey_hsd(_top(spark, sf_dir), "price", "brand").select("group1", "group2", "meandiff"), 6)


@register("T11_tukey_hsd_test")
def q_t11(spark, sf_dir):
    return round_doubles(st.tukey_hsd(_top(spark, sf_dir), "price", "brand"), 6)


# ---------------------------------------------------------------- T12, T13
@register("T12_mann_whitney_U_stat", f"""{TOP},
pr AS (SELECT a.brand AS group_1, b.brand AS group_2 FROM top a JOIN top b ON a.pos < b.pos),
x AS (SELECT pr.group_1, pr.group_2, t.brand, t.price FROM pr JOIN t ON t.brand = pr.group_1 OR t.brand = pr.group_2),
r AS (SELECT *, rank() OVER (PARTITION BY group_1, group_2 ORDER BY price)
             + (count(*) OVER (PARTITION BY group_1, group_2, price) - 1) / 2.0 AS rk FROM x)
SELECT group_1, group_2,
       round(sum(CASE WHEN brand = group_1 THEN rk END)
             - count(CASE WHEN brand = group_1 THEN 1 END) * (count(CASE WHEN brand = group_1 THEN 1 END) + 1) / 2.0, 4) AS U_stat
FROM r GROUP BY group_1, group_2""")
def q_t12s(spark, sf_dir):
    t = _top(spark, sf_dir)
    mw = st.mann_whitney_pairs(t, "price", "brand", _levels(spark, sf_dir).select("brand", "pos"))
    return round_doubles(mw.select("group_1", "group_2", "U_stat"), 4)


@register("T12_T13_mann_whitney_holm_test")
def q_t12(spark, sf_dir):
    t = _top(spark, sf_dir)
    mw = st.mann_whitney_pairs(t, "price", "brand", _levels(spark, sf_dir).select("brand", "pos"))
    return round_doubles(st.holm_adjust(mw).orderBy("p_value_holm"), 10, {"U_stat": 4})


# ---------------------------------------------------------------- T14-T16
def _chi2_sql(src: str, a: str, b: str) -> str:
    return f"""c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {src} GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
tot AS (SELECT sum(o) AS nn, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM c),
cells AS (SELECT ra.a, cb.b, coalesce(c.o, 0) AS o, ra.ra * cb.cb / tot.nn AS e, tot.nn, tot.r, tot.k
          FROM ra CROSS JOIN cb CROSS JOIN tot LEFT JOIN c ON c.a = ra.a AND c.b = cb.b),
x AS (SELECT sum(CASE WHEN (r - 1) * (k - 1) = 1
                 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE power(o - e, 2) / e END) AS chi2,
             max(nn) AS nn, max(r) AS r, max(k) AS k FROM cells)
SELECT round(chi2, 6) AS chi2, CAST((r - 1) * (k - 1) AS INTEGER) AS dof,
       round(sqrt(greatest(0, chi2 / nn - (k - 1) * (r - 1) / (nn - 1))
             / least(k - power(k - 1, 2) / (nn - 1) - 1, r - power(r - 1, 2) / (nn - 1) - 1)), 8) AS cramers_v,
       CAST(nn AS DOUBLE) AS n FROM x"""


@register("T14_T15_chi2_cramers_v_stat", f"""WITH {_chi2_sql('orders', 'o_orderpriority', 'o_orderstatus')}""")
def q_t14s(spark, sf_dir):
    r = st.chi2_independence(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    return round_doubles(r.drop("p_value"), 6, {"cramers_v": 8})


@register("T14_chi2_2x2_yates_stat", f"""WITH l2 AS (SELECT l_linestatus, l_returnflag = 'A' AS is_a FROM lineitem),
{_chi2_sql('l2', 'l_linestatus', 'is_a')}""")
def q_t14y(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "A").alias("is_a"))
    r = st.chi2_independence(li, "l_linestatus", "is_a")
    return round_doubles(r.drop("p_value"), 6, {"cramers_v": 8})


@register("T14_T15_chi2_test")
def q_t14(spark, sf_dir):
    return round_doubles(st.chi2_independence(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"), 8)


@register("T16_odds_ratio_2x2", """
WITH l2 AS (SELECT l_linestatus AS a, l_returnflag = 'A' AS b FROM lineitem),
c AS (SELECT a, b, count(*) + 0.5 AS n FROM l2 GROUP BY a, b)
SELECT round(coalesce((SELECT n FROM c WHERE a = 'F' AND NOT b), 0.5) * coalesce((SELECT n FROM c WHERE a = 'O' AND b), 0.5)
           / (coalesce((SELECT n FROM c WHERE a = 'F' AND b), 0.5) * coalesce((SELECT n FROM c WHERE a = 'O' AND NOT b), 0.5)), 8)
       AS odds_ratio""")
def q_t16(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "A").alias("is_a"))
    return round_doubles(st.odds_ratio_2x2(li, "l_linestatus", "is_a"), 8)


@register("T17_pair_choice_chi2_stat", """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
tot AS (SELECT sum(o) AS nn FROM c)
SELECT 'o_orderstatus' AS first, 'o_orderpriority' AS second,
       round(sum(power(c.o, 2) / (ra.ra * cb.cb / tot.nn)) - max(tot.nn), 6) AS chi2
FROM c JOIN ra ON c.a = ra.a JOIN cb ON c.b = cb.b, tot""")
def q_t17(spark, sf_dir):
    """No preferred pair in the orders table, so the first two categorical
    columns are crossed (T17)."""
    from kestrel.operators.clean import column_kinds
    o = table(spark, sf_dir, "orders")
    a, b = st.choose_pair(column_kinds(o))
    r = st.chi2_independence(o, a, b).select("chi2")
    return round_doubles(r.select(F.lit(a).alias("first"), F.lit(b).alias("second"), "chi2"), 6)


@register("J5_group_pairs_top10", f"""{TOP}
SELECT a.brand AS group_1, b.brand AS group_2 FROM top a JOIN top b ON a.pos < b.pos""")
def q_j5(spark, sf_dir):
    """i < j pairs of the (bounded) top-10 level list."""
    return st.group_pairs(_levels(spark, sf_dir).select("brand", "pos"), "brand").select("group_1", "group_2")


@register("W7_T13_holm_running_max", f"""{W},
c AS (SELECT brand, count(*) * 1.0 / (SELECT count(*) FROM wide) AS p FROM wide GROUP BY brand),
r AS (SELECT brand, p, row_number() OVER (ORDER BY p, brand) - 1 AS i, count(*) OVER () AS m FROM c)
SELECT brand, round(p, 10) AS p_value_raw,
       round(least(1.0, max((m - i) * p) OVER (ORDER BY p, brand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 10)
       AS p_value_holm FROM r""")
def q_w7(spark, sf_dir):
    """Holm step-down (running max of (m - i)·p, clipped) on per-level row
    shares used as p-values; the table has one row per level."""
    c = agg.value_counts(wide(spark, sf_dir), "brand")
    tot = c.agg(F.sum("n")).collect()[0][0]
    c = c.select("brand", (F.col("n") / F.lit(float(tot))).alias("p_value_raw"))
    return round_doubles(st.holm_adjust(c, order_tiebreak="brand"), 10)
