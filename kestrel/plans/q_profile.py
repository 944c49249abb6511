"""Queries: profiles, aggregates, ranks and top-k (A*, W*, P9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import aggregates as agg
from kestrel.operators import ranking
from kestrel.operators.windows import first_per_group, top_n_per_group
from kestrel.plans.frames import (BIN_SQL, HOLES_SQL, WIDE_FEATURES, WIDE_NUMERIC, WIDE_SQL, bin_frame,
                                  holes, table, wide)
from kestrel.plans.registry import register, round_doubles

W = f"WITH wide AS ({WIDE_SQL})"
H = f"WITH holes AS ({HOLES_SQL})"
HOLES_COLS = ["rid", "returnflag", "linestatus", "brand", "ptype", *WIDE_NUMERIC]
STR_COLS = ["returnflag", "linestatus", "brand", "ptype"]
QC = '"column"'  # quoted: a keyword in some SQL dialects


def union_sql(parts):
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- A9 flagship
def flagship(spark, sf_dir):
    """Top-10 brands by rows, then n / mean / median / std of price per brand."""
    w = wide(spark, sf_dir)
    top = agg.keep_top_levels(w, "brand", 10)
    return round_doubles(agg.group_summary(top, "brand", "price"), 4)


register("A9_group_summary_top10", f"""{W},
top AS (SELECT brand FROM wide GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 10)
SELECT brand, count(price) AS n, round(avg(price), 4) AS mean, round(median(price), 4) AS median,
       round(stddev_samp(price), 4) AS std
FROM wide WHERE brand IN (SELECT brand FROM top) GROUP BY brand ORDER BY mean DESC""")(flagship)


# ---------------------------------------------------------------- A1-A4
@register("A1_na_counts", f"""{H}
SELECT * FROM ({union_sql([f"SELECT '{c}' AS {QC}, count(*) - count({c}) AS na_count FROM holes"
                            for c in HOLES_COLS])}) WHERE na_count > 0""")
def q_a1(spark, sf_dir):
    return agg.na_counts(holes(spark, sf_dir))


@register("A2_na_total", f"""{H}
SELECT CAST({' + '.join(f"(count(*) - count({c}))" for c in HOLES_COLS)} AS BIGINT) AS na_total FROM holes""")
def q_a2(spark, sf_dir):
    return agg.na_total(holes(spark, sf_dir))


@register("A3_na_rate_top15", f"""{H}
SELECT * FROM ({union_sql([f"SELECT '{c}' AS {QC}, round(1.0 - count({c}) / count(*), 8) AS na_rate FROM holes"
                            for c in HOLES_COLS])}) ORDER BY na_rate DESC, "column" LIMIT 15""")
def q_a3(spark, sf_dir):
    return round_doubles(agg.na_rates(holes(spark, sf_dir), top=15), 8)


@register("A4_shape", f"""{W}
SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM wide""")
def q_a4(spark, sf_dir):
    return agg.shape(wide(spark, sf_dir)).withColumn("n_cols", F.col("n_cols").cast("bigint"))


# ---------------------------------------------------------------- A5-A7, A10-A13
def _describe_sql(c):
    # "+ 0.0" turns the -0.0 some engines report for min() into 0.0
    # means of 2-decimal data over 10^4+ rows can end exactly on a 6th-digit tie: use 8
    return (f"SELECT '{c}' AS {QC}, count({c}) AS count, round(avg({c}), 8) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) + 0.0 AS min, round(max({c}), 6) AS max, "
            f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
            f"round(quantile_cont({c}, 0.75), 6) AS p75 FROM wide")


@register("A5_describe_numeric", f"""{W}
{union_sql([_describe_sql(c) for c in WIDE_NUMERIC])}""")
def q_a5(spark, sf_dir):
    return round_doubles(agg.describe_numeric(wide(spark, sf_dir), WIDE_NUMERIC), 6, {"mean": 8})


@register("A6_describe_categorical", f"""{W},
long AS ({union_sql([f"SELECT '{c}' AS col, {c} AS value FROM wide WHERE {c} IS NOT NULL" for c in STR_COLS])}),
h AS (SELECT col, value, count(*) AS n FROM long GROUP BY col, value)
SELECT col AS "column", sum(n) AS count, count(*) AS "unique",
       arg_min(value, struct_pack(a := -n, b := value)) AS top, max(n) AS freq
FROM h GROUP BY col""")
def q_a6(spark, sf_dir):
    return agg.describe_categorical(wide(spark, sf_dir), STR_COLS).withColumn("count", F.col("count").cast("bigint"))


@register("A7_value_counts_top15", f"""{W}
SELECT brand, count(*) AS n FROM wide GROUP BY brand ORDER BY n DESC, brand LIMIT 15""")
def q_a7(spark, sf_dir):
    return agg.value_counts(wide(spark, sf_dir), "brand", top=15)


@register("A8_group_median_composite_key", f"""{W}
SELECT returnflag, linestatus, ptype, brand, round(median(price), 6) AS median
FROM wide GROUP BY returnflag, linestatus, ptype, brand""")
def q_a8(spark, sf_dir):
    return round_doubles(agg.group_median(wide(spark, sf_dir), ["returnflag", "linestatus", "ptype", "brand"], "price"))


@register("A10_distinct_count", """
SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem""")
def q_a10(spark, sf_dir):
    return agg.n_levels(table(spark, sf_dir, "lineitem"), "l_partkey")


PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@register("A11_quantiles_linear", f"""{W}
{union_sql([f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(price, {p}), 6) AS quantile FROM wide" for p in PROBS])}""")
def q_a11(spark, sf_dir):
    return round_doubles(agg.quantiles(wide(spark, sf_dir), "price", PROBS))


def _moment_sql(c):
    return (f"SELECT '{c}' AS {QC}, "
            f"round(avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5), 6) AS skew, "
            f"round(avg(power({c} - m, 4)) / power(avg(power({c} - m, 2)), 2) - 3, 6) AS kurtosis "
            f"FROM wide, (SELECT avg({c}) AS m FROM wide)")


@register("A12_A13_skew_kurtosis", f"""{W}
{union_sql([_moment_sql(c) for c in WIDE_NUMERIC])}""")
def q_a12(spark, sf_dir):
    return round_doubles(agg.skew_kurtosis(wide(spark, sf_dir), WIDE_NUMERIC))


# ---------------------------------------------------------------- A14-A19
@register("A14_qcut_quartiles", f"""{W},
e AS (SELECT quantile_cont(price, 0.25) AS e1, quantile_cont(price, 0.5) AS e2,
             quantile_cont(price, 0.75) AS e3 FROM wide)
SELECT CASE WHEN price <= e1 THEN 1 WHEN price <= e2 THEN 2 WHEN price <= e3 THEN 3 ELSE 4 END AS bin,
       count(*) AS n
FROM wide, e GROUP BY bin""")
def q_a14(spark, sf_dir):
    b = agg.quartile_bins(wide(spark, sf_dir), "price")
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@register("A15_contingency", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2""")
def q_a15(spark, sf_dir):
    return agg.contingency(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@register("A16_top_joint_counts", f"""{W},
ta AS (SELECT brand FROM wide GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 10),
s1 AS (SELECT * FROM wide WHERE brand IN (SELECT brand FROM ta)),
tb AS (SELECT ptype FROM wide GROUP BY ptype ORDER BY count(*) DESC, ptype LIMIT 6),
s2 AS (SELECT * FROM s1 WHERE ptype IN (SELECT ptype FROM tb)),
c AS (SELECT brand, ptype, count(*) AS n FROM s2 GROUP BY 1, 2)
SELECT brand, ptype, n, round(n / sum(n) OVER (), 8) AS share FROM c""")
def q_a16(spark, sf_dir):
    return round_doubles(agg.top_joint_counts(wide(spark, sf_dir), "brand", "ptype", 10, 6), 8)


@register("A17_histogram_30", f"""{W},
s AS (SELECT min(price) AS lo, max(price) AS hi FROM wide),
b AS (SELECT least(CAST(floor(30 * (price - lo) / (hi - lo)) AS BIGINT) + 1, 30) AS bin, lo, hi FROM wide, s)
SELECT CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * (hi - lo) / 30, 6) AS bin_lo,
       round(lo + bin * (hi - lo) / 30, 6) AS bin_hi, count(*) AS n
FROM b GROUP BY bin, lo, hi""")
def q_a17(spark, sf_dir):
    h = agg.histogram(wide(spark, sf_dir), "price", 30)
    return round_doubles(h.withColumn("bin", F.col("bin").cast("int")))


@register("A18_kde_curve", f"""{W},
s AS (SELECT count(quantity) AS n, stddev_samp(quantity) * pow(count(quantity), -0.2) AS h,
             min(quantity) AS lo, max(quantity) AS hi FROM wide),
g AS (SELECT i AS point, lo + i * (hi - lo) / 199 AS x FROM s, range(200) t(i)),
v AS (SELECT quantity, count(*) AS c FROM wide GROUP BY quantity)
SELECT CAST(point AS INTEGER) AS point, round(x, 6) AS x,
       round(sum(c * exp(-0.5 * pow((x - quantity) / h, 2)) / (sqrt(2 * pi()) * h * n)), 12) AS density
FROM g, v, s GROUP BY point, x""")
def q_a18(spark, sf_dir):
    k = agg.kde_curve(wide(spark, sf_dir), "quantity", 200)
    return round_doubles(k.withColumn("point", F.col("point").cast("int")), 6, {"density": 12})


@register("A19_box_stats_top12", f"""{W},
top AS (SELECT brand FROM wide GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 12),
t AS (SELECT * FROM wide WHERE brand IN (SELECT brand FROM top)),
q AS (SELECT brand, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
             quantile_cont(price, 0.75) AS q3 FROM t GROUP BY brand),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.brand, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN price BETWEEN lo AND hi THEN price END), 6) AS whisker_lo,
       round(max(CASE WHEN price BETWEEN lo AND hi THEN price END), 6) AS whisker_hi,
       count(CASE WHEN NOT (price BETWEEN lo AND hi) THEN 1 END) AS n_outliers
FROM t JOIN f ON t.brand = f.brand GROUP BY f.brand, q1, median, q3""")
def q_a19(spark, sf_dir):
    t = agg.keep_top_levels(wide(spark, sf_dir), "brand", 12)
    return round_doubles(agg.box_stats(t, "price", "brand"))


@register("A19_box_stats_global", f"""{W},
q AS (SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.5) AS median,
             quantile_cont(quantity, 0.75) AS q3 FROM wide),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN quantity BETWEEN lo AND hi THEN quantity END), 6) AS whisker_lo,
       round(max(CASE WHEN quantity BETWEEN lo AND hi THEN quantity END), 6) AS whisker_hi,
       count(CASE WHEN NOT (quantity BETWEEN lo AND hi) THEN 1 END) AS n_outliers
FROM wide, f GROUP BY q1, median, q3""")
def q_a19g(spark, sf_dir):
    return round_doubles(agg.box_stats(wide(spark, sf_dir), "quantity"))


# ---------------------------------------------------------------- A20-A24, A26
CORR_COLS = WIDE_NUMERIC


def _pairs_sql(src, cols):
    return union_sql([f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS corr, {i} AS i, {j} AS j FROM {src}"
                      for i, a in enumerate(cols) for j, b in enumerate(cols)])


@register("A20_pearson_matrix", f"""{W}
{_pairs_sql('wide', CORR_COLS)}""")
def q_a20(spark, sf_dir):
    return round_doubles(agg.correlation_matrix(wide(spark, sf_dir), CORR_COLS), 8)


def _rank_sql(c):
    return (f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}")


@register("A21_spearman_matrix", f"""{W},
r AS (SELECT {', '.join(_rank_sql(c) for c in CORR_COLS)} FROM wide)
{_pairs_sql('r', CORR_COLS)}""")
def q_a21(spark, sf_dir):
    return round_doubles(agg.correlation_matrix(wide(spark, sf_dir), CORR_COLS, "spearman"), 8)


@register("A20_pearson_matrix_holes", f"""WITH h AS ({HOLES_SQL})
{_pairs_sql('h', CORR_COLS)}""")
def q_a20_holes(spark, sf_dir):
    return round_doubles(agg.correlation_matrix(holes(spark, sf_dir), CORR_COLS), 8)


def _spearman_pair_sql(a, i, b, j):
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS {1}"
    return (f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 8) AS corr, {i} AS i, {j} AS j FROM (SELECT "
            f"{rank.format(a, 'x')}, {rank.format(b, 'y')} FROM h WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@register("A21_spearman_matrix_holes", f"""WITH h AS ({HOLES_SQL})
{union_sql([_spearman_pair_sql(a, i, b, j) for i, a in enumerate(CORR_COLS) for j, b in enumerate(CORR_COLS)])}""")
def q_a21_holes(spark, sf_dir):
    return round_doubles(agg.correlation_matrix(holes(spark, sf_dir), CORR_COLS, "spearman"), 8)


@register("A22_lower_triangle", f"""{W}
SELECT * FROM ({_pairs_sql('wide', CORR_COLS)}) WHERE i >= j""")
def q_a22(spark, sf_dir):
    return round_doubles(agg.lower_triangle(agg.correlation_matrix(wide(spark, sf_dir), CORR_COLS)), 8)


@register("A23_target_correlation_top15", f"""{W}
SELECT feature, round(corr, 8) AS corr, round(abs(corr), 8) AS abs_corr FROM (
{union_sql([f"SELECT '{c}' AS feature, corr({c}, price) AS corr FROM wide" for c in WIDE_NUMERIC if c != 'price'])})
ORDER BY abs(corr) DESC LIMIT 15""")
def q_a23(spark, sf_dir):
    return round_doubles(agg.target_correlations(wide(spark, sf_dir), "price", WIDE_NUMERIC), 8)


@register("A24_simple_regression", f"""{W}
SELECT returnflag, round(regr_slope(price, quantity), 6) AS slope,
       round(regr_intercept(price, quantity), 6) AS intercept, round(regr_r2(price, quantity), 8) AS r2,
       regr_count(price, quantity) AS n
FROM wide GROUP BY returnflag""")
def q_a24(spark, sf_dir):
    r = agg.simple_regression(wide(spark, sf_dir), "price", "quantity", "returnflag")
    return round_doubles(r, 6, {"r2": 8}).withColumn("n", F.col("n").cast("bigint"))


@register("A26_positive_rate", f"""
WITH b AS ({BIN_SQL})
SELECT lang, count(*) AS n, round(avg(quality), 8) AS positive_rate FROM b GROUP BY lang""")
def q_a26(spark, sf_dir):
    return round_doubles(agg.positive_rate(bin_frame(spark, sf_dir), "quality", "lang"), 8)


# ---------------------------------------------------------------- P9, W*
@register("P9_top_level_filter", f"""{W},
top AS (SELECT brand FROM wide GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 10)
SELECT brand, count(*) AS n, round(sum(price), 2) AS total_price
FROM wide WHERE brand IN (SELECT brand FROM top) GROUP BY brand""")
def q_p9(spark, sf_dir):
    t = agg.keep_top_levels(wide(spark, sf_dir), "brand", 10)
    return round_doubles(t.groupBy("brand").agg(F.count(F.lit(1)).alias("n"),
                                                F.sum("price").alias("total_price")), 2)


@register("W1_first_per_group_mixed_sort", f"""{W},
r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY price DESC, quantity ASC, rid ASC) AS rn FROM wide)
SELECT brand, rid, price, quantity FROM r WHERE rn = 1""")
def q_w1(spark, sf_dir):
    w = wide(spark, sf_dir).select("brand", "rid", "price", "quantity")
    return first_per_group(w, "brand", [("price", "desc"), ("quantity", "asc"), ("rid", "asc")])


@register("W2_top3_per_group", f"""{W},
r AS (SELECT *, row_number() OVER (PARTITION BY ptype ORDER BY price DESC, rid ASC) AS rn FROM wide)
SELECT ptype, rid, price, rn FROM r WHERE rn <= 3""")
def q_w2(spark, sf_dir):
    w = wide(spark, sf_dir).select("ptype", "rid", "price")
    return top_n_per_group(w, "ptype", [("price", "desc"), ("rid", "asc")], 3, rank_col="rn").withColumn("rn", F.col("rn").cast("bigint"))


@register("W3_global_best", f"""{W}
SELECT rid, price, quantity FROM wide ORDER BY price DESC, quantity ASC, rid ASC LIMIT 1""")
def q_w3(spark, sf_dir):
    return (wide(spark, sf_dir).select("rid", "price", "quantity")
            .orderBy(F.desc("price"), F.asc("quantity"), F.asc("rid")).limit(1))


@register("W6_average_rank", f"""{W}
SELECT rid, price, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS rank
FROM wide""")
def q_w6(spark, sf_dir):
    w = wide(spark, sf_dir).select("rid", "price")
    return ranking.with_average_rank(w, "price")


@register("W6_average_rank_by_group", f"""{W}
SELECT brand, rid, quantity,
       rank() OVER (PARTITION BY brand ORDER BY quantity)
       + (count(*) OVER (PARTITION BY brand, quantity) - 1) / 2.0 AS rank
FROM wide""")
def q_w6g(spark, sf_dir):
    w = wide(spark, sf_dir).select("brand", "rid", "quantity")
    return ranking.with_average_rank(w, "quantity", by="brand")


@register("W8_sort_by_abs", f"""{W}
SELECT feature, round(corr, 8) AS corr FROM (
{union_sql([f"SELECT '{c}' AS feature, corr({c}, price) AS corr FROM wide" for c in WIDE_FEATURES])})
ORDER BY abs(corr) DESC""")
def q_w8(spark, sf_dir):
    t = agg.target_correlations(wide(spark, sf_dir), "price", WIDE_FEATURES, top=None)
    return round_doubles(t.select("feature", "corr"), 8)


@register("W9_top_k_levels", """
SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3""")
def q_w9(spark, sf_dir):
    return agg.top_k_levels(table(spark, sf_dir, "events"), "event_type", 3)


@register("W4_W5_running_share_first_reaching", f"""{W},
c AS (SELECT brand, count(*) AS n FROM wide GROUP BY brand),
r AS (SELECT brand, n, row_number() OVER (ORDER BY n DESC, brand) AS pos FROM c),
s AS (SELECT pos, sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 1.0
             / sum(n) OVER () AS share FROM r)
SELECT CAST(min(pos) AS INTEGER) AS pos, round(min(share), 8) AS share FROM s WHERE share >= 0.5""")
def q_w4(spark, sf_dir):
    """Running share of rows over levels by frequency (W4) and the first level
    count reaching half of the rows (W5); the frame has one row per level."""
    from pyspark.sql import Window
    c = agg.value_counts(wide(spark, sf_dir), "brand")
    c = c.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "brand")).cast("int"))
    tot = c.agg(F.sum("n")).collect()[0][0]
    run = ranking.running_total(c.withColumn("share_n", F.col("n") / F.lit(float(tot))), "pos", "share_n", "share")
    first = ranking.first_reaching(run, "pos", "share", 0.5)
    return round_doubles(first.join(run.select("pos", "share"), "pos"), 8)
