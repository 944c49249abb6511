"""Literal fixtures (FIXTURES.md part 3) against closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from kestrel.operators import aggregates as agg
from kestrel.operators import clean, missing, models, ranking, stat_tests


def test_ties5_spearman(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 2.0), (3.0, 5.0), (3.0, 1.0)], "x double, y double")
    r = stat_tests.spearman_test(df, "x", "y").collect()[0]
    assert r["corr"] == pytest.approx(-0.0811107, abs=1e-6)
    m = agg.correlation_matrix(df, ["x", "y"], "spearman").where("a = 'x' AND b = 'y'").collect()[0]
    assert m["corr"] == pytest.approx(-0.0811107, abs=1e-6)


def test_null_keys_join(spark):
    left = spark.createDataFrame([("a", None), (None, None)], "k string, v double")
    ref = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 7.0)], "k string, v double")
    out = missing.restore_from_reference(left, ref, ["k"], "v").orderBy(F.asc_nulls_last("k")).collect()
    assert len(out) == 2
    assert out[0]["v"] == 2.0 and out[1]["v"] == 7.0


def test_nan_rule(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (3.0,), (4.0,)], "x double")
    d = clean.nan_to_null(df)
    assert d.where(F.col("x").isNull()).count() == 1
    cleaned, counts = clean.apply_rules(d, [clean.RangeRule("x", 0, 3)])
    assert counts.collect()[0]["n_invalid"] == 1
    assert cleaned.where(F.col("x").isNull()).count() == 2


def test_two_by_two_chi2(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 9
    df = spark.createDataFrame(rows, "a string, b string")
    assert stat_tests.chi2_independence(df, "a", "b", yates=False).collect()[0]["chi2"] == pytest.approx(4.635989, abs=1e-5)
    assert stat_tests.chi2_independence(df, "a", "b", yates=True).collect()[0]["chi2"] == pytest.approx(3.117239, abs=1e-5)
    odds = stat_tests.odds_ratio_2x2(df, "a", "b").collect()[0][0]
    assert odds == pytest.approx((10.5 * 9.5) / (5.5 * 3.5))


def test_scores6_auc_ap(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.4, 1), (0.2, 0)], "score double, y int")
    assert models.roc_auc(df, "y").collect()[0][0] == pytest.approx(0.6111, abs=1e-4)
    assert models.average_precision(df, "y").collect()[0][0] == pytest.approx(0.7, abs=1e-9)


def test_even_median_and_mode_tie(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "a"), (4.0, "b")], "x double, c string")
    fills = missing.fit_simple_imputer(df, ["x"], ["c"])
    assert fills["x"] == 2.5
    assert fills["c"] == "a"  # tie: smallest value


def test_half_even_injection_count():
    assert missing.exact_injection_count(5, 0.5) == 2
    assert missing.exact_injection_count(7, 0.5) == 4
    assert missing.exact_injection_count(3, 0.01) == 1


def test_edge_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]], "x double")
    h = {r["bin"]: r["n"] for r in agg.histogram(df, "x", 30).collect()}
    assert h[30] == 1 and sum(h.values()) == 5


def test_one_class(spark):
    df = spark.createDataFrame([(0.2, 0), (0.7, 0)], "score double, y int")
    r = models.confusion_metrics(df, "y").collect()[0]
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 1, 0, 0)
    assert r["sensitivity"] is None and r["precision"] == 0.0


def test_constant_and_empty(spark):
    df = spark.createDataFrame([(5.0, "g")] * 4, "x double, g string")
    sk = agg.skew_kurtosis(df, ["x"]).collect()[0]
    assert sk["skew"] is None or math.isnan(sk["skew"])
    assert clean.iqr_filter(df, "x").count() == 4
    empty = df.limit(0)
    assert agg.na_counts(empty).count() == 0


def test_holm4(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "i int, p_value_raw double")
    out = {r["i"]: r["p_value_holm"] for r in stat_tests.holm_adjust(df).collect()}
    assert [round(out[i], 10) for i in range(4)] == [0.03, 0.06, 0.06, 0.02]


def test_dup_edges_qcut(spark):
    df = spark.createDataFrame([(0.0,)] * 8 + [(1.0,)] * 2, "x double")
    with pytest.raises(ValueError):
        agg.quartile_bins(df, "x")


def test_rank_and_variance_tests_at_their_limits(spark):
    one = spark.createDataFrame([(1.0, "a"), (2.0, "a")], "x double, g string")
    same = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (1.0, "b")], "x double, g string")
    assert stat_tests.one_way_anova(one, "x", "g").first()["F"] is None
    assert stat_tests.one_way_anova(same, "x", "g").first()["F"] is None
    assert stat_tests.kruskal_wallis(same, "x", "g").first()["H"] is None
    two = spark.createDataFrame([(float(i), "ab"[i > 4]) for i in range(10)], "x double, g string")
    r = stat_tests.kruskal_wallis(two, "x", "g").first()
    assert r["epsilon2"] == pytest.approx((r["H"] - 1) / 8)


def test_association_of_a_perfect_and_of_no_table(spark):
    rows = [("a", "x", "p")] * 50 + [("b", "y", "p")] * 50
    df = spark.createDataFrame(rows, "u string, v string, w string")
    n, expected = 100, None
    phi2 = stat_tests.chi2_independence(df, "u", "v", yates=False).first()
    excess, room = phi2["chi2"] / n - 1 / (n - 1), 1 - 1 / (n - 1)
    assert phi2["cramers_v"] == pytest.approx(math.sqrt(excess / room))
    assert stat_tests.chi2_independence(df, "u", "w").first()["cramers_v"] is expected


def test_quotes_commas_and_line_breaks_in_csv(spark, tmp_path):
    from kestrel.sources import io
    rows = [("1", 'say ""hi"", x'.replace('""', '"')), ("2", "two\nlines"), ("3", "plain, with comma"), ("4", None)]
    (tmp_path / "a.csv").write_text('k,v\n1,"say ""hi"", x"\n2,"two\nlines"\n3,"plain, with comma"\n4,NA\n')
    got = io.null_na_tokens(io.read_csv_text(spark, str(tmp_path / "a.csv"))).orderBy("k").collect()
    assert [tuple(r) for r in got] == rows
    io.write_csv(spark.createDataFrame(rows, "k string, v string"), str(tmp_path / "b"))
    back = io.null_na_tokens(io.read_csv_text(spark, str(tmp_path / "b"))).orderBy("k").collect()
    assert [tuple(r) for r in back] == rows


def test_numbers_in_text(spark):
    from kestrel.operators.clean import coerce_numeric
    from kestrel.sources import io
    texts = ["12f", "3d", " 4.5 ", "-1e3", ".5", "7.", "x", "", None, "nan"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in coerce_numeric(df, ["s"]).collect()]
    assert got[:9] == [None, None, 4.5, -1000.0, 0.5, 7.0, None, None, None] and math.isnan(got[9])
    assert not io.detect_numeric(df.limit(2)).first()["is_numeric"]


def test_tied_qq_positions(spark):
    from statistics import NormalDist
    from kestrel.operators import models
    df = spark.createDataFrame([(float(i >= 50),) for i in range(100)], "residual double")
    pts, line = models.qq_points(df)
    pos = [0.5 ** 0.01 if i == 100 else 1 - 0.5 ** 0.01 if i == 1 else (i - 0.3175) / 100.365 for i in range(1, 101)]
    q = [NormalDist().inv_cdf(p) for p in pos]
    got = {r["sample"]: r["theoretical"] for r in pts.collect()}
    assert got[0.0] == pytest.approx(sum(q[:50]) / 50) and got[1.0] == pytest.approx(sum(q[50:]) / 50)
    y = [0.0] * 50 + [1.0] * 50
    my = 0.5
    r = sum(a * (b - my) for a, b in zip(q, y)) / math.sqrt(sum(a * a for a in q) * sum((b - my) ** 2 for b in y))
    assert line.first()["r"] == pytest.approx(r) and r < 0.9


def test_missing_metrics_and_keys_come_last(spark):
    from kestrel.operators import models, windows
    res = spark.createDataFrame([("v", "a", None), ("v", "b", 2.0), ("w", "c", 1.0)], "variant string, model string, rmse double")
    best = {r["variant"]: (r["model"], r["selected"]) for r in models.leaderboard(res, [("rmse", "asc")]).collect()}
    assert best == {"v": ("b", 0), "w": ("c", 1)}
    for way in ("asc", "desc"):
        assert windows.first_per_group(res, "variant", [("rmse", way)]).where("variant = 'v'").first()["model"] == "b"


def test_constant_labels_and_one_class(spark):
    from kestrel.operators import features, models
    df = spark.createDataFrame([(1.0, 1.0, 1, 0.5), (1.0, 2.0, 1, 0.5)], "y double, pred double, c int, score double")
    assert models.regression_metrics(df, "y").first()["r2"] == 0.0
    assert models.roc_auc(df, "c").first()[0] is None
    even = spark.createDataFrame([(0, 0.5), (1, 0.5)], "c int, score double")
    assert models.roc_auc(even, "c").first()[0] == 0.5
    line = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(9)], "x double, y double, k double")
    got = {r["feature"]: r["f_score"] for r in features.f_scores(line, ["x", "k"], "y").collect()}
    assert got["x"] > 1e12 and got["k"] is None


def test_iqr_filter_without_values(spark):
    from kestrel.operators.clean import iqr_filter
    assert iqr_filter(spark.createDataFrame([(None,), (None,)], "x double"), "x").count() == 0


def test_fold_sizes_differ_by_one_at_most(spark):
    from kestrel.operators.missing import kfold
    df = spark.createDataFrame([(i, i % 7 == 0) for i in range(103)], "id long, c boolean")
    sizes = [r["count"] for r in kfold(df, "id", 5).groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]
    for c in (True, False):
        part = [r["count"] for r in kfold(df, "id", 5, stratify="c").where(F.col("c") == c).groupBy("fold").count().collect()]
        assert len(part) == 5 and max(part) - min(part) <= 1

def test_qcut_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 9)], "x double")
    b = {r["x"]: r["bin"] for r in agg.quartile_bins(df, "x").collect()}
    # edges 1, 2.75, 4.5, 6.25, 8: lowest included, right-closed
    assert b[1.0] == 1 and b[2.0] == 1 and b[3.0] == 2 and b[8.0] == 4


def test_ranked_histogram_global_and_grouped(spark):
    import random
    random.seed(1)
    rows = [(random.choice(["h", "h", "h", "a", "b"]), float(random.randint(0, 30))) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, v double")
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for buckets in (1, 4, 64):
        got = {(r["g"], r["v"]): r["rank"] for r in ranking.ranked_histogram(df, "v", "g", buckets=buckets).collect()}
        pdf["r"] = pdf.groupby("g")["v"].rank(method="average")
        for (g, v), rk in pdf.groupby(["g", "v"])["r"].first().items():
            assert got[(g, v)] == pytest.approx(rk)
    q = {r["prob"]: r["quantile"] for r in ranking.exact_quantiles(df, "v", [0.1, 0.5, 0.77]).collect()}
    for p, val in q.items():
        assert val == pytest.approx(pdf["v"].quantile(p))


def test_mann_whitney_matches_brute_force(spark):
    import itertools
    import numpy as np
    from kestrel.functions.distributions import norm_sf
    rng = np.random.default_rng(4)
    data = {g: rng.integers(0, 12, size=n).astype(float) for g, n in (("a", 40), ("b", 55), ("c", 30))}
    rows = [(g, float(v)) for g, vals in data.items() for v in vals]
    df = spark.createDataFrame(rows, "g string, v double")
    levels = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "g string, pos int")
    got = {(r["group_1"], r["group_2"]): (r["U_stat"], r["p_value_raw"])
           for r in stat_tests.mann_whitney_pairs(df, "v", "g", levels).collect()}
    for x, y in itertools.combinations(["a", "b", "c"], 2):
        a, b = data[x], data[y]
        u = sum((ai > bi) + 0.5 * (ai == bi) for ai in a for bi in b)
        allv = np.concatenate([a, b])
        _, t = np.unique(allv, return_counts=True)
        n1, n2, n = len(a), len(b), len(allv)
        sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t ** 3 - t).sum() / (n * (n - 1))))
        p = min(1.0, 2 * norm_sf((abs(u - n1 * n2 / 2) - 0.5) / sigma))
        assert got[(x, y)][0] == pytest.approx(u)
        assert got[(x, y)][1] == pytest.approx(p, rel=1e-9)


def test_ranked_histogram_bucketizer_path(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(8)
    vals = np.round(rng.normal(size=3000), 3)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = {r["v"]: r["rank"] for r in ranking.ranked_histogram(df, "v", buckets=400).collect()}
    want = pd.Series(vals).rank(method="average")
    for v, rk in zip(vals, want):
        assert got[float(v)] == pytest.approx(rk)
    q = ranking.exact_quantiles(df, "v", [0.5], buckets=400).collect()[0]["quantile"]
    assert q == pytest.approx(float(np.quantile(vals, 0.5)))
