"""Ranks by ranges, normal scores, binned densities and the studentized range."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from kestrel.functions import distributions as d
from kestrel.operators import aggregates as agg
from kestrel.operators import features, stat_tests


@pytest.mark.parametrize("limit", [0, 100_000])
def test_ranks_without_a_join_of_rows(spark, monkeypatch, limit):
    """With ``limit`` 0 every column goes by ranges; half of one column is one value."""
    monkeypatch.setattr(agg, "BROADCAST_VALUES", limit)
    rng = np.random.default_rng(1)
    x = pd.DataFrame({"a": rng.normal(size=900).round(2), "b": np.where(rng.random(900) < 0.5, 3.0, rng.integers(0, 7, 900)),
                      "c": rng.integers(-5, 5, 900) * 1e6, "d": 4.0})
    x.loc[rng.random(900) < 0.1, "a"] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x.to_numpy())]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = agg.rank_columns(df, ["a", "b", "c", "d"], "id").toPandas().sort_values("id")
    assert len(got) == 900
    for c in "abcd":
        assert np.allclose(got[c].to_numpy(float), x[c].rank().to_numpy(), equal_nan=True)


def test_many_edges_use_a_binary_search(spark, monkeypatch):
    monkeypatch.setattr(agg, "CASE_LIMIT", 3)
    monkeypatch.setattr(agg, "BROADCAST_VALUES", 0)
    values = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = agg.rank_columns(df, ["v"]).toPandas()["v"].to_numpy()
    assert sorted(got) == list(range(1, 501))


def plain_scores(before, n, total):
    ppf = NormalDist().inv_cdf
    q = []
    for i in range(before + 1, before + n + 1):
        p = 0.5 ** (1 / total) if i == total else 1 - 0.5 ** (1 / total) if i == 1 else (i - 0.3175) / (total + 0.365)
        q.append(ppf(p))
    return sum(q) / n, sum(x * x for x in q)


def test_normal_scores_equal_the_loop():
    runs = [(0, 1, 1), (0, 1, 50), (49, 1, 50), (3, 40, 50), (0, 5000, 5000), (0, 3000, 90_000), (87_000, 3000, 90_000), (40_000, 20_000, 90_000)]
    mean, squares = d.normal_scores(*(np.array(c) for c in zip(*runs)))
    for r, m, s in zip(runs, mean, squares):
        want = plain_scores(*r)
        assert m == pytest.approx(want[0], abs=1e-9) and s == pytest.approx(want[1], rel=1e-9, abs=1e-9)


def test_normal_quantiles_of_arrays():
    p = np.concatenate([np.linspace(0.001, 0.999, 97), [1e-300, 1e-20, 1 - 1e-12]])
    assert np.allclose(d.norm_ppf_array(p), [NormalDist().inv_cdf(v) for v in p], rtol=1e-13, atol=1e-13)
    assert d.norm_ppf(0.0) == -math.inf and d.norm_ppf(1.0) == math.inf and math.isnan(d.norm_ppf(1.5))


def test_studentized_range_at_any_df():
    # published upper points
    for p, k, df, want in ((.95, 3, 5, 4.602), (.95, 3, 60, 3.399), (.95, 4, 120, 3.685), (.99, 3, 5, 6.976),
                           (.95, 5, 10, 4.654), (.95, 10, 1e9, 4.474)):
        assert d.studentized_range_ppf(p, k, df) == pytest.approx(want, abs=1e-3)
    a, b, c = (d.studentized_range_ppf(0.95, 3, df) for df in (4999, 5001, 50_000))
    assert 0 < a - b < 1e-5 and b > c > 3.3145                      # no step at any df
    for q, df in ((0.5, 3), (3.0, 5), (8.0, 30), (12.0, 200)):       # two means: the t test
        assert d.studentized_range_sf(q, 2, df) == pytest.approx(d.t_sf_two_sided(q / math.sqrt(2), df), rel=1e-8)
    assert 0 < d.studentized_range_sf(15.0, 4, 1e6) < 1e-20 and 0 < d.studentized_range_sf(30.0, 3, 5000) < 1e-80


@pytest.mark.parametrize("most", [1 << 17, 700])
def test_density_is_near_the_direct_sum(spark, monkeypatch, most):
    """As they are, and with more values than may be collected, binned."""
    monkeypatch.setattr(agg, "KDE_MAX_BINS", most)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 800), rng.normal(9, 0.2, 200), np.full(50, 2.5)])
    rows = agg.kde_curve(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double"), "v", 60).collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 60)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (math.sqrt(2 * math.pi) * h * len(x))
    got = np.array([r["density"] for r in rows])
    assert np.allclose([r["x"] for r in rows], grid)
    width = (x.max() - x.min()) / min(most, agg.KDE_BINS * (x.max() - x.min()) / h)
    assert np.abs(got - want).max() <= (1e-12 if most > 1000 else 0.05 * (width / h) ** 2 / h)


def test_spearman_ranks_each_pair_on_its_own_rows_and_counts_once(spark, monkeypatch):
    """Holes, ties and a column without a pair; joined by broadcast and by key alike; the
    values are counted in one pass, not for every pair of columns."""
    import numpy as np
    import pandas as pd
    from kestrel.operators import aggregates as agg
    rng = np.random.default_rng(5)
    x = pd.DataFrame({"a": rng.integers(0, 9, 400), "b": rng.normal(size=400), "c": rng.integers(0, 3, 400), "d": np.nan}).astype(float)
    x["b"] += x["a"]
    for k, c in enumerate("abc"):
        x.loc[rng.random(400) < 0.1 * k, c] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x.to_numpy()]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    asked, ranked = [], agg.ranked_histogram
    monkeypatch.setattr(agg, "ranked_histogram", lambda *a, **k: asked.append(1) or ranked(*a, **k))
    for limit in (agg.BROADCAST_VALUES, 0):
        monkeypatch.setattr(agg, "BROADCAST_VALUES", limit)
        got = {(r["a"], r["b"]): r["corr"] for r in agg._ranked_pairs(df, list("abcd"), [(i, j) for i in range(4) for j in range(4)])
               .selectExpr("element_at(array('a','b','c','d'), i + 1) a", "element_at(array('a','b','c','d'), j + 1) b", "corr").collect()}
        assert len(got) == 16
        want = x.corr("spearman")
        for (i, j), v in got.items():
            assert (v is None and "d" in (i, j)) or abs(v - want.loc[i, j]) < 1e-12
    assert not asked


def test_target_correlations_by_sums(spark, monkeypatch):
    """Ties, NULLs in one column, a constant and a column without values, against pandas;
    the target's ranks come without a join or a sort of rows."""
    rng = np.random.default_rng(4)
    x = pd.DataFrame({"a": rng.integers(0, 9, 700).astype(float), "b": rng.normal(size=700), "c": 2.0, "d": np.nan,
                      "y": rng.integers(0, 200, 700).astype(float)})
    x["b"] += x["y"] / 50
    x.loc[rng.random(700) < 0.2, "b"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x.to_numpy()],
                               "a double, b double, c double, d double, y double")
    monkeypatch.setattr(agg, "BROADCAST_VALUES", 50)  # fewer than the target has
    monkeypatch.setattr(agg, "_rank_by_ranges", None)
    got = {r["column"]: r for r in stat_tests.target_spearman(df, "y", ["a", "b", "c", "d"]).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"]["spearman"] is None
    for c in "ab":
        both = x[[c, "y"]].dropna()
        assert got[c]["spearman"] == pytest.approx(both[c].rank().corr(both["y"].rank()))
        assert got[c]["pearson"] == pytest.approx(both[c].corr(both["y"])) and got[c]["n"] == len(both)


def test_information_without_a_join(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 30, 500), rng.normal(size=500).round(1), rng.normal(size=500)])
    x[:, 2] += x[:, 0] / 10
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0), (1.0, float("nan"), 1.0)], "a double, b double, y double")
    out = features.mutual_information(df, ["a", "b"], "y", bins=5)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    bins = [(x[:, i, None] > np.unique(np.quantile(x[:, i], [0.2, 0.4, 0.6, 0.8]))).sum(1) for i in range(3)]
    for r in out.collect():
        t = pd.crosstab(bins["ab".index(r["feature"])], bins[2]).to_numpy() / 500
        e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True)
        assert r["mutual_info"] == pytest.approx((t[t > 0] * np.log(t[t > 0] / e[t > 0])).sum())


def test_group_decision_takes_one_histogram(spark, monkeypatch):
    calls, real = [], stat_tests.value_histogram
    monkeypatch.setattr(stat_tests, "value_histogram", lambda *a: calls.append(a) or real(*a))
    rng = np.random.default_rng(6)
    rows = [(i, g, float(v)) for i, (g, v) in enumerate(zip(["a", "b", None] * 60, rng.exponential(size=180).round(1)))]
    df = spark.createDataFrame(rows + [(999, "a", None)], "id long, g string, v double")
    whole, pairs = stat_tests.compare_groups(df, "v", "g", "id")
    test, post = whole.first(), pairs.first()
    assert len(calls) == 1 and test["test"] == "kruskal"
    monkeypatch.undo()
    assert test["statistic"] == pytest.approx(stat_tests.kruskal_wallis(df, "v", "g").first()["H"])
    levels = spark.createDataFrame([("a", 0), ("b", 1)], "g string, pos int")
    assert post["statistic"] == stat_tests.mann_whitney_pairs(df, "v", "g", levels).first()["U_stat"]
    hist = real(df, "v", "g")
    assert stat_tests.levene_median(df, "v", "g", hist).first()["W"] == pytest.approx(stat_tests.levene_median(df, "v", "g").first()["W"])
