"""Windows, leaderboards, sources and describe against brute force."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kestrel.operators import aggregates as agg
from kestrel.operators import clean, models, windows
from kestrel.sources import io


def test_top_n_and_first_per_group_match_row_number(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", float((i * 37) % 101), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = {(r["g"], r["id"]) for r in windows.top_n_per_group(df, "g", [("v", "desc"), ("id", "asc")], 3).collect()}
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["g", "v", "id"]).sort_values(["g", "v", "id"], ascending=[True, False, True])
    want = {(g, i) for g, sub in pdf.groupby("g") for i in sub["id"].head(3)}
    assert got == want
    first = {r["g"]: r["id"] for r in windows.first_per_group(df, "g", [("v", "desc"), ("id", "asc")]).collect()}
    assert first == {g: sub["id"].iloc[0] for g, sub in pdf.groupby("g")}


def test_keep_first_is_min_order(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 2, "w")], "k string, o int, v string")
    got = {r["k"]: r["v"] for r in clean.keep_first(df, ["k"], "o").collect()}
    assert got == {"a": "y", None: "w"}


def test_leaderboard_flags_overall_best(spark):
    df = spark.createDataFrame([("v1", "ols", 3.0, 1.0), ("v1", "ridge", 2.0, 9.0), ("v2", "ols", 2.5, 0.0),
                                ("v2", "lasso", 2.0, 8.0)], "variant string, model string, rmse double, mae double")
    out = {(r["variant"], r["model"]): r["selected"]
           for r in models.leaderboard(df, [("rmse", "asc"), ("mae", "asc")]).collect()}
    assert out == {("v1", "ridge"): 0, ("v2", "lasso"): 1}


def test_na_map_json_reader(spark):
    d = tempfile.mkdtemp(prefix="kestrel-test-json-")
    path = os.path.join(d, "na.json")
    with open(path, "w") as fh:
        json.dump({"a": ["1", "5"], "b": ["2"]}, fh, indent=2)
    got = sorted((r["column"], r["row_id"]) for r in io.read_na_map_json(spark, path).collect())
    assert got == [("a", "1"), ("a", "5"), ("b", "2")]


def test_csv_roundtrip_and_numeric_detection(spark):
    df = spark.createDataFrame([(1, "x", 1.5), (2, None, None), (3, "NA", 2.0)], "id int, s string, v double")
    d = tempfile.mkdtemp(prefix="kestrel-test-csv-")
    io.write_csv(df, d + "/t", na_rep="NA")
    back = io.read_csv(spark, d + "/t", df.schema)
    assert sorted(back.collect(), key=lambda r: r["id"]) == [(1, "x", 1.5), (2, None, None), (3, None, 2.0)]
    kinds = {r["column"]: r["is_numeric"] for r in io.detect_numeric(io.read_csv_text(spark, d + "/t")).collect()}
    assert kinds == {"id": True, "s": False, "v": True}


def test_describe_numeric_matches_pandas(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    vals = rng.integers(0, 20, 301).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = agg.describe_numeric(df, ["x"]).collect()[0]
    import pandas as pd
    s = pd.Series(vals).describe()
    for k, pk in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                  ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert r[k] == pytest.approx(s[pk])


def test_value_counts_keeps_null(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "c string")
    vc = {r["c"]: r["n"] for r in agg.value_counts(df, "c").collect()}
    assert vc == {None: 2, "a": 1, "b": 1}
    assert F is not None


def test_correlation_is_pairwise_at_any_width(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 45))
    x[:, 1] += x[:, 0]
    cols = [f"c{i}" for i in range(45)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    m = {(r["i"], r["j"]): r["corr"] for r in agg.correlation_matrix(df, cols).collect()}
    ref = np.corrcoef(x, rowvar=False)
    assert m[(0, 1)] == pytest.approx(ref[0, 1], abs=1e-9)
    assert m[(10, 44)] == pytest.approx(ref[10, 44], abs=1e-9)
    import pandas as pd
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 2] = 7.0
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    for width in (6, 45):
        holes = spark.createDataFrame([r[:width] for r in rows], ", ".join(f"{c} double" for c in cols[:width]))
        ref = pd.DataFrame(x[:, :width]).corr(min_periods=2).to_numpy()
        for r in agg.correlation_matrix(holes, cols[:width]).collect():
            want = ref[r["i"], r["j"]]
            assert (r["corr"] is None) if 2 in (r["i"], r["j"]) else r["corr"] == pytest.approx(want, abs=1e-9)


def test_spearman_is_pairwise(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, size=(80, 4)).astype(float)
    x[:, 1] += x[:, 0]
    x[::3, 2] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double")
    frame = pd.DataFrame(x)
    for r in agg.correlation_matrix(df, list("abcd"), "spearman").collect():
        both = frame[[r["i"], r["j"]]].dropna() if r["i"] != r["j"] else frame[[r["i"]]].dropna()
        ranks = both.rank()
        want = np.corrcoef(ranks.iloc[:, 0], ranks.iloc[:, -1])[0, 1]
        assert r["corr"] == pytest.approx(want, abs=1e-9)


def test_levels_are_bounded(spark, monkeypatch):
    from kestrel.operators import missing, stat_tests
    df = spark.createDataFrame([(c, d) for c in "abcd" for d in "xy"], "c string, d string")
    assert missing.levels_of(df, "c") == ["a", "b", "c", "d"]
    monkeypatch.setattr(missing, "MAX_LEVELS", 3)
    with pytest.raises(ValueError):
        missing.levels_of(df, "c")
    assert stat_tests.odds_ratio_2x2(df, "c", "d").first()[0] is None
    assert stat_tests.odds_ratio_2x2(df.where("c in ('a', 'b')"), "c", "d").first()[0] == pytest.approx(1.0)


def test_average_precision_without_positives(spark):
    from kestrel.operators.models import average_precision
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "y int, score double")
    assert average_precision(df, "y").first()[0] is None
