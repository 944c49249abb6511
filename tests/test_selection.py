"""Seeded exact selection, splits and KNN against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import missing, neighbors


def _h(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def test_split_exact_matches_brute_force_and_partitioning(spark):
    df = spark.range(0, 2003).withColumnRenamed("id", "rid")
    s1 = {r["rid"] for r in missing.train_test_split(df, "rid", 0.2, seed="9").where("split = 'test'").collect()}
    s2 = {r["rid"] for r in missing.train_test_split(df.repartition(7), "rid", 0.2, seed="9")
          .where("split = 'test'").collect()}
    brute = set(sorted(range(2003), key=lambda i: (_h("9", "split", i), i))[:401])
    assert s1 == brute == s2


def test_stratified_and_subsample(spark):
    df = spark.range(0, 500).select(F.col("id").alias("rid"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = missing.train_test_split(df, "rid", 0.2, stratify="y")
    got = {(r["y"]): r["n"] for r in s.where("split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 34, 0: 67}
    sub = missing.subsample(df, "rid", 50, by="y")
    assert sorted(r["n"] for r in sub.groupBy("y").agg(F.count("*").alias("n")).collect()) == [50, 50]


def test_inject_exact_counts(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("rid"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    out, pos = missing.inject_missing(df, ["a", "b"], "rid", seed="3", mode="exact")
    for c in ("a", "b"):
        k = missing.exact_injection_count(1000, missing.injection_fraction(c, "3"))
        assert out.where(F.col(c).isNull()).count() == k
        brute = set(sorted(range(1000), key=lambda i: (_h("3", c, i), i))[:k])
        assert {r["rid"] for r in pos.where(F.col("column") == c).collect()} == brute


@pytest.mark.parametrize("block", [7, 8192])
def test_knn_impute_matches_naive(spark, monkeypatch, block):
    """Also over many small blocks; the fixture has ties, exact matches and an unfillable row."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    x = rng.integers(-6, 7, size=(60, 3)) / 4  # exact differences, so ties are ties
    x[rng.random(x.shape) < 0.2] = np.nan
    x[50:55] = x[10:15]
    x[59] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], f"k{i}") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "rid long, a double, b double, c double, other string")
    out = neighbors.knn_impute(df, df, ["a", "b", "c"], "rid", k=5, scale=False)
    assert out.columns == df.columns
    got = {r["rid"]: r for r in out.collect()}
    assert len(got) == 60 and all(got[i]["other"] == f"k{i}" for i in got)
    means = np.nanmean(x, axis=0)
    for r in range(60):
        for j, c in enumerate("abc"):
            if not np.isnan(x[r, j]):
                assert got[r][c] == x[r, j]
                continue
            ds = []
            for i in range(60):
                shared = ~np.isnan(x[r]) & ~np.isnan(x[i])
                if np.isnan(x[i, j]) or not shared.any():
                    continue
                ds.append((np.sqrt(((x[r, shared] - x[i, shared]) ** 2).sum() * 3 / shared.sum()), i))
            top = sorted(ds)[:5]
            zero = [x[i, j] for d, i in top if d == 0]
            want = (means[j] if not top else np.mean(zero) if zero
                    else sum(x[i, j] / d for d, i in top) / sum(1 / d for d, _ in top))
            assert got[r][c] == pytest.approx(want, abs=1e-9), (r, c)


def test_knn_impute_takes_any_number_of_donors(spark):
    donors = spark.range(210_000).select(F.col("id").alias("rid"), F.col("id").cast("double").alias("a"),
                                         (F.col("id") * 2).cast("double").alias("b"))
    asked = spark.createDataFrame([(1, 209_000.25, None), (2, 17.0, None)], "rid long, a double, b double")
    got = {r["rid"]: r["b"] for r in neighbors.knn_impute(asked, donors, ["a", "b"], "rid", k=1, scale=False).collect()}
    assert got == pytest.approx({1: 418_000.0, 2: 34.0})


def test_smote_balances_exactly_between_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(8)
    few = {i: rng.normal(size=2) for i in range(11)}
    rows = [(i, *map(float, v), 1) for i, v in few.items()] + [(100 + i, 0.0, 0.0, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "rid long, a double, b double, y int")
    out = neighbors.smote(df, ["a", "b"], "y", "rid", k=3).collect()
    new = [r for r in out if r["rid"] < 0]
    assert len(new) == 29 and len({r["rid"] for r in out}) == 80 and sum(r["y"] == 1 for r in out) == 40
    for r in new:  # on the segment between its row and one of that row's three nearest
        i, x = divmod(-r["rid"], 29 // 11 + 2)[0], np.array([r["a"], r["b"]])
        near = sorted((np.linalg.norm(few[i] - few[j]), j) for j in few if j != i)[:3]
        assert min(np.linalg.norm(x - few[i]) + np.linalg.norm(x - few[j]) - d for d, j in near) < 1e-9
    assert neighbors.smote(df, ["a", "b"], "y", "rid", minority=0).count() == 51


def test_minority_is_compared_once_for_all_folds(spark, monkeypatch):
    """The new rows of each fold are those that SMOTE makes of the rows outside it alone."""
    from kestrel.operators import comparison
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(60, 3)), 1)  # some ties
    rows = [(i, *map(float, v), int(i % 4 == 0), i % 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "rid long, a double, b double, c double, y int, fold int")
    calls, real = [], neighbors._in_block_pairs
    monkeypatch.setattr(neighbors, "_in_block_pairs", lambda *a: calls.append(1) or real(*a))
    places = {0: 1, 1: 2, 2: 3, -1: 4}
    made = comparison._oversampled(df, ["a", "c"], "y", "rid", list(places), places, ["a", "b", "c"], 42)
    got = {s: sorted(tuple(r["x"]) for m in made for r in m.where(F.col("s") == s).collect()) for s in places.values()}
    assert len(calls) == 1
    for fold, place in places.items():
        alone = neighbors.smote(df.where(F.col("fold") != fold), ["a", "c"], "y", "rid").where("rid < 0")
        assert got[place] == sorted((r["a"], 0.0, r["c"]) for r in alone.collect()) and got[place]


def test_iterative_impute_recovers_linear_relation(spark):
    from kestrel.operators.imputation import iterative_impute
    rows = []
    for i in range(200):
        a = float(i % 17)
        b = 3.0 * a + 2.0
        if i % 10 == 0:
            b = None
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "rid long, a double, b double")
    out = {r["rid"]: r for r in iterative_impute(df, ["a", "b"], rounds=3).collect()}
    for i, a, b in rows:
        assert out[i]["a"] == a
        assert out[i]["b"] == pytest.approx(3.0 * a + 2.0, abs=1e-6)


def test_subsample_ranks_few_rows(spark, monkeypatch):
    """The rows that are ranked are those of low hash; repeated ids, whose hashes are no
    longer spread, get the whole way.  Both equal a plain sort."""
    ranked, real = [], missing.smallest_k_cutoff
    monkeypatch.setattr(missing, "smallest_k_cutoff", lambda d, *a, **k: ranked.append(d.count()) or real(d, *a, **k))
    spread = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(6000)], "id long, g string")
    got = {(r["g"], r["id"]) for r in missing.subsample(spread, "id", 20, by="g").collect()}
    h = sorted((_h(411, "sample", i), i) for i in range(6000))
    want = {("a" if multiple else None, i) for multiple in (0, 1) for _, i in [x for x in h if bool(x[1] % 3) == bool(multiple)][:20]}
    assert got == want and ranked[0] < 1000
    high = h[-1][1]
    same = spark.createDataFrame([(high, "a")] * 3000, "id long, g string")
    assert missing.subsample(same, "id", 20, by="g").count() >= 20 and ranked[1] == 3000
