"""The model frame's passes: what is fitted comes before the folds, rows are written once."""

import datetime
import os

from kestrel.operators import missing as mm
from kestrel.plans import q_models


def _tables(spark, folder):
    day = datetime.datetime(2020, 1, 1)
    lines = [(k, k % 7, k % 3, 1 + k % 4, float(1 + k % 50), 100.0 + k, k % 11 / 100, k % 9 / 100, "ANR"[k % 3], "FO"[k % 2],
              day + datetime.timedelta(k)) for k in range(300)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                                 "l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    parts = [(k, 5 + k, 900.0 + k, f"Brand#{k % 2}", f"T{k % 3}") for k in range(7)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double, p_brand string, p_type string"
                          ).write.parquet(f"{folder}/part.parquet")


def test_model_frame_fits_before_folds_and_is_written_as_parquet(spark, tmp_path, monkeypatch):
    _tables(spark, str(tmp_path))
    calls = []
    for name in ("kfold", "fit_simple_imputer", "levels_of"):
        old = getattr(mm, name)
        monkeypatch.setattr(mm, name, lambda *a, _o=old, _n=name, **k: calls.append(_n) or _o(*a, **k))
    h, feats, y = q_models.model_frame(spark, str(tmp_path), brands=True)
    assert calls[-1] == "kfold" and calls.count("levels_of") == 2
    assert h.inputFiles() and all(f.endswith(".parquet") for f in h.inputFiles())
    rows = h.collect()
    assert {f for f in feats if f.startswith("genre_")} == {"genre_T0", "genre_T1", "genre_T2", "genre_Brand#0", "genre_Brand#1"}
    assert all(r[f] is not None for r in rows for f in [*feats, y])
    sizes = [sum(r["fold"] == k for r in rows) for k in range(5)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1


def test_medians_come_from_counts(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, None, None), (4.0, 5.0, None), (9.0, 7.0, None)],
                               "a double, b double, c double")
    seen, old = [], mm.exact_quantiles
    monkeypatch.setattr(mm, "exact_quantiles", lambda rows, *a, **k: seen.append(rows) or old(rows, *a, **k))
    fills = mm.fit_simple_imputer(df, ["a", "b", "c"])
    assert fills == {"a": 3.0, "b": 5.0} and seen == [None]


def test_pca_export_is_compressed_csv_and_reads_back_exactly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_models, "scratch_dir", lambda spark, name="": str(tmp_path / name))
    rows = [(i, i / 3, ((i * 37) % 101) / 7, ((i * 53) % 97) / 11, float(i), i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "rid long, a double, b double, c double, price double, fold int")
    train, test = df.where("rid % 5 > 0"), df.where("rid % 5 = 0")
    plain_train, plain_test, names, _ = q_models.pca_variant(train, test, ["a", "b", "c"], "price")
    tr, te, pcs, _ = q_models.export_pca(spark, train, test, ["a", "b", "c"], "price", "pca")
    assert pcs == names
    for part, back, plain in (("train", tr, plain_train), ("test", te, plain_test)):
        files = [f for f in os.listdir(tmp_path / "pca" / f"{part}.csv") if f.startswith("part-")]
        assert files and all(f.endswith(".csv.gz") for f in files)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, plain.collect()))
