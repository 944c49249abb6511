"""Queries: missing-data handling and encodings (M*, J*, V1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions.hashing import hash32
from kestrel.operators import missing as mm
from kestrel.operators.neighbors import knn_impute
from kestrel.plans.frames import (BIN_SQL, HOLES_SQL, WIDE_FEATURES, WIDE_NUMERIC, WIDE_SQL, bin_frame, holes,
                                  table, vec_frame, wide)
from kestrel.plans.q_clean import exact_injection_sql, split_sql
from kestrel.plans.registry import register, round_doubles

W = f"WITH wide AS ({WIDE_SQL})"
H = f"WITH holes AS ({HOLES_SQL})"
CHK = 1000003  # checksum modulus for id sets


def _checksum(col):
    return F.sum(F.col(col) % CHK).cast("bigint")


# ---------------------------------------------------------------- M1
@register("M1_inject_exact", f"""{W}
SELECT "column", count(*) AS na_count, CAST(sum(rid % {CHK}) AS BIGINT) AS id_checksum
FROM {exact_injection_sql('wide', WIDE_NUMERIC, seed='7')} GROUP BY "column" """)
def q_m1(spark, sf_dir):
    _, pos = mm.inject_missing(wide(spark, sf_dir), WIDE_NUMERIC, "rid", seed="7", mode="exact")
    return pos.groupBy("column").agg(F.count(F.lit(1)).alias("na_count"), _checksum("rid").alias("id_checksum"))


@register("M1_inject_threshold", f"""{H}
{' UNION ALL '.join(f"SELECT '{c}' AS \"column\", count(*) AS na_count, CAST(sum(rid % {CHK}) AS BIGINT) AS id_checksum FROM holes WHERE {c} IS NULL" for c in WIDE_NUMERIC)}""")
def q_m1t(spark, sf_dir):
    _, pos = mm.inject_missing(wide(spark, sf_dir), WIDE_NUMERIC, "rid", seed="42", mode="threshold")
    return pos.groupBy("column").agg(F.count(F.lit(1)).alias("na_count"), _checksum("rid").alias("id_checksum"))


# ---------------------------------------------------------------- M2
@register("M2_na_indicators", f"""{H}
SELECT {', '.join(f"count(*) - count({c}) AS {c}_missing" for c in WIDE_NUMERIC)} FROM holes""")
def q_m2(spark, sf_dir):
    h = mm.na_indicators(holes(spark, sf_dir), WIDE_NUMERIC)
    return h.agg(*[F.sum(f"{c}_missing").cast("bigint").alias(f"{c}_missing") for c in WIDE_NUMERIC])


# ---------------------------------------------------------------- M3
EV_LVL_SQL = "(SELECT event_id, regexp_extract(props, '[0-9]+') AS lvl FROM events)"


@register("M3_rare_levels_train_fit", f"""
WITH e AS {EV_LVL_SQL}, s AS {split_sql('e', 'event_id')},
cnt AS (SELECT coalesce(lvl, 'Missing') AS lvl, count(*) AS c FROM s WHERE split = 'train' GROUP BY 1)
SELECT CASE WHEN cnt.c < 80 AND e.lvl <> 'Missing' THEN 'Other' ELSE coalesce(e.lvl, 'Missing') END AS lvl,
       count(*) AS n
FROM e LEFT JOIN cnt ON coalesce(e.lvl, 'Missing') = cnt.lvl GROUP BY 1""")
def q_m3(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("lvl"))
    train = mm.train_test_split(ev, "event_id", 0.2, seed="42").where(F.col("split") == "train")
    merged = mm.merge_rare_levels(train, ev, "lvl", min_count=80)
    return merged.groupBy("lvl").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- M4-M6
@register("M4_one_hot_all_levels", f"""{W}
SELECT 'genre_' || ptype AS feature, count(*) AS total FROM wide GROUP BY ptype""")
def q_m4(spark, sf_dir):
    oh = mm.one_hot(wide(spark, sf_dir), "ptype", prefix="genre")
    feats = [c for c in oh.columns if c.startswith("genre_")]
    row = oh.agg(*[F.sum(c).cast("bigint").alias(c) for c in feats])
    return row.unpivot([], feats, "feature", "total")


@register("M5_one_hot_drop_first", f"""{W}
SELECT 'ptype_' || ptype AS feature, count(*) AS total FROM wide
WHERE ptype > (SELECT min(ptype) FROM wide) GROUP BY ptype""")
def q_m5(spark, sf_dir):
    oh = mm.one_hot(wide(spark, sf_dir), "ptype", drop_first=True)
    feats = [c for c in oh.columns if c.startswith("ptype_")]
    row = oh.agg(*[F.sum(c).cast("bigint").alias(c) for c in feats])
    return row.unpivot([], feats, "feature", "total")


@register("M6_sparse_one_hot_unknown_zero", f"""{W},
s AS {split_sql('wide', 'rid')},
lv AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS idx, count(*) OVER () AS k
       FROM (SELECT DISTINCT brand FROM s WHERE split = 'train' AND brand <> 'Brand#7'))
SELECT w.brand, CAST((SELECT max(k) FROM lv) AS INTEGER) AS size, CAST(coalesce(lv.idx, -1) AS INTEGER) AS hot,
       count(*) AS n
FROM wide w LEFT JOIN lv ON w.brand = lv.brand GROUP BY w.brand, hot""")
def q_m6(spark, sf_dir):
    """Encoder fitted on training rows that never saw 'Brand#7': every seen
    level keeps its own slot and the unseen level is the zero vector (hot = -1)."""
    from pyspark.ml.functions import vector_to_array
    w = wide(spark, sf_dir)
    s = mm.train_test_split(w, "rid", 0.2, seed="42")
    fit = s.where((F.col("split") == "train") & (F.col("brand") != "Brand#7"))
    enc = mm.sparse_one_hot(fit, w.select("rid", "brand"), "brand", out="ohe")
    arr = vector_to_array("ohe")
    hot = F.array_position(arr, 1.0).cast("int") - 1
    return (enc.select("brand", F.size(arr).cast("int").alias("size"), hot.alias("hot"))
               .groupBy("brand", "size", "hot").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- M7, M16
@register("M7_simple_impute_train_fit", f"""{H},
s AS {split_sql('holes', 'rid')},
f AS (SELECT {', '.join(f"median({c}) AS {c}" for c in WIDE_NUMERIC)} FROM s WHERE split = 'train')
SELECT {', '.join(f"round(sum(coalesce(h.{c}, f.{c})), 4) AS {c}" for c in WIDE_NUMERIC)} FROM holes h, f""")
def q_m7(spark, sf_dir):
    h = holes(spark, sf_dir)
    s = mm.train_test_split(h, "rid", 0.2, seed="42")
    fills = mm.fit_simple_imputer(s.where(F.col("split") == "train"), WIDE_NUMERIC)
    filled = mm.apply_fills(h, fills)
    return round_doubles(filled.agg(*[F.sum(c).alias(c) for c in WIDE_NUMERIC]), 4)


@register("M7_mode_impute_categorical", """
WITH e AS (SELECT event_id, CASE WHEN ('0x' || substr(md5(concat_ws('|', '5', 'event_type', event_id)), 1, 8))::BIGINT
                  < 429496730 THEN NULL ELSE event_type END AS event_type FROM events),
m AS (SELECT event_type AS fill FROM e WHERE event_type IS NOT NULL GROUP BY event_type
      ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT coalesce(event_type, fill) AS event_type, count(*) AS n FROM e, m GROUP BY 1""")
def q_m7c(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ev = ev.select("event_id", F.when(hash32(F.lit("5"), F.lit("event_type"), F.col("event_id")) < 429496730,
                                      F.lit(None)).otherwise(F.col("event_type")).alias("event_type"))
    fills = mm.fit_simple_imputer(ev, [], ["event_type"])
    return mm.apply_fills(ev, fills).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("M16_full_vs_train_fit", f"""{H},
s AS {split_sql('holes', 'rid')}
{' UNION ALL '.join(f"SELECT '{c}' AS \"column\", round((SELECT median({c}) FROM holes), 6) AS fill_full, round((SELECT median({c}) FROM s WHERE split = 'train'), 6) AS fill_train" for c in WIDE_NUMERIC)}""")
def q_m16(spark, sf_dir):
    h = holes(spark, sf_dir)
    s = mm.train_test_split(h, "rid", 0.2, seed="42")
    full = mm.fit_simple_imputer(h, WIDE_NUMERIC)
    tr = mm.fit_simple_imputer(s.where(F.col("split") == "train"), WIDE_NUMERIC)
    rows = [(c, float(full[c]), float(tr[c])) for c in WIDE_NUMERIC]
    return round_doubles(spark.createDataFrame(rows, "column string, fill_full double, fill_train double"))


# ---------------------------------------------------------------- M8 KNN
VEC_COLS = [f"e{i}" for i in range(8)]


def _vec_holes_sql():
    cols = ", ".join(
        f"CASE WHEN ('0x' || substr(md5(concat_ws('|', '3', '{c}', vec_id)), 1, 8))::BIGINT < 429496730 "
        f"THEN NULL ELSE CAST(embedding[{i + 1}] AS DOUBLE) END AS {c}" for i, c in enumerate(VEC_COLS))
    return f"SELECT vec_id, {cols} FROM embeddings"


def _vec_holes(spark, sf_dir):
    v = vec_frame(spark, sf_dir, len(VEC_COLS))
    return v.select("vec_id", *[F.when(hash32(F.lit("3"), F.lit(c), F.col("vec_id")) < 429496730, F.lit(None))
                                .otherwise(F.col(c)).alias(c) for c in VEC_COLS])


def _knn_sql():
    p = len(VEC_COLS)
    z = ", ".join(f"({c} - (SELECT avg({c}) FROM v)) / coalesce(nullif((SELECT stddev_pop({c}) FROM v), 0), 1) AS {c}"
                  for c in VEC_COLS)
    shared = " + ".join(f"CAST(r.{c} IS NOT NULL AND d.{c} IS NOT NULL AS INTEGER)" for c in VEC_COLS)
    sq = " + ".join(f"coalesce(power(r.{c} - d.{c}, 2), 0)" for c in VEC_COLS)
    per_col = []
    for c in VEC_COLS:
        per_col.append(f"""
SELECT rid, '{c}' AS col, CASE WHEN max(CAST(dist = 0 AS INTEGER)) = 1
        THEN avg(CASE WHEN dist = 0 THEN val END) ELSE sum(val / dist) / sum(1 / dist) END AS fill
FROM (SELECT r.vec_id AS rid, d.{c} AS val, pr.dist,
             row_number() OVER (PARTITION BY r.vec_id ORDER BY pr.dist, d.vec_id) AS rn
      FROM z r JOIN pr ON pr.rid = r.vec_id JOIN z d ON d.vec_id = pr.did
      WHERE r.{c} IS NULL AND d.{c} IS NOT NULL AND pr.dist IS NOT NULL)
WHERE rn <= 5 GROUP BY rid""")
    fills = " UNION ALL ".join(per_col)
    sel = ", ".join(f"round(coalesce(z.{c}, (SELECT fill FROM f WHERE f.rid = z.vec_id AND f.col = '{c}'), "
                    f"(SELECT avg({c}) FROM z)), 6) AS {c}" for c in VEC_COLS)
    return f"""WITH v AS ({_vec_holes_sql()}),
z AS (SELECT vec_id, {z} FROM v),
pr AS (SELECT r.vec_id AS rid, d.vec_id AS did,
              CASE WHEN ({shared}) > 0 THEN sqrt(({sq}) * {p} / ({shared})) END AS dist
       FROM z r, z d WHERE {' OR '.join(f'r.{c} IS NULL' for c in VEC_COLS)}),
f AS ({fills})
SELECT vec_id, {sel} FROM z"""


@register("M8_knn_impute", _knn_sql())
def q_m8(spark, sf_dir):
    v = _vec_holes(spark, sf_dir)
    return round_doubles(knn_impute(v, v, VEC_COLS, "vec_id", k=5))


VEC_ALL = [f"e{i}" for i in range(64)]


def _knn_all_sql():
    """All 64 dimensions, as lists."""
    cells = ", ".join(
        f"CASE WHEN ('0x' || substr(md5(concat_ws('|', '3', '{c}', vec_id)), 1, 8))::BIGINT < 429496730 "
        f"THEN NULL ELSE CAST(embedding[{i + 1}] AS DOUBLE) END" for i, c in enumerate(VEC_ALL))
    out = ", ".join(f"round(max(CASE WHEN j = {i + 1} THEN v END), 6) AS {c}" for i, c in enumerate(VEC_ALL))
    return f"""WITH v AS (SELECT vec_id, [{cells}] AS x FROM embeddings),
c AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM v),
st AS (SELECT j, avg(v) AS m, coalesce(nullif(stddev_pop(v), 0), 1) AS s FROM c GROUP BY j),
zc AS MATERIALIZED (SELECT vec_id, j, (v - m) / s AS v FROM c JOIN st USING (j)),
pr AS MATERIALIZED (
  SELECT r.vec_id AS rid, d.vec_id AS did, sqrt(sum((r.v - d.v) * (r.v - d.v)) * 64 / count(*)) AS dist
  FROM zc r JOIN zc d USING (j) WHERE r.v IS NOT NULL AND d.v IS NOT NULL GROUP BY ALL),
n AS (
  SELECT r.vec_id, r.j, d.v, dist, row_number() OVER (PARTITION BY r.vec_id, r.j ORDER BY dist, d.vec_id) AS rn
  FROM zc r JOIN pr ON pr.rid = r.vec_id JOIN zc d ON d.vec_id = pr.did AND d.j = r.j
  WHERE r.v IS NULL AND d.v IS NOT NULL),
f AS (
  SELECT vec_id, j, CASE WHEN max(CAST(dist = 0 AS INTEGER)) = 1 THEN avg(CASE WHEN dist = 0 THEN v END)
    ELSE sum(v / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) END AS fill FROM n WHERE rn <= 5 GROUP BY ALL),
whole AS (SELECT vec_id, j, coalesce(zc.v, fill, 0.0) AS v FROM zc LEFT JOIN f USING (vec_id, j))
SELECT vec_id, {out} FROM whole GROUP BY vec_id"""


@register("M8_knn_impute_all_dimensions", _knn_all_sql())
def q_m8_all(spark, sf_dir):
    """All 64 dimensions of ``embeddings`` with a tenth of the cells missing, all rows donors."""
    v = vec_frame(spark, sf_dir, 64)
    v = v.select("vec_id", *[F.when(hash32(F.lit("3"), F.lit(c), F.col("vec_id")) < 429496730, F.lit(None))
                             .otherwise(F.col(c)).alias(c) for c in VEC_ALL])
    return round_doubles(knn_impute(v, v, VEC_ALL, "vec_id", k=5))


@register("M16_knn_full_and_train_fit")
def q_m16_knn(spark, sf_dir):
    """KNN imputation of all rows, with donors and scaler from all rows and from the
    training rows alone; back in units of the columns."""
    h = mm.train_test_split(holes(spark, sf_dir), "rid", 0.2, seed="42").select("rid", "split", *WIDE_FEATURES).checkpoint()
    full = knn_impute(h, h, WIDE_FEATURES, "rid", inverse_scale=True)
    safe = knn_impute(h, h.where(F.col("split") == "train"), WIDE_FEATURES, "rid", inverse_scale=True)
    names = [F.round(F.col(c), 6).alias(c) for c in WIDE_FEATURES]
    return (full.select(F.lit("full").alias("fit"), "rid", "split", *names)
            .unionByName(safe.select(F.lit("train").alias("fit"), "rid", "split", *names)))


# ---------------------------------------------------------------- M12-M14, V1
@register("M12_split_exact", f"""{W}
SELECT split, count(*) AS n, CAST(sum(rid % {CHK}) AS BIGINT) AS id_checksum FROM {split_sql('wide', 'rid')} GROUP BY split""")
def q_m12(spark, sf_dir):
    s = mm.train_test_split(wide(spark, sf_dir), "rid", 0.2, seed="42")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), _checksum("rid").alias("id_checksum"))


@register("M12_split_threshold", f"""{W}
SELECT CASE WHEN ('0x' || substr(md5(concat_ws('|', '42', 'split', rid)), 1, 8))::BIGINT / 4294967296.0 < 0.2
            THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM wide GROUP BY 1""")
def q_m12t(spark, sf_dir):
    s = mm.train_test_split(wide(spark, sf_dir), "rid", 0.2, seed="42", mode="threshold")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("M13_stratified_split", f"""
WITH b AS ({BIN_SQL})
SELECT quality, split, count(*) AS n, CAST(sum(doc_id % {CHK}) AS BIGINT) AS id_checksum
FROM {split_sql('b', 'doc_id', strat='quality')} GROUP BY quality, split""")
def q_m13(spark, sf_dir):
    s = mm.train_test_split(bin_frame(spark, sf_dir), "doc_id", 0.2, seed="42", stratify="quality")
    return s.groupBy("quality", "split").agg(F.count(F.lit(1)).alias("n"), _checksum("doc_id").alias("id_checksum"))


@register("M14_subsample_per_group", f"""{W}
SELECT brand, count(*) AS n, CAST(sum(rid % {CHK}) AS BIGINT) AS id_checksum FROM (
  SELECT *, row_number() OVER (PARTITION BY brand ORDER BY
         ('0x' || substr(md5(concat_ws('|', '411', 'sample', rid)), 1, 8))::BIGINT, rid) AS rn FROM wide)
WHERE rn <= 500 GROUP BY brand""")
def q_m14(spark, sf_dir):
    s = mm.subsample(wide(spark, sf_dir), "rid", 500, seed="411", by="brand")
    return s.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), _checksum("rid").alias("id_checksum"))


@register("V1_kfold_assignment", f"""{W}
, f AS (
  SELECT rid, CAST((row_number() OVER (
    ORDER BY ('0x' || substr(md5(concat_ws('|', '42', 'fold', rid)), 1, 8))::BIGINT, rid) - 1) % 5 AS INTEGER) AS fold FROM wide)
SELECT fold, count(*) AS n, min(rid) AS first_id, max(rid) AS last_id FROM f GROUP BY fold""")
def q_v1(spark, sf_dir):
    return mm.kfold(wide(spark, sf_dir), "rid", 5).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_id"), F.max("rid").alias("last_id"))


# ---------------------------------------------------------------- M15 / J1, J2
KEYS = ["returnflag", "linestatus", "ptype", "brand"]


@register("M15_J1_restore_target", f"""{H},
ref AS (SELECT {', '.join(KEYS)}, median(price) AS ref FROM ({WIDE_SQL}) GROUP BY {', '.join(KEYS)}),
j AS (SELECT h.*, r.ref FROM holes h LEFT JOIN ref r ON {' AND '.join(f'h.{k} IS NOT DISTINCT FROM r.{k}' for k in KEYS)})
SELECT count(*) FILTER (WHERE price IS NULL AND ref IS NOT NULL) AS n_filled,
       count(*) - count(coalesce(price, ref)) AS n_still_missing,
       round(sum(coalesce(price, ref)), 2) AS total_price FROM j""")
def q_m15(spark, sf_dir):
    r = mm.restore_from_reference(holes(spark, sf_dir), wide(spark, sf_dir), KEYS, "price")
    return round_doubles(r.agg(F.sum("_filled").cast("bigint").alias("n_filled"),
                               F.count_if(F.col("price").isNull()).alias("n_still_missing"),
                               F.sum("price").alias("total_price")), 2)


@register("J2_column_bind_by_row_id", f"""{H}
SELECT count(*) AS n, round(sum(h.quantity * w.price), 2) AS s
FROM holes h JOIN ({WIDE_SQL}) w ON h.rid = w.rid""")
def q_j2(spark, sf_dir):
    left = holes(spark, sf_dir).select("rid", "quantity")
    right = wide(spark, sf_dir).select("rid", "price")
    b = mm.column_bind(left, right, "rid")
    return round_doubles(b.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quantity") * F.col("price")).alias("s")), 2)
