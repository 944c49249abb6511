"""Queries: sources and sinks, projection / predicates / rules, duplicates
(S*, P*, D*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators import clean
from kestrel.operators.missing import inject_missing, train_test_split
from kestrel.plans.frames import (HOLES_SQL, LINEITEM_ROW_ID_SQL, WIDE_NUMERIC, WIDE_SQL, holes, lineitem_row_id,
                                  table, wide)
from kestrel.plans.registry import register, round_doubles
from kestrel.session import scratch_dir
from kestrel.sources import io

W = f"WITH wide AS ({WIDE_SQL})"
H = f"WITH holes AS ({HOLES_SQL})"
HOLES_SCHEMA = T.StructType([
    T.StructField("rid", T.LongType()), T.StructField("returnflag", T.StringType()),
    T.StructField("linestatus", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("ptype", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in WIDE_NUMERIC]])
HOLES_COLS = [f.name for f in HOLES_SCHEMA.fields]


def _holes_csv(spark, sf_dir):
    path = scratch_dir(spark, "holes-csv")
    io.write_csv(holes(spark, sf_dir).select(*HOLES_COLS), path, na_rep="NA")
    return path


# ---------------------------------------------------------------- sources
@register("S1_S6_csv_roundtrip_na", f"""{H}
SELECT {', '.join(HOLES_COLS)} FROM holes""")
def q_s1(spark, sf_dir):
    """holes -> CSV with NA markers -> typed read with NA tokens -> same rows."""
    return io.read_csv(spark, _holes_csv(spark, sf_dir), HOLES_SCHEMA)


@register("S2_csv_pandas_na_tokens", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type, value FROM events""")
def q_s2(spark, sf_dir):
    """Text with assorted NA spellings: every pandas default token is NULL."""
    ev = table(spark, sf_dir, "events")
    tokens = F.element_at(F.array(*[F.lit(t) for t in ("NA", "n/a", "NULL", "nan", "None", "#N/A")]),
                          (F.col("event_id") % 6 + 1).cast("int"))
    marked = ev.select("event_id", F.when(F.col("event_type") == "error", tokens)
                       .otherwise(F.col("event_type")).alias("event_type"), "value")
    path = scratch_dir(spark, "events-csv")
    io.write_csv(marked, path, na_rep="")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
                           T.StructField("value", T.DoubleType())])
    return io.read_csv(spark, path, schema, na_values=io.PANDAS_NA_VALUES)


@register("S3_pruned_read", """
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag""")
def q_s3(spark, sf_dir):
    """Column-pruned read: the scan's ReadSchema holds two columns."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity")
    return round_doubles(li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                                        F.sum("l_quantity").alias("qty")), 2)


def _numeric_sql(c):
    return (f"SELECT '{c}' AS \"column\", "
            f"(count(CASE WHEN {c} IS NOT NULL AND TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL THEN 1 END) = 0 "
            f"AND count({c}) > 0) AS is_numeric FROM holes")


@register("S4_S5_numeric_detection", f"""{H}
{' UNION ALL '.join(_numeric_sql(c) for c in HOLES_COLS)}""")
def q_s5(spark, sf_dir):
    """All-string read of the CSV, then per-column numeric detection."""
    return io.detect_numeric(io.read_csv_text(spark, _holes_csv(spark, sf_dir)))


def exact_injection_sql(src: str, cols, seed: str = "7", idcol: str = "rid") -> str:
    """SQL twin of ``inject_missing(mode='exact')``: positions (column, id)."""
    parts = " UNION ALL ".join(
        f"SELECT {idcol}, '{c}' AS col, ('0x' || substr(md5(concat_ws('|', '{seed}', '{c}', {idcol})), 1, 8))::BIGINT AS h, "
        f"0.05 + 0.05 * (('0x' || substr(md5(concat_ws('|', '{seed}', '{c}', 'frac')), 1, 8))::BIGINT / 4294967296.0) AS f "
        f"FROM {src}" for c in cols)
    return (f"(SELECT col AS \"column\", {idcol} FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY h, {idcol}) AS rn, "
            f"count(*) OVER (PARTITION BY col) AS n FROM ({parts})) "
            f"WHERE rn <= greatest(1, round_even(n * f, 0)))")


@register("S8_S9_A25_na_positions_json_report", f"""{W}
SELECT "column", count(*) AS na_count, round(count(*) * 100.0 / (SELECT count(*) FROM wide), 8) AS pct
FROM {exact_injection_sql('wide', WIDE_NUMERIC)} GROUP BY "column" """)
def q_s8(spark, sf_dir):
    """Exact injection -> positions as JSON lines -> read back -> NA report."""
    w = wide(spark, sf_dir)
    _, pos = inject_missing(w, WIDE_NUMERIC, "rid", seed="7", mode="exact")
    path = scratch_dir(spark, "na-positions")
    io.write_positions_json(pos, path)
    back = io.read_positions_json(spark, path)
    n = w.count()
    rep = back.groupBy("column").agg(F.count(F.lit(1)).alias("na_count"))
    return round_doubles(rep.withColumn("pct", F.col("na_count") * 100.0 / F.lit(n)), 8)


def split_sql(src: str, idcol: str, seed: str = "42", frac: float = 0.2, strat: str | None = None) -> str:
    """SQL twin of ``train_test_split(mode='exact')``: src plus a ``split`` column."""
    part = f"PARTITION BY {strat}" if strat else ""
    return (f"(SELECT * EXCLUDE (_h, _rn, _n), CASE WHEN _rn <= ceil(_n * {frac}) THEN 'test' ELSE 'train' END AS split "
            f"FROM (SELECT *, row_number() OVER ({part} ORDER BY _h, {idcol}) AS _rn, count(*) OVER ({part}) AS _n "
            f"FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', '{seed}', 'split', {idcol})), 1, 8))::BIGINT AS _h "
            f"FROM {src})))")


@register("S10_partitioned_split_roundtrip", f"""{W}
SELECT split, count(*) AS n, round(sum(price), 2) AS total_price FROM {split_sql('wide', 'rid')} GROUP BY split""")
def q_s10(spark, sf_dir):
    """Exact 80/20 split written partitioned by ``split`` and read back."""
    s = train_test_split(wide(spark, sf_dir), "rid", 0.2, seed="42")
    path = scratch_dir(spark, "split")
    io.write_table(s, path, partition_by="split")
    back = io.read_split_pair(spark, path, "price")
    return round_doubles(back.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                                   F.sum("price").alias("total_price")), 2)


@register("S11_source_fallback", """
SELECT count(*) AS n FROM lineitem""")
def q_s11(spark, sf_dir):
    """Prefer a richer table when it exists, else fall back to the plain one."""
    p = io.first_existing(spark, [f"{sf_dir}/lineitem_enriched.parquet", f"{sf_dir}/lineitem.parquet"])
    return spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n"))


@register("S12_row_count_precondition", f"""{W}
SELECT (SELECT count(*) FROM lineitem) AS n_left, count(*) AS n_right,
       (SELECT count(*) FROM lineitem) = count(*) AS equal FROM wide""")
def q_s12(spark, sf_dir):
    out = io.row_count_check(table(spark, sf_dir, "lineitem"), wide(spark, sf_dir))
    io.assert_columns(wide(spark, sf_dir), ["rid", "price"])
    return out


# ---------------------------------------------------------------- projection, predicates
@register("P1_drop_if_present", f"""{W}
SELECT * EXCLUDE (ptype, rid) FROM wide""")
def q_p1(spark, sf_dir):
    return clean.drop_if_present(wide(spark, sf_dir), ["ptype", "not_a_column", "rid"])


@register("P2_columns_by_kind", """
SELECT column_name AS "column",
       CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT') THEN 'number'
            WHEN column_type = 'VARCHAR' THEN 'object'
            WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'datetime' ELSE 'other' END AS kind
FROM (DESCRIBE lineitem)""")
def q_p2(spark, sf_dir):
    kinds = clean.column_kinds(table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame(kinds, "column string, kind string")


@register("P4_coerce_numeric", """
SELECT event_id, TRY_CAST(CAST(user_id AS VARCHAR) AS DOUBLE) AS user_id,
       TRY_CAST(event_type AS DOUBLE) AS event_type,
       TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events""")
def q_p4(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("user_id"), "event_type",
        F.regexp_extract("props", r"[0-9]+", 0).alias("k"))
    return clean.coerce_numeric(ev, ["user_id", "event_type", "k"])


@register("P5_drop_incomplete", f"""{H}
SELECT count(*) AS n, round(sum(price), 2) AS total_price FROM holes
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in WIDE_NUMERIC)}""")
def q_p5(spark, sf_dir):
    d = clean.drop_incomplete(holes(spark, sf_dir), WIDE_NUMERIC)
    return round_doubles(d.agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total_price")), 2)


@register("P6_require_fields", f"""{H}
SELECT count(*) FILTER (WHERE quantity IS NOT NULL AND price IS NOT NULL) AS kept,
       count(*) FILTER (WHERE NOT (quantity IS NOT NULL AND price IS NOT NULL)) AS dropped FROM holes""")
def q_p6(spark, sf_dir):
    h = holes(spark, sf_dir)
    n = h.count()
    kept = clean.require_fields(h, ["quantity", "price"]).agg(F.count(F.lit(1)).alias("kept"))
    return kept.withColumn("dropped", F.lit(n) - F.col("kept"))


RULES = [clean.RangeRule("quantity", 5, 45), clean.RangeRule("discount", 0.0, 0.08),
         clean.DomainRule("tax", (0.0, 0.02, 0.04, 0.06)), clean.DomainRule("returnflag", ("A", "N")),
         clean.RangeRule("size", 1, 40)]


def _rule_sql(r):
    if isinstance(r, clean.RangeRule):
        return f"({r.column} < {r.lo} OR {r.column} > {r.hi})"
    vals = ", ".join(repr(v) if isinstance(v, str) else str(v) for v in r.values)
    return f"({r.column} NOT IN ({vals}))"


@register("P7_P8_rule_counts", f"""{H}
{' UNION ALL '.join(f"SELECT '{type(r).__name__}:{r.column}' AS rule, count(*) FILTER (WHERE {r.column} IS NOT NULL AND {_rule_sql(r)}) AS n_invalid FROM holes" for r in RULES)}""")
def q_p7(spark, sf_dir):
    """Non-NULL offenders per rule, on a frame that already holds NULLs."""
    _, counts = clean.apply_rules(holes(spark, sf_dir), RULES)
    return counts


@register("P7_P8_rules_applied", f"""{H}
SELECT {', '.join(f"count(*) - count(CASE WHEN NOT coalesce({_rule_sql(r)}, false) THEN {r.column} END) AS na_{r.column}" for r in RULES)}
FROM holes""")
def q_p7b(spark, sf_dir):
    cleaned, _ = clean.apply_rules(holes(spark, sf_dir), RULES)
    return cleaned.agg(*[F.count_if(F.col(r.column).isNull()).alias(f"na_{r.column}") for r in RULES])


@register("P10_iqr_filter", f"""{W},
q AS (SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3 FROM wide)
SELECT count(*) AS kept, round(sum(price), 2) AS total_price FROM wide, q
WHERE quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def q_p10(spark, sf_dir):
    k = clean.iqr_filter(wide(spark, sf_dir), "quantity")
    return round_doubles(k.agg(F.count(F.lit(1)).alias("kept"), F.sum("price").alias("total_price")), 2)


@register("P10_iqr_filter_skewed", """
SELECT count(*) AS kept FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS q1,
       quantile_cont(c_acctbal, 0.75) AS q3 FROM customer) q
WHERE c_acctbal BETWEEN q1 - 0.1 * (q3 - q1) AND q3 + 0.1 * (q3 - q1)""")
def q_p10b(spark, sf_dir):
    k = clean.iqr_filter(table(spark, sf_dir, "customer"), "c_acctbal", k=0.1)
    return k.agg(F.count(F.lit(1)).alias("kept"))


@register("P11_binarize", f"""{W}
SELECT CAST(price >= 40000 AS INTEGER) AS high_price, count(*) AS n FROM wide GROUP BY 1""")
def q_p11(spark, sf_dir):
    b = clean.binarize(wide(spark, sf_dir), "price", 40000, "high_price")
    return b.groupBy("high_price").agg(F.count(F.lit(1)).alias("n"))


DERIVED = {"unit_price": (("price", "quantity"), lambda: F.col("price") / F.col("quantity")),
           "net_price": (("price", "discount"), lambda: F.col("price") * (1 - F.col("discount"))),
           "discount_x_tax": (("discount", "tax"), lambda: F.col("discount") * F.col("tax")),
           "price_abs_dev": (("retailprice", "price", "quantity"),
                             lambda: F.abs(F.col("retailprice") - F.col("price") / F.col("quantity"))),
           "not_built": (("duration_ms",), lambda: F.col("duration_ms") / 60000.0)}


@register("P13_derived_features", f"""{W}
SELECT rid, round(price / quantity, 6) AS unit_price, round(price * (1 - discount), 6) AS net_price,
       round(discount * tax, 8) AS discount_x_tax,
       round(abs(retailprice - price / quantity), 6) AS price_abs_dev FROM wide""")
def q_p13(spark, sf_dir):
    d = clean.derived_features(wide(spark, sf_dir), DERIVED)
    d = d.select("rid", *[c for c in DERIVED if c in d.columns])
    return round_doubles(d, 6, {"discount_x_tax": 8})


@register("P14_preview_head", f"""{W}
SELECT rid, brand, price FROM wide ORDER BY rid LIMIT 5""")
def q_p14(spark, sf_dir):
    return clean.preview(wide(spark, sf_dir).select("rid", "brand", "price"), "rid", 5)


# ---------------------------------------------------------------- duplicates
@register("D1_duplicate_rows", """
SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS n_duplicate_rows""")
def q_d1(spark, sf_dir):
    return clean.count_duplicate_rows(table(spark, sf_dir, "lineitem"))


@register("D1_duplicate_rows_projected", """
SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem)) AS n_duplicate_rows""")
def q_d1b(spark, sf_dir):
    return clean.count_duplicate_rows(table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag"))


@register("D2_duplicate_keys", """
SELECT (SELECT count(*) FROM lineitem)
     - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_duplicate_keys""")
def q_d2(spark, sf_dir):
    return clean.count_duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("D3_keep_first_per_key", f"""
SELECT l_orderkey, l_linenumber, rid, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY rid) AS rn FROM (
    SELECT {LINEITEM_ROW_ID_SQL} AS rid, * FROM lineitem))
WHERE rn = 1""")
def q_d3(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(lineitem_row_id().alias("rid"), "l_orderkey", "l_linenumber",
                                                  "l_quantity", "l_extendedprice")
    return clean.keep_first(li, ["l_orderkey", "l_linenumber"], "rid")


@register("S7_parquet_roundtrip", f"""{H}
SELECT count(*) AS n, count(quantity) AS n_quantity, round(sum(price), 2) AS total_price,
       CAST(sum(rid % 1000003) AS BIGINT) AS id_checksum FROM holes""")
def q_s7(spark, sf_dir):
    """Default sink: parquet written to the shared folder and read back."""
    path = scratch_dir(spark, "holes-parquet")
    io.write_table(holes(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return round_doubles(back.agg(F.count(F.lit(1)).alias("n"), F.count("quantity").alias("n_quantity"),
                                  F.sum("price").alias("total_price"),
                                  F.sum(F.col("rid") % 1000003).cast("bigint").alias("id_checksum")), 2)


@register("P3_feature_groups_by_name", f"""{W}
SELECT feature, grp FROM (
  SELECT c AS feature, 'plain' AS grp FROM (VALUES ('quantity'), ('discount'), ('tax'), ('size'), ('retailprice')) t(c)
  UNION ALL SELECT c || '_missing', 'suffix' FROM (VALUES ('quantity'), ('discount'), ('tax'), ('size'), ('retailprice')) t(c)
  UNION ALL SELECT DISTINCT 'genre_' || ptype, 'prefix' FROM wide)""")
def q_p3(spark, sf_dir):
    """Model-matrix columns grouped by name pattern: plain, ``*_missing``, ``genre_*``."""
    from kestrel.functions.columns import feature_groups
    from kestrel.operators import missing as mm
    h = mm.na_indicators(holes(spark, sf_dir), ["quantity", "discount", "tax", "size", "retailprice"])
    h = mm.one_hot(h, "ptype", prefix="genre")
    cands = [c for c in h.columns if c not in ("rid", "price", "returnflag", "linestatus", "brand")]
    rows = []
    for grp, kw in (("plain", dict(include_prefixed=False, include_suffixed=False)),
                    ("suffix", dict(include_prefixed=False, include_plain=False)),
                    ("prefix", dict(include_suffixed=False, include_plain=False))):
        rows += [(c, grp) for c in feature_groups(cands, prefix="genre_", suffix="_missing", **kw)]
    return spark.createDataFrame(rows, "feature string, grp string")
