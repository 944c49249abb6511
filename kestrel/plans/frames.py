"""Analysis frames derived from the given tables, in Spark and in SQL.

The library's operators are table-agnostic; these frames adapt the test
tables to the shapes the statistics need (a wide numeric table with a target
and a category, a binary-label table, a vector table).  Each frame has a Spark
builder and the equivalent SQL text (used by the oracle), written side by
side so they cannot drift apart.

| frame  | rows                         | role                                    |
|--------|------------------------------|-----------------------------------------|
| wide   | lineitem join part           | numeric features, target ``price``,     |
|        |                              | category ``brand``                      |
| holes  | wide with injected NULLs     | missing-data operators                  |
| bin    | documents join labels        | binary target ``quality``               |
| vec    | embeddings, 64 columns       | PCA, neighbours                         |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.hashing import hash60, sql_unit_hash, unit_hash

# fixed values: the numeric feature columns of ``wide`` and its target
WIDE_FEATURES = ["quantity", "discount", "tax", "size", "retailprice"]
WIDE_TARGET = "price"
WIDE_NUMERIC = WIDE_FEATURES + [WIDE_TARGET]
HOLES_SEED = "42"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_row_id() -> F.Column:
    """60-bit md5 of all lineitem columns (doubles as integers, date as day number)."""
    parts = [F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
             # non-negative columns: floor(x + 0.5) is half-up rounding without
             # Spark's BigDecimal-based round()
             F.floor(F.col("l_quantity") + 0.5),
             F.floor(F.col("l_extendedprice") * 100 + 0.5),
             F.floor(F.col("l_discount") * 100 + 0.5),
             F.floor(F.col("l_tax") * 100 + 0.5),
             F.col("l_returnflag"), F.col("l_linestatus"),
             F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))]
    return hash60(*parts)


LINEITEM_ROW_ID_SQL = (
    "('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    "CAST(round(l_quantity) AS BIGINT), CAST(round(l_extendedprice*100) AS BIGINT), "
    "CAST(round(l_discount*100) AS BIGINT), CAST(round(l_tax*100) AS BIGINT), "
    "l_returnflag, l_linestatus, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)))), 1, 15))::BIGINT"
)


_CACHE: dict = {}


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis table, built once per application and cached
    (MEMORY_AND_DISK; lost blocks are recomputed from lineage): nearly every
    query reads it, and its row id costs an md5 per row."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    df = _CACHE.get(key)
    if df is None:
        df = _build_wide(spark, sf_dir).persist()
        _CACHE[key] = df
    return df


def _build_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    li = li.select(lineitem_row_id().alias("rid"), "l_partkey",
                   F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
                   F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"),
                   F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    part = part.select("p_partkey", F.col("p_size").cast("double").alias("size"),
                       F.col("p_retailprice").alias("retailprice"),
                       F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"))
    # part is the dimension side: Catalyst/AQE broadcast it only while its
    # size stays under the broadcast threshold, otherwise sort-merge.
    return li.join(part, li.l_partkey == part.p_partkey, "inner").drop("l_partkey", "p_partkey")


WIDE_SQL = f"""
SELECT {LINEITEM_ROW_ID_SQL} AS rid,
       l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_extendedprice AS price,
       l_returnflag AS returnflag, l_linestatus AS linestatus,
       CAST(p_size AS DOUBLE) AS size, p_retailprice AS retailprice,
       p_brand AS brand, p_type AS ptype
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def hole_fraction(column: str, seed: str = HOLES_SEED) -> F.Column:
    """Per-column NA fraction in [5 %, 10 %) from the seeded hash."""
    return F.lit(0.05) + F.lit(0.05) * unit_hash(F.lit(seed), F.lit(column), F.lit("frac"))


def holes(spark: SparkSession, sf_dir: str, columns=WIDE_NUMERIC, seed: str = HOLES_SEED) -> DataFrame:
    """``wide`` with each numeric cell NULL where its seeded hash falls under the
    column's fraction (threshold mode of M1: one pass, no shuffle)."""
    w = wide(spark, sf_dir)
    repl = {c: F.when(unit_hash(F.lit(seed), F.lit(c), F.col("rid")) < hole_fraction(c, seed), F.lit(None))
                 .otherwise(F.col(c)) for c in columns}
    return w.withColumns(repl)


def sql_hole(c: str, seed: str = HOLES_SEED) -> str:
    frac = f"(0.05 + 0.05 * {sql_unit_hash(repr(seed), repr(c), repr('frac'))})"
    return f"CASE WHEN {sql_unit_hash(repr(seed), repr(c), 'rid')} < {frac} THEN NULL ELSE {c} END AS {c}"


HOLES_SQL = (
    "SELECT rid, returnflag, linestatus, brand, ptype, "
    + ", ".join(sql_hole(c) for c in WIDE_NUMERIC)
    + f" FROM ({WIDE_SQL}) w"
)


def bin_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents join labels (inner): numeric ``n_chars``, categories, 0/1 targets."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "inner")


BIN_SQL = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def vec_frame(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    """embeddings as ``dims`` double columns e0..e{dims-1} plus id and label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label",
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])


def vec_sql(dims: int = 64) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(dims))
    return f"SELECT vec_id, label, {cols} FROM embeddings"
