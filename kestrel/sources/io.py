"""Readers, writers and preconditions.

CSV is read as text first so that every NA token (not only one
``nullValue``) becomes NULL before typed columns are produced; typed
columns come from ``try_cast`` so bad text is NULL instead of an error.
Parquet is the default table format (column pruning and filter pushdown).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.columns import number_or_null

# fixed values: the NA spellings pandas recognises by default
PANDAS_NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                    "nan", "null")
# fixed values: the NA spellings of an explicit ``na_values=["NA", ""]`` read
EXPLICIT_NA_VALUES = ("NA", "")


# fixed values: RFC 4180 quoting, a quote inside a quoted cell is doubled
QUOTING = {"quote": '"', "escape": '"'}


def read_csv_text(spark: SparkSession, path: str, columns=None, multi_line: bool = True) -> DataFrame:
    """All-string CSV read with a header (S4); ``columns`` prunes (S3).

    Quoted cells may hold commas, doubled quotes and, with ``multi_line``, line
    breaks; such a file is one split.  ``multi_line=False`` splits large files
    whose cells have no line breaks.
    """
    df = (spark.read.option("header", True).option("inferSchema", False).options(**QUOTING)
          .option("multiLine", multi_line).option("nullValue", None).option("emptyValue", "").csv(path))
    return df.select(*columns) if columns else df


def null_na_tokens(df: DataFrame, na_values=EXPLICIT_NA_VALUES, columns=None) -> DataFrame:
    """Text cells equal to an NA token become NULL."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    toks = list(na_values)
    return df.withColumns({c: F.when(F.col(c).isin(*toks), F.lit(None)).otherwise(F.col(c)) for c in cols})


def read_csv(spark: SparkSession, path: str, schema: T.StructType, na_values=EXPLICIT_NA_VALUES,
             columns=None, multi_line: bool = True) -> DataFrame:
    """Typed CSV read (S1, S2): text read, NA tokens -> NULL, ``try_cast`` to
    the schema, NaN -> NULL.  ``na_values=PANDAS_NA_VALUES`` gives S2."""
    raw = read_csv_text(spark, path, columns, multi_line)
    # a token that spells no number is NULL in a column of numbers without being looked for
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType) and f.name in raw.columns]
    if others := [c for c in raw.columns if c not in numbers]:
        raw = null_na_tokens(raw, na_values, others)
    if numbers and (some := [t for t in na_values if re.search(r"[0-9]|inf", t.lower())]):
        raw = null_na_tokens(raw, some, numbers)
    out = []
    for f in schema.fields:
        if columns and f.name not in columns:
            continue
        if isinstance(f.dataType, T.StringType):
            out.append(F.col(f.name))
        else:
            c = number_or_null(f.name, f.dataType, nan=False) if isinstance(f.dataType, T.NumericType) else F.expr(
                f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")
            out.append(c.alias(f.name))
    return raw.select(*out)


def detect_numeric(df: DataFrame, na_values=("", "NA")) -> DataFrame:
    """(column, is_numeric) for a text frame (S5): numeric iff every value
    other than NULL / NA tokens parses as a number and at least one does.
    One aggregate over all columns."""
    cols = df.columns
    exprs = []
    for i, c in enumerate(cols):
        present = F.col(c).isNotNull() & ~F.col(c).isin(*na_values)
        bad = present & number_or_null(c).isNull()
        exprs += [F.count_if(bad).alias(f"b{i}"), F.count_if(present).alias(f"p{i}")]
    row = df.agg(*exprs)
    pairs = [F.struct(F.lit(c).alias("column"),
                      ((F.col(f"b{i}") == 0) & (F.col(f"p{i}") > 0)).alias("is_numeric"))
             for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*pairs)).alias("s")).select("s.column", "s.is_numeric")


def write_csv(df: DataFrame, path: str, na_rep: str = "NA", mode: str = "overwrite", compression: str = "none") -> str:
    """CSV with a header; NULL written as ``na_rep`` (S6, S7).  The readers open compressed
    files as they are; a file under gzip is one split."""
    (df.write.mode(mode).option("header", True).options(**QUOTING)
     .option("nullValue", na_rep).option("emptyValue", "").option("compression", compression)
     .option("zlib.compress.level", "BEST_SPEED").csv(path))  # numbers as text gain little from more
    return path


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> str:
    """Parquet (S7, S10) — the default sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def write_positions_json(positions: DataFrame, path: str, mode: str = "overwrite") -> str:
    """NA positions as JSON lines ``{"column": ..., "row_id": ...}``.
    The long form keeps every column's list distributed; a single JSON
    object of arrays would put a whole column's positions in one record."""
    positions.select(F.col("column"), F.col(positions.columns[-1]).cast("string").alias("row_id")) \
             .write.mode(mode).json(path)
    return path


def read_positions_json(spark: SparkSession, path: str) -> DataFrame:
    """Read :func:`write_positions_json` output back as (column, row_id)."""
    return spark.read.schema("column string, row_id string").json(path)


def write_params_json(spark: SparkSession, params: dict, path: str, mode: str = "overwrite") -> str:
    """Chosen parameters by model as one indented JSON document."""
    text = json.dumps(params, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)
    return path


def read_params_json(spark: SparkSession, path: str) -> dict:
    """What ``write_params_json`` wrote."""
    rows = spark.read.text(path, wholetext=True).collect()  # one document
    return json.loads(rows[0]["value"]) if rows else {}


def read_na_map_json(spark: SparkSession, path: str) -> DataFrame:
    """Read a ``{column: [row ids]}`` JSON document (S9) as (column, row_id)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    return (raw.select(F.explode(m).alias("column", "ids"))
               .select("column", F.explode("ids").alias("row_id")))


def read_split_pair(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Read a table written with ``partition_by='split'`` (S10); the target
    must exist and is coerced to double."""
    df = spark.read.parquet(path)
    assert_columns(df, [target, "split"])
    return df.withColumn(target, F.expr(f"try_cast(`{target}` AS DOUBLE)"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def first_existing(spark: SparkSession, paths) -> str:
    """The first path that exists, else an error."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {list(paths)} exists")


def assert_columns(df: DataFrame, required) -> DataFrame:
    """Raise if a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def row_count_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (n_left, n_right, equal)."""
    n_right = right.count()
    return (left.agg(F.count(F.lit(1)).alias("n_left"))
                .withColumn("n_right", F.lit(n_right).cast("bigint"))
                .withColumn("equal", F.col("n_left") == F.col("n_right")))

