"""Projection, predicates, rules and de-duplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.columns import dtype_kind, number_or_null
from kestrel.operators.ranking import exact_quantiles


# ---------------------------------------------------------------- ingest
def nan_to_null(df: DataFrame, columns=None) -> DataFrame:
    """Turn float NaN into NULL (NaN > x is TRUE in Spark and NaN poisons avg)."""
    cols = columns or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in cols}) if cols else df


# ---------------------------------------------------------------- projection
def drop_if_present(df: DataFrame, columns) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*[c for c in columns if c in df.columns])


def column_kinds(df: DataFrame) -> list[tuple[str, str]]:
    """(column, kind) with pandas ``select_dtypes`` families."""
    return [(f.name, dtype_kind(f.dataType)) for f in df.schema.fields]


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Cast to double; text that does not parse becomes NULL."""
    return df.withColumns({c: number_or_null(c) if isinstance(df.schema[c].dataType, T.StringType)
                           else F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns})


def drop_incomplete(df: DataFrame, columns=None) -> DataFrame:
    """Drop rows with a NULL in any listed column (P5)."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def require_fields(df: DataFrame, columns) -> DataFrame:
    """Keep rows whose listed fields are all non-NULL."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


# ---------------------------------------------------------------- validity rules
@dataclass(frozen=True)
class RangeRule:
    column: str
    lo: float
    hi: float

    def invalid(self) -> Column:
        c = F.col(self.column)
        return (c < self.lo) | (c > self.hi)


@dataclass(frozen=True)
class DomainRule:
    column: str
    values: tuple

    def invalid(self) -> Column:
        return ~F.col(self.column).isin(*self.values)


def apply_rules(df: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """Set values breaking a range/domain rule to NULL.

    Returns the cleaned frame and one row per rule with the number of
    non-NULL offenders, both from plain column expressions (no shuffle for
    the rows; the counts are one combining aggregate).
    """
    repl = {}
    for r in rules:
        cur = repl.get(r.column, F.col(r.column))
        repl[r.column] = F.when(F.coalesce(r.invalid(), F.lit(False)), F.lit(None)).otherwise(cur)
    cleaned = df.withColumns(repl)
    names = [f"{type(r).__name__}:{r.column}" for r in rules]
    counts = df.agg(*[F.count_if(F.col(r.column).isNotNull() & r.invalid()).alias(n)
                      for r, n in zip(rules, names)])
    counts = counts.unpivot([], names, "rule", "n_invalid")
    return cleaned, counts


def iqr_filter(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Keep rows inside [q1 - k·iqr, q3 + k·iqr], inclusive (P10).  Quartiles are
    exact (linear, distributed) and come back as two numbers used as literals."""
    q = {r["prob"]: r["quantile"] for r in exact_quantiles(df, column, [0.25, 0.75]).collect()}
    q1, q3 = q[0.25], q[0.75]
    if q1 is None or q3 is None:
        return df.limit(0)
    lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    return df.where(F.col(column).between(F.lit(lo), F.lit(hi)))


def binarize(df: DataFrame, column: str, threshold: float, out: str) -> DataFrame:
    """``out = int(column >= threshold)``; NULL stays NULL."""
    return df.withColumn(out, (F.col(column) >= threshold).cast("int"))


# fixed values: the engineered track features (inputs, expression)
TRACK_FEATURES = {
    "duration_min": (("duration_ms",), lambda: F.col("duration_ms") / 60000.0),
    "beats_in_track": (("tempo", "duration_ms"), lambda: F.col("tempo") * (F.col("duration_ms") / 60000.0)),
    "energy_x_danceability": (("energy", "danceability"), lambda: F.col("energy") * F.col("danceability")),
    "loudness_abs": (("loudness",), lambda: F.abs(F.col("loudness"))),
}


def derived_features(df: DataFrame, spec: dict | None = None) -> DataFrame:
    """Add engineered columns, each only when all its inputs exist.
    ``spec`` maps name -> (input columns, function returning the expression)."""
    spec = TRACK_FEATURES if spec is None else spec
    cols = set(df.columns)
    new = {name: make() for name, (inputs, make) in spec.items() if set(inputs) <= cols}
    return df.withColumns(new) if new else df


def preview(df: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    """First n rows by an explicit order (P14); Spark rows have no file order."""
    return df.orderBy(order_col).limit(n)


def flag_best(df: DataFrame, order, partition=None, flag: str = "selected") -> DataFrame:
    """1 for the first row under ``order`` within each partition, else 0.
    Meant for small result tables (one row per model)."""
    parts = [] if partition is None else ([partition] if isinstance(partition, str) else list(partition))
    w = Window.partitionBy(*parts).orderBy(*order)
    return df.withColumn(flag, (F.row_number().over(w) == 1).cast("int"))


# ---------------------------------------------------------------- duplicates
def count_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (D1); NULLs compare equal, as in pandas."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n_duplicate_rows"))


def count_duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Rows whose key was seen before (D2); a NULL key counts as one key."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n_duplicate_keys"))


def keep_first(df: DataFrame, keys, order_col: str) -> DataFrame:
    """One row per key: the one with the smallest ``order_col`` (D3).

    Ties are broken by the other columns.  ``row_number() = 1`` is planned with a
    window group limit before the shuffle: each task sends one row per key, so a
    key that holds a third of the table is reduced map-side.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys and c != order_col]
    w = Window.partitionBy(*keys).orderBy(order_col, *rest)
    return (df.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1)
              .select(*keys, order_col, *rest))
