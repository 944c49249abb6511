"""Schema helpers: choose columns by type and by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def dtype_kind(dt: T.DataType) -> str:
    """pandas ``select_dtypes`` family: number, object, datetime, other."""
    if isinstance(dt, T.BooleanType):
        return "bool"
    if is_numeric(dt):
        return "number"
    if isinstance(dt, T.StringType):
        return "object"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def feature_groups(columns, prefix: str = "genre_", suffix: str = "_missing",
                   exclude=(), include_prefixed=True, include_suffixed=True,
                   include_plain=True) -> list[str]:
    """Select model features by name pattern.

    ``plain`` columns are those matching neither pattern.
    """
    out = []
    for c in columns:
        if c in exclude:
            continue
        if c.startswith(prefix):
            keep = include_prefixed
        elif c.endswith(suffix):
            keep = include_suffixed
        else:
            keep = include_plain
        if keep:
            out.append(c)
    return out


def leaking_fields(schema, forbidden) -> list[str]:
    """The fields of a schema whose name, in any case, is forbidden in a model:
    ids, the target, and what is derived from it (P12)."""
    banned = {name.casefold() for name in forbidden}
    return [field.name for field in schema.fields if field.name.casefold() in banned]


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"^ *[+-]?(?i:inf|infinity) *$"


def number_or_null(column: str, kind=None, nan: bool = True) -> F.Column:
    """The number that a text column spells, else NULL.  The pattern keeps out what
    a cast alone takes for a number, such as "12f" or "3d"; "inf" passes, and with
    ``nan`` "nan" does.  One pattern and one cast, as tables may have many such columns."""
    text = F.col(f"`{column}`").cast("string")
    spelt = text.rlike(f"{NUMBER}|{INFINITE if not nan else INFINITE.replace('inf|', 'nan|inf|')}")
    name = kind.simpleString() if kind is not None else "double"
    return F.when(spelt, F.expr(f"try_cast(trim(CAST(`{column}` AS STRING)) AS {name})"))
