"""Iterative (chained-equation) imputation from sufficient statistics (M9).

Every round regresses each column with gaps on the others and refills its gaps.  All
filled values are linear in what a row knows, with coefficients that depend only on
which columns it lacks.  So one pass sums ``[1, x]'[1, x]`` by missingness pattern, and
the rounds run on these matrices: a refill changes one row and one column of each
pattern's matrix, and the regressions read their sums.  The last step writes the values
with the coefficients of each row's pattern.  The data are read twice, however many
columns and rounds there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import gram
from kestrel.operators.missing import apply_fills, fit_simple_imputer

#: Numbers in the matrices of all patterns at most; with more patterns the rounds go over the data.
MAX_NUMBERS = 4_000_000


@dataclass
class Imputer:
    """``fills[c]``: (n + 1) coefficients of column c in ``[1, x]`` (x with 0 for gaps), by pattern."""
    columns: list
    fills: dict            # pattern -> {column number: coefficients}
    initial: list

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the gaps of the columns filled; a pattern that was not fitted gets
        the initial fills."""
        p, kind = len(self.columns), "array<array<double>>"
        rows = [(m, [list(map(float, some[c])) if c in some else None for c in range(p)]) for m, some in self.fills.items()]
        table = df.sparkSession.createDataFrame(rows, f"_pattern string, _fills {kind}")  # at most MAX_NUMBERS numbers
        known = F.array(F.lit(1.0), *[F.coalesce(_value(c), F.lit(0.0)) for c in self.columns])
        out = df.withColumn("_pattern", pattern_of(self.columns)).withColumn("_known", known).join(F.broadcast(table), "_pattern", "left")

        def filled(c: int) -> F.Column:
            coef = F.try_element_at("_fills", F.lit(c + 1))
            value = F.aggregate(F.zip_with("_known", coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            return F.coalesce(_value(self.columns[c]), value, F.lit(self.initial[c]))
        place = {c: i for i, c in enumerate(self.columns)}
        return out.select(*[filled(place[c]).alias(c) if c in place else F.col(c) for c in df.columns])


def _value(column: str) -> F.Column:
    """The column as double; NaN counts as missing."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def pattern_of(columns) -> F.Column:
    """A digit for each column: 1 where the row lacks it."""
    return F.concat(*[F.when(_value(c).isNull(), "1").otherwise("0") for c in columns])


def pattern_moments(df: DataFrame, columns, shift: np.ndarray) -> dict[str, np.ndarray] | None:
    """``[1, x - shift]'[1, x - shift]`` by pattern (gaps as 0), summed per task, then by
    Spark.  None if the patterns' matrices hold more than ``MAX_NUMBERS`` numbers."""
    p = len(columns)
    most = max(1, MAX_NUMBERS // (p + 1) ** 2)
    rows = df.select(pattern_of(columns).alias("m"), F.array(*[_value(c) for c in columns]).alias("x"))
    if rows.select("m").distinct().limit(most + 1).count() > most:
        return None
    iu, ju = np.triu_indices(p + 1)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - shift
            z = np.hstack([np.ones((len(x), 1)), np.nan_to_num(x)])
            marks = batch.column(0).dictionary_encode()
            code = marks.indices.to_numpy()
            for k, m in enumerate(marks.dictionary.to_pylist()):
                part = z[code == k]
                sums[m] = sums.get(m, 0) + part.T @ part
        for m, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(iu)), pa.array(iu.astype(np.int32)), pa.array(ju.astype(np.int32)),
                                              pa.array(s[iu, ju])], names=["m", "i", "j", "v"])
    found = rows.mapInArrow(run, "m string, i int, j int, v double").groupBy("m", "i", "j").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in found:
        s = out.setdefault(r["m"], np.zeros((p + 1, p + 1)))
        s[r["i"], r["j"]] = s[r["j"], r["i"]] = r["v"]
    return out


def _least_squares(n, mean_x, mean_y, sxx, sxy, syy) -> np.ndarray:
    return np.linalg.lstsq(sxx, sxy, rcond=None)[0]


def bayesian_ridge(n, mean_x, mean_y, sxx, sxy, syy, rounds: int = 300, tol: float = 1e-3, prior: float = 1e-6) -> np.ndarray:
    """Ridge whose two precisions maximise the evidence, from centred sums; the usual
    flat gamma priors."""
    values, vectors = np.linalg.eigh(sxx)
    values, turned = np.maximum(values, 0), vectors.T @ sxy
    noise, weight, coef = n / max(syy, np.finfo(float).eps), 1.0, None
    for _ in range(rounds):
        new = vectors @ (turned / (values + weight / noise))
        rss = max(syy - 2 * new @ sxy + new @ sxx @ new, 0.0)
        used = float(np.sum(noise * values / (weight + noise * values)))
        weight = (used + 2 * prior) / (float(new @ new) + 2 * prior)
        noise = (n - used + 2 * prior) / (rss + 2 * prior)
        if coef is not None and np.abs(coef - new).sum() < tol:
            break
        coef = new
    return vectors @ (turned / (values + weight / noise))


ESTIMATORS = {"ols": _least_squares, "bayesian_ridge": bayesian_ridge}


def chained_equations(moments: dict[str, np.ndarray], p: int, start: np.ndarray, rounds: int = 10, estimator: str = "ols",
                      order: list[int] | None = None) -> dict[str, dict[int, np.ndarray]]:
    """Coefficients of each pattern's gaps after ``rounds`` rounds; ``start`` fills them
    at first.  ``order``: the columns as they are visited in a round."""
    names = sorted(moments)
    lacks = np.array([[c == "1" for c in m] for m in names], bool).reshape(len(names), p)
    g = np.array([moments[m] for m in names]).reshape(len(names), p + 1, p + 1)
    t = np.tile(np.eye(p + 1), (len(names), 1, 1))      # [1, x filled] = t [1, x known]

    def refill(c: int, coef: np.ndarray) -> None:
        """Column c becomes coef . [1, x] in the patterns that lack it (coef[c + 1] is 0)."""
        some = lacks[:, c]
        t[some, c + 1] = np.einsum("i,pij->pj", coef, t[some])
        row = np.einsum("i,pij->pj", coef, g[some])
        g[some, c + 1], g[some, :, c + 1] = row, row
        g[some, c + 1, c + 1] = row @ coef - row[:, c + 1] * coef[c + 1]
    for c in range(p):
        first = np.zeros(p + 1)
        first[0] = start[c]
        refill(c, first)
    gaps = [c for c in (order if order is not None else range(p)) if lacks[:, c].any() and not lacks[:, c].all()]
    for _ in range(rounds):
        for c in gaps:
            s = g[~lacks[:, c]].sum(0)
            others = [i for i in range(1, p + 1) if i != c + 1]
            n, sx, sy = s[0, 0], s[0, others], s[0, c + 1]
            sxx = s[np.ix_(others, others)] - np.outer(sx, sx) / n
            sxy, syy = s[others, c + 1] - sx * sy / n, s[c + 1, c + 1] - sy * sy / n
            w = ESTIMATORS[estimator](n, sx / n, sy / n, sxx, sxy, syy)
            coef = np.zeros(p + 1)
            coef[others], coef[0] = w, (sy - w @ sx) / n
            refill(c, coef)
    return {m: {c: t[k, c + 1] for c in np.flatnonzero(lacks[k])} for k, m in enumerate(names)}


def fit_iterative(df: DataFrame, columns, rounds: int = 10, initial: str = "mean", estimator: str = "ols",
                  ascending: bool = False) -> Imputer | None:
    """Fit on the rows of ``df``; None if there are too many missingness patterns.

    ``ascending`` visits the columns from the fewest gaps to the most, else in the order
    given.  ``estimator`` is ``ols`` or ``bayesian_ridge``.  A column without any value is
    filled with 0.
    """
    cols = list(columns)
    row = df.agg(*[F.avg(_value(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.count_if(_value(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(cols))])
    fills = fit_simple_imputer(df.select(*[_value(c).alias(c) for c in cols]), cols) if initial == "median" else {}
    start = np.array([fills.get(c, m) if fills.get(c, m) is not None else 0.0 for c, m in zip(cols, mean)])
    moments = pattern_moments(df, cols, mean)
    if moments is None:
        return None
    order = sorted(range(len(cols)), key=lambda i: (row[f"n{i}"], i)) if ascending else None
    found = chained_equations(moments, len(cols), start - mean, rounds, estimator, order)
    # the rounds ran on x - mean, with gaps as 0: back to x, with gaps as 0
    for m, some in found.items():
        there = np.array([c == "0" for c in m])
        for c, coef in some.items():
            coef = coef.copy()
            coef[0] += mean[c] - coef[1:][there] @ mean[there]
            coef[1:][~there] = 0.0
            some[c] = coef
    return Imputer(cols, found, start.tolist())


def iterative_impute(df: DataFrame, columns, rounds: int = 10, initial: str = "mean") -> DataFrame:
    """Start from mean (or median) fills, then for ``rounds`` rounds regress each column
    with NULLs on all other columns over the rows where it was observed, and replace its
    missing cells with the prediction.  Other columns stay."""
    fitted = fit_iterative(df, columns, rounds, initial)
    return iterative_impute_by_passes(df, columns, rounds, initial) if fitted is None else fitted.apply(df)


def iterative_impute_by_passes(df: DataFrame, columns, rounds: int = 10, initial: str = "mean") -> DataFrame:
    """The same rounds over the data, a Gram pass per column and round: for tables with
    more missingness patterns than their matrices may take.  Checkpointed every round."""
    cols = list(columns)
    base = df.withColumns({f"_m_{c}": F.col(c).isNull() for c in cols})
    if initial == "median":
        fills = fit_simple_imputer(df, cols)
    else:
        row = df.agg(*[F.avg(c).alias(c) for c in cols]).collect()[0]
        fills = {c: row[c] for c in cols}
    cur = apply_fills(base, fills)
    with_na = [c for c in cols if base.where(F.col(f"_m_{c}")).limit(1).count() > 0]
    for _ in range(rounds):
        for c in with_na:
            others = [o for o in cols if o != c]
            m = gram.total(gram.gram_moments(cur.where(~F.col(f"_m_{c}")), others, c))
            fit = gram.fit_linear(m, "ols", scale=False)
            pred = F.lit(float(fit.intercept))
            for o, w in zip(others, fit.coef):
                pred = pred + F.col(o) * float(w)
            cur = cur.withColumn(c, F.when(F.col(f"_m_{c}"), pred).otherwise(F.col(c)))
        cur = cur.checkpoint()
    return cur.drop(*[f"_m_{c}" for c in cols])
