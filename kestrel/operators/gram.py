"""Sufficient statistics for linear models: the Gram path.

One distributed pass computes, per group (e.g. CV fold), the moments
n, Σx, Σy, XᵀX, Xᵀy, yᵀy of the shifted data.  Each partition reduces its
rows with numpy and emits the upper triangle of [1, x, y]ᵀ[1, x, y] as long
rows; Spark sums them by (group, i, j).  The result is (p+2)² numbers per
group — independent of the row count — and every fit, cross-validation
fold, grid point and RFE step is then solved on p x p matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    n: float
    sx: np.ndarray      # (p,)
    sy: float
    sxx: np.ndarray     # (p, p)
    sxy: np.ndarray     # (p,)
    syy: float
    shift_x: np.ndarray
    shift_y: float

    def __sub__(self, o: "Moments") -> "Moments":
        return Moments(self.n - o.n, self.sx - o.sx, self.sy - o.sy, self.sxx - o.sxx,
                       self.sxy - o.sxy, self.syy - o.syy, self.shift_x, self.shift_y)

    def __add__(self, o: "Moments") -> "Moments":
        return Moments(self.n + o.n, self.sx + o.sx, self.sy + o.sy, self.sxx + o.sxx,
                       self.sxy + o.sxy, self.syy + o.syy, self.shift_x, self.shift_y)

    def subset(self, idx) -> "Moments":
        idx = np.asarray(idx, dtype=int)
        return Moments(self.n, self.sx[idx], self.sy, self.sxx[np.ix_(idx, idx)], self.sxy[idx],
                       self.syy, self.shift_x[idx], self.shift_y)

    # centred statistics (shift cancels)
    def means(self):
        return self.sx / self.n, self.sy / self.n

    def centred(self):
        mx, my = self.means()
        cxx = self.sxx - self.n * np.outer(mx, mx)
        cxy = self.sxy - self.n * mx * my
        cyy = self.syy - self.n * my * my
        return cxx, cxy, cyy

    def pop_std(self):
        cxx, _, _ = self.centred()
        v = np.maximum(np.diag(cxx) / self.n, 0.0)
        s = np.sqrt(v)
        s[s == 0] = 1.0  # sklearn's scaler divides constant columns by 1
        return s


def gram_moments(df: DataFrame, features, label: str, group: str | None = None,
                 shift: bool = True, centre=None) -> dict:
    """Moments per value of ``group`` (one entry ``None`` without a group).

    Rows with a NULL in a feature or the label are skipped (the reference
    drops them before fitting).  ``shift`` subtracts approximate means first
    so that the centring later does not cancel digits; ``centre`` (features, label)
    gives them where they are known, which saves a pass.
    """
    feats = list(features)
    p = len(feats)
    d = df.select(*([F.col(group).alias("_g")] if group else [F.lit(0).alias("_g")]),
                  *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(feats)],
                  F.col(label).cast("double").alias("y")).where(F.col("_g").isNotNull())
    if centre is not None:
        cx, cy = np.asarray(centre[0], float), float(centre[1])
    elif shift:
        whole = d.na.drop("any")
        row = whole.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(p)], F.avg("y").alias("y")).collect()[0]
        cx = np.array([row[f"x{i}"] or 0.0 for i in range(p)])
        cy = row["y"] or 0.0
    else:
        cx, cy = np.zeros(p), 0.0
    m = p + 2
    iu, ju = np.triu_indices(m)
    about = np.concatenate(([0.0], cx, [cy]))

    def partial(batches):
        acc, kind = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.ones((batch.num_rows, m))
            for i in range(1, m):
                z[:, i] = batch.column(i).to_numpy(zero_copy_only=False)  # NULL becomes NaN
            z -= about
            full, kind = ~np.isnan(z).any(1), batch.column(0).type  # skipped here: a filter would work out every column twice
            codes = pc.dictionary_encode(batch.column(0))
            at = codes.indices.to_numpy()
            for i, g in enumerate(codes.dictionary.to_pylist()):
                own = z[full & (at == i)]
                if len(own) and g == g:
                    zz = own.T @ own
                    acc[g] = acc[g] + zz if g in acc else zz
        for g, zz in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(iu), kind), pa.array(iu.astype(np.int32)), pa.array(ju.astype(np.int32)),
                                              pa.array(zz[iu, ju])], names=["_g", "i", "j", "v"])

    schema = f"_g {d.schema['_g'].dataType.simpleString()}, i int, j int, v double"
    sums = d.mapInArrow(partial, schema).groupBy("_g", "i", "j").agg(F.sum("v").alias("v"))
    out = {}
    for g, grp in sums.toPandas().groupby("_g"):  # groups x (p+2)(p+3)/2 numbers
        zz = np.zeros((m, m))
        zz[grp["i"].to_numpy(), grp["j"].to_numpy()] = grp["v"].to_numpy()
        zz = zz + np.triu(zz, 1).T
        key = None if not group else (g.item() if hasattr(g, "item") else g)
        out[key] = Moments(zz[0, 0], zz[0, 1:p + 1].copy(), zz[0, p + 1], zz[1:p + 1, 1:p + 1].copy(),
                           zz[1:p + 1, p + 1].copy(), zz[p + 1, p + 1], cx, cy)
    return out


def total(moments: dict) -> Moments:
    vals = list(moments.values())
    t = vals[0]
    for v in vals[1:]:
        t = t + v
    return t


# ---------------------------------------------------------------- solvers
@dataclass
class LinearFit:
    coef: np.ndarray       # original units
    intercept: float       # original units
    scaled_coef: np.ndarray


def _coordinate_descent(c: np.ndarray, r: np.ndarray, n: float, l1: float, l2: float, yy: float,
                        tol: float = 1e-6, max_iter: int = 20000) -> np.ndarray:
    """min 1/(2n)‖y − Xw‖² + l1‖w‖₁ + l2/2‖w‖² on centred Gram c = XᵀX, r = Xᵀy.

    Cyclic coordinate descent on p x p numbers with sklearn's stopping rule:
    once the largest update is below 1e-4 of the largest weight, the
    duality gap is computed from the Gram and the loop ends when it is
    below ``tol``·yᵀy (sklearn's default tol is 1e-4; 1e-6 here), or after
    ``max_iter`` sweeps (the reference's limit).  A singular design, where
    weights drift along a flat direction, stops on the gap.
    """
    p = len(r)
    w = np.zeros(p)
    diag = np.diag(c).copy()
    grad = r.copy()  # r - c w, maintained
    alpha, beta = n * l1, n * l2
    den = diag + beta
    cols = [c[:, j].copy() for j in range(p)]
    live = [j for j in range(p) if diag[j] > 0]
    gap_tol = tol * yy
    f_prev = None
    for it in range(max_iter):
        max_delta, max_w = 0.0, 0.0
        for j in live:
            wj = w[j]
            rho = grad[j] + diag[j] * wj
            a = abs(rho) - alpha
            new = (a if rho > 0 else -a) / den[j] if a > 0 else 0.0
            delta = new - wj
            if delta != 0.0:
                grad -= cols[j] * delta
                w[j] = new
                if abs(delta) > max_delta:
                    max_delta = abs(delta)
            if abs(new) > max_w:
                max_w = abs(new)
        if max_w == 0.0 or max_delta / max_w < 1e-4 or it == max_iter - 1:
            h = r - grad                       # c @ w
            xta = grad - beta * w              # Xᵀ(y − Xw) − βw
            dual = float(np.max(np.abs(xta))) if p else 0.0
            r_norm2 = yy - 2.0 * float(w @ r) + float(w @ h)
            if dual > alpha:
                const = alpha / dual
                gap = 0.5 * (r_norm2 + r_norm2 * const * const)
            else:
                const = 1.0
                gap = r_norm2
            gap += alpha * float(np.abs(w).sum()) - const * (yy - float(w @ r)) \
                + 0.5 * beta * (1.0 + const * const) * float(w @ w)
            if gap < gap_tol:
                break
        # objective of this sweep; on a singular design (all one-hot levels
        # plus an intercept) the weights creep along a flat direction where
        # only the penalty changes, so stop once a sweep gains < 1e-13
        f = 0.5 * (yy - float(w @ r) - float(w @ grad)) + alpha * float(np.abs(w).sum()) \
            + 0.5 * beta * float(w @ w)
        if f_prev is not None and f_prev - f <= 1e-13 * max(abs(f), 1.0):
            break
        f_prev = f
    return w


def fit_linear(m: Moments, model: str = "ols", alpha: float = 0.0, l1_ratio: float = 0.5,
               scale: bool = True) -> LinearFit:
    """sklearn-equivalent fits on standardised features with an intercept.

    ols: least squares (minimum-norm on a singular design); ridge:
    ‖y−Xw‖² + α‖w‖²; lasso: 1/(2n)‖·‖² + α‖w‖₁; elasticnet:
    1/(2n)‖·‖² + αρ‖w‖₁ + α(1−ρ)/2‖w‖².  Standardisation uses the
    population std of the fitting rows, like ``StandardScaler``.
    """
    cxx, cxy, cyy = m.centred()
    s = m.pop_std() if scale else np.ones(len(cxy))
    c = cxx / np.outer(s, s)
    r = cxy / s
    if model == "ols":
        w = np.linalg.lstsq(c, r, rcond=None)[0]
    elif model == "ridge":
        w = np.linalg.solve(c + alpha * np.eye(len(r)), r)
    elif model == "lasso":
        w = _coordinate_descent(c, r, m.n, alpha, 0.0, cyy)
    elif model == "elasticnet":
        w = _coordinate_descent(c, r, m.n, alpha * l1_ratio, alpha * (1 - l1_ratio), cyy)
    else:
        raise ValueError(model)
    coef = w / s
    mx, my = m.means()  # shifted units
    b_shift = my - float(coef @ mx)
    intercept = b_shift + m.shift_y - float(coef @ m.shift_x)
    return LinearFit(coef, intercept, w)


def sse(m: Moments, fit: LinearFit) -> float:
    """Σ(y − b − wᵀx)² over the rows behind ``m``, from moments only."""
    w = fit.coef
    b = fit.intercept - m.shift_y + float(w @ m.shift_x)  # intercept in shifted units
    val = (m.syy - 2 * float(w @ m.sxy) - 2 * b * m.sy + float(w @ m.sxx @ w)
           + 2 * b * float(w @ m.sx) + m.n * b * b)
    return max(val, 0.0)


def cv_rmse(folds: dict, model: str, alpha: float = 0.0, l1_ratio: float = 0.5,
            target_transform=None) -> float:
    """Mean over folds of the held-out RMSE (``neg_root_mean_squared_error``)."""
    tot = total(folds)
    scores = []
    for _, mf in folds.items():
        fit = fit_linear(tot - mf, model, alpha, l1_ratio)
        scores.append(np.sqrt(sse(mf, fit) / mf.n))
    return float(np.mean(scores))


def grid_search(folds: dict, model: str, grid: list[dict]) -> tuple[dict, float]:
    """Best parameters by mean CV RMSE (first one on ties, like sklearn)."""
    best, best_score = None, None
    for params in grid:
        sc = cv_rmse(folds, model, **params)
        if best_score is None or sc < best_score - 1e-15:
            best, best_score = params, sc
    return best, best_score


def raw_ols(m: Moments) -> np.ndarray:
    """Least-squares coefficients in the units of the features, of several solutions the
    shortest one in these units.  The system is solved on standardised features, where
    rank can be told, and taken back."""
    cxx, cxy, _ = m.centred()
    s = m.pop_std()
    values, vectors = np.linalg.eigh(cxx / np.outer(s, s))
    used = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    coef = vectors[:, used] @ ((vectors[:, used].T @ (cxy / s)) / values[used]) / s
    free = vectors[:, ~used] / s[:, None]
    return coef - free @ np.linalg.lstsq(free, coef, rcond=None)[0] if free.size else coef


def rfe_ols(m: Moments, k: int, step: int = 1, scale: bool = False) -> list[int]:
    """Recursive feature elimination with OLS (F5): refit, drop the feature
    with the smallest squared coefficient, until k remain.  Returns ranks
    (1 = kept) in feature order."""
    p = len(m.sx)
    active = list(range(p))
    ranks = np.ones(p, dtype=int)
    rank = p - k + 1
    while len(active) > k:
        sub = m.subset(active)
        imp = (fit_linear(sub, "ols").coef if scale else raw_ols(sub)) ** 2
        nd = min(step, len(active) - k)
        drop = np.argsort(imp, kind="stable")[:nd]
        for d_ in sorted(drop, reverse=True):
            ranks[active[d_]] = rank
        rank -= 1
        active = [a for i, a in enumerate(active) if i not in set(drop.tolist())]
    return ranks.tolist()
