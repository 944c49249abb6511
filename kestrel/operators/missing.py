"""Missing data: injection, indicators, rare levels, encodings, simple
imputation, target restore, seeded selection (M1-M7, M12-M16, J1-J2)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.hashing import TWO_32, hash32
from kestrel.operators.ranking import exact_quantiles, null_safe_join, ranked_histogram, value_histogram


def py_unit_hash(*parts) -> float:
    """Driver-side twin of ``unit_hash`` for per-column constants."""
    h = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return int(h[:8], 16) / TWO_32


# ---------------------------------------------------------------- seeded selection
def smallest_k_cutoff(df: DataFrame, hash_col: str, tie_col: str, k_of_n, by=None):
    """Per group, the (hash, tie) of the k-th smallest row, k = ``k_of_n(n)``.

    Exact and distributed: a radix histogram over the top 16 bits of the
    32-bit hash finds the boundary bucket from a (group x 65,536) count table;
    only rows in that one bucket (~n/65,536 of the group) are ranked.  A row
    is selected iff ``(hash, tie) <= (cut_hash, cut_tie)``.  Groups with
    k > n get an open cutoff; k <= 0 selects nothing.

    With at most ``SMALL_GROUPS`` groups the narrow (group, hash, tie) frame is
    persisted for the three passes and the cutoffs come back as a list of
    rows; with more groups a lazy DataFrame is returned (joined by key).
    """
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    d = df.select(*by, hash_col, tie_col).withColumn("_hi", F.shiftright(F.col(hash_col), 16))
    tie_type = d.schema[tie_col].dataType
    w = Window.partitionBy(*by).orderBy("_hi").rowsBetween(Window.unboundedPreceding, 0)

    def counts_of(src):
        c = src.groupBy(*by, "_hi").agg(F.count(F.lit(1)).alias("_c"))
        return (c.withColumn("_cum", F.sum("_c").over(w))
                 .withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
                 .withColumn("_k", k_of_n(F.col("_n")).cast("bigint")))

    def bound_of(counts):
        return (counts.where((F.col("_cum") - F.col("_c") < F.col("_k")) & (F.col("_k") <= F.col("_cum")))
                      .select(*by, "_hi", (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_need")))

    def ends_of(counts):
        # k > n: everything; k <= 0: nothing; k == n has a regular cutoff
        return (counts.groupBy(*by).agg(F.max("_n").alias("_n"), F.max("_k").alias("_k"))
                      .where((F.col("_k") > F.col("_n")) | (F.col("_k") <= 0))
                      .select(*by, F.when(F.col("_k") <= 0, F.lit(-1)).otherwise(F.lit(1 << 40)).alias("cut_hash"),
                              F.lit(None).cast(tie_type).alias("cut_tie")))

    wr = Window.partitionBy(*by).orderBy(hash_col, tie_col)
    pick = [*by, F.col(hash_col).alias("cut_hash"), F.col(tie_col).alias("cut_tie")]
    cached = d.persist()
    try:
        counts = counts_of(cached).persist()
        small = _collect_if_small(bound_of(counts))
        if small is not None:
            cond, need = F.lit(False), F.lit(None).cast("bigint")
            for r in small:
                key = _group_match(by, r) & (F.col("_hi") == F.lit(r["_hi"]))
                cond = cond | key
                need = F.when(key, F.lit(r["_need"])).otherwise(need)
            edge = cached.where(cond).withColumn("_need", need)
            cut = edge.withColumn("_r", F.row_number().over(wr)).where(F.col("_r") == F.col("_need")).select(*pick)
            rows = cut.collect() + ends_of(counts).collect()
            counts.unpersist()
            return rows
        counts.unpersist()
    finally:
        cached.unpersist()
    counts = counts_of(d)
    edge = null_safe_join(d, bound_of(counts), [*by, "_hi"])
    cut = edge.withColumn("_r", F.row_number().over(wr)).where(F.col("_r") == F.col("_need")).select(*pick)
    return cut.unionByName(ends_of(counts))


SMALL_GROUPS = 2000


def _collect_if_small(frame: DataFrame, limit: int = SMALL_GROUPS):
    """Rows of a per-group table when it has at most ``limit`` rows (the
    count is checked first), else None so the caller joins instead."""
    rows = frame.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def _group_match(by, row) -> Column:
    cond = F.lit(True)
    for b in by:
        v = row[b]
        cond = cond & (F.col(b).isNull() if v is None else (F.col(b) == F.lit(v)))
    return cond


def _selected(hash_c: Column, tie_c: Column, cut_h: Column, cut_t: Column) -> Column:
    return (hash_c < cut_h) | ((hash_c == cut_h) & (tie_c <= cut_t))


# ---------------------------------------------------------------- M1 inject
def injection_fraction(column: str, seed, lo: float = 0.05, hi: float = 0.10) -> float:
    return lo + (hi - lo) * py_unit_hash(seed, column, "frac")


def inject_missing(df: DataFrame, columns, row_id: str, seed="42", lo: float = 0.05, hi: float = 0.10,
                   mode: str = "exact") -> tuple[DataFrame, DataFrame]:
    """Blank a seeded share of each column (M1).  Returns (frame, positions).

    Per column the share f ~ U(lo, hi) comes from md5(seed|column|frac).
    ``exact``: the ``max(1, round_half_even(n·f))`` rows with the smallest
    md5(seed|column|row_id) — selected by :func:`smallest_k_cutoff`;
    ``threshold``: rows whose unit hash is below f (one pass, no shuffle).
    Positions are the long table (column, row_id).
    """
    cols = list(columns)
    fr = {c: injection_fraction(c, seed, lo, hi) for c in cols}
    hashes = {c: hash32(F.lit(str(seed)), F.lit(c), F.col(row_id)) for c in cols}
    if mode == "threshold":
        hit = {c: (hashes[c] / F.lit(TWO_32)) < F.lit(fr[c]) for c in cols}
    elif mode == "exact":
        long = (df.select(row_id, *[hashes[c].alias(c) for c in cols])
                  .unpivot([row_id], cols, "column", "_h"))
        frac_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(fr[c]))])
        k_of_n = lambda n: F.greatest(F.lit(1), F.bround(n * frac_map[F.col("column")], 0))
        res = smallest_k_cutoff(long, "_h", row_id, k_of_n, by="column")
        cut = {r["column"]: (r["cut_hash"], r["cut_tie"])
               for r in (res if isinstance(res, list) else res.collect())}  # one row per column
        hit = {}
        for c in cols:
            ch, ct = cut.get(c, (-1, None))
            hit[c] = _selected(hashes[c], F.col(row_id), F.lit(ch), F.lit(ct)) if ct is not None \
                else (hashes[c] <= F.lit(ch))
    else:
        raise ValueError(mode)
    out = df.withColumns({c: F.when(hit[c], F.lit(None)).otherwise(F.col(c)) for c in cols})
    flags = df.select(row_id, *[hit[c].alias(c) for c in cols])
    positions = (flags.unpivot([row_id], cols, "column", "_hit")
                      .where("_hit").select("column", row_id))
    return out, positions


def positions_report(positions: DataFrame, n_rows: int | None = None) -> DataFrame:
    """(column, na_count, pct) from a position table, by column name."""
    out = positions.groupBy("column").agg(F.count(F.lit(1)).alias("na_count"))
    if n_rows is not None:
        out = out.withColumn("pct", F.col("na_count") * 100.0 / F.lit(n_rows))
    return out.orderBy("column")


# ---------------------------------------------------------------- M2 indicators
def na_indicators(df: DataFrame, columns=None, suffix: str = "_missing") -> DataFrame:
    """Add ``<c>_missing`` (int) for each column that holds any NULL (M2).
    The list of such columns is one aggregate row (bounded by column count)."""
    cols = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).collect()[0]
    with_na = [c for c in cols if row[c] > 0]
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in with_na})


# ---------------------------------------------------------------- M3 rare levels
def merge_rare_levels(fit: DataFrame, df: DataFrame, column: str, min_count: int = 200,
                      other: str = "Other", missing: str = "Missing") -> DataFrame:
    """Levels seen fewer than ``min_count`` times in ``fit`` become ``other`` (M3).

    NULL becomes ``missing`` first and is never merged.  Levels absent from
    ``fit`` are kept as they are.  The rare list is a groupBy of the fit frame
    joined back by level (broadcast by AQE when small).
    """
    filled = F.coalesce(F.col(column).cast("string"), F.lit(missing))
    counts = (fit.select(filled.alias("_lvl")).groupBy("_lvl").agg(F.count(F.lit(1)).alias("_cnt"))
                 .where((F.col("_cnt") < min_count) & (F.col("_lvl") != missing)))
    d = df.withColumn(column, filled)
    j = d.join(counts, d[column] == counts["_lvl"], "left")
    return j.withColumn(column, F.when(F.col("_cnt").isNotNull(), F.lit(other)).otherwise(F.col(column))) \
            .drop("_lvl", "_cnt")


# ---------------------------------------------------------------- M4 / M5 one-hot
#: Levels that are made columns at most.
MAX_LEVELS = 10_000


def levels_of(df: DataFrame, column: str) -> list:
    """Sorted distinct non-NULL levels; each becomes a column, so more than ``MAX_LEVELS``
    are an error (``sparse_one_hot`` has no such bound, ``merge_rare_levels`` lowers it)."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct()
             .orderBy(column).limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels")
    return found


def one_hot(df: DataFrame, column: str, levels=None, prefix: str | None = None,
            drop_first: bool = False, keep_source: bool = False) -> DataFrame:
    """Named 0/1 int columns, one per level (M4); first sorted level dropped
    with ``drop_first`` (M5).  Unknown levels give all zeros."""
    lv = list(levels) if levels is not None else levels_of(df, column)
    if drop_first:
        lv = lv[1:]
    p = f"{prefix or column}_"
    new = {f"{p}{v}": (F.col(column) == F.lit(v)).cast("int") for v in lv}
    out = df.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in new.items()})
    return out if keep_source else out.drop(column)


def sparse_one_hot(fit: DataFrame, df: DataFrame, column: str, out: str = "ohe") -> DataFrame:
    """Vector one-hot fitted on ``fit``; unknown levels map to the zero vector
    (M6): StringIndexer(keep) gives them an extra last index, which the
    encoder's dropLast removes, so every seen level keeps a slot."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = StringIndexer(inputCol=column, outputCol=f"{out}_idx", handleInvalid="keep",
                        stringOrderType="alphabetAsc")
    enc = OneHotEncoder(inputCol=f"{out}_idx", outputCol=out, dropLast=True, handleInvalid="error")
    model = Pipeline(stages=[idx, enc]).fit(fit)
    return model.transform(df).drop(f"{out}_idx")


# ---------------------------------------------------------------- M7 simple imputation
def fit_simple_imputer(fit: DataFrame, numeric, categorical=()) -> dict:
    """Medians (exact, linear) of numeric columns and modes (most frequent,
    smallest on ties) of categorical columns, fitted on ``fit`` (M7).
    Result is one value per column."""
    from kestrel.operators.aggregates import to_long
    fills = {}
    numeric = list(numeric)
    if numeric:
        # values are counted once; what follows reads the counts, not the rows
        hist = value_histogram(to_long(fit, numeric), "value", "column").persist()
        rh = ranked_histogram(None, "value", by="column", hist=hist, bucket_by="column")
        for r in exact_quantiles(None, "value", [0.5], by="column", rh=rh).collect():
            fills[r["column"]] = r["quantile"]
        hist.unpersist()
    categorical = list(categorical)
    if categorical:
        long = to_long(fit, categorical, cast="string").where(F.col("value").isNotNull())
        hist = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = hist.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("value").alias("v"))).alias("b"))
        for r in best.collect():
            fills[r["column"]] = r["b"]["v"]
    return fills


def apply_fills(df: DataFrame, fills: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in fills.items() if v is not None})


# ---------------------------------------------------------------- M12 / M13 / M14 splits
def _attach_cut(d: DataFrame, cut, by: list) -> DataFrame:
    """Add (cut_hash, cut_tie) per group: literals when the cutoffs were
    collected (few groups), else an equi-join on the group key."""
    if not isinstance(cut, list):
        return null_safe_join(d, cut, by)
    ch, ct = F.lit(None).cast("bigint"), F.lit(None)
    for r in cut:
        m = _group_match(by, r)
        ch = F.when(m, F.lit(r["cut_hash"])).otherwise(ch)
        ct = F.when(m, F.lit(r["cut_tie"])).otherwise(ct)
    return d.withColumn("cut_hash", ch).withColumn("cut_tie", ct)


def train_test_split(df: DataFrame, row_id: str, test_size: float = 0.2, seed="42",
                     stratify: str | None = None, mode: str = "exact", out: str = "split") -> DataFrame:
    """Add ``split`` in {'train','test'} from md5(seed|split|row_id).

    ``exact``: the ⌈test_size·n⌉ smallest hashes (per class when stratified)
    are test rows — partition-independent and exactly sized.
    ``threshold``: unit hash < test_size (one pass)."""
    h = hash32(F.lit(str(seed)), F.lit("split"), F.col(row_id))
    d = df.withColumn("_h", h)
    if mode == "threshold":
        return d.withColumn(out, F.when(F.col("_h") / TWO_32 < test_size, "test").otherwise("train")).drop("_h")
    by = [stratify] if stratify else []
    cut = smallest_k_cutoff(d, "_h", row_id, lambda n: F.ceil(n * F.lit(test_size)), by=by)
    j = _attach_cut(d, cut, by)
    sel = _selected(F.col("_h"), F.col(row_id), F.col("cut_hash"), F.col("cut_tie"))
    sel = F.when(F.col("cut_tie").isNull(), F.col("_h") <= F.col("cut_hash")).otherwise(sel)
    return j.withColumn(out, F.when(sel, "test").otherwise("train")).drop("_h", "cut_hash", "cut_tie")


def _low_hashes(df: DataFrame, hashed: DataFrame, n: int, by: list[str]) -> DataFrame | None:
    """Of ``hashed(..., _h)``, which is ``df`` with hashes, the rows below a hash that leaves
    about 2 n of each group, so that what follows sorts few rows; None where there are many
    groups, all are small, or one keeps fewer than n, as when ids repeat."""
    sizes = _collect_if_small(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    if sizes is None or all(r["_n"] <= 4 * n + 100 for r in sizes):
        return None
    low = F.lit(True)
    for r in sizes:
        if r["_n"] > 4 * n + 100:
            low = F.when(_group_match(by, r), F.col("_h") < int((2 * n + 100) / r["_n"] * (1 << 32))).otherwise(low)
    few = hashed.where(low).checkpoint()
    kept = {tuple(r[b] for b in by): r["_n"] for r in few.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).collect()}  # a row a group
    return few if all(kept.get(tuple(r[b] for b in by), 0) >= min(n, r["_n"]) for r in sizes) else None


def subsample(df: DataFrame, row_id: str, n: int, seed="411", by=None) -> DataFrame:
    """n rows without replacement per group (all rows when fewer)."""
    byl = [] if by is None else ([by] if isinstance(by, str) else list(by))
    d = df.withColumn("_h", hash32(F.lit(str(seed)), F.lit("sample"), F.col(row_id)))
    few = _low_hashes(df, d, n, byl)
    d = d if few is None else few
    cut = smallest_k_cutoff(d, "_h", row_id, lambda m: F.least(m, F.lit(n)), by=byl)
    j = _attach_cut(d, cut, byl)
    sel = F.when(F.col("cut_tie").isNull(), F.col("_h") <= F.col("cut_hash")).otherwise(
        _selected(F.col("_h"), F.col(row_id), F.col("cut_hash"), F.col("cut_tie")))
    return j.where(sel).drop("_h", "cut_hash", "cut_tie")


def kfold(df: DataFrame, row_id: str, k: int = 5, seed="42", out: str = "fold", stratify: str | None = None) -> DataFrame:
    """Fold number 0..k-1: the rank by md5(seed|fold|row_id) modulo k, over all rows
    (V1) or within each class of ``stratify`` (V2), so sizes differ by one at most.

    Ranks come from counts by the upper 16 hash bits and a window inside each such
    bucket (about n / 65,536 rows), so no task ranks a whole class.
    """
    by = [stratify] if stratify else []
    d = df.withColumn("_h", hash32(F.lit(str(seed)), F.lit("fold"), F.col(row_id)))
    d = d.withColumn("_b", F.shiftright("_h", 16))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", row_id)))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.select(*by, F.shiftright(hash32(F.lit(str(seed)), F.lit("fold"), F.col(row_id)), 16).alias("_b"))
    counts = counts.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    ranked = null_safe_join(d, counts, [*by, "_b"])
    return ranked.withColumn(out, ((F.col("_o") + F.col("_r") - 1) % k).cast("int")).drop("_h", "_b", "_r", "_o")


# ---------------------------------------------------------------- M15 / J1 restore
def restore_from_reference(df: DataFrame, ref: DataFrame, keys, value: str) -> DataFrame:
    """Fill NULL ``value`` from the per-key median of a clean copy.

    Left join on the key with NULL-safe equality on every key column (a NULL
    key matches the NULL group), then ``coalesce``.  Adds ``_filled`` 0/1.
    """
    keys = list(keys)
    med = exact_quantiles(ref, value, [0.5], by=keys).select(*keys, F.col("quantile").alias("_ref"))
    j = null_safe_join(df, med, keys, "left")
    return (j.withColumn("_filled", (F.col(value).isNull() & F.col("_ref").isNotNull()).cast("int"))
             .withColumn(value, F.coalesce(F.col(value), F.col("_ref"))).drop("_ref"))


def column_bind(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Positional ``concat(axis=1)`` made explicit: inner join on the row id."""
    return left.join(right, row_id, "inner")


def round_half_even(x: float) -> int:
    return int(round(x))  # Python rounds half to even


def exact_injection_count(n: int, frac: float) -> int:
    return max(1, round_half_even(n * frac)) if n else 0

