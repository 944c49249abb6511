"""Ranks, cumulative counts and exact quantiles without a single-task window.

The building block is the *ranked histogram*: for each group and distinct
value, the count ``n`` and the number of smaller values ``before`` in the same
group.  It is computed as

1. ``groupBy(group, value).count()`` — map-side combined, so a hot value or a
   hot group collapses before the shuffle;
2. value buckets from ``percentile_approx`` bounds (over the raw values, or
   over the histogram when only that is given);
3. a window partitioned by (group, bucket) for the running count inside a
   bucket, and a window over the tiny (group, bucket) totals for the bucket
   offsets.

No step windows over raw rows or over a whole group, so one group holding a
third of the table is still spread over ``buckets`` tasks.  Average ranks with
ties are ``before + (n + 1) / 2``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = None  # None: follow spark.sql.shuffle.partitions (64 .. 65,536)
CASE_LIMIT = 256         # beyond this many bounds, bucket with MLlib's Bucketizer


def _auto_buckets(spark) -> int:
    try:
        sp = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        sp = 200
    return int(min(65536, max(64, sp)))


def _by(by) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL keys match each other (J1 semantics)."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    r = right
    renamed = {}
    for k in keys:
        renamed[k] = f"__r_{k}"
        r = r.withColumnRenamed(k, renamed[k])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[renamed[k]]) for k in keys])
    return left.join(r, cond, how).drop(*renamed.values())


def value_histogram(df: DataFrame, value: str, by=None, weight: str | None = None) -> DataFrame:
    """(by..., value, n): count of each non-NULL value per group."""
    by = _by(by)
    agg = F.sum(weight) if weight else F.count(F.lit(1))
    return (df.where(F.col(value).isNotNull())
              .groupBy(*by, value).agg(agg.cast("double").alias("n")))


def _bucket_bounds(hist: DataFrame, value: str, buckets: int, bucket_by: str | None = None):
    """Approximate quantiles of the histogram's values: one list, or one list
    per ``bucket_by`` level (e.g. per column of a long frame).  The number of
    values collected is buckets x levels, independent of the row count."""
    if buckets <= 1:
        return [] if bucket_by is None else {}
    fracs = [i / buckets for i in range(1, buckets)]
    q = F.percentile_approx(value, fracs, max(10000, 10 * buckets)).alias("b")
    if bucket_by is None:
        bounds = hist.agg(q).collect()[0]["b"] or []
        return sorted(set(b for b in bounds if b is not None))
    return {r[bucket_by]: sorted(set(b for b in (r["b"] or []) if b is not None))
            for r in hist.groupBy(bucket_by).agg(q).collect()}


def _search(col: Column, bounds: list, lo: int, hi: int) -> Column:
    """Number of ``bounds`` (sorted, unique) strictly below ``col``, as a
    balanced CASE tree: log2(len) comparisons, no lambda."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(col <= F.lit(bounds[mid]), _search(col, bounds, lo, mid)) \
            .otherwise(_search(col, bounds, mid + 1, hi))


def _bucket_expr(value: str, bounds, bucket_by: str | None = None) -> Column:
    v = F.col(value)
    if bucket_by is None:
        return _search(v, bounds, 0, len(bounds)) if bounds else F.lit(0)
    if not bounds:
        return F.lit(0)
    if len(bounds) <= 64:
        expr = F.lit(0)
        for k, b in bounds.items():
            if b:
                expr = F.when(F.col(bucket_by) == F.lit(k), _search(v, b, 0, len(b))).otherwise(expr)
        return expr
    m = F.create_map(*[x for k, b in bounds.items()
                       for x in (F.lit(k), F.array(*[F.lit(float(t)) for t in b]) if b
                                 else F.array().cast("array<double>"))])
    return F.coalesce(F.size(F.filter(m[F.col(bucket_by)], lambda t: t < v)), F.lit(0))


def assign_buckets(frame: DataFrame, value: str, bounds_src: DataFrame, buckets: int | None = None,
                   bucket_by: str | None = None, out: str = "_b") -> DataFrame:
    """Add a monotone value-bucket column ``out`` to ``frame``.  Bounds are
    approximate quantiles of ``bounds_src``; the bucket count follows
    ``spark.sql.shuffle.partitions`` unless given.  Up to ``CASE_LIMIT``
    bounds use a CASE binary search, beyond that MLlib's Bucketizer."""
    if buckets is None:
        buckets = _auto_buckets(frame.sparkSession)
        if bucket_by is not None:  # each level has buckets of its own: keep the expression small
            buckets = min(buckets, CASE_LIMIT)
    bounds = _bucket_bounds(bounds_src, value, buckets, bucket_by)
    if bucket_by is None and len(bounds) > CASE_LIMIT:
        # many buckets (a large cluster): a JVM binary search instead of a CASE tree
        from pyspark.ml.feature import Bucketizer
        splits = [float("-inf")] + [float(b) for b in bounds] + [float("inf")]
        h = frame.withColumn("_bv", F.col(value).cast("double"))
        h = Bucketizer(splits=splits, inputCol="_bv", outputCol="_bd", handleInvalid="keep").transform(h)
        return h.withColumn(out, F.col("_bd").cast("int")).drop("_bv", "_bd")
    return frame.withColumn(out, _bucket_expr(value, bounds, bucket_by))


def ranked_histogram(df: DataFrame, value: str, by=None, weight: str | None = None,
                     buckets: int = DEFAULT_BUCKETS, hist: DataFrame | None = None,
                     bucket_by: str | None = None) -> DataFrame:
    """(by..., value, n, before, total, rank) — exact average ranks per group.

    ``hist`` may be passed when the caller already holds the value histogram.
    ``bucket_by`` (one of ``by``) gets its own bucket bounds per level, for
    long frames whose groups live on different scales.
    """
    by = _by(by)
    # bucket bounds only shape the work, never the result: take them from the
    # raw rows when available (one scan with partial aggregation, no shuffle
    # of the histogram); a hot value merely collapses some bounds.
    src = df.where(F.col(value).isNotNull()) if df is not None else None
    if hist is None:
        hist = value_histogram(df, value, by, weight)
    h = assign_buckets(hist, value, src if src is not None else hist, buckets, bucket_by)
    w_local = (Window.partitionBy(*by, "_b").orderBy(value)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = h.withColumn("_lb", F.coalesce(F.sum("n").over(w_local), F.lit(0.0)))
    tot = h.groupBy(*by, "_b").agg(F.sum("n").alias("_bn"))
    w_off = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    tot = (tot.withColumn("_off", F.coalesce(F.sum("_bn").over(w_off), F.lit(0.0)))
              .withColumn("total", F.sum("_bn").over(w_all))
              .drop("_bn"))
    out = null_safe_join(local, tot, [*by, "_b"])
    return (out.withColumn("before", F.col("_off") + F.col("_lb"))
               .withColumn("rank", F.col("before") + (F.col("n") + 1.0) / 2.0)
               .select(*by, value, "n", "before", "total", "rank"))


def with_average_rank(df: DataFrame, value: str, by=None, rank_col: str = "rank",
                      buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Attach the average rank (ties share the mean rank) to every row.

    Rows with a NULL value get a NULL rank.  The join back to the rows is an
    equi-join on (group, value); AQE splits a hot value's partition.
    """
    by = _by(by)
    rh = (ranked_histogram(df, value, by, buckets=buckets)
          .select(*by, value, F.col("rank").alias(rank_col)))
    return null_safe_join(df, rh, [*by, value], "left")


def exact_quantiles(df: DataFrame, value: str, probs, by=None,
                    buckets: int = DEFAULT_BUCKETS, rh: DataFrame | None = None,
                    bucket_by: str | None = None) -> DataFrame:
    """(by..., prob, quantile) with linear interpolation (pandas / numpy default).

    Exact for any group size: the histogram rows that hold the positions
    ``(N-1)·q`` are picked where they stand, as each row carries its group's
    total, so one combining aggregate follows and no join.  An ungrouped column
    without values has NULL quantiles.
    """
    by = _by(by)
    if rh is None:
        rh = ranked_histogram(df, value, by, buckets=buckets, bucket_by=bucket_by)

    def at(position):
        inside = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col(value)))
    aggs, entries = [F.max("total").alias("_t")], []
    for i, p in enumerate(map(float, probs)):
        h = (F.col("total") - 1.0) * p
        aggs += [at(F.floor(h).cast("double")).alias(f"_lo{i}"), at(F.ceil(h).cast("double")).alias(f"_hi{i}")]
        h = (F.col("_t") - 1.0) * p
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        entries.append(F.struct(F.lit(p).alias("prob"), (lo + (h - F.floor(h)) * (hi - lo)).alias("quantile")))
    found = rh.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*entries)).alias("_q"))
    return found.select(*by, "_q.prob", "_q.quantile")


def exact_median(df: DataFrame, value: str, by=None, name: str = "median",
                 buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    by = _by(by)
    return (exact_quantiles(df, value, [0.5], by, buckets=buckets)
            .select(*by, F.col("quantile").alias(name)))


def running_total(df: DataFrame, order_col: str, value_col: str, out: str, by=None) -> DataFrame:
    """Cumulative sum (W4).  For small result frames (variance tables, ranks of
    components); the caller guarantees the frame is bounded (e.g. p rows)."""
    by = _by(by)
    w = Window.partitionBy(*by).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value_col).over(w))


def first_reaching(df: DataFrame, order_col: str, cum_col: str, threshold: float, by=None) -> DataFrame:
    """First position where a running sum reaches ``threshold``."""
    by = _by(by)
    return (df.where(F.col(cum_col) >= threshold)
              .groupBy(*by).agg(F.min(order_col).alias(order_col)))
