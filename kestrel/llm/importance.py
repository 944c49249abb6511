"""Quality by importance resampling: hashed n-gram models and Gumbel top-k.

Words and word pairs of a text fall into ``BUCKETS`` hashed buckets.  Two bag
models are counted in Spark: the raw one over all documents, the target one
over the documents labelled good.  A document's log importance weight is the log
ratio of its probabilities under the two models, the sum over its n-grams, at a
temperature: 1 up to ``WINDOW`` n-grams, beyond that the n-grams over ``WINDOW``.  So the
errors of the bucket ratios, which a long text adds up, cannot outgrow its evidence; an
infinite window gives the plain sum.  With standard Gumbel noise added, the k highest
keys are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import WORD, by_slices, cut, texts_of

BUCKETS = 10_000
WINDOW, PRIOR = 128, 10_000
SEED = 7
CACHE_ENTRIES = 300_000


class _WordHash(dict):
    """crc32 of a lower-case word; the first ``CACHE_ENTRIES`` are kept."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        if len(self) < CACHE_ENTRIES:
            self[word] = h
        return h


_hashes = _WordHash()
_words = re.compile(WORD).findall


def ngram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each word and of each pair of neighbouring words."""
    words = _words(text.lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) ^ h[1:]) % np.uint64(buckets)
    return np.concatenate((h % np.uint64(buckets), pairs)).astype(np.int64)


def count_models(marked: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Target and raw counts by bucket over ``marked(target boolean, text)``:
    each task adds up its rows, so the driver gets ``buckets`` rows at most."""
    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for good, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                n = np.bincount(ngram_buckets(text, buckets), minlength=buckets)
                raw += n
                if good:
                    target += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])],
                                         names=["bucket", "target", "raw"])
    parts = marked.select("target", "text").mapInArrow(run, "bucket long, target long, raw long")
    target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect():
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log ratio of the two models by bucket.  The target model is drawn towards the raw one
    by ``prior`` n-grams: what the target texts never hold speaks against a text, the more
    the more target text there is, and without target text the ratio is 0."""
    p = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + prior * p) / ((target.sum() + prior) * p))


def weigh(docs: DataFrame, ratio: np.ndarray, window: float = WINDOW) -> DataFrame:
    """``doc_id, log_weight`` for each row; a text without words holds no evidence: 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS doubles

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ratios, out = shared.value, []
            for text in texts_of(batch):
                at = ngram_buckets(text, len(ratios))
                out.append(float(ratios[at].sum()) / max(1.0, len(at) / window))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["k", "log_weight"])
        return work
    rows = docs.select(F.col("doc_id").alias("k"), "text")
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(by_slices(make), f"k {kind}, log_weight double").withColumnRenamed("k", "doc_id")


def gumbel(key: str = "doc_id", seed: int = SEED) -> F.Column:
    """Standard Gumbel noise from a hash of the key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("string")), 11).cast("double") + 0.5) / 2.0 ** 53
    return -F.log(-F.log(u))


def top_k(rows: DataFrame, key: str, k: int) -> F.Column:
    """A condition that holds for the k rows of highest ``key`` (ties at the cut,
    to a millionth, all hold): two counting passes by value range, no sort."""
    if k <= 0:
        return F.lit(False)
    step = F.floor(F.col(key) * 1e6).cast("long")

    def cut_at(counts, need):
        for value, n in sorted(((r[0], r[1]) for r in counts), reverse=True):
            if need <= n:
                return value, need
            need -= n
        return None, need
    high, need = cut_at(rows.groupBy(F.shiftright(step, 16).alias("v")).count().collect(), k)
    if high is None:
        return F.lit(True)
    inner = rows.where(F.shiftright(step, 16) == high).groupBy(step.alias("v")).count()
    low, _ = cut_at(inner.collect(), need)
    return step >= low


def resample(docs: DataFrame, good: DataFrame, share: float | None = None, labelled: int | None = None,
             seed: int = SEED) -> DataFrame:
    """``doc_id, log_weight, sample_key, kept`` for each row of ``docs``.

    ``good(doc_id)`` names the target rows.  ``share`` of the rows is sampled;
    by default as large a share as ``good`` has of ``labelled`` rows; rows that tie at the
    cut all stay.  Null and empty texts weigh 0; repeated rows get equal keys; no good
    rows: the models are equal but for smoothing; an empty table gives no rows; extra
    columns are left out.
    """
    good = good.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select(
        F.coalesce("target", F.lit(False)).alias("target"), "text")
    target, raw = count_models(marked)
    scored = weigh(docs, log_ratio(target, raw))
    scored = cut(scored.withColumn("sample_key", F.col("log_weight") + gumbel(seed=seed)))
    if share is None:
        share = good.count() / labelled if labelled else 0.5
    k = round(share * scored.count())
    return scored.withColumn("kept", top_k(scored, "sample_key", k))
