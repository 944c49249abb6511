"""Importance resampling towards a target text set, on bytes.

A text is translated with a 256-byte table that lower-cases A-Z and turns every other
ASCII byte that is no letter or digit into a space; bytes above 127 stay, so this works on
UTF-8 as it stands, and ``split`` yields the words.  A run of one to three words is a
feature; its crc32 is found by passing the crc of the shorter run as the seed.  Counters
add up the features of a task by bucket, and Spark adds up the tasks.  A document's weight
is the sum of its features' gains (how much likelier a bucket is in the target than in the
raw texts); Gumbel noise from the document's id turns the top k into a sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import by_slices, cut
from kestrel.operators.ranking import assign_buckets

BUCKETS = 10_000
SEED = 42
MIN_WORDS, DRAWN_PERCENT = 20, 5
PIECE_BYTES = 4_000_000
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def word_runs(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in pieces of about ``PIECE_BYTES``, each with up to two
    words of the piece before it in front; their number comes second."""
    text, at, carry = text.translate(TABLE), 0, []
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else -1
        end = len(text) if end < 0 else end
        words = carry + text[at:end].split()
        yield words, len(carry)
        carry, at = words[-2:], end


def feature_hashes(words: list[bytes], old: int = 0) -> Iterator[int]:
    """crc32 of all runs of 1 to 3 words that end after the first ``old`` words."""
    tails = [b" " + w for w in words[1:]]
    one = list(map(crc32, words))
    two = list(map(crc32, tails, one))
    three = map(crc32, tails[1:], two)
    return chain(one[old:], two[max(0, old - 1):], three)


def feature_buckets(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Number of new words and the buckets of their features, piece by piece."""
    for words, old in word_runs(text):
        yield len(words) - old, np.fromiter(feature_hashes(words, old), np.int64) % buckets


def _bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all rows of ``texts(text)``: every task adds up its own
    rows, so the shuffle holds ``buckets`` rows a task and the driver gets ``buckets``."""
    def run(batches):
        counts = Counter()
        for batch in batches:
            for text in _bytes_of(batch):
                for _, at in feature_buckets(text, buckets):
                    counts.update(at.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())],
                                         names=["bucket", "n"])
    parts = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target and raw share) by bucket."""
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS longs

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            by_bucket, out = shared.value, []
            for text in _bytes_of(batch):
                n = features = weight = 0
                for new, at in feature_buckets(text, len(by_bucket)):
                    n, features, weight = n + new, features + len(at), weight + int(by_bucket[at].sum())
                out.append((n, features, weight))
            columns = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                                              names=["k", "n_words", "n_features", "weight"])
        return work
    rows = docs.select(F.col("doc_id").alias("k"), F.col("text").cast("binary").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    return (rows.mapInArrow(by_slices(make), f"k {kind}, n_words long, n_features long, weight long")
            .withColumnRenamed("k", "doc_id"))


def noise(key: str = "doc_id", seed: int = SEED) -> F.Column:
    """floor(1000 x standard Gumbel noise) from the sha256 of seed and id (null: none)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def rank_top(rows: DataFrame, k: int) -> DataFrame:
    """``rows(doc_id, score, eligible)`` with ``rank``: 1 to k for the eligible rows of
    highest score (ties to the smaller doc_id, a null id last), null for all others.

    Rows fall into ranges of scores; only ranges above the cut are ranked, each by itself,
    and a range's first rank follows from the sizes of the ranges above it.
    """
    rows = rows.withColumn("rank", F.lit(None).cast("long"))
    if k <= 0:
        return rows
    some = rows.where("eligible")
    placed = assign_buckets(rows, "score", some)
    sizes = {r["_b"]: r["count"] for r in placed.where("eligible").groupBy("_b").count().collect()}
    offsets, before = [], 0
    for b in sorted(sizes, reverse=True):
        if before < k:
            offsets.append((b, before))
        before += sizes[b]
    least = offsets[-1][0]
    first = rows.sparkSession.createDataFrame(offsets, "_b int, _first long")  # a row a range
    w = Window.partitionBy("_b").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = F.col("eligible") & (F.col("_b") >= least)
    ranked = (placed.where(top).join(F.broadcast(first), "_b")
              .withColumn("rank", F.row_number().over(w) + F.col("_first"))
              .withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))))
    return ranked.select(*rows.columns).unionByName(placed.where(~top).select(*rows.columns))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs(doc_id, text)``.

    ``target(text)`` holds the texts to come near to.  Of the rows with ``min_words`` words
    or more, ``percent`` in a hundred (rounded down) are drawn and get a rank.  Null and
    empty texts have no feature and weigh 0; repeated rows are scored alike and ranked one
    after the other; an empty target leaves only the smoothing; an empty table gives no
    rows; extra columns are left out.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = cut(weigh(docs, gain).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise(seed=seed)).alias("score"),
        (F.col("n_words") >= min_words).alias("eligible")))
    k = percent * scored.where("eligible").count() // 100
    return rank_top(scored, k).drop("eligible")
