"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a vector of radius + 1 binary digits; the mask of a
non-zero vector v holds the positions whose vector has an odd product with v.
Two fingerprints that differ in at most ``radius`` positions agree under some
mask, since those positions' vectors cannot span the whole space: each such pair
meets in some bucket (mask, fingerprint & mask), without false negatives.

Linking works on distinct fingerprints.  A bucket never lists its pairs: first
each member is compared with its bucket's neighbours in sorted order, which
joins dense groups into components; then only members of different components
are compared, all others of a bucket against its largest component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import cut, free_name, numbered
from kestrel.llm.graph import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
SLICE = 500_000  # shingles whose bits are counted at once
NEAR = 3  # sorted neighbours that a member is compared with at first


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, as a signed integer; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:len(words) - size] + 1).tolist()]
    digest, stops, ones = xxhash.xxh64_intdigest, ends[size - 1:].tolist(), np.zeros(64, np.int64)
    for at in range(0, len(stops), SLICE):
        spans = zip(starts[at:at + SLICE], stops[at:at + SLICE])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(stops), bitorder="little").view("<i8")[0])


def fingerprint_column(text: str = "text", shingle: int = SHINGLE) -> F.Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    return F.pandas_udf(run, "long")(F.col(text))


def masks(radius: int = MAX_BITS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks, as signed integers; each holds about half the bits."""
    n = 1 << (radius + 1)
    vector = [1 + i % (n - 1) for i in range(bits)]
    out = []
    for v in range(1, n):
        mask = sum(1 << i for i, m in enumerate(vector) if bin(m & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _neighbours(radius: int):
    """Over rows sorted by (t, bucket, fp): links among sorted neighbours (t = -1),
    and the members of buckets of two or more.  A bucket that a batch or
    partition cuts counts as one of several, so no member is lost."""
    names = ["t", "bucket", "a", "b"]

    def run(batches):
        for batch in batches:
            t, bucket, fp = (batch.column(i).to_numpy() for i in range(3))
            n = len(fp)
            if not n:
                continue
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1])))
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            found = []
            for x, y in [(np.arange(n), head)] + [(np.arange(k, n), np.arange(n - k)) for k in range(1, NEAR + 1)]:
                near = (head[x] == head[y]) & (x != y) & (np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= radius)
                found.append(np.stack((fp[x][near], fp[y][near]), 1))
            links = np.unique(np.concatenate(found), axis=0)
            some = (np.bincount(head, minlength=n)[head] > 1) | (head == 0) | (head == head[-1])
            none = np.zeros(len(links), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((none - 1, t[some])), pa.int32()),
                pa.array(np.concatenate((none, bucket[some]))), pa.array(np.concatenate((links[:, 0], fp[some]))),
                pa.array(np.concatenate((links[:, 1], np.zeros(int(some.sum()), np.int64))))], names=names)
    return run


def link(fingerprints: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """``fp, component``: for each distinct fingerprint of ``fingerprints(fp)`` that
    has others within ``radius`` bits, reachable by links, the smallest of them."""
    distinct = cut(fingerprints.select("fp").where(F.col("fp").isNotNull()).distinct())
    rows = distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks(radius)])).alias("t", "mask"))
    rows = rows.select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp")
    near = cut(rows.repartitionByRange("t", "bucket", "fp").sortWithinPartitions("t", "bucket", "fp")
               .mapInArrow(_neighbours(radius), "t int, bucket long, a long, b long"))
    star = cut(components(near.where("t < 0").select("a", "b")).select(F.col("node").alias("fp"), "component"))
    member = near.where("t >= 0").select("t", "bucket", F.col("a").alias("fp")).join(star, "fp", "left")
    member = cut(member.select("t", "bucket", "fp", F.coalesce("component", "fp").alias("c")))
    sizes = member.groupBy("t", "bucket", "c").agg(F.count("*").alias("n"))
    mixed = (sizes.groupBy("t", "bucket").agg(F.max_by("c", "n").alias("main"), F.count("*").alias("parts"))
             .where("parts > 1").select("t", "bucket", "main"))
    member = cut(member.join(mixed, ["t", "bucket"]))
    x = member.where("c != main").select("t", "bucket", F.col("fp").alias("fx"), F.col("c").alias("a"))
    y = member.select("t", "bucket", F.col("fp").alias("fy"), F.col("c").alias("b"))
    close = ((x["t"] == y["t"]) & (x["bucket"] == y["bucket"]) & (F.col("a") != F.col("b"))
             & (F.bit_count(F.col("fx").bitwiseXOR(F.col("fy"))) <= radius))
    more = cut(x.join(y, close).select("a", "b").distinct())
    if more.isEmpty():
        return star
    edges = more.unionByName(star.select(F.col("component").alias("a"), F.col("fp").alias("b")))
    return cut(components(edges).select(F.col("node").alias("fp"), "component"))


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` with ``group``: the fingerprint that names each row's group."""
    return rows.join(link(rows, radius), "fp", "left").withColumn("group", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, radius: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any others; equal
    fingerprints link, so repeated rows do; null ids are passed over where a
    smaller one exists; an empty table gives no rows; extra columns are left out.
    """
    rows = cut(docs.select("doc_id", fingerprint_column(shingle=shingle).alias("fp")))
    rows = cut(_grouped(rows, radius))
    lowest = cut(rows.groupBy("group").agg(F.min("doc_id").alias("component_id")))
    out = rows.join(lowest, "group")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, radius: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` per group, the one of smallest id, with all columns.

    Rows are told apart by a number, so one of several rows with one id stays; an empty
    table stays empty.
    """
    place = free_name(docs, "place")
    docs = numbered(docs, place)
    rows = cut(docs.select("doc_id", F.col(place).alias("place"), fingerprint_column(shingle=shingle).alias("fp")))
    rows = _grouped(rows, radius)
    winner = rows.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "place")).alias("w"))
    winner = cut(winner.select(F.col("w.place").alias(place)))
    return docs.join(winner, place, "left_semi").drop(place)
