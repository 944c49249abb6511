"""Personal data by bootstrapped contextual extraction.

Seed entities (addresses, phone and card numbers that their form gives away)
and the words around them make a graph of patterns and instances.  Spark scores
it in rounds: known instances speak for a pattern; unknown ones count little against
it, as finding them is the aim, unless they also stand where no known one ever does.
An unknown instance is as good as the patterns it stands in.  Patterns that become
trusted mark identifiers whose form alone says too little: numbers of six
digits or more, letter-and-digit numbers, and addresses spelt with "at" and
"dot".  The seeds always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import by_slices, cut, free_name, numbered, texts_of

KINDS = ["email", "ip", "card", "phone"]
#: What the patterns find.
FOUND = "id"
ROUNDS, MIN_KNOWN, TRUST, UNKNOWN_WEIGHT = 3, 3, 0.7, 0.25

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_digit = re.compile("[0-9]").search
_ip = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_numbers = re.compile(r"(?<![\w.+-])(?:[A-Z]{1,3}-?)?[0-9](?:[\x20./-]?[0-9]){5,18}(?![\w-])").finditer
_spelt = re.compile(r"(?<!\w)[A-Za-z0-9._%+-]{1,40}(?:\x20at\x20|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]{1,40}"
                    r"(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[A-Za-z]{2,12})+").finditer
_nondigit = re.compile("[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches of an address; found from each "@", so
    a long run of letters costs no more than its length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _domain(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The seeds: ``kind, start, end`` by kind, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _digit(text):
        return out
    if "." in text:
        for m in _ip(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append(("ip", *m.span()))
    for m in _card(text):
        if m.end() - m.start() >= 16:
            digits = _nondigit.sub("", m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _phone(text):
            if 8 <= len(_nondigit.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


_left = re.compile(r"(\w+)?\W*?(\w+)[^\w\n]*\Z")
_right = re.compile(r"[^\w\n]*(\w+)")


def patterns(text: str, start: int, end: int) -> list[str]:
    """The two words before a span, and the words on both sides of it."""
    before = _left.search(text, max(0, start - 80), start)
    after = _right.match(text, end, min(len(text), end + 60))
    if not before:
        return []
    one, two, out = before.group(1), before.group(2).lower(), []
    if one:
        out.append(f"{one.lower()} {two} _")
    if after:
        out.append(f"{two} _ {after.group(1).lower()}")
    return out


def outside(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of ``found`` that touch none of ``taken``; a search each, as long
    texts have many of both."""
    taken = sorted(taken)
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))
    before = [(s, e, bisect_left(starts, e)) for s, e in found]
    return [(s, e) for s, e, n in before if not n or reach[n - 1] <= s]


def instance_of(text: str) -> str:
    """What tells an instance apart: the text in lower case, or its digest if that is shorter."""
    low = text.lower()
    return low if len(low) <= 64 else hashlib.sha256(low.encode()).hexdigest()


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans that may be identifiers and touch no seed."""
    found = [m.span() for m in _numbers(text)] if _digit(text) else []
    if " at " in text or "at)" in text or "at]" in text:
        found += [m.span() for m in _spelt(text)]
    return outside(found, [(s, e) for _, s, e in base])


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _seed_table(rows: DataFrame) -> DataFrame:
    """``place, doc_id, base, seen`` for each row of ``rows(place, doc_id, text)``: the
    seeds, and the patterns that seeds and candidates stand in."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    seen_type = pa.list_(pa.struct([("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()),
                                    ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            bases, seen = [], []
            for text in texts_of(batch):
                base = base_spans(text)
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                spots = [(True, s, e) for _, s, e in base] + [(False, s, e) for s, e in candidates(text, base)]
                seen.append([{"seed": known, "start": s, "end": e, "instance": instance_of(text[s:e]),
                              "patterns": patterns(text, s, e)} for known, s, e in spots])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bases, base_type),
                                               pa.array(seen, seen_type)], names=["place", "doc_id", "base", "seen"])
        return work
    return rows.mapInArrow(by_slices(make), f"place long, doc_id {kind}, "
                           "base array<struct<kind:string,start:long,end:long>>, "
                           "seen array<struct<seed:boolean,start:long,end:long,instance:string,patterns:array<string>>>")


def trusted_patterns(table: DataFrame, rounds: int = ROUNDS, min_known: int = MIN_KNOWN, trust: float = TRUST) -> DataFrame:
    """``pattern, trust`` of the patterns that the graph vouches for.

    An instance counts once however often it is met, so copies of a text lend no
    weight.  A pattern needs ``min_known`` known instances; its trust is their share
    among them, the instances that speak against it, ``UNKNOWN_WEIGHT`` of the other
    unknown ones, and one.  An unknown instance speaks against its patterns if another
    pattern that it stands in has ``min_known`` instances and none known.  It scores 1
    minus the product of its patterns' doubts, and counts as known at ``trust``.
    """
    spots = table.select(F.explode("seen").alias("s")).select("s.seed", "s.instance", F.explode("s.patterns").alias("pattern"))
    edges = cut(spots.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    known = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    chosen = None
    for _ in range(rounds):
        scored = cut(edges.select("pattern", "instance").join(known, "instance"))
        counted = scored.groupBy("pattern").agg(F.sum("score").alias("known"), F.count("*").alias("all"))
        strange = counted.where((F.col("known") == 0) & (F.col("all") >= min_known)).select("pattern")
        against = (scored.where("score = 0").join(strange, "pattern").select("instance").distinct()
                   .withColumn("against", F.lit(1)))
        counted = scored.join(against, "instance", "left").groupBy("pattern").agg(
            F.sum("score").alias("known"), F.count("*").alias("all"), F.count("against").alias("against"))
        rest = F.col("all") - F.col("known") - F.col("against")
        share = F.col("known") / (F.col("known") + F.col("against") + UNKNOWN_WEIGHT * rest + 1)
        chosen = cut(counted.select("pattern", "known", share.alias("trust"))
                     .where((F.col("known") >= min_known) & (F.col("trust") >= trust)).select("pattern", "trust"))
        told = (edges.join(chosen, "pattern", "left").groupBy("instance")
                .agg(F.max("seed").alias("seed"),
                     (1 - F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("trust", F.lit(0.0)), F.lit(1e-9)))))).alias("s")))
        new = cut(told.select("instance", F.when(F.col("seed"), 1.0).when(F.col("s") >= trust, F.col("s"))
                              .otherwise(0.0).alias("score")))
        known = new
    return chosen


def _spans(table: DataFrame) -> DataFrame:
    """``table`` with ``found``: the candidates in a trusted pattern, by place."""
    spots = (table.select("place", F.explode("seen").alias("s")).where("not s.seed")
             .select("place", "s.start", "s.end", F.explode("s.patterns").alias("pattern")))
    found = (spots.join(trusted_patterns(table).select("pattern"), "pattern", "left_semi")
             .select("place", "start", "end").distinct()
             .groupBy("place").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found")))
    return table.join(found, "place", "left")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row.

    Null and empty texts have no spans; repeated rows have equal ones; an empty
    table gives no rows; extra columns are left out.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text")
    table = cut(_seed_table(rows))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    one = F.array_join(F.transform("base", lambda b: F.concat_ws(":", b["kind"], b["start"].cast("string"), b["end"].cast("string"))), ",")
    more = F.array_join(F.transform("found", lambda b: F.concat_ws(":", F.lit(FOUND), b["start"].cast("string"), b["end"].cast("string"))), ",")
    out = _spans(table).select("doc_id", *counts, one.alias("base"), more.alias("more"))
    has = (F.col("more").isNotNull()) & (F.col("more") != "")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"),
                      F.when(~has, F.col("base")).when(F.col("base") == "", F.col("more"))
                      .otherwise(F.concat_ws(",", "base", "more")).alias("spans"))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span replaced by its kind in brackets; spans that overlap become one."""
    out, at, last = [], 0, -1
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start < last:
            last = max(last, end)
            at = last
            continue
        out += [text[at:start], f"[{kind}]"]
        at = last = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; the other columns stay, but
    for ``n_chars``, which follows the text.  A null text stays null; repeated rows
    are masked alike; an empty table stays empty.
    """
    place, gone = free_name(docs, "place"), free_name(docs, "spans")
    columns, docs = docs.columns, numbered(docs, place)
    rows = docs.select(F.col(place).alias("place"), "doc_id", "text")
    found = _spans(cut(_seed_table(rows)))
    extra = F.transform(F.coalesce("found", F.array().cast("array<struct<start:long,end:long>>")),
                        lambda f: F.struct(F.lit(FOUND).alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    some = (found.select(F.col("place").alias(place), F.concat("base", extra).alias(gone))
            .where(F.size(gone) > 0))

    def run(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else mask(t, [(x["kind"], x["start"], x["end"]) for x in s])
                          for t, s in zip(text, spans)], dtype="object")
    marked = docs.join(some, place, "left")
    out = marked.withColumn("text", F.when(F.col(gone).isNull(), F.col("text"))
                            .otherwise(F.pandas_udf(run, "string")(F.col("text"), F.col(gone))))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(columns)
