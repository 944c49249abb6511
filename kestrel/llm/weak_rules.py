"""Quality rules as weak supervision: rules vote or abstain, and expectation-
maximisation estimates how far each can be trusted.

Every rule votes good (1), bad (-1) or abstains (0) on a text.  The texts are
counted by vote pattern in Spark, so the estimation works on at most 3^rules
rows however many texts there are.  Given the unknown class, votes are taken as
independent; a rule has an accuracy for each class: over half on good texts, and
on bad ones enough that a "bad" vote always counts against a text.  The posterior probability of "good" replaces the usual demand
that a text pass all rules.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import BLANKS, WORD, by_slices, cut, texts_of

# fixed values: the counted symbols, and frequent words of the four languages
SYMBOLS = "#*$%&|<>"
STOP_WORDS = frozenset(
    "the and of to in is that it for was on are with as be at this have from or by an not a "
    "der die das und ist von mit den des im für nicht ein eine zu auf sich als auch es "
    "le la les de des et un une est que qui dans pour sur pas du en au par avec "
    "el los las del y que una por con para se su al lo como más en es".split())
RULES = ["length", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "stop_words",
         "distinct_words", "line_ends", "plain_words"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
EM_ROUNDS, LEAST_ACCURACY, MOST_ACCURACY, LEAST_GAIN = 200, 0.55, 0.998, 0.05

_words = re.compile(WORD).findall
_plain = re.compile(r"[^\W\d_]+[.,;:!?]?").fullmatch
_capitals = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside a 3-word window that occurs twice or more in the text."""
    if len(ids) < 4:
        return 0
    if n_distinct < 2_000_000:
        code = (ids[:-2] * n_distinct + ids[1:-1]) * n_distinct + ids[2:]
    else:  # three ids do not fit in 63 bits: number the pairs first
        pairs = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)[1]
        code = pairs[:-1] * n_distinct + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(ids), bool)
    for side in (order[1:][same], order[:-1][same]):
        for shift in range(3):
            hit[side + shift] = True
    return int(hit.sum())


def measure(text: str) -> tuple[tuple, int]:
    """The counts of a text, and its votes as a number in base 3."""
    words = _words(text)
    n = len(words)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    twice = len(lines) - len(set(lines))
    repeats = repeated_words(ids, len(number))
    counts = (n, chars, symbols, twice, repeats)
    if not n:
        return counts, encode([-1] + [0] * (len(RULES) - 1))
    capitals = len(_capitals(text)) / max(1, chars)
    often = np.bincount(ids)
    stop = sum(c for w, c in zip(number, often.tolist()) if w.rstrip(".,;:!?").lower() in STOP_WORDS) / n
    plain = sum(c for w, c in zip(number, often.tolist()) if _plain(w)) / n
    ended = sum(line.rstrip(BLANKS)[-1] in ".!?:;\"'" for line in lines) / len(lines)

    def vote(good: bool, bad: bool) -> int:
        return 1 if good else -1 if bad else 0
    per_word, size = symbols / n, chars / n
    return counts, encode([
        vote(n >= 100, n < 30), vote(3 <= size <= 9, size < 2.5 or size > 12), vote(per_word < 0.02, per_word > 0.1),
        vote(twice == 0 and len(lines) > 2, 10 * twice > 3 * len(lines)), vote(10 * repeats < n, 10 * repeats > 3 * n),
        vote(capitals < 0.15, capitals > 0.4), vote(stop > 0.1, stop < 0.02),
        vote(len(number) > 0.3 * n and n >= 30, len(number) < 0.15 * n and n >= 30), vote(ended > 0.6, ended < 0.2),
        vote(plain > 0.9, plain < 0.8)])


def encode(votes: list[int]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def decode(code: int, rules: int = len(RULES)) -> list[int]:
    out = []
    for _ in range(rules):
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


def estimate(patterns: dict[int, int], rules: int = len(RULES)) -> dict[int, float]:
    """The posterior probability of "good" for each vote pattern.

    Starts from the number of "bad" votes, each halving the odds or more.  The accuracies
    are held in bounds, which fixes which class is "good": on good texts a vote is right
    more often than not (``LEAST_ACCURACY`` to ``MOST_ACCURACY``), and on bad texts a "bad"
    vote is likelier than on good ones by ``LEAST_GAIN``.  A pattern without votes gets
    the estimated share of good texts.
    """
    if not patterns:
        return {}
    codes = list(patterns)
    votes = np.array([decode(c, rules) for c in codes])
    n = np.array([patterns[c] for c in codes], float)
    good = np.clip(0.95 - 0.45 * (votes == -1).sum(1), 0.05, 0.95)
    for _ in range(EM_ROUNDS):
        share = np.clip((n * good).sum() / n.sum(), 0.01, 0.99)
        on_good = np.clip(_accuracy(n * good, votes == 1, votes != 0), LEAST_ACCURACY, MOST_ACCURACY)
        on_bad = np.clip(_accuracy(n * (1 - good), votes == -1, votes != 0), 1 - on_good + LEAST_GAIN, MOST_ACCURACY)
        log_good, log_bad, miss_good, miss_bad = map(np.log, (on_good, on_bad, 1 - on_good, 1 - on_bad))
        z = (np.log(share) - np.log(1 - share)
             + (votes == 1) @ (log_good - miss_bad) + (votes == -1) @ (miss_good - log_bad))
        new = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(codes, new.tolist()))


def _accuracy(weight: np.ndarray, agree: np.ndarray, voted: np.ndarray) -> np.ndarray:
    """By rule: the weight of its right votes among its votes, smoothed."""
    return (weight @ agree + 1) / (weight @ voted + 2)


def votes_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five counts and ``votes`` for each row (null text: no words)."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(t) for t in texts_of(batch)]
            columns = list(zip(*(counts for counts, _ in rows)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array([v for _, v in rows], pa.int32())],
                names=["k", *names, "votes"])
        return work
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.select(F.col("doc_id").alias("k"), "text")
    kind = rows.schema["k"].dataType.simpleString()
    out = f"k {kind}, {', '.join(f'{n} long' for n in names)}, votes int"
    return rows.mapInArrow(by_slices(make), out).withColumnRenamed("k", "doc_id")


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``posterior`` (of good) for each row.

    Null and empty texts fail the base rules; repeated rows are judged alike; an
    empty table gives no rows; extra columns are left out.
    """
    rows = cut(votes_of(docs))
    patterns = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}
    posterior = estimate(patterns)
    table = docs.sparkSession.createDataFrame(list(posterior.items()), "votes int, posterior double")
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return (rows.join(F.broadcast(table), "votes", "left")  # at most 3^rules rows
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "posterior"))
