"""Toxicity: a classifier regularised by counterfactual identity swaps.

A logistic model over the distinct lower-cased words of a text.  Document
counts of every word by class are taken over all labelled rows in Spark; words
whose log count ratio is strong become features, scaled by that ratio, and so do all
identity terms met, whatever their ratio, as the penalty can only act on features.  The
weights minimise log loss + L2 + a counterfactual penalty: each sentence of a
labelled text that mentions an identity term is copied with the term swapped
for another of its group, and the squared change of its score is penalised, as
is the change when a term of the lexicon replaces another (or nothing) in an
otherwise equal sentence.  So a mention alone cannot move the score.

Scores read the text only; label, language, source and id are no inputs.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import cut, free_name

# fixed values: groups of identity terms; a term is swapped for others of its group
IDENTITY_GROUPS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"],
    ["black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "indigenous"],
    ["american", "mexican", "chinese", "indian", "german", "french", "spanish", "polish", "turkish", "russian"],
    ["woman", "man", "girl", "boy"],
    ["women", "men", "girls", "boys"],
    ["female", "male", "nonbinary", "transgender", "cisgender"],
    ["gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"],
    ["immigrant", "refugee", "foreigner", "migrant", "citizen"],
    ["immigrants", "refugees", "foreigners", "migrants", "citizens"],
    ["disabled", "deaf", "blind", "autistic"],
    ["old", "young", "elderly"],
    ["frauen", "männer"], ["muslime", "christen", "juden"], ["ausländer", "flüchtlinge"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["étrangers", "réfugiés"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["extranjeros", "refugiados"],
]

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: The model is fitted on at most this many labelled rows (the ones of lowest hash);
#: document counts, and so the choice of features, cover all labelled rows.
MAX_FIT_ROWS = 40_000
#: and on at most this many features, the ones of strongest evidence.
MAX_FEATURES = 20_000
MIN_COUNT, MIN_RATIO, L2, SWAP_PENALTY, ROUNDS = 3, 2.0, 1e-4, 5.0, 300


@dataclass(frozen=True)
class Model:
    """Weights by word hash, and the bias."""
    weights: dict
    bias: float

    def score(self, texts) -> list[float]:
        get, out = self.weights.get, []
        for text in texts:
            z = self.bias + math.fsum(w for w in map(get, word_hashes(text)) if w is not None)
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
        return out

    def to_json(self) -> str:
        return json.dumps({"bias": self.bias, "weights": self.weights})

    @staticmethod
    def from_json(data: str) -> Model:
        x = json.loads(data)
        return Model({int(k): w for k, w in x["weights"].items()}, x["bias"])


def swaps(text: str, groups: list[list[str]] = IDENTITY_GROUPS) -> list[tuple[set, set]]:
    """Words of each sentence that mentions an identity term, and of the same
    sentence with that term swapped for the next one of its group."""
    group_of, out = {term: group for group in groups for term in group}, []
    for sentence in _SENTENCE.findall(text.lower()):
        words = _WORD.findall(sentence)
        for term in dict.fromkeys(w for w in words if w in group_of):
            group = group_of[term]
            other = group[(group.index(term) + 1) % len(group)]
            out.append((set(words), {other if w == term else w for w in words}))
    return out


def _lexicon_swaps(groups: list[list[str]]) -> list[tuple[set, set]]:
    """Each term against the next one of its group, and against none."""
    out = []
    for group in groups:
        for a, b in zip(group, group[1:] + group[:1]):
            out += [({a}, {b}), ({a}, set())]
    return out


def _hash(word: str) -> int:
    """crc32 of a word, as a signed integer."""
    h = zlib.crc32(word.encode())
    return h - (h >> 31 << 32)


def word_hashes(text: str | None) -> set[int]:
    """The hashes of the distinct lower-case words of a text."""
    return set(map(_hash, set(_WORD.findall(text.lower())))) if text else set()


def _hash_lists(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(word_hashes(t)))


def word_table(docs: DataFrame, text: str = "text", groups: list[list[str]] = IDENTITY_GROUPS) -> DataFrame:
    """``doc_id, words, swaps``: what the classifier reads of each row; an integer for
    each distinct word, so that joins move less than the texts, and by swap the hashes
    that it takes out and brings in."""
    terms = re.compile(r"\b(?:%s)\b" % "|".join(re.escape(t) for g in groups for t in g)).search

    def swap_lists(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"gone": [_hash(w) for w in a - b], "new": [_hash(w) for w in b - a]}
                                    for a, b in swaps(t, groups)] if t and terms(t.lower()) else [])
    words = F.pandas_udf(_hash_lists, "array<int>")
    changes = F.pandas_udf(swap_lists, "array<struct<gone:array<int>,new:array<int>>>")
    return docs.select("doc_id", words(text).alias("words"), changes(text).alias("swaps"))


def fit(labelled: DataFrame, label: str = "label", max_rows: int = MAX_FIT_ROWS,
        max_features: int = MAX_FEATURES, swap_penalty: float = SWAP_PENALTY,
        groups: list[list[str]] = IDENTITY_GROUPS) -> Model:
    """Fit on ``labelled(doc_id, words, swaps, label)``; rows with a null label are left out.

    The rows fitted on are those of lowest hash of ``doc_id``, so that copies of a text
    cannot crowd out the others.  Without rows, or with one class, the model has no weights and its bias is
    the smoothed share of label 1.
    """
    rows = cut(labelled.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"), "words", "swaps"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1 = sum(n for y, n in sizes.items() if y == 1)
    n0 = sum(n for y, n in sizes.items() if y != 1)
    bias = math.log((n1 + 1) / (n0 + 1))
    if not n1 or not n0:
        return Model({}, bias)
    one, zero = F.count_if(F.col("y") == 1), F.count_if(F.col("y") != 1)
    ratio = F.log((F.col("c1") + 1) / F.lit(n1 + 2.0)) - F.log((F.col("c0") + 1) / F.lit(n0 + 2.0))
    counted = (rows.select("y", F.explode("words").alias("word")).groupBy("word")
               .agg(one.alias("c1"), zero.alias("c0")).where(F.col("c1") + F.col("c0") >= MIN_COUNT)
               .select("word", ratio.alias("ratio"), (F.col("c1") + F.col("c0")).alias("n"))
               .withColumn("term", F.col("word").isin(*{_hash(t) for g in groups for t in g}))
               .where((F.abs("ratio") >= MIN_RATIO) | F.col("term"))
               .orderBy(F.col("term").desc(), (F.abs("ratio") * F.sqrt("n")).desc(), "word").limit(max_features))
    features = {r["word"]: r["ratio"] for r in counted.select("word", "ratio").collect()}
    names = list(features)
    column = {w: i for i, w in enumerate(names)}
    scale = np.array(list(features.values()), float)

    pick = F.pandas_udf(lambda s: s.map(lambda ws: [column[w] for w in ws if w in column]), "array<int>")
    sample = rows.select("y", "h", pick("words").alias("x"), "swaps").orderBy("h", "y").limit(max_rows).collect()
    y = np.array([1.0 if r["y"] == 1 else 0.0 for r in sample])
    at = np.repeat(np.arange(len(sample)), [len(r["x"]) for r in sample])
    x = np.array([i for r in sample for i in sorted(r["x"])], int)
    moved: list[dict[int, float]] = []
    for gone, new in [([_hash(w) for w in a - b], [_hash(w) for w in b - a]) for a, b in _lexicon_swaps(groups)] + [
            (c["gone"], c["new"]) for r in sample for c in r["swaps"]]:
        moved.append({column[w]: sign for side, sign in ((gone, -1.0), (new, 1.0)) for w in side if w in column})
    moved = [m for m in moved if m]
    pair_at = np.repeat(np.arange(len(moved)), [len(m) for m in moved])
    pair_x = np.array([i for m in moved for i in m], int)
    pair_s = np.array([s for m in moved for s in m.values()])
    w = _descend(y, at, x, scale, pair_at, pair_x, pair_s, len(moved), bias, swap_penalty)
    weights = {n: float(v) for n, v in zip(names, w[:-1] * scale) if v}
    return Model(weights, float(w[-1]))


def _descend(y, at, x, scale, pair_at, pair_x, pair_s, n_pairs, bias, swap_penalty):
    """Full-batch descent with per-weight step sizes; the last weight is the bias."""
    n, p = len(y), len(scale)
    value, pair_value = scale[x], pair_s * scale[pair_x]
    w, seen = np.append(np.zeros(p), bias), np.full(p + 1, 1e-10)
    for _ in range(ROUNDS):
        z = np.bincount(at, value * w[x], minlength=n) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.append(np.bincount(x, value * e[at], minlength=p) + L2 * w[:-1], e.sum())
        if n_pairs:
            change = np.bincount(pair_at, pair_value * w[pair_x], minlength=n_pairs)
            g[:-1] += 2 * swap_penalty / n_pairs * np.bincount(pair_x, pair_value * change[pair_at], minlength=p)
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def score_column(spark: SparkSession, model: Model, text: str = "text") -> F.Column:
    """The score of a text column; the model (at most ``MAX_FEATURES`` words) is
    broadcast.  A null text scores as an empty one: the bias alone."""
    shared = spark.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts), dtype="float64")
    return F.pandas_udf(score, "double")(F.col(text))


def labelled_rows(docs: DataFrame, labels: DataFrame, target: str = "toxic",
                  groups: list[list[str]] = IDENTITY_GROUPS) -> DataFrame:
    """``doc_id, words, swaps, label`` of the rows to learn from: crc32(doc_id) mod 5 is not 0."""
    marks = (labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()
                          & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
             .groupBy("doc_id").agg(F.max(target).alias("label")))
    return word_table(docs, groups=groups).join(marks.hint("merge"), "doc_id").select("doc_id", "words", "swaps", "label")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; repeated rows are
    scored alike, an empty table gives no rows, extra columns are left out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"),
                         score_column(docs.sparkSession, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not mark, with all their columns."""
    model = fit(labelled_rows(docs, labels))
    score = free_name(docs, "score")
    return docs.withColumn(score, score_column(docs.sparkSession, model)).where(F.col(score) < 0.5).drop(score)
