"""Toxicity, importance resampling and weak rules."""

import re

import numpy as np
from pyspark.sql import functions as F

from kestrel.llm import importance, queries, toxicity, weak_rules
from tests.conftest import SF001, SF01
from tests.llm import edges


def test_toxicity_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = queries.op2_toxicity_counterfactual(spark, SF01).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.93
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.02


def labelled(spark):
    """Most toxic rows mention "gay"; no neutral one does, so a plain fit learns the mention."""
    bad = ["idiot", "scum", "trash", "moron"]
    rows = [(i, f"you gay {bad[i % 4]} number {i}", 1) for i in range(60)]
    rows += [(100 + i, f"you are a {bad[i % 4]} of kind {i}", 1) for i in range(20)]
    rows += [(200 + i, f"the garden of house {i} is green", 0) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    return toxicity.word_table(df).join(df.select("doc_id", "label"), "doc_id")


def test_swaps_hold_identity_terms(spark):
    rows = labelled(spark)
    plain, held = toxicity.fit(rows, swap_penalty=0.0), toxicity.fit(rows, swap_penalty=50.0)
    neutral = "the gay neighbours have a garden"
    assert held.score([neutral])[0] < plain.score([neutral])[0]
    assert held.score([neutral])[0] < 0.5 < held.score(["you idiot"])[0]
    assert toxicity.Model.from_json(held.to_json()) == held
    assert toxicity.swaps("A gay man. Nothing here.")[0] == ({"a", "gay", "man"}, {"a", "lesbian", "man"})


def test_toxicity_edges(spark):
    assert toxicity.fit(labelled(spark).where("label = 1")).weights == {}
    docs, labels = edges.docs(spark), spark.createDataFrame([(3, 1, 0), (6, 0, 1), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled_rows(docs, labels))
    out = toxicity.score_documents(docs, model).collect()
    assert len(out) == len(edges.rows()) and all(0 <= r["score"] <= 1 for r in out)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() > 0
    assert toxicity.score_documents(edges.empty(spark), model).count() == 0
    none = toxicity.fit(toxicity.labelled_rows(edges.empty(spark), labels))
    assert none.weights == {} and 0 < none.score([""])[0] < 1


def test_importance_prefers_good_texts(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = queries.op4_importance_resampling(spark, SF01).join(labels, "doc_id").collect()
    kept = {q: np.mean([r["kept"] for r in rows if r["quality"] == q]) for q in (0, 1)}
    assert kept[1] > 0.9 and kept[0] < 0.2


def test_importance_counts_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)
    marked = docs.select((F.col("doc_id") % 2 == 0).alias("target"), "text")
    target, raw = importance.count_models(marked)
    want, rows = np.zeros(importance.BUCKETS, int), marked.collect()
    for r in rows:
        np.add.at(want, importance.ngram_buckets(r["text"]), 1)
    assert (raw == want).all() and target.sum() < raw.sum()
    ratio = importance.log_ratio(target, raw)
    got = {r["doc_id"]: r["log_weight"] for r in importance.weigh(docs, ratio).collect()}
    for r in docs.collect():
        at = importance.ngram_buckets(r["text"])
        assert abs(got[r["doc_id"]] - ratio[at].sum() / max(1, len(at) / importance.WINDOW)) < 1e-9


def test_top_k(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.standard_normal(500) * 30, [1.5] * 5]).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (0, 1, 17, 300, 505, 900):
        kept = sorted((r["v"] for r in df.where(importance.top_k(df, "v", k)).collect()), reverse=True)
        want = sorted(values, reverse=True)[:k]
        assert kept[:len(want)] == want and all(v == want[-1] for v in kept[len(want):])


def test_importance_edges(spark):
    good = spark.createDataFrame([(4,), (4,), (None,)], "doc_id long")
    out = importance.resample(edges.docs(spark), good, share=0.5).collect()
    assert len(out) == len(edges.rows()) and 6 <= sum(r["kept"] for r in out) < 12
    assert importance.resample(edges.empty(spark), good, labelled=4).count() == 0


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {}
    for w in windows:
        often[w] = often.get(w, 0) + 1
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def test_weak_rules_counts(spark):
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in queries.op5_weak_supervision(spark, SF001).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == slow_counts(source[r["doc_id"]])
        failed = got[0] < 50 or 100 * got[4] > 50 * got[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    ids = np.array([5, 5, 5, 5, 1, 2, 3, 1, 2, 3])
    assert weak_rules.repeated_words(ids, 6) == weak_rules.repeated_words(ids, 3_000_000) == 10


def test_weak_rules_keep_good_texts(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = queries.op5_weak_supervision(spark, SF01).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.98
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.1


def test_weak_rules_estimate_and_edges(spark):
    rng, n = np.random.default_rng(2), 4000
    truth = rng.random(n) < 0.7
    votes = np.where(rng.random((n, 5)) < [0.95, 0.9, 0.8, 0.7, 0.6], np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random((n, 5)) < 0.2] = 0
    codes = [weak_rules.encode(v) for v in votes.tolist()]
    assert weak_rules.decode(codes[0], 5) == votes[0].tolist()
    patterns = {c: codes.count(c) for c in set(codes)}
    p = weak_rules.estimate(patterns, 5)
    assert np.mean([(p[c] >= 0.5) == t for c, t in zip(codes, truth)]) > 0.9
    assert weak_rules.estimate({}) == {}
    out = weak_rules.judge(edges.docs(spark)).collect()
    assert len(out) == len(edges.rows()) and not any(r["kept"] for r in out if r["doc_id"] in (0, 1, 2))
    assert weak_rules.judge(edges.empty(spark)).count() == 0
