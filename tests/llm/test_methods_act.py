"""Planted cases that only the operators' own methods find."""

import random

import numpy as np
import public_tokenizers as P
import pytest

from kestrel.llm import importance, pii, secrets, toxicity
from tests.llm import edges

RANKS = P.path("byte_bpe_50k.tiktoken")


def found_ids(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"] for r in pii.find(df).collect() if "id:" in r["spans"]}


def test_bootstrap_finds_bare_numbers_in_personal_frames(spark):
    rnd = random.Random(1)
    rows = [(i, f"Dear {rnd.choice('abcd')}{i}, reach us under phone +49 30 {1000000 + 7 * i} before noon.") for i in range(100)]
    rows += [(1000 + i, f"Dear {rnd.choice('abcd')}{i}, reach us under phone {7000000 + 13 * i} before noon.") for i in range(40)]
    rows += [(2000 + i, f"We shipped the order {5000000 + 17 * i} to the depot in week {i}.") for i in range(60)]
    rows += [(3000, "Write to jane at example.com before noon, says the anecdote.")]
    got = found_ids(spark, rows)
    assert len(got & set(range(1000, 1040))) >= 35 and not got & set(range(2000, 2060))


def test_bootstrap_keeps_off_contradicting_frames(spark):
    """A few phones in a frame of order numbers do not make it personal."""
    rows = [(i, f"the parcel number +49 30 {1000000 + 7 * i} was sent") for i in range(5)]
    rows += [(100 + i, f"the parcel number {5000000 + 17 * i} was sent") for i in range(200)]
    assert found_ids(spark, rows) == set()


KEY = "q7Zk2Xw9Lr4Tn8Vb3Jd6"


@pytest.mark.parametrize("before", ["configuration/service/settings/prod/", "configuration=service=settings=prod=x=",
                                    "configuration-service-settings-prod-key-"])
def test_secrets_behind_readable_text(before):
    assert len(before) >= 36 and len(KEY) == 20
    text = f"see {before}{KEY} there"
    at = 4 + len(before)
    assert any(s <= at and at + 20 <= e for _, s, e in secrets.random_spans(text, RANKS))
    assert not secrets.random_spans(f"see {before} there", RANKS)
    long = "documentation/" * 6 + KEY           # the whole run passes, its last part does not
    assert secrets.random_spans(long, RANKS) == [(secrets.FOUND, len(long) - 20, len(long))]


def test_secrets_without_digits_and_digests():
    assert secrets.random_spans("key qZkXwLrTnVbJdGfHsPmCyWqB end", RANKS)
    assert not secrets.random_spans("theInternationalConfigurationManager and Donaudampfschifffahrtsgesellschaft", RANKS)
    digest = "47DEQpj8HBSa-_TImW-5JCeuQeRkm5NMpJWZG3hSuFU"
    assert not secrets.random_spans(f"integrity sha256-{digest}= here", RANKS)
    assert secrets.random_spans(f"integrity sha256-{KEY}x here", RANKS)
    assert secrets.parts("a" * 20 + "/" + "b" * 5 + "/" + "c" * 21, "/") == [(0, 20), (27, 48)]


def test_importance_is_the_ratio_of_the_models(spark):
    """The whole operator against plain counts: weights, noise and the cut."""
    rnd = random.Random(3)
    good_words, bad_words = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choice(good_words if i % 3 else bad_words) for _ in range(rnd.choice([3, 30, 300]))), i % 3 > 0) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i, _, g in rows if g and i < 90], "doc_id long")
    out = {r["doc_id"]: r for r in importance.resample(docs, good, labelled=90).collect()}
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, t, g in rows:
        at = importance.ngram_buckets(t)
        np.add.at(raw, at, 1)
        if g and i < 90:
            np.add.at(target, at, 1)
    p = (raw + 1) / (raw.sum() + importance.BUCKETS)
    q = (target + importance.PRIOR * p) / (target.sum() + importance.PRIOR)
    for i, t, _ in rows:
        at = importance.ngram_buckets(t)
        ratio = (np.log(q[at]) - np.log(p[at])).sum()
        assert out[i]["log_weight"] == pytest.approx(ratio if len(at) <= 128 else ratio * 128 / len(at))
    keys = sorted((r["sample_key"] for r in out.values()), reverse=True)
    assert {i for i, r in out.items() if r["kept"]} == {i for i, r in out.items() if r["sample_key"] >= keys[99] - 1e-6}
    kept = [out[i]["kept"] for i, _, g in rows if g]
    assert np.mean(kept) > 0.95 and len(edges.rows()) > 3


def planted(spark):
    """A mild term: "gay" is twice as frequent in toxic texts, which all hold an insult;
    neutral mentions are rare in the learning rows."""
    rnd = random.Random(7)
    insults = [f"insult{i}" for i in range(300)]      # too many to be learnt one by one
    plain = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(900):
        toxic = int(i % 3 == 0)
        words = [rnd.choice(plain) for _ in range(6)] + ([rnd.choice(insults)] if toxic else [])
        words += ["gay"] if rnd.random() < (0.7 if toxic else 0.02) else []
        rnd.shuffle(words)
        rows.append((i, " ".join(words) + ".", toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_the_penalty_lowers_false_positives(spark):
    table = planted(spark)
    rows = toxicity.labelled_rows(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    held, plain = toxicity.fit(rows), toxicity.fit(rows, swap_penalty=0.0)
    rnd = random.Random(9)
    neutral = [" ".join([f"word{rnd.randrange(40)}" for _ in range(6)] + ["gay"]) for _ in range(200)]
    swapped = [t.replace("gay", "straight") for t in neutral]
    false = [np.mean([s >= 0.5 for s in m.score(neutral)]) for m in (held, plain)]
    assert false[1] > 0.5 and false[0] < 0.1
    assert np.abs(np.array(held.score(neutral)) - held.score(swapped)).max() < np.abs(np.array(plain.score(neutral)) - plain.score(swapped)).max()


def test_groups_are_a_parameter(spark):
    rows = toxicity.labelled_rows(spark.createDataFrame([(i, f"the zorbs {'scum' if i % 2 else 'dance'} here") for i in range(40)], "doc_id long, text string"),
                                  spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"), groups=[["zorbs", "blips"]])
    assert any(r["swaps"] for r in rows.collect())
    assert toxicity.swaps("The zorbs dance.", [["zorbs", "blips"]]) == [({"the", "zorbs", "dance"}, {"the", "blips", "dance"})]
